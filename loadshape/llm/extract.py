"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tokens: blocks that open and close, and text.  Streams of one host are aligned along their open
blocks: what is found at the same place of two pages is one item of the expression, what only some pages have becomes
optional, what a page has several times at one place a repeated group, and text that differs a slot.  Extraction matches
a page with its host's expression: slots and groups with text of their own are content, text that all pages share is
template; tags and class names are hints on which items are menus, adverts and the like.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.llm.common import cut, without

# fixed values
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
BOILER_TAGS = frozenset(
    "nav header footer aside form dialog menu button select option fieldset head script style noscript template textarea "
    "iframe svg title".split()
)
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs header footer comment comments disqus notice cookie cookies consent popup modal newsletter subscribe "
    "related share social widget toolbar pagination".split()
)
#: Class names with one of these say what a block has or lacks, not what it is.
HAVING = frozenset("no not with without has have is hide".split())
#: Blocks around everything, whatever their class names.
FRAMES = frozenset("html body main article".split())
MAIN_TAGS = ("article", "main")
#: Open blocks that a path names.
DEEP = 200
#: An opening tag that ends an open element of these kinds.
ENDED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
P_ENDS_AT = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)

_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile("[>\"']")


def _tag_end(page: str, at: int, lone: set[str]) -> int:
    """Position after the ``>`` that ends the tag begun before ``at``, quoted ones passed over; -1 if there is none.

    A quote that is never closed is a character like any other; ``lone`` remembers which kinds are, so that a page is
    searched for each once.
    """
    while m := _MARK.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        if m[0] not in lone:
            end = page.find(m[0], at)
            if end < 0:
                lone.add(m[0])
            else:
                at = end + 1
    return -1


def _names(attrs: str) -> list[str]:
    """Class, id and role names in lower case, their numbers left out: ``post-12 no_sidebar`` gives no-sidebar, post."""
    if "=" not in attrs:
        return []
    found = {"-".join(w for w in re.split("[^a-z]+", n) if w) for v in _NAMES.findall(attrs) for n in "".join(v).lower().split()}
    return sorted(found - {""})


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): ('open', tag, path element), ('close', tag, ''), ('text', '', characters as they stand).

    One pass from left to right: no character is looked at more than a few times, however broken the markup.  A tag that
    is never closed ends the page.
    """
    text, at, lone = 0, 0, set()
    lower = None
    while (lt := page.find("<", at)) >= 0:
        close = page.startswith("/", lt + 1)
        m = _TAG.match(page, lt + 1 + close)
        if not m:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = len(page) if end < 0 else end + 3
            elif close or page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt) + 1 or len(page)
            else:  # a character of the text
                at = lt + 1
                continue
            if lt > text:
                yield "text", "", page[text:lt]
            text = at = end
            continue
        if lt > text:
            yield "text", "", page[text:lt]
        end = _tag_end(page, m.end(), lone)
        tag = m[0].lower()
        if end < 0:
            return
        if close:
            yield "close", tag, ""
        elif tag in RAW:
            yield "open", tag, tag
            yield "close", tag, ""
            lower = page.lower() if lower is None else lower
            # lower case may change the length of a page; then its own characters are searched
            found = (lower if len(lower) == len(page) else page).find(f"</{tag}", end)
            end = len(page) if found < 0 else page.find(">", found) + 1 or len(page)
        else:
            yield "open", tag, ".".join([tag, *_names(page[m.end() : end - 1])])
        text = at = end
    if text < len(page):
        yield "text", "", page[text:]


def walk(page: str) -> Iterator[tuple[bool, str, str]]:
    """(is text, path, text) of a page: the path names the open blocks; between texts, a space where a block begins or ends.

    Ends that HTML lets out are put in, ends without a beginning left out; inline elements aren't part of a path.  Blocks
    inside more than ``DEEP`` others share the path of the outer ones, but for tags that say what main text is.
    """
    stack: list[tuple[str, str]] = []  # tag, and path with it
    opened: Counter = Counter()

    def path() -> str:
        return stack[-1][1] if stack else ""

    for kind, tag, value in tokens(page):
        if kind == "text":
            yield True, path(), value
            continue
        if tag in INLINE or tag in VOID:
            yield False, path(), " " if tag in VOID else ""
            continue
        if kind == "open":
            ends = ENDED_BY.get(tag, ()) + (("p",) if tag in P_ENDS_AT else ())
            while stack and stack[-1][0] in ends:
                opened[stack.pop()[0]] -= 1
            outer = path()
            if len(stack) < DEEP:
                inner = f"{outer}/{value}" if outer else value
            else:
                told = tag in BOILER_TAGS or tag in FRAMES
                inner = f"{outer}/{tag}" if told and tag not in outer.split("/")[DEEP:] else outer
            stack.append((tag, inner))
            opened[tag] += 1
        elif opened[tag]:
            while (last := stack.pop()[0]) != tag:
                opened[last] -= 1
            opened[tag] -= 1
        yield False, path(), " "


def text_hash(value: str) -> int:
    """Signed 64-bit hash of a text with its white space made one space."""
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Wrapper:
    """The expression of a host: per place (the path of its open blocks), in the order of first appearance, how many
    pages have it, how often one page has it at most, its characters of text, and the least and greatest hash of its
    texts (equal: a constant)."""

    pages: int = 0
    places: dict[str, list] = field(default_factory=dict)

    def align(self, other: Wrapper) -> None:
        """Generalise to cover ``other`` as well."""
        self.pages += other.pages
        for path, (n, most, chars, low, high) in other.places.items():
            mine = self.places.get(path)
            if mine is None:
                self.places[path] = [n, most, chars, low, high]
            else:
                mine[0] += n
                mine[1] = max(mine[1], most)
                mine[2] += chars
                mine[3], mine[4] = min(mine[3], low), max(mine[4], high)

    def expression(self) -> str:
        """The expression in writing: ``( place )+`` repeats, ``?`` is optional, ``#`` a slot, ``=`` a constant text."""
        out = []
        for path, (n, most, _, low, high) in self.places.items():
            item = f"{path} {'=' if low == high and self.pages > 1 else '#'}"
            out.append((f"( {item} )+" if most > 1 else item) + ("?" if n < self.pages else ""))
        return "\n".join(out)

    def boiler(self) -> set[str]:
        """Places inside a menu, header, footer, sidebar, notice, advert, form or comments.

        Tags of that kind, and class names that are such a word as a whole, always say so.  Names made up of several words,
        and forms, say so unless they hold most of the text of the pages.
        """
        held: Counter = Counter()
        for path, place in self.places.items():
            at = -1
            while (at := path.find("/", at + 1)) >= 0:
                held[path[:at]] += place[2]
            held[path] += place[2]
        total = sum(place[2] for place in self.places.values())
        out = set()
        for path in self.places:
            prefix = ""
            for element in path.split("/"):
                prefix = f"{prefix}/{element}" if prefix else element
                if _boiler(element, 2 * held[prefix] < total):
                    out.add(path)
                    break
        return out

    def main(self) -> dict[str, list[str]]:
        """Places of the main text: for pages that have one inside an article, inside a main element, and for all others.

        For the others: of the blocks whose text differs between pages, the one with the most, and those beside it that
        have a fifth as much at least, with all below them.
        """
        boiler = self.boiler()
        kept = {p: s for p, s in self.places.items() if p not in boiler}
        inside = {tag: sorted(p for p in kept if any(e.split(".")[0] == tag for e in p.split("/"))) for tag in MAIN_TAGS}
        blocks: Counter = Counter()
        for path, (_, _, chars, low, high) in kept.items():
            if low != high or self.pages == 1:
                blocks[path.rpartition("/")[0]] += chars
        most = max(blocks.values(), default=0)
        chosen = [b for b, n in blocks.items() if 5 * n >= most] if blocks else list(kept)
        below = lambda p, b: p == b or (p.startswith(b + "/") if b else "/" not in p)
        return inside | {"": sorted(p for p in kept if any(below(p, b) for b in chosen))}

    def dump(self) -> str:
        return json.dumps([self.pages, self.places])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))


def _boiler(element: str, is_part: bool) -> bool:
    tag, *names = element.split(".")
    if tag in BOILER_TAGS:
        return tag != "form" or is_part
    if tag in FRAMES:
        return False
    for name in names:
        words = name.split("-")
        if len(words) == 1 and name in BOILER_WORDS:
            return True
        if is_part and not HAVING & set(words) and BOILER_WORDS & {words[0], words[-1]}:
            return True
    return False


def wrap(page: str) -> tuple[Wrapper, set[int]]:
    """The wrapper of a single page, and the hashes of its texts outside of what is never main text."""
    places: dict[str, list] = {}
    texts: set[int] = set()
    never: dict[str, bool] = {}
    for is_text, path, text in walk(page):
        if is_text and (value := " ".join(text.split())):
            whole = text_hash(value)
            place = places.setdefault(path, [1, 0, 0, whole, whole])
            place[1] += 1
            place[2] += len(value)
            place[3], place[4] = min(place[3], whole), max(place[4], whole)
            if path not in never:
                never[path] = any(_boiler(e, False) for e in path.split("/"))
            if not never[path]:
                texts.add(whole)
    return Wrapper(1, places), texts


def main_text(page: str, places: dict[str, frozenset[str]], template: frozenset[int] = frozenset()) -> str:
    """Text at the places of the main text: references decoded, white space made one space, blocks joined by a space.

    Texts of the host's ``template`` are left out, unless they are most of what there is: then pages are alike because
    their articles are.
    """
    stream = list(walk(page))
    found = {path for is_text, path, text in stream if is_text and not text.isspace()}
    here = next((places[tag] for tag in MAIN_TAGS if found & places[tag]), places[""])

    def joined(less: frozenset[int]) -> str:
        parts = []
        for is_text, path, text in stream:
            if not is_text:
                parts.append(text)
            elif path in here and not (less and text_hash(" ".join(text.split())) in less):
                parts.append(html.unescape(text))
        return " ".join("".join(parts).split())

    whole = joined(frozenset())
    if template:
        own = joined(template)
        return own if 2 * len(own) >= len(whole) else whole
    return whole


#: Partial wrappers of a host that one task merges at a time, and hosts whose wrappers are broadcast at most.
FAN_IN, BROADCAST_HOSTS = 64, 20_000


#: Texts of a task counted at a time; and the pages, and tenths of a host's pages, that a template's text is on at least.
COUNTED, LEAST_PAGES, TENTHS = 200_000, 3, 9


def infer(pages: DataFrame, host: str, page: str) -> tuple[DataFrame, DataFrame]:
    """Per host one wrapper of all its pages (host, wrapper), and the texts of its template (host, texts).

    Every task aligns the pages it reads, host by host, and passes on a wrapper per host; those are merged up a tree,
    at most ``FAN_IN`` tasks' at a time, so a host with a third of all pages is spread like any other.  Which places
    are main text depends on sums, minima and maxima only, so the order of merging has no part in it.  Texts are counted
    by hash, once a page, with partial sums: those on nearly all pages of a host are its template.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        found: dict[str, Wrapper] = {}
        counts: Counter = Counter()

        def counted() -> pd.DataFrame:
            rows = pd.DataFrame([(h, task, None, t, n) for (h, t), n in counts.items()], columns=["host", "task", "wrapper", "text", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for h, p in zip(batch["host"], batch["page"]):
                wrapper, texts = wrap(p)
                found.setdefault(h, Wrapper()).align(wrapper)
                counts.update((h, t) for t in texts)
                if len(counts) >= COUNTED:
                    yield counted()
        if counts:
            yield counted()
        if found:
            yield pd.DataFrame({"host": list(found), "task": task, "wrapper": [w.dump() for w in found.values()], "text": None, "n": [w.pages for w in found.values()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        merged = Wrapper()
        for text in sorted(group["wrapper"]):
            merged.align(Wrapper.load(text))
        return pd.DataFrame({"host": group["host"][:1], "task": group["task"][:1] // FAN_IN, "wrapper": [merged.dump()]})

    schema = "host string, task int, wrapper string"
    rows = pages.select(F.col(host).alias("host"), F.col(page).alias("page"))
    passed = cut(rows.mapInPandas(partial, f"{schema}, text long, n long"))
    sizes = passed.where("wrapper IS NOT NULL").groupBy("host").agg(F.sum("n").alias("pages"))
    often = passed.where("text IS NOT NULL").groupBy("host", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES)
    often = often.join(sizes, "host").where(F.col("n") * 10 >= F.col("pages") * TENTHS)
    template = often.groupBy("host").agg(F.collect_list("text").alias("texts"))
    found = passed.where("wrapper IS NOT NULL").select("host", "task", "wrapper")
    most = found.agg(F.max("task")).first()[0]
    while most is not None:
        found = found.groupBy("host", F.floor(F.col("task") / FAN_IN).alias("part")).applyInPandas(lambda g: merge(g), schema)
        if most < FAN_IN:
            break
        most //= FAN_IN
        found = cut(found)
    return found.select("host", "wrapper"), template


def host_of(url: Column) -> Column:
    """Host of a url in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(df: DataFrame, url: str = "url", page: str = "html", out: str = "main_text") -> DataFrame:
    """``df`` with the main text of ``page``, by the wrapper of the page's host.

    A NULL or empty page has empty text; rows without url share the host ''.  Repeated rows are extracted each.  A page
    of any length is read in one pass whose time grows with it.  A column named ``out`` is replaced, all others kept,
    whatever their names.  An empty table gives an empty result.
    Pages aren't moved: the wrappers' places come to them, by broadcast for up to ``BROADCAST_HOSTS`` hosts and by a
    join, which Spark splits where one host has very many pages, beyond that.
    """
    kept = without(df, out).columns
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(url)).alias("host"),
        F.coalesce(F.col(page), F.lit("")).alias("page"),
    )

    @F.pandas_udf("string")
    def places(wrappers: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(Wrapper.load(w).main()) for w in wrappers], dtype=object)

    @F.pandas_udf("string")
    def texts(pages: pd.Series, chosen: pd.Series, templates: pd.Series) -> pd.Series:
        known: dict[str, dict[str, frozenset]] = {}

        def of(text: str) -> dict[str, frozenset]:
            if text not in known:
                known[text] = {k: frozenset(v) for k, v in json.loads(text).items()}
            return known[text]

        return pd.Series(
            [main_text(p, of(c), frozenset() if t is None else frozenset(t.tolist())) for p, c, t in zip(pages, chosen, templates)],
            dtype=object,
        )

    wrappers, template = infer(rows, "host", "page")
    hosts = cut(wrappers.select("host", places("wrapper").alias("places")).join(template, "host", "left"))
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    return rows.join(side, "host").select("row.*", texts("page", "places", "texts").alias(out))

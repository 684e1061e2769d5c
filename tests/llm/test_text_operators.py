"""Language ID, secret scans, decontamination and extraction against brute force, and their edge cases."""

import random
import re
import time
from collections import Counter

import pytest

from loadshape.llm import decontaminate, extract, language, secret_scan

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# language ID -------------------------------------------------------------------


def test_language_is_right_on_held_out_rows(spark, docs):
    model = language.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    rows = language.predict(docs.where("crc32(cast(doc_id as string)) % 4 = 2"), model).collect()
    assert len(rows) > 30
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_score_is_naive_bayes():
    texts = [("a", "abab ab"), ("a", "aab"), ("b", "bbbb ba"), ("b", "bcb")]
    counts = {}
    for lang, text in texts:
        for codes, spans in language._pieces([text]):
            for bucket in language._grams(codes, spans):
                for x in bucket[bucket < language.BUCKETS].tolist():
                    counts.setdefault(lang, {}).setdefault(x, 0)
                    counts[lang][x] += 1
    import numpy as np

    grams = np.full((2, language.BUCKETS), 0.5)
    for i, lang in enumerate("ab"):
        for k, n in counts[lang].items():
            grams[i, k] += n
    logp = np.zeros((2, language.BUCKETS + 1))
    logp[:, :-1] = np.log(grams / grams.sum(1, keepdims=True))
    model = language.Model(("a", "b"), np.log([0.5, 0.5]), logp)
    names, scores = language.score(["abba", "ccb", "", None, "123"], model)
    assert names[2:] == ["und"] * 3 and list(scores[2:]) == [0, 0, 0]
    want = []
    for text in ("abba", "ccb"):
        total = np.log([0.5, 0.5])
        text = f" {text} "
        n_grams = 0
        for codes, spans in language._pieces([text.strip()]):
            for bucket in language._grams(codes, spans):
                for x in bucket.tolist():
                    total = total + logp[:, x]
                    n_grams += x < language.BUCKETS
        assert n_grams == sum(len(text) - n + 1 for n in language.ORDERS)
        p = np.exp(total - total.max())
        want.append((["a", "b"][p.argmax()], (p / p.sum()).max()))
    assert [n for n, _ in want] == names[:2]
    assert scores[:2] == pytest.approx([s for _, s in want])


def test_long_texts_are_counted_whole(monkeypatch):
    text = "".join(random.Random(1).choices("abcde é", k=5000))
    whole = [b for codes, spans in language._pieces([text, "xyz"]) for b in language._grams(codes, spans)]
    monkeypatch.setattr(language, "SLICE", 64)
    cut = [b for codes, spans in language._pieces([text, "xyz"]) for b in language._grams(codes, spans)]

    def bag(parts):
        out = {}
        for p in parts:
            for x in p[p < language.BUCKETS].tolist():
                out[x] = out.get(x, 0) + 1
        return out

    assert bag(whole) == bag(cut)


def test_language_edge_cases(spark):
    rows = [(None, "abc", "x", 1), (1, None, "x", 2), (1, None, "x", 2), (2, "", None, 3), (3, "...", "y", 4), (4, "abc " * 50_000, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = language.predict(df, language.fit(df)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out) == [
        (0, "x"), (1, "und"), (1, "und"), (2, "und"), (3, "und"), (4, "x")
    ]
    none = language.fit(df.where("false"))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}
    assert language.predict(df.where("false"), none).count() == 0


# secret scans --------------------------------------------------------------------

ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets_of(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    for i, rule in enumerate(secret_scan.MORE_RULES):
        found += [(m.start(), 3 + i, rule.kind, m.end()) for m in re.finditer(rule.value, text) if len(m[0]) >= rule.least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_secrets_are_those_of_the_patterns():
    draw = random.Random(5)
    parts = [
        "password", "PassWd", "secret", "token", "api_key", "ApiKey", "AKIA", "AKIA" + "X9" * 9, "=", ":", " ", "  ", '"', "'",
        "abc123", "deadbeef" * 3, "0123456789abcdef", "é", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "aB3" * 14,
        "eyJhbGci.eyJzdWIi.sflKxwRJ_abc", "f", "K", "ſecret", ",",
    ]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 5000 + "g", "password" * 500, "token=token=secret:abc" * 300, "secret=token:abcdefgh", "token==abc", "f" * 24, ""]
    found = secret_scan.Scanner(secret_scan.RULES).texts(texts + [None])
    assert found == [secrets_of(t) for t in texts] + [[]]
    assert sum(map(len, found)) > 500


def test_automaton_is_minimal_on_a_known_language():
    nfa = secret_scan._Nfa()
    a, b = nfa.add("(ab|cb)x{2,3}")
    dfa = secret_scan.determinise(nfa, [a], [b], search=False)
    # start, after a or c, after b, xx counts 1 to 3, dead
    assert len(dfa.to) == 7
    assert secret_scan._Anchored("(ab|cb)x{2,3}", False).end(b"cbxxxx", 0, 6) == 5


def test_scan_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "", 8), (2, "token=abcdef", 9)], "doc_id long, text string, spans int")
    rows = secret_scan.scan(df).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 0, 0, 1]
    assert secret_scan.scan(df.where("false")).count() == 0


# decontamination -----------------------------------------------------------------


def distance_within(passage, text):
    """Edits between the passage and the stretch of the text that is nearest to it."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_finds_are_those_within_the_edit_budget(spark):
    draw = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    noise = [r.text[:120] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    index = decontaminate.Index.of(items, 0.1)
    found_any = 0
    for _ in range(60):
        key, passage = draw.choice(items)
        changed = list(decontaminate.normalised(passage))
        for _ in range(draw.randint(0, int(0.13 * len(changed)))):
            at = draw.randrange(len(changed))
            how = draw.random()
            if how < 0.4:
                changed[at] = draw.choice("abcxyz")
            elif how < 0.7:
                del changed[at]
            else:
                changed.insert(at, draw.choice("abc xyz"))
        text = decontaminate.normalised(f"{draw.choice(noise)} {''.join(changed)} {draw.choice(noise)}")
        item = index.keys.index(key)
        edits = distance_within(decontaminate.normalised(passage), text)
        hits = [h for h in decontaminate.search([text], index) if h[1] == item]
        assert bool(hits) == (edits <= index.budgets[item])
        for _, _, start, end, e in hits:
            assert e == edits == distance_within(decontaminate.normalised(passage), text[start:end])
        found_any += bool(hits)
    assert found_any > 20


def test_long_documents_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 500)
    passage = "the quick brown fox jumps over the lazy dog and runs away from the angry bear"
    index = decontaminate.Index.of([(1, passage)], 0.1)
    filler = "lorem ipsum dolor sit amet "
    for before in (0, 17, 18, 36, 200):
        text = filler * before + passage + " " + filler * 50
        at = len(filler) * before
        assert decontaminate.search([text], index) == [(0, 0, at, at + len(passage), 0)]


def test_decontamination_edge_cases(spark):
    passage = "seven wizards of the northern tower kept the secret for a hundred years"
    docs = spark.createDataFrame(
        [(1, f"x {passage.upper()}  y", 1), (1, f"x {passage.upper()}  y", 1), (None, passage.replace(" ", "\n"), 2), (2, None, 3), (3, "", 4), (4, "clean", 5)],
        "doc_id long, text string, start int",
    )
    bench = spark.createDataFrame([(9, passage), (10, passage), (11, None), (12, ""), (13, "short")], "item_id long, text string")
    found = decontaminate.find(docs, bench, "doc_id", "text", "item_id", "text").collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in found) == [(0, 9, 0), (0, 10, 0)] + [(1, 9, 0)] * 2 + [(1, 10, 0)] * 2
    kept = decontaminate.keep_clean(docs, bench, "text", "text")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.find(docs.where("false"), bench, "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.keep_clean(docs, bench.where("false"), "text", "text").count() == 6


def test_benchmark_in_several_rounds(spark, monkeypatch, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.find(docs, bench, "doc_id", "text", "item_id", "text").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    more = decontaminate.find(docs, bench, "doc_id", "text", "item_id", "text").collect()
    assert sorted(one) == sorted(more) and len(one) > 0


def test_passages_longer_than_a_slice_are_searched_in_pieces(spark):
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefghijklmnop", k=7)) for _ in range(90_000)]
    passage = " ".join(words)
    assert len(passage) > decontaminate.SLICE
    docs = spark.createDataFrame([(1, "so " + passage[30_000:60_000] + " it"), (2, " ".join(words[::-1][:4000]))], "d long, t string")
    items = spark.createDataFrame([(7, passage), (8, "a short passage of some words that is not there")], "i long, p string")
    found = decontaminate.find(docs, items, "d", "t", "i", "p").collect()
    assert {(r.d, r.i) for r in found} == {(1, 7)} and len(found) in (2, 3)
    assert all(r.edits == 0 and abs(r.item_chars - decontaminate.PIECE) < 200 for r in found)


# extraction ----------------------------------------------------------------------


def test_extracts_the_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for row in extract.extract(pages, out="text").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)[1]
        want = "".join(
            html.unescape(x) if not x.startswith("<") else "" if x in ("<b>", "</b>") else " "
            for x in re.split(r"(<[^>]*>)", inside)
        )
        assert row.text == " ".join(want.split())


def of_host(pages):
    """The wrapper of some pages, and the texts that its template has."""
    wrapper, counts = extract.Wrapper(), Counter()
    for p in pages:
        one, texts = extract.wrap(p)
        wrapper.align(one)
        counts.update(texts)
    often = {t for t, n in counts.items() if n >= extract.LEAST_PAGES and n * 10 >= wrapper.pages * extract.TENTHS}
    return wrapper, frozenset(often)


def texts_of(pages):
    wrapper, template = of_host(pages)
    places = {k: frozenset(v) for k, v in wrapper.main().items()}
    return [extract.main_text(p, places, template) for p in pages]


def test_wrapper_of_a_host():
    page = "<body><div class=menu>{m}</div><div id=c><h2>{t}</h2>{p}</div>{o}<div>Same foot</div></body>"
    pages = [
        page.format(
            m="Home About", t=f"Title {i}", p="".join(f"<p>Text {i} of {j} with many words in it</p>" for j in range(i % 3 + 1)),
            o="<ul><li>one</ul>" if i == 2 else "",
        )
        for i in range(6)
    ]
    wrapper, _ = of_host(pages)
    written = wrapper.expression().split("\n")
    assert "( body/div.c/p # )+" in written and "body/div.c/h2 #" in written  # a repeated group, a slot
    assert "body/div.menu =" in written and "body/div =" in written and "body/ul/li =?" in written  # constants, one optional
    assert wrapper.main()[""] == ["body/div.c/h2", "body/div.c/p"]
    other, _ = of_host(pages[::-1])
    assert other.main() == wrapper.main() and other.places == wrapper.places
    assert texts_of(pages)[4] == "Title 4 Text 4 of 0 with many words in it Text 4 of 1 with many words in it"


def test_markup_of_all_kinds():
    page = (
        "<!doctype html><header>No</header><main><article><h1>A &amp; B</h1><p>one<b>two</b>  three<p>four<br>five"
        "<script>var x='</p>no'</script><style>p{}</style><!-- no <p>no</p> --><aside>no</aside><form>no</form>"
        "<div class='share-buttons'>no</div><div class=\"comments\"><p>no</p></div><ul><li>a<li>b</ul></article></main><footer>no"
    )
    assert texts_of([page]) == ["A & B onetwo three four five a b"]


STORY = "<p>The story of day {i} goes on for a while, with words of its own {i}.</p><p>And then some more of it, {i}.</p>"


def test_names_of_frames_and_of_what_blocks_lack_are_no_hints():
    for opening, closing in (
        ("<body class='no-sidebar'>", "</body>"), ("<body><div class='content with-sidebar'>", "</div>"),
        ("<body><div id='social-post'>", "</div>"), ("<body><form action=x>", "</form>"), ("<body class=menu-open><div class=c>", "</div>"),
    ):
        pages = [f"{opening}<div class='sidebar'><p>Links {i}</p></div>{STORY.format(i=i)}{closing}" for i in range(4)]
        for i, text in enumerate(texts_of(pages)):
            assert text == f"The story of day {i} goes on for a while, with words of its own {i}. And then some more of it, {i}."


def test_pages_without_article_beside_pages_with_one():
    pages = [f"<body><article>{STORY.format(i=i)}</article></body>" for i in range(3)]
    pages.append(f"<body><nav>Menu</nav><div class=c>{STORY.format(i=9)}</div></body>")
    assert texts_of(pages)[3].startswith("The story of day 9") and texts_of(pages)[0].startswith("The story of day 0")


def test_an_article_in_two_blocks_is_whole():
    page = "<body><div class=byline>{i} May</div><div class=one><p>{a}</p></div><div class=two><p>{b}</p></div><div class=foot>Same foot</div>"
    pages = [page.format(i=i, a=f"first part {i} " * 20, b=f"second part {i} " * 15) for i in range(4)]
    want = " ".join((f"first part 2 " * 20 + f"second part 2 " * 15).split())
    assert texts_of(pages)[2] == want


def test_notices_that_all_pages_share_are_template():
    notice = "<p>Sign up today for our letter</p>"
    pages = [f"<body><article>{STORY.format(i=i)}{notice}</article></body>" for i in range(5)]
    assert all("Sign up" not in t and t.endswith(f"more of it, {i}.") for i, t in enumerate(texts_of(pages)))
    # articles that are alike as a whole stay, and two pages are not enough to tell
    same = [f"<body><p>{i}</p><article>{STORY.format(i=1)}</article></body>" for i in range(5)]
    assert all(t.startswith("The story of day 1") for t in texts_of(same))
    assert all("Sign up" in t for t in texts_of(pages[:2]))


@pytest.mark.parametrize("unit", ["<a ", "<a x=\"", "<div>", "<p><b <i '", "<!--", "<script>", "</a ", "<", "<ul><li>", "<nav>", "</div>", "<!"])
def test_broken_markup_takes_time_in_proportion(unit):
    start = time.perf_counter()
    page = "<p>kept</p>" + unit * (1_000_000 // len(unit))
    text = texts_of([page])[0]
    assert text.startswith("kept") and time.perf_counter() - start < 25


def test_quotes_that_never_close_and_tags_in_values():
    assert texts_of(["<p title=\"it's\">one</p><p title='a > b'>two</p><p data-x=\">three</p>"]) == ["one two three"]
    assert texts_of(["<p>a < b and c</p><P CLASS=x>d</P>"]) == ["a < b and c d"]
    deep = "<div>" * 5000 + "<p>in</p><nav>no</nav>" + "</div>" * 5000 + "<p>out</p>"
    assert texts_of([deep]) == ["in out"]


def test_extraction_edge_cases(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, "http://h/x", ""), (3, "http://h/y", "<p>hello &lt;world"), (3, "http://h/y", "<p>hello &lt;world"), (None, "nonsense", "text only")],
        "page_id long, url string, html string",
    )
    rows = extract.extract(df, out="text").collect()
    assert sorted((r.page_id or 0, r.text) for r in rows) == [(0, "text only"), (1, ""), (2, ""), (3, "hello <world"), (3, "hello <world")]
    assert extract.extract(df.where("false")).count() == 0


def test_bodies_that_begin_alike_are_no_template():
    greeting = "Dear readers of the evening edition, welcome back to our pages on all that happened today: "
    page = "<body><div class=byline><p>{d}</p></div><div class=c><p>{t}</p></div><div class=end><p>Same foot</p></div></body>"
    pages = [page.format(d=f"{i} May", t=greeting + f"story {i} " * 30) for i in range(4)]
    wrapper, _ = of_host(pages)
    assert len(greeting) > 64 and wrapper.main()[""] == ["body/div.c/p"]
    assert texts_of(pages)[2] == " ".join((greeting + "story 2 " * 30).split())


def test_clashing_names_and_templates_in_spark(spark):
    notice = "<p>Sign up today for our letter</p>"
    rows = [(i, "http://h/x", f"<body><article>{STORY.format(i=i)}{notice}</article></body>", "k") for i in range(12)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "page_id long, url string, html string, host string, row int, places int, texts int")
    found = extract.extract(df.repartition(5), out="text")
    assert found.columns == [*df.columns, "text"]
    assert all(r.text.endswith(f"more of it, {r.page_id}.") and r.host == "k" for r in found.collect())

"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Q = 8
#: Edits allowed per character of a passage.
EDIT_RATE = 0.1
#: Characters of passages broadcast at a time; a larger benchmark is searched for in several rounds.
BLOCK_CHARS = 4_000_000
#: Characters of text searched at a time.
SLICE = 1 << 19
#: Passages above ``SLICE`` characters are searched for in pieces of this many.
PIECE = 1 << 13
#: Not a code point: stands between texts and for what lies outside one.
BORDER = 0x110000
_FILTER_BITS = 22


def normalised(text: str | None) -> str:
    """Lower case, white space as one space."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the q-gram that begins at each code point."""
    n = max(0, len(codes) - Q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h *= np.uint64(0x100000001B3)
        h += codes[k : k + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Index:
    """Sorted q-gram hashes of the passages with where they occur, and per passage its edit budget.

    A passage of m characters with at most k edits shares at least m - q + 1 - k q of its q-grams: the least count.
    Where that would be below one, the budget is lowered until it is one.
    """

    keys: tuple
    passages: tuple[np.ndarray, ...]
    budgets: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, items: Sequence[tuple], edit_rate: float) -> Index:
        keyed = [(k, _codes(t)) for k, t in ((k, normalised(t)) for k, t in items) if len(t) >= Q]
        lengths = np.array([len(c) for _, c in keyed], np.int64)
        budgets = np.minimum((edit_rate * lengths).astype(np.int64), (lengths - Q) // Q)
        hashes = [_grams(c) for _, c in keyed]
        allh = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(keyed)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(allh, kind="stable")
        grams, first = np.unique(allh[order], return_index=True)
        member = np.zeros(1 << _FILTER_BITS, bool)
        member[grams >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(
            tuple(k for k, _ in keyed), tuple(c for _, c in keyed), budgets, lengths - Q + 1 - budgets * Q,
            grams, np.append(first, len(allh)), owner[order], place[order], member,
        )


def _align(passage: np.ndarray, text: np.ndarray, low: int, width: int, anchored: bool) -> np.ndarray:
    """Edit distances of the passage to stretches of text that end on each diagonal low, low + 1, ... of the band.

    A stretch may begin anywhere, or only at 0 where ``anchored``.  Outside of ``text`` nothing matches.
    """
    at = np.arange(width)
    padded = np.full(len(passage) + width, BORDER, np.int64)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    far = 1 << 30
    row = np.abs(at + low) if anchored else np.zeros(width, np.int64)
    if anchored:
        row = np.where(at + low < 0, far, row)
    for i, c in enumerate(passage):
        step = row + (padded[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - at) + at
    return row


def _locate(passage: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best alignment on diagonals low to high, if within budget."""
    low, width = low - budget, high - low + 2 * budget + 1
    there = text[max(0, low) : max(0, low + width + len(passage))].tobytes()
    exact = there.find(passage.tobytes())
    while exact > 0 and exact % 4:  # between two code points
        exact = there.find(passage.tobytes(), exact + 1)
    if exact >= 0:
        start = max(0, low) + exact // 4
        return start, start + len(passage), 0
    row = _align(passage, text, low, width, anchored=False)
    best = int(row.argmin())
    edits = int(row[best])
    if edits > budget:
        return None
    end = low + best + len(passage)
    back = _align(passage[::-1], text[:end][::-1], -budget, 2 * budget + 1, anchored=True)
    close = [c for c in np.argsort(np.abs(np.arange(len(back)) - budget), kind="stable") if back[c] == edits]
    start = end - (len(passage) - budget + int(close[0])) if close else end - len(passage)
    return max(0, start), min(end, len(text)), edits


def _search(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, passage, start, end, edits) in a buffer of texts that begin and end at the given places."""
    h = _grams(codes)
    at = np.flatnonzero(index.filter[h >> np.uint64(64 - _FILTER_BITS)])
    slot = np.searchsorted(index.grams, h[at])
    slot[slot == len(index.grams)] = 0
    same = index.grams[slot] == h[at]
    at, slot = at[same], slot[same]
    many = index.first[slot + 1] - index.first[slot]
    if not many.sum():
        return
    pick = np.repeat(index.first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owner, hit = index.owner[pick], np.repeat(at, many)
    doc = np.searchsorted(begins, hit, side="right") - 1
    diagonal = hit - begins[doc] - index.place[pick]
    # bands of 2 (k + 1) diagonals that overlap by half: the k + 1 an alignment can take lie in one of them
    band = diagonal // (index.budgets[owner] + 1) + (1 << 21)
    pair = doc << 42 | owner << 22
    both = np.concatenate([pair | band, pair | (band - 1)])
    order = np.argsort(both, kind="stable")
    keys, first, counts = np.unique(both[order], return_index=True, return_counts=True)
    enough = counts >= index.least[keys >> 22 & (1 << 20) - 1]
    seen: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for key, f, n in zip(keys[enough].tolist(), first[enough].tolist(), counts[enough].tolist()):
        # a q-gram that repeats makes more pairs than there are shared q-grams
        met = order[f : f + n] % len(pick)
        shared = min(len(set(index.place[pick[met]].tolist())), len(set(hit[met].tolist())))
        if shared < index.least[key >> 22 & (1 << 20) - 1]:
            continue
        doc, item, b = key >> 42, key >> 22 & (1 << 20) - 1, (key & (1 << 22) - 1) - (1 << 21)
        k = int(index.budgets[item])
        low, high = b * (k + 1), (b + 2) * (k + 1) - 1
        regions = seen.setdefault((doc, item), [])
        if any(edits == 0 and low <= start <= high for edits, start, _ in regions):
            continue
        found = _locate(index.passages[item], codes[begins[doc] : ends[doc]], low, high, k)
        if found:
            regions.append((found[2], found[0], found[1]))
    for (doc, item), regions in seen.items():
        taken: list[tuple[int, int]] = []
        for edits, start, end in sorted(regions):
            if all(end <= a or start >= z for a, z in taken):
                taken.append((start, end))
                yield doc, item, start, end, edits


def _pieces(texts: Sequence[str], reach: int) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int], list[int]]]:
    """Buffers of whole texts with borders between; a text longer than a slice in pieces that overlap by ``reach``."""
    parts: list[np.ndarray] = []
    owners, begins, ends, shifts, size = [], [], [], [], 0
    border = np.array([BORDER], "<u4")
    for i, text in enumerate(texts):
        codes = _codes(text)
        for at in range(0, max(1, len(codes) - reach), SLICE):
            piece = codes[at : at + SLICE + reach]
            if parts and size + len(piece) > SLICE:
                yield np.concatenate(parts), owners, begins, ends, shifts
                parts, owners, begins, ends, shifts, size = [], [], [], [], [], 0
            owners.append(i)
            begins.append(size)
            ends.append(size + len(piece))
            shifts.append(at)
            parts += [piece, border]
            size += len(piece) + 1
    if parts:
        yield np.concatenate(parts), owners, begins, ends, shifts


def search(texts: Sequence[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, passage, start, end, edits) of every passage found, by text; offsets in the normalised text."""
    if not index.keys:
        return []
    reach = int(max(len(p) for p in index.passages) + 4 * index.budgets.max() + 4)
    found = set()
    for codes, owners, begins, ends, shifts in _pieces([normalised(t) for t in texts], reach):
        for piece, item, start, end, edits in _search(codes, np.array(begins), np.array(ends), index):
            found.add((owners[piece], item, start + shifts[piece], end + shifts[piece], edits))
    return sorted(found)


def pieces_of(text: str) -> list[str]:
    """A long passage in pieces of about ``PIECE`` characters."""
    text = normalised(text)
    n = max(1, -(-len(text) // PIECE))
    at = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def find(
    docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str, edit_rate: float = EDIT_RATE
) -> DataFrame:
    """(key, item_key, start, end, edits, item_chars): where a benchmark passage lies in a document.

    A row says that characters start to end (exclusive) of the normalised text (lower case, white space as one space)
    are the whole passage but for ``edits`` insertions, deletions and replacements, at most ``edit_rate`` of
    its length.  A passage above ``SLICE`` characters is cut into pieces of about ``PIECE``, each a passage of its own under
    the same key.  Of overlapping finds of a passage the closest stays.  Passages below ``Q`` characters, empty and
    NULL ones aren't searched for, NULL and empty documents have no finds; repeated passages and rows are each found.

    Documents aren't moved.  The benchmark is dealt to blocks of about ``BLOCK_CHARS`` characters by a hash; each is
    broadcast as sorted q-gram hashes and searched for in a pass of its own, so memory is bounded for any benchmark.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).alias("k"), F.col(item_text).alias("t"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, piece) for k, t in zip(batch["k"], batch["t"]) for piece in pieces_of(t)]
            yield pd.DataFrame(found, columns=["k", "t"])

    long = F.coalesce(F.length("t"), F.lit(0)) > SLICE
    chars, n_long = items.agg(F.sum(F.length("t")), F.count_if(long)).first()
    if n_long:
        items = items.where(~long).unionByName(items.where(long).mapInPandas(cut_up, items.schema))
    rounds = max(1, math.ceil((chars or 0) / BLOCK_CHARS))
    kind, item_kind = (dict(d.dtypes)[k] for d, k in ((docs, key), (benchmark, item_key)))
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, start int, `end` int, edits int, item_chars int"
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = None
    for r in range(rounds):
        block = [(i["k"], i["t"]) for i in items.where(F.pmod(F.xxhash64("k", "t"), F.lit(rounds)) == r).toLocalIterator()]
        index = Index.of(block, edit_rate)
        sent = spark.sparkContext.broadcast(tuple(getattr(index, f) for f in Index.__dataclass_fields__))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(*sent.value)
            for batch in batches:
                hits = search(batch["t"].tolist(), index)
                if hits:
                    keys = batch["k"].tolist()
                    yield pd.DataFrame(
                        [(keys[d], index.keys[i], a, b, e, len(index.passages[i])) for d, i, a, b, e in hits],
                        columns=[key, item_key, "start", "end", "edits", "item_chars"],
                    )

        part = rows.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, edit_rate: float = EDIT_RATE
) -> DataFrame:
    """``docs`` without the documents in which a benchmark passage is found; columns as they are.

    Rows are judged by their text: texts with a find are few, and their hashes are taken out by an anti join, so
    neither clashing column names nor missing or repeated keys matter.
    """
    row = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    named = docs.select(row.alias("_k"), F.col(text).alias("_t"))
    items = benchmark.select(F.lit(0).alias("_i"), F.col(item_text).alias("_p"))
    dirty = find(named, items, "_k", "_t", "_i", "_p", edit_rate).select(F.col("_k").alias("dirty")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row.alias("digest"))
    return rows.join(dirty, F.col("digest") == F.col("dirty"), "left_anti").select("row.*")

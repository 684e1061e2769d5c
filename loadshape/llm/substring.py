"""Substring dedup: passages of a given number of words that an earlier document has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadshape.llm.common import cut, release, without

#: Bytes of text, and words, worked on at a time.
CHUNK = 1 << 18
#: Documents whose windows are compared at a time.
SLICE_ROWS = 2000
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: The filter of repeated grams is a bitmap of 2^16 to 2^30 bits, 16 for each gram while they last.
MIN_BITS, MAX_BITS = 16, 30


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all of them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_UP, _DOWN = ([_powers(b if up else pow(b, -1, 1 << 64), CHUNK + 1) for b in (_BASE, _SECOND)] for up in (True, False))


def _slices(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hash of values[begin:end] for each pair, from running sums; at most CHUNK values, 64 mixed bits each."""
    up, down = _UP[which], _DOWN[which]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of some bytes, and where it begins.

    A word is taken eight bytes at a time, each mixed into what came before; that is one to one for words of up to eight
    bytes of a length.  Words of more than ``LONG_WORD`` bytes have their XXH64.
    """
    data = np.frombuffer(raw + bytes(8), np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data[: len(raw)]], [True]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    length = ends - begins
    eights = np.ndarray((len(raw) + 1,), "<u8", data, strides=(1,))
    out = _mix(length.astype(np.uint64) + np.uint64(_SECOND))
    here = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(here):
        left = length[here] - at
        part = eights[begins[here] + at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[here] = _mix((out[here] ^ part) * np.uint64(_BASE) + np.uint64(at))
        at += 8
        here = here[left > 8]
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(raw[begins[i] : ends[i]])
    return out, begins


def words(raw: bytes) -> np.ndarray:
    """64-bit hash of each word (a run without ASCII white space) of a text of any length."""
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and end > at and not _SPACE[raw[end]]:  # not within a word
            end -= 1
        if end == at:  # a word longer than a chunk
            end = at + CHUNK
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
        found.append(_word_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def grams(ids: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each run of n words; ``which`` 1 is a second one, over other hashes of the words."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    ids = _mix(ids + np.uint64(_SECOND)) if which else ids
    out = []
    for at in range(0, len(ids) - n + 1, CHUNK - n + 1):
        part = ids[at : at + CHUNK]
        begins = np.arange(len(part) - n + 1)
        out.append(_slices(part, begins, begins + n, which))
    return np.concatenate(out)


def checks(ids: np.ndarray, n: int) -> np.ndarray:
    """32 bits of the second hash of each run of n words: with the first, a run has 96."""
    return (grams(ids, n, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values."""
    out, have = values, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


Hashed = tuple[np.ndarray, ...]


def _of(ids: np.ndarray, window: int, what: str) -> Hashed:
    """Per window what is asked for: its ``h``ash, its ``c``heck, its ``a``nchor - the least hash of its half-windows."""
    half = (window + 1) // 2
    kinds = {"h": np.uint64, "c": np.int32, "a": np.uint64}
    if len(ids) < window:
        return tuple(np.zeros(0, kinds[w]) for w in what)
    made = {
        "h": lambda: grams(ids, window), "c": lambda: checks(ids, window),
        "a": lambda: least_of(grams(ids, half), window - half + 1),
    }
    return tuple(made[w]() for w in what)


def _hashes(text: str | None, window: int, what: str = "hca") -> Hashed:
    return _of(words((text or "").encode("utf-8", "surrogatepass")), window, what)


def _many(texts: list[str | None], window: int, what: str = "hca") -> Iterator[Hashed]:
    """``_hashes`` of each text; short texts are worked on side by side in one buffer."""

    def together(raw: list[bytes]) -> Iterator[Hashed]:
        ids, begins = _word_hashes(b"\n".join(raw))
        owner = np.searchsorted(np.cumsum([0] + [len(x) + 1 for x in raw]), begins, side="right") - 1
        if len(ids) < window:
            yield from (_of(ids[:0], window, what) for _ in raw)
            return
        own = owner[: len(ids) - window + 1]
        whole = own == owner[window - 1 :]  # not across two texts
        parts = [x[whole] for x in _of(ids, window, what)]
        cuts = np.searchsorted(own[whole], np.arange(len(raw) + 1))
        yield from (tuple(x[i:j] for x in parts) for i, j in zip(cuts[:-1], cuts[1:]))

    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) + 1 > CHUNK:
            yield from together(held)
            held, size = [], 0
        if len(raw) + 1 > CHUNK:
            yield _of(words(raw), window, what)
        else:
            held.append(raw)
            size += len(raw) + 1
    if held:
        yield from together(held)


def _extremes(hashes: list[np.ndarray], keys: list[int], names: tuple[str, str, str]) -> pa.RecordBatch:
    """Per distinct hash of a batch the least and greatest key."""
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.array(keys, np.int64), [len(h) for h in hashes])
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(every)) - 1 if len(every) else first
    return pa.RecordBatch.from_arrays(
        [pa.array(every[first].view(np.int64)), pa.array(owner[first]), pa.array(owner[last])], names=list(names)
    )


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor): half-windows that anchor a window in documents of different keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            found = [np.unique(anchors) for (anchors,) in _many(batch.column("text").to_pylist(), window, "a")]
            yield _extremes(found, batch.column("key").to_pylist(), ("anchor", "low", "high"))

    return (
        docs.mapInArrow(run, "anchor long, low long, high long")
        .groupBy("anchor")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low < high")
        .select("anchor")
    )


def bitmap(hashes: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bitmap that has the leading bits of every hash set, and its size as a power of two.

    Its size is bounded whatever the number of hashes: a fuller bitmap lets more through, never less.
    """
    hashes = cut(hashes)
    power = min(MAX_BITS, max(MIN_BITS, (16 * hashes.count()).bit_length()))
    at = F.shiftrightunsigned(column, 64 - power)
    parts = (
        hashes.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767).cast("long")).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(1 << power, bool) if power < 15 else np.zeros((1 << power) // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    release(hashes)
    return out, power


def _is_set(bits: np.ndarray, power: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - power)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _distinct(hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((check, hashes))
    hashes, check = hashes[order], check[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])
    return hashes[new], check[new]


def _candidates(texts: list[str | None], window: int, filtered: tuple[np.ndarray, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the distinct windows, by hash and check, whose anchor passes the filter."""
    out = []
    for hashes, check, anchors in _many(texts, window):
        met = _is_set(*filtered, anchors)
        out.append(_distinct(hashes[met], check[met]))
    return out


def _among(hashes: np.ndarray, check: np.ndarray, of: np.ndarray, of_check: np.ndarray) -> np.ndarray:
    """Which windows are among those of ``of``, by hash and check."""
    of, of_check = _distinct(of, of_check)
    out = np.zeros(len(hashes), bool)
    low, high = np.searchsorted(of, hashes, "left"), np.searchsorted(of, hashes, "right")
    for k in range(int((high - low).max(initial=0))):  # more than one step only if two windows share the first hash
        there = low + k < high
        out[there] |= of_check[(low + k)[there]] == check[there]
    return out


def earlier_windows(docs: DataFrame, window: int, sent) -> DataFrame:
    """(key, earlier, checks): per document the hashes and checks of its windows that a document with a smaller key has too.

    Equal windows have equal anchors, so only windows whose anchor passes the broadcast filter ``sent`` are looked
    at.  Of the documents of a batch that share a window all but the smallest key have an earlier one
    already; only that one is sent on, to be compared with the smallest of other batches.  So a passage
    that a third of all documents share costs a row per batch, not one per document.
    """

    def split(smallest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
                found = _candidates(batch.column("text").to_pylist(), window, sent.value)
                every = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
                check = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int32)
                owner = np.repeat(np.array(batch.column("key").to_pylist(), np.int64), [len(h) for h, _ in found])
                del found
                order = np.lexsort((owner, check, every))
                every, check, owner = every[order], check[order], owner[order]
                first = np.concatenate([[True], (every[1:] != every[:-1]) | (check[1:] != check[:-1])])[: len(every)]
                least = owner[first][np.cumsum(first) - 1] if len(every) else owner
                pick = np.flatnonzero(first if smallest else owner > least)
                pick = pick[np.argsort(owner[pick], kind="stable")]  # runs of one key take less room in the shuffle
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[pick].view(np.int64)), pa.array(check[pick]), pa.array(owner[pick])], names=["hash", "check", "key"]
                )

        return docs.mapInArrow(run, "hash long, check int, key long")

    across = split(smallest=True).withColumn("low", F.min("key").over(Window.partitionBy("hash", "check")))
    met = across.where("low < key").select("hash", "check", "key").unionByName(split(smallest=False))
    found = met.groupBy("key").agg(F.collect_set(F.struct("hash", "check")).alias("w"))
    return found.select("key", F.col("w.hash").alias("earlier"), F.col("w.check").alias("checks"))


def remove_repeats(df: DataFrame, key: str, text: str = "text", window: int = 50) -> DataFrame:
    """``df`` with ``kept`` (the words that stay, joined by a space), ``n_words`` and ``removed``, an array of
    (start, end) word ranges.

    A window is ``window`` consecutive words (runs without ASCII white space), compared through 96 bits of two hashes over
    64-bit hashes of the words.  Words covered by a window that also starts in a document with a smaller ``key`` are removed; windows
    are judged on the input.  The ranges are the maximal runs of such words.  ``key`` is an integer; rows without key
    lose no word and cost no other row one.  Rows that share a key are judged alike.  NULL and empty texts have
    no words.  Columns of the names added are replaced, all others kept.
    """
    rows = without(df, "kept", "n_words", "removed", "_earlier", "_checks", "_of")
    keyed = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    # documents without a window whose anchor repeats lose nothing and need not meet the others
    sent = df.sparkSession.sparkContext.broadcast(bitmap(repeated_anchors(keyed, window), "anchor"))
    earlier = earlier_windows(keyed, window, sent).select(
        F.col("key").alias("_of"), F.col("earlier").alias("_earlier"), F.col("checks").alias("_checks")
    )

    @F.pandas_udf("kept string, n_words long, removed array<struct<start:long,end:long>>")
    def trimmed(texts: pd.Series, found: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = []
        for text, hashes, check in zip(texts, found, marks):
            raw = (text or "").encode("utf-8", "surrogatepass")
            parts = raw.split()
            ranges: list[dict[str, int]] = []
            if hashes is not None and len(hashes):
                own, own_check = _hashes(text, window, "hc")
                steps = np.zeros(len(parts) + 1, np.int64)
                of = np.asarray(hashes, np.int64).view(np.uint64), np.asarray(check, np.int32)
                begins = np.flatnonzero(_among(own, own_check, *of))
                np.add.at(steps, begins, 1)
                np.add.at(steps, begins + window, -1)
                covered = np.concatenate([[0], (np.cumsum(steps[:-1]) > 0).astype(np.int8), [0]])
                edges = np.flatnonzero(np.diff(covered)).reshape(-1, 2).tolist()
                ranges = [{"start": a, "end": b} for a, b in edges]
                stay, at = [], 0
                for a, b in edges:
                    stay += parts[at:a]
                    at = b
                kept = stay + parts[at:]
            else:
                kept = parts
            out.append((b" ".join(kept).decode("utf-8", "surrogatepass"), len(parts), ranges))
        return pd.DataFrame(out, columns=["kept", "n_words", "removed"])

    @F.pandas_udf("boolean")
    def shares(texts: pd.Series) -> pd.Series:
        return pd.Series([_is_set(*sent.value, anchors).any() for (anchors,) in _many(texts.tolist(), window, "a")], dtype="bool")

    names = rows.columns
    meeting = rows.where(shares(F.col(text))).join(earlier, F.col(key).cast("long") == F.col("_of"), "left").drop("_of")
    meeting = meeting.withColumn("_trimmed", trimmed(F.col(text), F.col("_earlier"), F.col("_checks"))).select(*names, "_trimmed.*")
    held = F.coalesce(F.col(text), F.lit(""))
    alone = rows.where(~shares(F.col(text))).select(
        *names,
        F.trim(F.regexp_replace(held, r"[\x20\x09-\x0D]+", " ")).alias("kept"),
        F.regexp_count(held, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("removed"),
    )
    return meeting.unionByName(alone)

"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape.llm.common import without

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: The matrix of log probabilities is broadcast: at most so many languages, of half a megabyte each.
MAX_LANGUAGES = 256
#: Characters counted or scored at a time.
SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def _pieces(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Code points of lowered, space-padded texts, in slices; per slice (text, begin, own end) of each piece.

    A text longer than a slice is cut; a piece carries the few code points that its last n-grams need.
    """
    ahead = max(ORDERS) - 1
    parts: list[str] = []
    spans: list[tuple[int, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        for at in range(0, len(text), SLICE):
            piece = text[at : at + SLICE + ahead]
            if parts and size + len(piece) > SLICE:
                yield np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4"), spans
                parts, spans, size = [], [], 0
            spans.append((i, size, size + min(len(piece), SLICE)))
            parts.append(piece)
            size += len(piece)
    if parts:
        yield np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4"), spans


def _grams(codes: np.ndarray, spans: list[tuple[int, int, int]]) -> Iterator[np.ndarray]:
    """Per order, the bucket of the n-gram that begins at each code point; BUCKETS where none does."""
    begins = np.array([a for _, a, _ in spans] + [len(codes)])
    own = np.array([b for _, _, b in spans])
    ids = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        # the hash of an n-gram extends that of its first n - 1 code points
        ids[: len(codes) - n + 1] = ids[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n not in ORDERS:
            continue
        mixed = (ids ^ (ids >> np.uint32(15))) * np.uint32(0x9E3779B1)
        bucket = (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
        for back in range(1, max(ORDERS) + 1):  # those that would reach into the next text, and the code points ahead
            at = begins[1:] - back
            none = (at >= own) | (at + n > begins[1:])
            bucket[at[none & (at >= begins[:-1])]] = BUCKETS
        yield bucket


@dataclass(frozen=True)
class Model:
    """Languages in order, and per language the log probability of each bucket (the last is for no n-gram)."""

    languages: tuple[str, ...]
    prior: np.ndarray
    logp: np.ndarray


def _counted(lang: str, text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for name, n in totals.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": name, "bucket": at, "n": n[at]})
            totals.clear()

        for batch in batches:
            for name, own in batch.groupby(lang):
                n = totals.setdefault(name, np.zeros(BUCKETS + 2, np.int64))
                n[BUCKETS + 1] += len(own)
                for codes, spans in _pieces(own[text].tolist()):
                    for bucket in _grams(codes, spans):
                        n[: BUCKETS + 1] += np.bincount(bucket, minlength=BUCKETS + 1)
            if len(totals) > MAX_LANGUAGES:
                yield from rows()
        yield from rows()

    return run


def fit(df: DataFrame, lang: str = "lang", text: str = "text", smoothing: float = 0.5) -> Model:
    """A model of all rows with non-NULL ``lang`` and ``text``.

    Every task adds up its n-gram counts and passes on one row per language and bucket it has met; Spark sums
    them.  What comes to the driver is bounded by ``MAX_LANGUAGES`` times ``BUCKETS`` counts; more languages
    are refused.  Without rows the model knows no language and predicts ``und``.
    """
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counts = (
        rows.mapInPandas(_counted("lang", "text"), "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    names = counts.where(F.col("bucket") == BUCKETS + 1).select("lang").limit(MAX_LANGUAGES + 1)
    counts = counts.persist()
    try:
        languages = tuple(sorted(r[0] for r in names.collect()))
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        table = counts.toPandas()
    finally:
        counts.unpersist()
    n = np.zeros((len(languages), BUCKETS + 2))
    n[np.searchsorted(languages, table["lang"].to_numpy(str)) if len(table) else [], table["bucket"]] = table["n"]
    docs, grams = n[:, BUCKETS + 1], n[:, :BUCKETS] + smoothing
    logp = np.zeros((len(languages), BUCKETS + 1))
    logp[:, :BUCKETS] = np.log(grams) - np.log(grams.sum(axis=1, keepdims=True))
    return Model(languages, np.log(docs / docs.sum()) if len(docs) else docs, logp)


def score(texts: Sequence[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability per text."""
    sums = np.tile(model.prior, (len(texts), 1))
    for codes, spans in _pieces([t or "" for t in texts]):
        owner = np.array([i for i, _, _ in spans])
        begins = np.array([a for _, a, _ in spans])
        for bucket in _grams(codes, spans):
            for k, logp in enumerate(model.logp):
                np.add.at(sums[:, k], owner, np.add.reduceat(logp[bucket], begins))
    known = np.array([t is not None and bool(_LETTER.search(t)) for t in texts], bool)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = sums.argmax(axis=1)
    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, share, 0.0)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the posterior probability of that language.

    The model is broadcast; its size is bounded by ``MAX_LANGUAGES``.  A text that is NULL or has no letter is
    ``und`` with score 0; of languages that tie, the first by name is taken.  Columns of these names are
    replaced, all others kept.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.logp))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Model(*sent.value)
        for texts in batches:
            names, scores = score(texts.tolist(), known)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    out = without(df, "lang_pred", "score")
    return out.withColumn("_predicted", predicted(F.col(text))).select(
        *[out[c] for c in out.columns], "_predicted.lang_pred", "_predicted.score"
    )

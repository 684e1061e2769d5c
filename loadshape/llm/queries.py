"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.llm import (
    decontaminate, exact, extract, language, metric_join, mixing, negatives, secret_scan, sharding, simhash, substring, warc,
    whitening,
)
from loadshape.llm.common import cut, shared_path

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """A quarter of the rows, by doc_id; a NULL doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


@query
def op1_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.fit(docs.where(~held_out()), "lang", "text")
    return language.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, "text").drop("text")


def of_kinds(spans: str, *kinds: str):
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def spans_text(spans: str, kinds: tuple[str, ...] | None = None):
    """Spans as kind:start:end, comma-joined; of some kinds only, where given."""
    chosen = F.col(spans) if kinds is None else of_kinds(spans, *kinds)
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(chosen, one))


@query
def op2_secret_scan(spark, sf):
    base = tuple(r.kind for r in secret_scan.BASE_RULES)
    found = secret_scan.scan(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return found.select(
        "doc_id",
        *[F.size(of_kinds("spans", k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(spans_text("spans", base), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
    )


@query
def op3_warc(spark, sf):
    plan = warc.plan_records(table(spark, sf, "pages"), "page_id", "url", "html")
    record = warc.record_text(*[F.col(c) for c in ("key", "url", "payload", "digest", "refers_to")])
    raw, target = shared_path(spark, "warc-raw"), shared_path(spark, "warc")
    warc.write_monolithic(plan.select(record), raw)
    warc.normalise(spark, raw, target)
    return warc.resolve_revisits(cut(warc.read_archives(spark, f"{target}/archives"))).select(
        F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op4_decontamination(spark, sf):
    return decontaminate.find(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text"
    )


@query
def op5_sharding(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("copies"),
    )
    placed = sharding.assign_shards(docs, F.col("size"), F.col("copies"), F.col("doc_id"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op7_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", mixing.count_tokens("text").alias("n"))
    mixed = mixing.mix(docs, "source", F.col("n"), F.col("doc_id"), max_repetition=2.0, block_tokens=1 << 16)
    return mixed.select("doc_id", "source", "epoch", "block", "block_rank", "tokens")


@query
def op6_html_extraction(spark, sf):
    found = extract.extract(table(spark, sf, "pages"), "url", "html", "text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_exact_dedup(spark, sf):
    found = exact.deduplicate_files(spark, f"{sf}/documents.parquet", "doc_id", "text")
    return found.select(
        "doc_id", F.col("keep").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query
def op9_substring_dedup(spark, sf):
    found = substring.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 50)
    covered = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_words", covered.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"), "doc_id", "text", 3, 3)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query
def op11_embedding_whitening(spark, sf):
    found = whitening.whiten(table(spark, sf, "embeddings"), "vec_id", "embedding", scale=1024, offset=100_000, components=8)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op12_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(
        table(spark, sf, "embeddings"), "vec_id", label, "embedding", F.col("vec_id") % 50 == 0, positives=5, negatives=3,
        scale=256, lowest=50, highest=95,
    )


@query
def op13_embedding_near_dedup(spark, sf):
    return metric_join.near_duplicates(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", similarity=0.93)

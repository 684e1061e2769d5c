"""WARC, sharding, mixing, copies, near copies and repeated passages against brute force, and their edge cases."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loadshape.llm import exact, mixing, sharding, simhash, substring, warc
from loadshape.llm.common import components, cut, shared_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# components ----------------------------------------------------------------------


def roots_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_of_chains_hubs_and_loops(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    edges += [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(150)]
    draw.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == roots_of([(a, b) for a, b in edges if a is not None and a != b])
    assert components(df.where("false")).count() == 0


# SimHash -------------------------------------------------------------------------


def test_near_duplicates_are_the_components_of_close_fingerprints(spark):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = set(base.tolist())
    for x in base[:25].tolist():  # clouds of many near prints, and pairs at 3 and 4 bits
        for _ in range(12):
            y = x
            for b in draw.choice(64, draw.integers(1, 5), replace=False):
                y ^= 1 << int(b)
            prints.add(y - (1 << 64) if y >= 1 << 63 else y)
    prints = sorted(prints)
    array = np.array(prints, np.int64).view(np.uint64)
    want = [(prints[i], prints[j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3) if i < j]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df).collect()]
    assert {frozenset(x) for x in got} <= {frozenset(x) for x in want}
    assert roots_of(got) == roots_of(want) and len(want) > 300


def simple_fingerprint(text, n):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(found[i : i + n]).encode(), 42) for i in range(max(1, len(found) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_edge_cases(spark):
    texts = ["A b  c\td", "É E É", "one", None, "", "a b c d " * 30_000, "x y z"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)] + [(3, None, 1)], "doc_id long, text string, fp int")
    rows = simhash.near_duplicates(df, "doc_id").collect()
    want = Counter((i if i else None, simple_fingerprint(t, 3)) for i, t in enumerate(texts)) + Counter([(3, 0)])
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in rows) == want
    assert {r.component for r in rows if r.fp == 0} == {3}
    assert simhash.near_duplicates(df.where("false"), "doc_id").count() == 0
    assert simhash.fingerprints(df).columns == ["doc_id", "text", "fp"]


def test_deduplicate_keeps_one_of_each_group(spark):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(400)]
    texts = [" ".join(draw.choices(vocabulary, k=300)) for _ in range(6)]
    near = texts[0] + " tail"
    rows = [(7, texts[0], "x"), (3, texts[0], "y"), (9, near, "z"), (None, texts[0], "n")]
    rows += [(20 + i, t, "s") for i, t in enumerate(texts[1:])] + [(30, None, "e"), (31, "", "e"), (5, texts[5], "r"), (5, texts[5], "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest string")
    kept = simhash.deduplicate(df.withColumnRenamed("_digest", "note"), "doc_id")
    assert kept.columns == ["doc_id", "text", "note"]
    distance = bin(simple_fingerprint(texts[0], 3) ^ simple_fingerprint(near, 3)).count("1")
    want = {3, 5, 20, 21, 22, 23, 30} | ({9} if distance > 3 else set())
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert simhash.deduplicate(df.where("false"), "doc_id").count() == 0


def test_texts_that_share_a_fingerprint_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *a: df.withColumn("fp", F.lit(5).cast("long")))
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicate(df, "doc_id").collect()] == [1]


# exact copies --------------------------------------------------------------------


def test_exact_copies_and_later_files(spark, tmp_path):
    schema = "doc_id long, text string, digest string"
    first = [(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "", "x"), (None, "b", "x"), (6, "b", "x"), (6, "b", "x"), (7, "c" * 300_000, "x")]
    path, state = str(tmp_path / "docs"), shared_path(spark, "state")
    spark.createDataFrame(first, schema).write.parquet(path)
    rows = exact.deduplicate_files(spark, path, "doc_id", "text", state).collect()
    got = Counter((r.doc_id, r.keep, r.group_size, r.kept) for r in rows)
    assert got == Counter([
        (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (None, 6, 3, False), (6, 6, 3, True), (6, 6, 3, False),
        (7, 7, 1, True),
    ])
    spark.createDataFrame([(9, "a", "x"), (0, "new", "x")], schema).write.mode("append").parquet(path)
    rows = exact.deduplicate_files(spark, path, "doc_id", "text", state).collect()
    assert {(r.doc_id, r.keep, r.group_size) for r in rows} >= {(1, 9, 3), (9, 9, 3), (0, 0, 1)} and len(rows) == 10


def test_exact_copies_by_shuffle_and_without_rows(spark, docs, monkeypatch, tmp_path):
    path = f"{SF}/documents.parquet"
    few = exact.deduplicate_files(spark, path, "doc_id", "text").collect()
    monkeypatch.setattr(exact, "BROADCAST_DIGESTS", 0)
    assert sorted(few) == sorted(exact.deduplicate_files(spark, path, "doc_id", "text").collect())
    docs.where("false").write.parquet(str(tmp_path / "none"))
    assert exact.deduplicate_files(spark, str(tmp_path / "none"), "doc_id", "text").count() == 0


# repeated passages ---------------------------------------------------------------


def without_repeats(rows, window):
    first, out = {}, {}
    for key, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        covered = [False] * len(found)
        for i in range(len(found) - window + 1):
            if first.setdefault(tuple(found[i : i + window]), key) < key:
                covered[i : i + window] = [True] * window
        out[key] = (len(found), sum(covered), " ".join(w for w, c in zip(found, covered) if not c))
    return out


def test_repeated_passages_go(spark):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "Ü x", "-"]
    passages = [" ".join(draw.choices(vocabulary, k=draw.randint(4, 25))) for _ in range(12)]
    rows = []
    for key in range(60):
        parts = [draw.choice(passages) if draw.random() < 0.5 else " ".join(draw.choices(vocabulary, k=9)) for _ in range(draw.randint(0, 7))]
        rows.append((key, draw.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, rows[5][1]), (101, None), (102, ""), (103, " \n "), (104, "solo " * 40_000)]
    df = spark.createDataFrame([(k, t, "c") for k, t in rows] + [(None, rows[7][1], "c")], "doc_id long, text string, kept string")
    got = substring.remove_repeats(df, "doc_id", window=8).collect()
    want = without_repeats(rows, 8)
    assert {r.doc_id: (r.n_words, sum(x.end - x.start for x in r.removed), r.kept) for r in got if r.doc_id is not None} == want
    assert sum(n for _, n, _ in want.values()) > 300
    orphan = next(r for r in got if r.doc_id is None)
    assert orphan.removed == [] and orphan.n_words == want[7][0]
    assert substring.remove_repeats(df.where("false"), "doc_id").count() == 0


def test_words_and_grams_in_chunks(monkeypatch):
    text = (" ".join("word%d" % (i % 97) for i in range(3000)) + " " + "x" * 700 + " end").encode()
    whole = substring.words(text)
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.split()))
    runs, marks = substring.grams(whole, 5), substring.checks(whole, 5)
    monkeypatch.setattr(substring, "CHUNK", 256)
    assert (substring.words(text) == whole).all()
    assert (substring.grams(whole, 5) == runs).all() and (substring.checks(whole, 5) == marks).all()
    texts = ["a b c d e f", None, " ", "x " * 300, "c d e f a b c", "d e", text.decode(), "a b c"] * 3
    for found, one in zip(substring._many(texts, 3), texts, strict=True):
        assert all((x == y).all() for x, y in zip(found, substring._hashes(one, 3), strict=True))


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_words_that_polynomials_confuse_are_different(spark):
    # the two words have one hash under every polynomial modulo 2^64
    one, other = thue_morse(2048, "ab"), thue_morse(2048, "ba")
    common = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*common[:7], one, *common[7:]])), (2, " ".join([*common[:7], other, *common[7:]])), (3, " ".join([*common[:7], one, *common[7:]]))]
    got = {r.doc_id: r.removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", window=31).collect()}
    assert got[1] == [] and got[2] == [] and [(x.start, x.end) for x in got[3]] == [(0, 31)]


def test_bitmaps_leave_no_files(spark):
    import glob

    cut(spark.range(3))  # makes the folder
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/rdd-*"))
    bits, power = substring.bitmap(spark.range(50).select(F.xxhash64("id").alias("h")), "h")
    assert set(glob.glob(f"{folder}/rdd-*")) == before and bits.any() and power >= 16


def test_word_hashes_take_in_every_byte():
    draw = random.Random(2)
    seen = {}
    for n in [*range(1, 30), 63, 64, 65, 200]:
        for _ in range(200):
            word = "".join(draw.choices("ab", k=n)).encode()
            seen.setdefault(word, set()).add(int(substring.words(b" x " + word + b"\ty")[1]))
    assert all(len(h) == 1 for h in seen.values()) and len({h for s in seen.values() for h in s}) == len(seen)
    assert substring.words(b"a\x00 a").tolist()[0] != substring.words(b"a a").tolist()[0]
    assert len(substring.words(b"")) == len(substring.words(b" \n")) == 0


def test_windows_are_told_apart_by_the_second_hash_too():
    h, c = np.array([5, 5, 7, 9], np.uint64), np.array([1, 2, 3, 4], np.int32)
    of = np.array([7, 5, 9, 5], np.uint64), np.array([3, 2, 5, 8], np.int32)
    assert substring._among(h, c, *of).tolist() == [False, True, True, False]
    assert substring._among(h, c, of[0][:0], of[1][:0]).tolist() == [False] * 4


# WARC ----------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big, small = "<p>é" + "x" * 2000, "<p>tiny"
    pages = [(1, "http://a\r\nb", big), (5, "http://c", big), (5, "http://c", big), (3, None, small), (4, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n" + big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    plan = warc.plan_records(df, "page_id", "url", "html")
    raw, target = shared_path(spark, "raw"), shared_path(spark, "warc")
    text = warc.record_text(*[F.col(c) for c in ("key", "url", "payload", "digest", "refers_to")])
    warc.write_monolithic(plan.select(text), raw, records_per_file=3)
    warc.normalise(spark, raw, target, records_per_file=2)
    rows = warc.resolve_revisits(warc.read_archives(spark, f"{target}/archives")).collect()
    utf8 = {k: (h or "").encode() for k, _, h in pages}
    want = Counter(
        (k, len(utf8[k]), hashlib.sha1(utf8[k]).hexdigest(), "revisit" if k == 1 else "response", 5 if k == 1 else None) for k, _, _ in pages
    )
    assert Counter((r.record_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want

    # the sidecar index cuts single members out of files that any gzip reader takes
    files = {}
    for f in spark.read.format("binaryFile").load(f"{target}/archives").collect():
        files[tuple(int(x) for x in re.search(r"part-(\d+)-.*-c(\d+)\.", f.path).groups())] = bytes(f.content)
    index = spark.read.parquet(f"{target}/index").collect()
    assert len(index) == len(pages) and len(files) > 3
    for r in index:
        record = gzip.decompress(files[r.archive, r.part][r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and f"<urn:record:{r.record_key}>".encode() in record
    whole = b"".join(gzip.decompress(x) for x in files.values())
    assert whole.count(b"WARC-Record-ID") == len(pages)


def test_archives_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.plan_records(none, "page_id", "url", "html").count() == 0


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc._inflated(memoryview(gzip.compress(b"x" * 10_000)[:-20])))
    many = gzip.compress(b"a" * 100) + gzip.compress(b"") + gzip.compress(bytes(range(256)) * 9000)
    assert b"".join(x for _, x in warc._inflated(memoryview(many))) == b"a" * 100 + bytes(range(256)) * 9000


# sharding ------------------------------------------------------------------------


def placed(df, shards=24):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return sharding.assign_shards(df, size, F.coalesce("text", F.lit("")), F.col("doc_id"), shards)


def test_shards_are_even_and_slots_gapless(spark, docs):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 20)).otherwise(F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 20))).alias("text"))
    rows = placed(hot).collect()
    sizes, slots, texts = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r.shard] += len(r.text) + 8
        slots[r.shard].append(r.slot)
        texts[r.text].add(r.shard)
    assert len(rows) == 3000 and set(sizes) == set(range(24))
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in texts.values()) == 1
    assert sorted((r.doc_id, r.shard) for r in rows) == sorted((r.doc_id, r.shard) for r in placed(hot.repartition(7)).collect())


def test_sharding_edge_cases(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "x" * 100_000, 7)], "doc_id long, text string, shard int")
    rows = placed(df).collect()
    assert len(rows) == 4 and all(0 <= r.shard < 24 for r in rows)
    assert placed(df.where("false")).count() == 0
    sharding.write_shards(placed(df), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 4


# mixing --------------------------------------------------------------------------


def test_exponent_meets_its_target():
    tokens = [1000.0, 200.0, 50.0, 0.0]
    limited = mixing.solve(tokens, max_repetition=2.0)
    assert mixing.repetition(tokens, limited.weights) == pytest.approx(2.0, abs=1e-6)
    assert sum(limited.weights) == pytest.approx(1) and limited.weights[3] == 0
    flat = mixing.solve(tokens, target_entropy=0.9 * math.log(3))
    assert mixing.entropy(flat.weights) == pytest.approx(0.9 * math.log(3), abs=1e-6)
    assert mixing.solve(tokens, max_repetition=1e9).exponent == 0
    assert mixing.solve(tokens, target_entropy=0.0).exponent == 1
    assert mixing.solve([], max_repetition=2).weights == ()
    with pytest.raises(ValueError):
        mixing.solve(tokens)


def test_budgets_are_read_in_blocks(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, F.lit("small")).when(F.col("id") % 5 == 1, None).otherwise(F.lit("large")).alias("source"),
        (F.col("id") % 7 + 1).alias("n"),
    )
    mixed = mixing.mix(rows, "source", F.col("n"), F.col("doc_id"), max_repetition=1.5, block_tokens=100).collect()
    have, got = Counter(), Counter()
    for r in rows.collect():
        have[r.source] += r.n
    for r in mixed:
        got[r.source] += r.tokens
    weights = mixing.solve([have[s] for s in (None, "large", "small")], max_repetition=1.5).weights
    budget = max(have[s] / w for s, w in zip((None, "large", "small"), weights))
    for s, w in zip((None, "large", "small"), weights):
        assert 0 <= got[s] - w * budget < 7 + 1e-6
    assert len({(r.doc_id, r.epoch) for r in mixed}) == len(mixed)
    assert {r.doc_id for r in mixed if r.epoch == 0} == set(range(2000))
    again = mixing.mix(rows.repartition(5), "source", F.col("n"), F.col("doc_id"), max_repetition=1.5, block_tokens=100).collect()
    assert sorted((r.doc_id, r.epoch) for r in mixed) == sorted((r.doc_id, r.epoch) for r in again)


def test_mixing_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None, 3), (1, None, None, 3), (2, "", "a", 4), (3, "x " * 50_000, "a", 5), (None, "w", "b", 6)], "doc_id long, text string, source string, epoch int")
    out = mixing.mix(df, "source", mixing.count_tokens("text"), F.col("doc_id"), max_repetition=2.0).collect()
    assert Counter(r.doc_id for r in out if r.epoch == 0) == Counter([1, 1, 2, 3, None])
    none = mixing.mix(df.where("false"), "source", mixing.count_tokens("text"), F.col("doc_id"), max_repetition=2.0)
    assert none.count() == 0

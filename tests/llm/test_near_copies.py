"""Near copies by fingerprints against brute force over all pairs."""

import random

import xxhash

from loadshape.llm import simhash


def fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=3):
    """Keys that stay: the smallest of each component of all pairs within the distance; and the number of near pairs."""
    prints = {key: fingerprint(text) for key, text in rows}
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = 0
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                pairs += prints[a] != prints[b]
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {top(k) for k in prints}, pairs


def edited(draw, vocabulary):
    rows = []
    for _ in range(40):
        words = draw.choices(vocabulary, k=draw.choice([4, 20, 150, 400, 900]))
        for _ in range(draw.randint(1, 6)):
            copy = list(words)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return [(k, t) for k, (_, t) in enumerate(draw.sample(rows, len(rows)))]


def test_one_row_of_each_class_stays(spark):
    draw = random.Random(12)
    rows = edited(draw, [f"w{i}" for i in range(3000)]) + [(900, None), (901, ""), (902, " \n"), (903, "One TWO"), (904, "one two")]
    want, pairs = brute(rows)
    assert pairs > 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in simhash.deduplicate(df, "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_repeats_null_keys_and_clashing_names(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 5), (None, "a b c d", 6), (None, "x y z", 7), (None, "x y z", 7), (2, None, 8), (0, "", 9)]
    names = ["key", "digest", "fp", "row", "_key", "_first", "component", "kept_key", "dots.too"]
    df = spark.createDataFrame([(*r, *[1] * 9) for r in rows], "doc_id long, text string, n int, " + ", ".join(f"`{n}` int" for n in names))
    kept = simhash.deduplicate(df, "doc_id")
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.n) for r in kept.collect()), key=repr) == [(0, "", 9), (1, "a b c d", 5), (None, "x y z", 7)]
    assert simhash.deduplicate(df.where("false"), "doc_id").count() == 0

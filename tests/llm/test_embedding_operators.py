"""Whitening, hard negatives and near duplicates of embeddings against brute force, and their odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadshape.llm import metric_join, negatives, whitening
from loadshape.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, x string, node long, grp string, score int"


def table(spark, rows):
    """Rows (id, vector, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "g", 2) for r in rows], SCHEMA).repartition(5)


def odd_vectors(start):
    return [
        (start, None, 0), (start + 1, [], 0), (start + 2, [None, 1.0, 0.0], 0), (start + 3, [float("nan"), 1.0, 0.0], 0),
        (start + 4, [float("inf"), 1.0, 0.0], 0), (start + 5, [1.0, 2.0], 0),
    ]


# near duplicates -----------------------------------------------------------------


def near_brute(rows, similarity):
    def unit(v, label):
        if label is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v, float)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v, label) for _, v, label in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= similarity:
                links[i].add(j)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *[root[j] for j in links[i]]]) for i in range(len(rows))]
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(
        ((k, len(links[i]), least.get(root[i]), k == least.get(root[i])) for i, (k, _, _) in enumerate(rows)), key=repr
    )


def near(df, **settings):
    return sorted((tuple(r) for r in metric_join.near_duplicates(df, "vec_id", "embedding", "label", **settings).collect()), key=repr)


def clustered(seed, n, dim, spreads):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    rows = []
    for k in range(n):
        v = centres[draw.integers(12)] + draw.normal(size=dim) * draw.choice(spreads)
        rows.append((k, (v * draw.choice([0.1, 1.0, 30.0])).tolist(), int(draw.integers(2))))
    return rows


@pytest.mark.parametrize("cell", [8, 40, 2048])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    monkeypatch.setattr(metric_join, "STRIP", 5)
    rows = clustered(3, 260, 6, [0.02, 0.2, 0.6])
    rows += [(300, rows[4][1], rows[4][2]), (301, rows[4][1], rows[4][2]), (4, rows[4][1], rows[4][2])]
    rows += [(302, [0.0] * 6, 1), (303, rows[7][1], None), (None, rows[9][1], rows[9][2]), (304, [1.0], 1), (305, [2.0], 1)]
    rows += odd_vectors(400)
    for similarity in (0.93, 0.999, 0.5):
        want = near_brute(rows, similarity)
        assert near(table(spark, rows), similarity=similarity) == want
    assert sum(r[1] for r in want) > 1000


def test_near_duplicates_of_one_dense_cloud(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 30)
    monkeypatch.setattr(metric_join, "BLOCK", 32)
    rows = clustered(5, 300, 16, [0.01, 0.05])
    rows = [(k, v, 0) for k, v, _ in rows]
    assert near(table(spark, rows)) == near_brute(rows, 0.93)


def test_near_duplicates_of_huge_and_tiny_vectors(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [1.0, -1.0], 0), (4, [5e-324, 5e-324], 0)]
    assert near(table(spark, rows)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False)]


# hard negatives --------------------------------------------------------------------


def negatives_brute(rows, positives=5, count=3, scale=256):
    usable = {
        (k, label, tuple(math.floor(scale * c) for c in v))
        for k, v, label in rows
        if k is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v)
    }
    out = []
    for ka, la, a in usable:
        if ka % 50:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b)), kb, lb) for kb, lb, b in usable if kb != ka and len(a) == len(b)
        )
        for ps, pk, _ in [s for s in scored if s[2] == la][:positives]:
            window = [s for s in scored if s[2] != la and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:count]
            out += [(ka, pk, i + 1, nk, -ps, -ns) for i, (ns, nk, _) in enumerate(window)]
    return sorted(out)


def mined(df, **settings):
    found = negatives.hard_negatives(df, "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0, **settings)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("blocks", [(7, 3), (16384, 4096)])
def test_hard_negatives_against_sorting_everything(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[1])
    monkeypatch.setattr(negatives, "STRIP", 2)
    draw = np.random.default_rng(1)
    # coarse entries: many equal scores
    rows = [(k, (draw.integers(-3, 6, 4) / 8).tolist(), int(draw.integers(3))) for k in range(420)]
    rows += [(50, rows[50][1], rows[50][2]), (1000, rows[9][1], None), (None, rows[9][1], 0), (1050, [0.0] * 4, 1)]
    rows += [(1100, [-0.5] * 4, 9), (1150, [1.0, 1.0], 1), (1151, [1.0, 1.0], 1), (1152, [0.8, 0.9], 2)]
    rows += [(k + 2000, v, label) for k, v, label in odd_vectors(0)]
    want = negatives_brute(rows)
    assert len(want) > 50 and mined(table(spark, rows)) == want


def test_hard_negatives_of_large_scores(spark):
    rows = [(0, [1e5, 1e5], 0), (1, [1e5, 1e5], 0), (2, [7e4, 8e4], 1), (3, [1e30, 0.0], 1), (4, [-1e30, 0.0], 0)]
    got = mined(table(spark, rows), scale=256)
    assert (0, 1, 1, 2, 2 * (25600000**2), 25600000 * (17920000 + 20480000)) in got


# whitening ---------------------------------------------------------------------------


def whitened(df, **settings):
    return whitening.whiten(df, "vec_id", "embedding", **settings)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_against_numpy(spark, weights):
    draw = np.random.default_rng(4)
    rows = [(k, (draw.normal(size=3) * [3, 1, 0.2] + 5).tolist(), 0) for k in range(200)]
    rows += [(500 + k, rows[3][1], 0) for k in range(90)] + [(3, rows[3][1], 1), (None, rows[8][1], 0)] + odd_vectors(900)
    good = [(k, v) for k, v, _ in rows if v and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good])).astype(np.int64) + 100000
    fit = x if weights == "counts" else np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = fit - total / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitened(table(spark, rows), weights=weights).toPandas()
    assert len(got) == 3 * len(good) and set(got["n"]) == {n} and set(got["component"]) == {1, 2, 3}
    for i in range(3):
        own = got[got["component"] == i + 1]
        assert own["explained"].iloc[0] == pytest.approx(values[i] / values.sum(), rel=1e-9)
        want = sorted((repr(k), float(w)) for (k, _), w in zip(good, (x - total / n) @ axes[:, i] / np.sqrt(values[i])))
        seen = sorted((repr(None if k != k else int(k)), w) for k, w in zip(own["vec_id"], own["whitened"]))
        sign = 1 if abs(seen[0][1] - want[0][1]) < 1e-6 else -1
        want = sorted((k, sign * w) for k, w in want)
        assert [k for k, _ in seen] == [k for k, _ in want]
        np.testing.assert_allclose([w for _, w in seen], [w for _, w in want], atol=1e-8)
    deviations = {int((n * r - total) @ (n * r - total)) for r in x}
    assert {int(d) for d in got["deviation"]} == deviations
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_without_variance_and_beyond_64_bits(spark):
    same = whitened(table(spark, [(k, [1.0, 2.0], 0) for k in range(3)])).collect()
    assert len(same) == 6 and {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same} == {(None, None, None, 0)}
    flat = whitened(table(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)])).orderBy("vec_id", "component").collect()
    assert [r.whitened for r in flat][1::2] == [None, None] and abs(flat[0].whitened) == pytest.approx(1.0)
    far = whitened(table(spark, [(1, [1e12, 0.0], 0), (2, [-1e12, 1.0], 0), (3, [0.0, 1e300], 0)])).collect()
    x = [[int(1024 * 1e12) + 100000, 100000], [-int(1024 * 1e12) + 100000, 101024], [100000, whitening.LARGEST + 100000]]
    total = [sum(c) for c in zip(*x)]
    assert {int(r.deviation) for r in far} == {sum((3 * c - t) ** 2 for c, t in zip(r, total)) for r in x}


def test_empty_tables_and_no_usable_vector(spark):
    for rows in ([], odd_vectors(0)[:5]):
        df = spark.createDataFrame([(*r, "x", 1, "g", 2) for r in rows], SCHEMA)
        assert whitened(df).count() == 0 and mined(df) == []
        assert near(df) == sorted(((k, 0, k, True) for k, _, _ in rows), key=repr)


def test_queries_over_the_whole_table(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    white = QUERIES["op11_embedding_whitening"](spark, SF)
    assert white.count() == 8 * n and dict(white.dtypes)["deviation"] == "bigint"
    assert QUERIES["op13_embedding_near_dedup"](spark, SF).count() == n

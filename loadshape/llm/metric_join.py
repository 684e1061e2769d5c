"""Near duplicates among embeddings: an exact range join in cells around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape.llm.common import components, cut
from loadshape.llm.vectors import doubles, finite, matrix

#: Distinct vectors of a group for each of its pivots, about; and of a block, two of which meet in a task at most.
CELL = 1 << 11
BLOCK = 1 << 11
#: Doubles that all pivots hold at most; they are broadcast.  Groups without pivots are one cell, in blocks.
PIVOT_VALUES = 1 << 21
#: Rows of a block compared at a time.
STRIP = 512
#: Distances computed in doubles are surer than this; bounds are loosened by it, never tightened.
SLACK = 1e-6

ASSIGNED = "node long, copies long, grp string, unit binary, cells array<struct<cell:int,home:boolean,ring:int>>"


def distance(similarity: float) -> float:
    """Euclidean distance of unit vectors of that cosine."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * similarity)))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


def choose_pivots(groups: DataFrame) -> dict[str, np.ndarray]:
    """Pivots per group of more than ``CELL`` vectors: about one in ``CELL``, drawn by a hash of the vector, as unit vectors.

    The largest groups come first where ``PIVOT_VALUES`` would not hold them all; what a group gets does not change the
    result.
    """
    sizes = groups.groupBy("grp", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    # one pivot holds 64 values or more in all but tiny vectors, so this many groups fill the bound
    largest = sizes.orderBy(F.desc("n"), "grp").limit(PIVOT_VALUES // 64).collect()
    wanted, left = {}, PIVOT_VALUES
    for r in largest:
        k = min(-(-r.n // CELL), left // r.dim)
        if k > 1:
            wanted[r.grp], left = (r.n, k), left - k * r.dim
    if not wanted:
        return {}
    quota = F.create_map(*[x for g, (n, k) in wanted.items() for x in (F.lit(g), F.struct(F.lit(min(1.0, 3.0 * k / n)).alias("share"), F.lit(k).alias("k")))])
    drawn = groups.withColumn("q", F.element_at(quota, F.col("grp"))).withColumn("h", F.xxhash64("vector"))
    # a few more than wanted pass the threshold; their order decides
    drawn = drawn.where((F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)) < F.col("q.share"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("h", "node"))
    drawn = drawn.withColumn("place", place).where("place <= q.k").orderBy("grp", "place").select("grp", "vector")
    found: dict[str, list] = {}
    for r in drawn.collect():
        found.setdefault(r.grp, []).append(r.vector)
    return {g: np.unique(_units(np.array(v, float)), axis=0) for g, v in found.items()}


def _assign(groups: DataFrame, pivots: dict[str, np.ndarray], radius: float) -> DataFrame:
    """Per vector its unit vector and the cells that it lies in: its own, and those of smaller number that a partner can own.

    A vector's home is its nearest pivot.  A vector at home in ``i`` lies no farther from pivot ``i`` than from any other,
    so by the triangle inequality a partner ``y`` from cell ``j`` has d(y, i) <= d(y, j) + 2 * radius; the plane between
    the two pivots bounds it more tightly: (d(y, i)^2 - d(y, j)^2) / 2 d(i, j) <= radius.  A pair is looked for in the
    smaller of its two home cells.  Rings are distances from the pivot: 0 up to half the radius, where any two
    vectors are partners; 1 up to where a vector can still have a partner in ring 0; 2 beyond.
    """
    shared = groups.sparkSession.sparkContext.broadcast(pivots)
    core = radius / 2 - SLACK
    edges = [core, core + radius + 2 * SLACK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps: dict[str, np.ndarray] = {}
        for b in batches:
            cells: list = [None] * len(b)
            units: list = [None] * len(b)
            names = np.array(b.column("grp").to_pylist(), object)
            for name in dict.fromkeys(names.tolist()):
                at = np.nonzero(names == name)[0]
                x = _units(matrix(b.column("vector").take(pa.array(at))))
                p = shared.value.get(name)
                if p is None:
                    for i, u in zip(at, x):
                        units[i], cells[i] = u.tobytes(), [{"cell": 0, "home": True, "ring": 2}]
                    continue
                far = _apart(x @ p.T)
                home = far.argmin(axis=1)
                if name not in gaps:
                    gaps[name] = _apart(p @ p.T)
                own = far[np.arange(len(x)), home][:, None]
                reach = far**2 - own**2 <= 2 * radius * gaps[name][home] + SLACK
                reach &= np.arange(len(p))[None, :] <= home[:, None]
                reach[np.arange(len(x)), home] = True
                rings = np.searchsorted(edges, far, side="left")
                for k, i in enumerate(at):
                    units[i] = x[k].tobytes()
                    cells[i] = [{"cell": int(c), "home": bool(c == home[k]), "ring": int(rings[k, c])} for c in np.nonzero(reach[k])[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("node"), b.column("copies"), b.column("grp"), pa.array(units, pa.binary()),
                    pa.array(cells, pa.list_(pa.struct([("cell", pa.int32()), ("home", pa.bool_()), ("ring", pa.int32())]))),
                ],
                ["node", "copies", "grp", "unit", "cells"],
            )

    return groups.select("node", "copies", "grp", "vector").mapInArrow(run, ASSIGNED)


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Per node the smallest node reachable over the edges, which are given in both directions."""
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    ends, starts = np.unique(u, return_index=True)
    root = np.arange(n)
    while True:
        less = root.copy()
        less[ends] = np.minimum(root[ends], np.minimum.reduceat(root[v], starts))
        less = less[less]
        if (less == root).all():
            return root
        root = less


def _compare(similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["first"].to_numpy()]
        second = pdf[~pdf["first"].to_numpy()]
        alone = bool(pdf["alone"].iloc[0])
        if alone:
            second = first
        nothing = pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        if not len(first) or not len(second):
            return nothing
        units = [np.frombuffer(b"".join(s["unit"]), "<f8").reshape(len(s), -1) for s in (first, second)]
        us, vs = [], []
        for at in range(0, len(first), STRIP):
            close = units[0][at : at + STRIP] @ units[1].T >= similarity
            if alone:
                i = np.arange(len(close))
                close[i, i + at] = False
            u, v = np.nonzero(close)
            us.append(u + at)
            vs.append(v)
        u, v = np.concatenate(us), np.concatenate(vs)
        if not len(u):
            return nothing
        if alone:  # both directions are there
            nodes, copies = first["node"].to_numpy(), first["copies"].to_numpy()
        else:
            nodes = np.concatenate([first["node"], second["node"]])
            copies = np.concatenate([first["copies"], second["copies"]])
            u, v = np.concatenate([u, v + len(first)]), np.concatenate([v + len(first), u])
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, u, copies[v])
        has = np.unique(u)
        root = _roots(u, v, len(nodes))
        return pd.DataFrame({"node": nodes[has], "links": links[has], "root": nodes[root[has]]})

    return run


def _links_in_cells(assigned: DataFrame, similarity: float) -> DataFrame:
    """(node, links, root): partial counts of linked copies, and a node that each is connected to, over all cells."""
    here = assigned.select("node", "copies", "grp", "unit", F.inline("cells"))
    ball = here.where("ring = 0").groupBy("grp", "cell").agg(
        F.sum(F.when(F.col("home"), F.col("copies"))).alias("at_home"),
        F.sum(F.when(~F.col("home"), F.col("copies"))).alias("guests"),
        F.min(F.when(F.col("home"), F.col("node"))).alias("root"),
    )
    # within half the radius of a pivot all are partners: counted, not compared
    others = F.when(F.col("home"), F.col("at_home") - F.col("copies") + F.coalesce("guests", F.lit(0))).otherwise(F.col("at_home"))
    together = (
        here.where("ring = 0").select("node", "copies", "grp", "cell", "home")
        .join(ball.where("root IS NOT NULL"), ["grp", "cell"])
        .select("node", others.alias("links"), "root")
    )
    kinds = here.groupBy("grp", "cell", "home", "ring").agg(F.count(F.lit(1)).alias("n"))
    parts = kinds.groupBy("grp", "cell").agg(
        F.sort_array(F.collect_list(F.struct(
            "home", "ring", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")
        ))).alias("kinds")
    )
    dealt = here.join(parts, ["grp", "cell"]).withColumn(
        "part",
        F.pmod(
            F.xxhash64("node"),
            F.filter("kinds", lambda k: (k["home"] == F.col("home")) & (k["ring"] == F.col("ring")))[0]["parts"],
        ).cast("int"),
    )

    def meets(k: Column) -> Column:
        """Blocks that can hold a partner: never two guests, rings next to each other, ring 0 with itself is done."""
        return (k["home"] | F.col("home")) & (F.abs(k["ring"] - F.col("ring")) <= 1) & ~((k["ring"] == 0) & (F.col("ring") == 0))

    partners = F.explode(F.flatten(F.transform(
        F.filter("kinds", meets),
        lambda k: F.transform(
            F.sequence(F.lit(0), k["parts"] - 1), lambda q: F.struct(~k["home"], k["ring"], q.alias("part"))
        ),
    )))
    own = F.struct(~F.col("home"), F.col("ring"), F.col("part"))
    # a pair of blocks has one name, whichever of the two a row belongs to; guests come second
    met = dealt.select("node", "copies", "unit", "grp", "cell", own.alias("own"), partners.alias("other"))
    met = met.select(
        "node", "copies", "unit", "grp", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        (F.col("own") <= F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("alone"),
    )
    compared = met.groupBy("grp", "cell", "a", "b").applyInPandas(_compare(similarity), "node long, links long, root long")
    return together.unionByName(compared)


def near_duplicates(
    df: DataFrame, key: str, vector: str, label: str | Column | None = None, similarity: float = 0.93
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``.

    Two rows are linked if their labels are equal and not NULL (any two, without ``label``) and the cosine of their vectors
    is at least ``similarity``, in doubles.  ``n_links`` counts the other rows that a row is linked to; ``component_id`` is
    the smallest key reachable over links, its own included; ``kept`` where that is its own key.

    Equal vectors of a label are one entry with a number of copies.  Of the rest, pivots drawn from a label's vectors
    divide them into cells, the triangle inequality decides which cells a vector must be sent to besides its own,
    and every cell is joined by itself, in pairs of bounded blocks.  Vectors within half the radius of one pivot are
    partners without being compared, so a dense cloud of near copies costs its number, not the square.  Tasks return
    counts and one connection per vector, never the pairs.  No pair of the similarity is lost, nor one below it found.

    A vector that is NULL, empty, zero, or holds a NULL or non-finite entry links with nothing, nor do vectors of different
    lengths or rows with a NULL label; they come out with 0 links and as their own component.  Rows with a NULL key take
    part; a component without any key is NULL.  Repeated rows are linked like others and come out as often as they come
    in.  Other columns of ``df`` play no part, whatever their names.  An empty table gives an empty result.  Vectors
    without clusters, of many dimensions, are as far from each other as from any pivot: then cells exclude little,
    and the work is that of comparing each vector with those of its label.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is above 0 and at most 1")
    name = F.lit("") if label is None else (F.col(label) if isinstance(label, str) else label).cast("string")
    v = doubles(vector)
    usable = finite(vector) & F.exists(v, lambda c: c != 0) & name.isNotNull()
    rows = df.select(
        F.col(key).alias("key"),
        F.when(usable, F.concat_ws(":", F.size(v).cast("string"), name)).alias("grp"),
        F.when(usable, v).alias("vector"),
    )
    groups = cut(
        rows.where("grp IS NOT NULL").groupBy("grp", "vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    assigned = cut(_assign(groups, choose_pivots(groups), distance(similarity)))
    found = cut(_links_in_cells(assigned, similarity))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found, "node", "root")
    nodes = groups.join(counts, "node", "left").join(classes, "node", "left").select(
        "grp", "vector", "least", F.coalesce("component", "node").alias("class"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    first = nodes.groupBy("class").agg(F.min("least").alias("component_id"))
    verdicts = nodes.join(first, "class").select("grp", "vector", "n_links", "component_id")
    linked = rows.where("grp IS NOT NULL").join(verdicts, ["grp", "vector"]).select("key", "n_links", "component_id")
    alone = rows.where("grp IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )

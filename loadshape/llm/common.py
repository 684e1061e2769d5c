"""What several corpus operators need: the shared folder, column clashes, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; below the warehouse where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_path(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` has kept and that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the undirected ``links``.

    Alternating large-star and small-star steps: each node hangs its larger neighbours, then its smaller
    ones and itself, on the smallest node it knows, until nothing changes.  The number of links never grows
    and every step is two aggregations with partial sums; a hub of any degree is an ordinary key.  Links
    with a NULL end and links of a node to itself are left out.  The rounds needed grow with the logarithm
    of a component's diameter; each is cut with ``checkpoint()``.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND u <> v")
        .distinct()
    )

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        if not small:
            least = least.select("u", F.least("u", "m").alias("m"))
            both = both.where("v > u")
        hung = both.join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        if small:
            hung = hung.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        return hung.where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    known = None
    while (now := state(edges)) != known:
        known = now
        edges = cut(star(star(edges, small=False), small=True))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Object graphs as tables: walks, inheritance, reachability, renumbering, revisions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_DEPTH = 256


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared checkpoint folder."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:  # only where driver and executors are one process
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{root.rstrip('/')}/parchlake/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def walk_tree(spark: SparkSession, edges: DataFrame, roots: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Depth-first order of a forest by its levels: edges (doc, parent, ordinal, child, *attributes), roots (doc, node,
    *attributes). Returns doc, node, path (ordinals), depth, and each attribute of the nearest node that has it.

    A node counts once, where it comes first; each level is one join, up to MAX_DEPTH of them.
    """
    level = roots.select("doc", "node", F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), *attributes)
    seen = level
    for depth in range(1, MAX_DEPTH + 1):
        kids = edges.withColumnsRenamed({a: f"own_{a}" for a in attributes})
        level = level.withColumnRenamed("node", "parent").join(kids, ["doc", "parent"]).select(
            "doc", F.col("child").alias("node"), F.concat("path", F.array(F.col("ordinal").cast("int"))).alias("path"), F.lit(depth).alias("depth"),
            *(F.coalesce(f"own_{a}", a).alias(a) for a in attributes),
        )
        level = level.groupBy("doc", "node").agg(F.min_by(F.struct("path", "depth", *attributes), "path").alias("x")).select("doc", "node", "x.*")
        level = _cut(level.join(seen.select("doc", "node"), ["doc", "node"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, node, depth): all nodes that roots (doc, node) reach over edges (doc, src, dst); new nodes only, level by level."""
    frontier = _cut(roots.select("doc", "node").distinct())
    seen, depth = frontier.withColumn("depth", F.lit(0)), 0
    while True:
        depth += 1
        found = frontier.withColumnRenamed("node", "src").join(edges, ["doc", "src"]).select("doc", F.col("dst").alias("node")).distinct()
        frontier = _cut(found.join(seen, ["doc", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))


def collect_garbage(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The objects (doc, node, ...) that roots reach."""
    return objects.join(reachable(edges, roots).select("doc", "node"), ["doc", "node"], "left_semi")


def renumbered(objects: DataFrame, order: list) -> DataFrame:
    """Adds `new_node`: 1.. within each document, in the given order."""
    return objects.withColumn("new_node", F.row_number().over(Window.partitionBy("doc").orderBy(*order)))


def rewrite_references(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges (doc, src, dst) in new numbers; a reference to a missing object becomes null."""
    of = lambda c: numbers.select("doc", F.col("node").alias(c), F.col("new_node").alias(f"new_{c}"))
    return edges.join(of("src"), ["doc", "src"]).join(of("dst"), ["doc", "dst"], "left")


def resolve(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Left join of references (doc, dst) to objects (doc, node, value): null where the target is missing."""
    return refs.join(objects.select("doc", F.col("node").alias("dst"), "value"), ["doc", "dst"], "left")


def newest(revisions: DataFrame, keys: list[str], order: list, keep: list[str]) -> DataFrame:
    """For each key the row of the newest revision: an aggregate with map-side combine, no sort of all revisions."""
    return revisions.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("x")).select(*keys, "x.*")

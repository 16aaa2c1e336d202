"""A graph kept as tables and merged by conversation (GRF-10, SNK-07): bucketed partitions, of which a second build rewrites only those it touches."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import contract as C
from ..registry import query
from . import graph as G
from . import relationships as R

#: Partitions of a kept table; a conversation lies in one.
PARTS = 64


def part_of(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("binary")), F.lit(PARTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def keep(rows: DataFrame, path: str, key: str) -> None:
    """Merges rows (conv, key, ...) into the table at path: of each conversation that rows have, all earlier rows give way; one row a key, the last by value.

    What is merged is written beside the table first and read back, so no partition is replaced while it is read; dynamic overwrite then replaces the
    partitions touched and leaves the others' files alone. Building the same rows twice leaves the same table.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in ("conv", key)]
    last = rows.groupBy("conv", key).agg(F.max(F.struct(*rest)).alias("_r")).select("conv", key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    new = last.withColumn("part", part_of(F.col("conv")))
    staged = f"{path}-staged-{uuid.uuid4().hex}"
    new.write.parquet(staged)
    new = spark.read.parquet(staged)
    merged = new
    if _exists(spark, path):
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # PARTS at most
        old = spark.read.parquet(path).where(F.col("part").isin(touched)).join(new.select("conv").distinct(), "conv", "left_anti")
        merged = new.unionByName(old.select(*new.columns))
    ready = f"{path}-staged-{uuid.uuid4().hex}"
    merged.repartition("part").write.parquet(ready)
    spark.read.parquet(ready).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for p in (staged, ready):
        gone = spark._jvm.org.apache.hadoop.fs.Path(p)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def keep_graph(nodes: DataFrame, edges: DataFrame, folder: str, ends: DataFrame | None = None) -> None:
    """ends (conv, end_id, kind, person, node_id, is_source): edges from each source to each target of a person, kept by their ends, for they are as many as both multiplied."""
    keep(nodes, f"{folder}/nodes", "node_id")
    keep(edges, f"{folder}/edges", "edge_id")
    if ends is not None:
        keep(ends, f"{folder}/ends", "end_id")


def kept_graph(spark: SparkSession, folder: str, conv: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The kept nodes and edges, but those that ends tell; of one conversation only its partition is read."""
    return _kept(spark, folder, "nodes", conv), _kept(spark, folder, "edges", conv)


def kept_ends(spark: SparkSession, folder: str, conv: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv, kind, person, source) and (conv, kind, person, target): joined by the first three they are edges."""
    t = _kept(spark, folder, "ends", conv)
    return tuple(t.where(F.col("is_source") == source).select("conv", "kind", "person", F.col("node_id").alias(name)) for source, name in ((True, "source"), (False, "target")))


def _kept(spark: SparkSession, folder: str, name: str, conv: str | None) -> DataFrame:
    t = spark.read.parquet(f"{folder}/{name}")
    return (t if conv is None else t.where((F.col("part") == part_of(F.lit(conv))) & (F.col("conv") == conv))).drop("part")


def _ends(parts: R.Parts) -> DataFrame:
    every = []
    for kind, (own, deals) in G.people_ends(parts).items():
        for df, file, source in ((own, "from_file", True), (deals, "to_file", False)):
            node = X.node_id("document", F.col(file))
            every.append(df.select("conv", F.md5(F.concat_ws("-", F.lit(f"{kind}-{source}"), "person", node)).alias("end_id"), F.lit(kind).alias("kind"), "person", node.alias("node_id"), F.lit(source).alias("is_source")))
    return reduce(DataFrame.unionByName, every)


_COUNTS = "SELECT conv, sum(n)::BIGINT AS nodes, sum(e)::BIGINT AS edges FROM (SELECT conv, count(DISTINCT node_id) AS n, 0 AS e FROM nodes GROUP BY conv UNION ALL SELECT conv, 0, count(DISTINCT edge_id) FROM edges GROUP BY conv) GROUP BY conv"


@query("grf_10_summary", G.oracle(_COUNTS, **G.FRAMES))
@C.parse_once
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph is built and kept, one conversation is built again, and the kept tables are counted by conversation; links by people are kept and counted by their ends."""
    folder = C.written_to(spark, "graph")
    nodes = G.nodes(spark, sf_dir)  # writes the sections, which what clauses name is then read from
    parts = R.relation_parts(spark, sf_dir)
    edges, ends = G.other_edges(spark, sf_dir, parts), _ends(parts)
    keep_graph(nodes, edges, folder, ends)
    again = F.col("conv") == "src1"
    keep_graph(nodes.where(again), edges.where(again), folder, ends.where(again))
    nodes, edges = kept_graph(spark, folder)
    n = nodes.groupBy("conv").agg(F.count(F.lit(1)).alias("nodes"))
    sources, targets = (t.groupBy("conv", "kind", "person").agg(F.count(F.lit(1)).alias(c)) for t, c in zip(kept_ends(spark, folder), ("s", "t"), strict=True))
    people = sources.join(targets, ["conv", "kind", "person"]).select("conv", (F.col("s") * F.col("t")).alias("edges"))
    e = edges.groupBy("conv").agg(F.count(F.lit(1)).alias("edges")).unionByName(people).groupBy("conv").agg(F.sum("edges").alias("edges"))
    none = F.lit(0).cast("long")
    return n.join(e, "conv", "full").select("conv", F.coalesce("nodes", none).alias("nodes"), F.coalesce("edges", none).alias("edges"))

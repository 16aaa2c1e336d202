"""Merges into tables without a table format, and what aggregations of a document store become (SNK, SRC-21).

A merge is one shuffle: base and delta are unioned with a sequence number and the last value that isn't null wins by key and
column. Tables written by partition are then overwritten partition by partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import contract as C
from ..registry import query


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Field-wise merge: a delta's filled columns replace the base's, absent keys are added. Null keys match each other."""
    columns = [c for c in base.columns if c not in keys]
    both = base.withColumn("_seq", F.lit(0)).unionByName(delta.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    g = both.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in columns])
    return g.select(*base.columns)


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    new = delta.join(base.select(*keys), reduce(lambda x, y: x & y, [delta[k].eqNullSafe(base[k]) for k in keys]), "left_anti")
    return base.unionByName(new.select(*base.columns))


def replace_partition(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """All of a key's rows give way to the delta's."""
    return base.join(delta.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(delta.select(*base.columns))


def append_items(base: DataFrame, delta: DataFrame, key: str, items: str) -> DataFrame:
    """Appends arrays by key, creating keys that aren't there."""
    j = base.join(delta.withColumnRenamed(items, "_new"), key, "full_outer")
    return j.select(key, F.concat(F.coalesce(items, F.array().cast(base.schema[items].dataType)), F.coalesce("_new", F.array().cast(base.schema[items].dataType))).alias(items))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1000000)
    return c.select(key.alias("c_custkey"), F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))


_DELTA = "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS k, upper(c_name) AS n, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 END AS a FROM customer WHERE c_custkey % 3 = 0"


@query("snk_04_upsert", f"SELECT coalesce(d.k, c.c_custkey) AS c_custkey, coalesce(d.n, c.c_name) AS c_name, coalesce(d.a, c.c_acctbal) AS c_acctbal, c.c_mktsegment FROM customer c FULL OUTER JOIN ({_DELTA}) d ON d.k = c.c_custkey")
def upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge by key (SNK-03, SNK-04)."""
    return upsert(_base(spark, sf_dir), _delta(spark, sf_dir), ["c_custkey"])


def update(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with a delta's filled columns by key, and modified: whether the row has changed by it. Keys that base hasn't got add nothing (SNK-03)."""
    columns = [c for c in delta.columns if c not in keys]
    j = base.join(delta.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), keys, "left")
    changed = reduce(lambda a, b: a | b, [F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)) for c in columns], F.lit(False))
    j = j.withColumn("modified", changed)
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns], "modified")


@query("snk_03_update", f"SELECT c.c_custkey, coalesce(d.n, c.c_name) AS c_name, coalesce(d.a, c.c_acctbal) AS c_acctbal, c.c_mktsegment, d.k IS NOT NULL AND (d.n <> c.c_name OR d.a IS NOT NULL) AS modified FROM customer c LEFT JOIN ({_DELTA}) d ON d.k = c.c_custkey")
def update_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update(_base(spark, sf_dir), _delta(spark, sf_dir), ["c_custkey"])


@query("snk_05_compound_upsert", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def compound_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = C.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return upsert(base, base.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("changed")), ["o_custkey", "o_orderkey"])


@query("snk_08_replace_partition", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT DISTINCT o_custkey, -1 FROM orders WHERE o_custkey % 10 = 0")
def replace_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = C.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return replace_partition(base, base.where("o_custkey % 10 = 0").select("o_custkey").distinct().withColumn("o_orderkey", F.lit(-1).cast("long")), "o_custkey")


@query("snk_09_insert_absent", f"SELECT c_custkey, c_name FROM customer UNION ALL SELECT k, n FROM ({_DELTA}) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def insert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_absent(_base(spark, sf_dir).select("c_custkey", "c_name"), _delta(spark, sf_dir).select("c_custkey", "c_name"), ["c_custkey"])


@query("snk_10_append_items", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id) AS items FROM events GROUP BY user_id")
def append_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events appended to the lists of the others."""
    e = C.table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("late"))
    lists = lambda d: d.groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("items"))
    a = append_items(lists(e.where("not late")), lists(e.where("late")), "user_id", "items")
    return a.select("user_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("snk_11_nested_update", "SELECT conv_id, string_agg(turn || ':' || CASE WHEN turn = 2 THEN 9.5 ELSE 1.0 END, ',' ORDER BY turn) AS times, count(*) AS n FROM conversations GROUP BY conv_id")
def nested_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element of an array of structs changed in place (SNK-11, SNK-12)."""
    g = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.lit(1.0).alias("seconds")))).alias("t"))
    new = F.transform("t", lambda x: F.when(x["turn"] == 2, x.withField("seconds", F.lit(9.5))).otherwise(x))
    return g.select("conv_id", F.array_join(F.transform(new, lambda x: F.concat_ws(":", x["turn"], x["seconds"].cast("decimal(3,1)"))), ",").alias("times"), F.size("t").cast("long").alias("n"))


@query("snk_18_audit", "SELECT event_id, event_type FROM events WHERE lower(coalesce(event_type, 'information')) IN ('error', 'critical')")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "events").where(F.lower(F.coalesce("event_type", F.lit("information"))).isin("error", "critical")).select("event_id", "event_type")


@query("snk_14_points", "SELECT 'f' || doc_id AS file_id, source AS conv, md5('f' || doc_id || ':1.1') AS check_id, length(text) > 0 AS embedded FROM documents")
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector rows before a write: keys and the flag that a file has something to embed."""
    return C.table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), "doc_id").alias("file_id"), F.col("source").alias("conv"), F.md5(F.concat(F.lit("f"), "doc_id", F.lit(":1.1"))).alias("check_id"), (F.length("text") > 0).alias("embedded"))


# --- what aggregation pipelines of a document store become ------------------------------------------------------------------------


@query("src_21_pipeline", "SELECT o_orderpriority AS _id, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS total, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('O', 'F') GROUP BY 1")
def pipeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match and group."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    found = C.table(spark, sf_dir, "orders").where((price > 1000) & F.col("o_orderstatus").isin("O", "F"))
    return found.groupBy(F.col("o_orderpriority").alias("_id")).agg(F.sum(price).cast("decimal(18,2)").alias("total"), F.count(F.lit(1)).alias("n"))


@query("src_21_lookup", "SELECT c.c_custkey, count(o.o_orderkey) AS orders, coalesce(string_agg(o.o_orderkey::VARCHAR, ',' ORDER BY o.o_orderkey), '') AS keys FROM (SELECT * FROM customer WHERE c_acctbal > 0) c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-up of an array: each customer with its orders, none as an empty one; grouped before the join, so a customer meets one row."""
    orders = C.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    a = C.table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey").join(orders, "c_custkey", "left").withColumn("o", F.coalesce("o", F.array().cast("array<bigint>")))
    return a.select("c_custkey", F.size("o").cast("long").alias("orders"), F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("keys"))


@query("src_21_unwind_sort_skip", "SELECT word, n FROM (SELECT unnest(string_split(p_name, ' ')) AS word, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, word LIMIT 10 OFFSET 3")
def unwind_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwind, count, sort, skip and limit."""
    words = C.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").offset(3).limit(10)

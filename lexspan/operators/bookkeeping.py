"""Costs, prices, prompts and workbenches (BKP)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import contract as C
from ..registry import query

_COSTS = "SELECT user_id % 50 AS batch_id, user_id AS file_id, event_type AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events"
_PRICES = {"view": 1.0, "click": 2.5, "purchase": 10.0}


def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, file_id, model, tokens): one row a model call."""
    e = C.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("batch_id"), F.col("user_id").alias("file_id"), F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


@query("bkp_01_call_costs", f"SELECT batch_id, file_id, model, tokens, round(coalesce(tokens / 1000000.0 * rate, 0), 9)::DOUBLE AS cost, count(*) AS n FROM ({_COSTS}) LEFT JOIN (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in _PRICES.items())}) p(model, rate) USING (model) GROUP BY ALL")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens times the model's rate, 0 without a price; the prices are a literal map (BKP-01, BKP-03)."""
    rate = F.create_map(*[F.lit(x) for kv in _PRICES.items() for x in kv])[F.col("model")]
    a = cost_rows(spark, sf_dir).withColumn("cost", F.round(F.coalesce(F.col("tokens") / 1000000.0 * rate, F.lit(0.0)), 9))
    return a.groupBy("batch_id", "file_id", "model", "tokens", "cost").agg(F.count(F.lit(1)).alias("n"))


@query("bkp_02_cost_rollup", f"SELECT batch_id, file_id, sum(tokens)::BIGINT AS tokens, count(*) AS calls FROM ({_COSTS}) GROUP BY ROLLUP (batch_id, file_id)")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by file, by batch and in all, in one pass."""
    return cost_rows(spark, sf_dir).rollup("batch_id", "file_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


#: Parts stand for prompts and their brands for document types; one brand is that of classification.
_KINDS = ("Attribute", "Clause", "Obligation")
_TYPES = "SELECT p_partkey AS prompt_id, CASE p_brand WHEN 'Brand#1' THEN 'Classification' WHEN 'Brand#2' THEN NULL ELSE p_brand END AS document_type, list_value('Attribute', 'Clause', 'Obligation')[p_size % 3 + 1] AS kind FROM part"
_PROMPTS_OF = f"SELECT document_type, prompt_id, kind FROM ({_TYPES}) WHERE document_type IS NOT NULL"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, document_type, kind): the library of prompts."""
    brand = F.when(F.col("p_brand") == "Brand#1", "Classification").when(F.col("p_brand") != "Brand#2", F.col("p_brand"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("p_size") % 3 + 1)
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt_id"), brand.alias("document_type"), kind.alias("kind"))


def prompt_maps(library: DataFrame) -> DataFrame:
    """(document_type, prompt_ids): which prompts a document type has, as one row a type."""
    return library.groupBy("document_type").agg(F.sort_array(F.collect_list("prompt_id")).alias("prompt_ids"))


def prompts_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_type, prompt_id, kind) by two look-ups: a type's prompt ids, then each prompt; a type without a name has none."""
    library = prompts(spark, sf_dir)
    each = prompt_maps(library).where("document_type is not null").select("document_type", F.explode("prompt_ids").alias("prompt_id"))
    return each.join(library.select("prompt_id", "kind"), "prompt_id").select("document_type", "prompt_id", "kind")


@query("bkp_04_prompts_by_type", f"SELECT document_type, prompt_id, kind FROM ({_PROMPTS_OF}) WHERE kind IN ('Attribute', 'Clause')")
def prompts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute and clause prompts of each document type (BKP-04, 05)."""
    return prompts_of_types(spark, sf_dir).where("kind in ('Attribute', 'Clause')")


@query("bkp_07_document_types", f"SELECT document_type, count(*) AS prompts FROM ({_TYPES}) WHERE document_type IS DISTINCT FROM 'Classification' GROUP BY document_type")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document types but Classification; the one without a name stays."""
    return prompt_maps(prompts(spark, sf_dir)).where(~F.col("document_type").eqNullSafe("Classification")).select("document_type", F.size("prompt_ids").cast("long").alias("prompts"))


@query("bkp_08_open_columns", "SELECT conv_id, string_agg(label, ',' ORDER BY turn) AS open FROM (SELECT conv_id, turn, role || turn AS label FROM conversations WHERE conv_id % 4 = 0 OR turn % 2 = 1) GROUP BY conv_id")
def open_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbench columns still to do: all of a queued file, else those not processed yet."""
    col = F.struct("turn", F.concat("role", "turn").alias("label"), (F.col("turn") % 2 == 0).alias("done"))
    bench = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(col)).alias("c"))
    todo = F.when(F.col("conv_id") % 4 == 0, F.col("c")).otherwise(F.filter("c", lambda x: ~x["done"]))
    return bench.select("conv_id", F.array_join(F.transform(todo, lambda x: x["label"]), ",").alias("open")).where("open <> ''")


@query("bkp_10_first_answer", "SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def first_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("turn"))

"""Threads, histories and barriers (CNV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import contract as C
from ..registry import query


@query("cnv_02_barrier", "SELECT source AS conv, count(*) FILTER (doc_id % 7 IN (0, 1)) AS waiting, count(*) FILTER (doc_id % 7 IN (0, 1)) = 0 AS ready FROM documents GROUP BY source")
def barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose files are all past the queue."""
    n = F.count(F.when((F.col("doc_id") % 7).isin(0, 1), 1))
    return C.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("conv")).agg(n.alias("waiting"), (n == 0).alias("ready"))


#: Every seventh turn stands for an answer that failed.
_STATUS = "CASE WHEN turn % 7 = 5 THEN 'Failed' ELSE 'Processed' END"


@query(
    "cnv_03_history",
    f"""SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'assistant: ' || CASE WHEN length(text) > 800 THEN left(text, 800) || '…' ELSE text END ELSE 'human: ' || text END, chr(10) ORDER BY turn) AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS now FROM conversations)
        WHERE role IN ('user', 'assistant') AND {_STATUS} = 'Processed' AND turn IS DISTINCT FROM now) WHERE n <= 20 GROUP BY conv_id""",
)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty messages of each conversation that are done, without the answer in the making (its last), long answers cut at 800 characters."""
    now = C.table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("now"))
    done = C.table(spark, sf_dir, "conversations").where(f"role in ('user', 'assistant') and {_STATUS} = 'Processed'").join(now, "conv_id", "left").where("not (turn <=> now)")
    a = done.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n <= 20")
    cut = F.when(F.length("text") > 800, F.concat(F.substring("text", 1, 800), F.lit("…"))).otherwise(F.col("text"))
    line = F.when(F.col("role") == "assistant", F.concat(F.lit("assistant: "), cut)).otherwise(F.concat(F.lit("human: "), "text"))
    return a.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


@query("cnv_05_thread", "SELECT conv_id, turn, role, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS created FROM conversations")
def thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("created"))


@query("cnv_07_new_elements", "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n > 10")
def new_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress messages after the first ten that a listener has seen."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return C.table(spark, sf_dir, "events").select("user_id", "event_id", n.alias("n")).where("n > 10")


@query("cnv_10_reembed_totals", "SELECT source AS conv, 'f' || doc_id AS file_id, sum(len(string_split(text, chr(10))))::BIGINT AS n FROM documents GROUP BY ROLLUP (source, doc_id) HAVING GROUPING(source) = 0")
def reembed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by file and in all for each conversation."""
    d = C.table(spark, sf_dir, "documents").select(F.col("source").alias("conv"), F.concat(F.lit("f"), "doc_id").alias("file_id"), F.size(F.split("text", "\n")).alias("k"))
    return d.rollup("conv", "file_id").agg(F.sum("k").alias("n"), F.grouping("conv").alias("g")).where("g = 0").drop("g")


@query("cnv_13_pairs", "SELECT conv_id, turn, next AS answer_turn FROM (SELECT conv_id, turn, role, lead(turn) OVER w AS next, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with the answer right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("turn").over(w).alias("answer_turn"), F.lead("role").over(w).alias("next_role"))
    return a.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "answer_turn")


@query("cnv_14_components", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'chart' ELSE 'text' END AS kind, CASE turn % 4 WHEN 3 THEN 'plain' WHEN 0 THEN 'hi' END AS content FROM conversations")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer content as typed components: JSON by its type, anything else as text (CNV-12, CNV-14)."""
    k = F.col("turn") % 4
    raw = F.when(k == 0, '{"type":"text","content":"hi"}').when(k == 1, '{"type":"table","rows":[["a","1"]]}').when(k == 2, '{"type":"chart","chartType":"bar"}').otherwise("plain")
    c = F.from_json("raw", "type string, content string, rows array<array<string>>, chartType string")
    good = c["type"].isin("text", "table", "chart", "html")
    a = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return a.select("conv_id", "turn", F.when(good, c["type"]).otherwise("text").alias("kind"), F.when(good, c["content"]).otherwise(F.col("raw")).alias("content"))

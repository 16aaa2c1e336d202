"""Vector search, readiness, file facts, citations of answers and the playbook (RET, PLB)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import contract as C
from ..plans.sql import oracle
from ..registry import query

TOP_K, LEAST_SCORE = 20, 0.35
#: Vectors of one question: its own and its expansions.
SEVERAL = (0, 1, 2)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(points: DataFrame, query_vector: list[float], k: int) -> DataFrame:
    """The k points of largest cosine in each label, ties by id: a window group limit, so each task keeps k rows a label before the shuffle."""
    score = F.round(cosine(F.col("embedding"), F.lit(query_vector).cast("array<double>")), 6)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return points.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k)


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(C.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


_COS = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)"


@query("ret_06_vector_top_k", f"SELECT label, vec_id, rank FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= {TOP_K}")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), TOP_K).select("label", "vec_id", "rank")


@query("ret_07_multi_query", f"SELECT label, vec_id, arg_max(q, {{'s': s, 'q': -q}}) AS won_by, CAST(count(*) AS BIGINT) AS n FROM (SELECT q.vec_id AS q, e.label, e.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (0, 1, 2)) q) WHERE rank <= {TOP_K} GROUP BY label, vec_id HAVING max(s) >= {LEAST_SCORE}")
def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each point over several question vectors; weak points go. The vectors are a literal array, so the points are read once."""
    p = C.table(spark, sf_dir, "embeddings")
    asked = [(r["vec_id"], list(r["embedding"])) for r in p.where(F.col("vec_id").isin(*SEVERAL)).orderBy("vec_id").collect()]  # as many rows as SEVERAL at most
    rows = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.round(cosine(F.col("embedding"), F.lit(v).cast("array<double>")), 6).alias("score")) for q, v in asked])
    each = p.select("label", "vec_id", F.inline(rows))
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("q", "label").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= TOP_K)
    g = top.groupBy("label", "vec_id").agg(F.max("score").alias("s"), F.max_by("q", F.struct("score", -F.col("q"))).alias("won_by"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("s") >= LEAST_SCORE).select("label", "vec_id", "won_by", "n")


@query("ret_01_readiness", "SELECT label, count(*) > 0 AS ready, count(*) AS n FROM embeddings GROUP BY label")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "embeddings").groupBy("label").agg((F.count(F.lit(1)) > 0).alias("ready"), F.count(F.lit(1)).alias("n"))


@query("ret_03_file_meta", oracle("SELECT file_id, role, role_rank, effective_date FROM files"))
def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(spark, sf_dir).select("file_id", "role", "role_rank", "effective_date")


@query("ret_04_unindexed_files", oracle("SELECT file_id, '__raw_p' || page AS section_id, md5(string_agg(line, chr(10) ORDER BY p)) AS content_md5 FROM lines WHERE file_id NOT IN (SELECT file_id FROM sections WHERE doc_id % 3 <> 0) GROUP BY file_id, page HAVING trim(string_agg(line, chr(10) ORDER BY p)) <> ''"))
def unindexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages stand in for files without sections (here: of every third file the index is missing)."""
    have = C.sections(spark, sf_dir).where("doc_id % 3 <> 0").select("file_id").distinct()
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    pages = C.lines(spark, sf_dir).join(have, "file_id", "left_anti").groupBy("file_id", "page").agg(text.alias("t")).where("trim(t) <> ''")
    return pages.select("file_id", F.concat(F.lit("__raw_p"), "page").alias("section_id"), F.md5("t").alias("content_md5"))


@query("ret_29_citations", oracle("SELECT c.conv, c.n AS source, f.file_id, f.file_name FROM (SELECT source AS conv, unnest([1, 3, 99]) AS n FROM (SELECT DISTINCT source FROM documents)) c JOIN (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY doc_id) AS n FROM files) f ON f.conv = c.conv AND f.n = c.n"))
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source numbers of an answer (JSON) with what they stand for; unknown numbers go."""
    said = F.from_json(F.lit('{"citations": [{"sourceIndex": 1}, {"sourceIndex": 3}, {"sourceIndex": 99}]}'), "citations array<struct<sourceIndex: bigint>>")
    f = C.files(spark, sf_dir)
    numbered = f.withColumn("source", F.row_number().over(Window.partitionBy("conv").orderBy("doc_id")))
    asked = f.select("conv").distinct().select("conv", F.explode(said["citations"]["sourceIndex"]).alias("source"))
    return asked.join(numbered, ["conv", "source"]).select("conv", "source", "file_id", "file_name")


#: Categories of the playbook's entries by label, and the words of the one asked for.
CATEGORIES, ASKED_CATEGORY = ["payment terms", "limits of liability", "terms of payment", "audit rights", "data transfer"], "payment terms"
_CATEGORY = "list_value(" + ", ".join(f"'{c}'" for c in CATEGORIES) + f")[label % {len(CATEGORIES)} + 1]"


@query("plb_01_playbook_top_k", f"SELECT vec_id, category, rank FROM (SELECT e.vec_id, {_CATEGORY} AS category, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label % 3 IN (0, 2) AND list_has_all(string_split({_CATEGORY}, ' '), ['payment', 'terms'])) WHERE rank <= 5")
def playbook_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest entries for critical functions or both (label mod 3: 0 CIF, 1 Non CIF, 2 Both) whose category has all words asked for: a sort limit, k rows a task."""
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("label") % len(CATEGORIES) + 1)
    p = C.table(spark, sf_dir, "embeddings").where("label % 3 in (0, 2)").withColumn("category", category)
    p = p.where(F.size(F.array_except(F.array(*map(F.lit, ASKED_CATEGORY.split())), F.split("category", " "))) == 0)
    score = F.round(cosine(F.col("embedding"), F.lit(_vector(spark, sf_dir, 0)).cast("array<double>")), 6)
    best = p.select("vec_id", "category", score.alias("s")).orderBy(F.desc("s"), "vec_id").limit(5)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "vec_id"))).select("vec_id", "category", "rank")


@query("plb_04_categories", "SELECT DISTINCT 'category ' || label AS category FROM embeddings WHERE label % 3 IN (0, 2)")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "embeddings").where("label % 3 in (0, 2)").select(F.concat(F.lit("category "), "label").alias("category")).distinct()

"""Measures of models, and the offline defaults of model steps (MLE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import contract as C
from ..registry import query
from .neighbours import asked_vectors, nearest
from .retrieval import _COS

_PREDICTED = "SELECT l.quality AS label, CASE WHEN length(d.text) - length(replace(replace(d.text, '!', ''), '*', '')) > 20 THEN 0 ELSE 1 END AS guess FROM labels l JOIN documents d USING (doc_id)"


def accuracy(rows: DataFrame, label: str, guess: str) -> DataFrame:
    """Share of right guesses overall (label null) and by label, in one pass."""
    right = F.avg((F.col(label) == F.col(guess)).cast("double"))
    return rows.rollup(label).agg(F.round(right, 6).alias("accuracy"), F.count(F.lit(1)).alias("n")).withColumnRenamed(label, "label")


@query("mle_05_accuracy", f"SELECT label, round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, count(*) AS n FROM ({_PREDICTED}) GROUP BY ROLLUP (label)")
def accuracy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marks-based guess of quality against the labels."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") - F.length(F.replace(F.replace("text", F.lit("!"), F.lit("")), F.lit("*"), F.lit(""))) > 20, 0).otherwise(1).alias("guess"))
    return accuracy(C.table(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "guess")


@query("mle_06_ranking", f"WITH r AS (SELECT q.vec_id AS q, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id) SELECT q, coalesce(round(1.0 / min(CASE WHEN hit THEN rank END), 6), 0)::DOUBLE AS reciprocal, round(sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END), 6)::DOUBLE AS dcg FROM r WHERE rank <= 10 GROUP BY q")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank and discounted gain at 10 of every hundredth vector as a question against all vectors; same label counts as relevant. The index of cells finds the
    nearest, exactly: its bounds say which cells may be left out."""
    e = C.table(spark, sf_dir, "embeddings")
    labels = e.select(F.col("vec_id").alias("q"), F.col("label").alias("ql"))
    top = nearest(e, asked_vectors(e), 10, exact=True).join(labels, "q")
    hit = F.col("label") == F.col("ql")
    return top.groupBy("q").agg(F.coalesce(F.round(1.0 / F.min(F.when(hit, F.col("rank"))), 6), F.lit(0.0)).alias("reciprocal"), F.round(F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias("dcg"))


def embed(text: Column, size: int = 64) -> Column:
    """The default encoder: a hashed bag of words of unit length (MLE-01)."""
    slots = F.transform(X.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(counts, lambda v: F.when(norm > 0, v / norm).otherwise(0.0))


def overlap_score(question: Column, text: Column) -> Column:
    """The default pair scorer: the share of the question's words that the text has (MLE-02)."""
    q = X.tokens(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, X.tokens(text))) / F.size(q)).otherwise(0.0)


@query("mle_02_overlap_scores", "SELECT doc_id, round(len(list_intersect(['the', 'license', 'of'], list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')))) / 3.0, 6)::DOUBLE AS score FROM documents")
def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select("doc_id", F.round(overlap_score(F.lit("the license of"), F.col("text")), 6).alias("score"))

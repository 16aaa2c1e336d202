"""A classifier of sections that is trained, kept and applied (PRS-22, MLE-04): hashed words of title and start, logistic regression, early stop on accuracy."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import contract as C
from ..registry import query
from .evaluation import accuracy

# The characters of a section that are read, what stands between title and text, and the share held out.
START, BETWEEN, HELD_OUT = 300, " [SEP] ", 0.1
FEATURES, STEPS, LEAST_GAIN = 1 << 12, (5, 10, 20, 40), 0.001


def section_text(title: Column, content: Column) -> Column:
    """What a classifier reads of a section; without a title only the text."""
    start = F.substring(F.coalesce(content, F.lit("")), 1, START)
    return F.when(F.coalesce(F.trim(title), F.lit("")) != "", F.concat(F.trim(title), F.lit(BETWEEN), start)).otherwise(start)


def held_out(*key: Column) -> Column:
    """A tenth of the rows, by a hash of their key: with enough rows a tenth of each label as well, without a sort or a draw."""
    return F.pmod(F.xxhash64(*key), F.lit(1000)) < 1000 * HELD_OUT


def featured(rows: DataFrame) -> DataFrame:
    """rows with text, as features: hashed counts of words in lower case."""
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern="[^\\p{L}\\p{N}_]+", minTokenLength=1)
    return HashingTF(inputCol="_words", outputCol="features", numFeatures=FEATURES).transform(words.transform(rows)).drop("_words")


def train(rows: DataFrame) -> tuple[PipelineModel, list[tuple[int, float]]]:
    """rows (text, label, held_out): the model of the step with the best accuracy on what is held out, and (steps, accuracy) as far as it went:
    more steps are tried until they gain less than LEAST_GAIN."""
    f = featured(rows).select("features", F.col("label").cast("double").alias("label"), "held_out").cache()
    try:
        best, history = None, []
        for steps in STEPS:
            model = LogisticRegression(maxIter=steps, regParam=0.01, standardization=False).fit(f.where("not held_out"))
            right = model.transform(f.where("held_out")).agg(F.coalesce(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.lit(0.0))).first()[0]
            gain = right - (history[-1][1] if history else -1)
            history.append((steps, right))
            if best is None or gain > 0:
                best = model
            if gain < LEAST_GAIN:
                break
        return PipelineModel([best]), history
    finally:
        f.unpersist()


def classified(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with text, with guess and confidence, that of the guessed label."""
    out = model.transform(featured(rows))
    return out.withColumns({"guess": F.col("prediction").cast("int"), "confidence": F.round(F.array_max(vector_to_array("probability")), 6)}).drop("features", "rawPrediction", "probability", "prediction")


def labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, section_id, text, label, held_out) of all sections; label: what the labels say of the document's quality, null where they say nothing. A document's
    sections are held out together."""
    s = C.sections(spark, sf_dir).select("file_id", "section_id", "doc_id", section_text(F.col("title"), F.col("content")).alias("text"))
    told = C.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return s.join(told, "doc_id", "left").withColumn("held_out", held_out(F.col("doc_id")))


@query("prs_22_section_classes")
@C.parse_once
def section_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and its confidence for every section, by a model that the labelled ones taught."""
    rows = labelled_sections(spark, sf_dir)
    model, _ = train(rows.where("label is not null"))
    return classified(rows, model).select("file_id", "section_id", "label", "held_out", "guess", "confidence")


@query("mle_04_held_out_accuracy")
@C.parse_once
def held_out_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of that model on what was held out, overall and by label."""
    rows = labelled_sections(spark, sf_dir).where("label is not null")
    model, _ = train(rows)
    return accuracy(classified(rows.where("held_out"), model), "label", "guess")

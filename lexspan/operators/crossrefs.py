"""References between clauses: extraction, hints and ordered resolution (XRF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import HINT_FILES, HINT_STOP_WORDS
from ..plans import contract as C
from ..plans import fixed as S
from ..plans.sql import lit, oracle, parent
from ..registry import query


@query("xrf_01_references", oracle("SELECT conv, file_id, section_id, ref, hint AS ref_doc_hint FROM crossrefs"))
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised references of each section but to itself, with the document that the text behind the first of each names (XRF-01, 02, 04)."""
    return C.crossrefs(spark, sf_dir).select("conv", "file_id", "section_id", "ref", F.col("hint").alias("ref_doc_hint"))


@query("xrf_03_parent_refs", oracle(f"SELECT DISTINCT ref, {parent('ref')} AS parent_ref FROM crossrefs"))
def parent_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.crossrefs(spark, sf_dir).select("ref", X.parent_id(F.col("ref")).alias("parent_ref")).distinct()


def _useful(text: Column) -> Column:
    return F.array_except(X.words(text), F.array(*[F.lit(w) for w in HINT_STOP_WORDS]))


def hint_files(hints: DataFrame, files: DataFrame) -> DataFrame:
    """hints (conv, hint): (conv, hint, to_file, to_doc, shared, rank) of the HINT_FILES files of the conversation whose names share most words
    with the hint, by order among equals; of the first files where none shares a word (XRF-05). Hints with the same words are looked up once."""
    keyed = hints.distinct().withColumn("key", F.array_join(F.sort_array(_useful(F.col("hint"))), " "))
    asked = keyed.select("conv", "key").distinct()
    named = files.select("conv", F.col("file_id").alias("to_file"), F.col("doc_id").alias("to_doc"), F.explode(_useful(F.col("file_name"))).alias("word"))
    met = asked.select("conv", "key", F.explode(F.split("key", " ")).alias("word")).join(named, ["conv", "word"]).groupBy("conv", "key", "to_file", "to_doc").agg(F.count(F.lit(1)).alias("shared"))
    rank = lambda *order: F.row_number().over(Window.partitionBy(*order[0]).orderBy(*order[1]))
    best = met.withColumn("rank", rank(["conv", "key"], [F.desc("shared"), "to_doc"])).where(F.col("rank") <= HINT_FILES)
    first = files.select("conv", F.col("file_id").alias("to_file"), F.col("doc_id").alias("to_doc"), F.lit(0).cast("long").alias("shared"), rank(["conv"], ["doc_id"]).alias("rank")).where(F.col("rank") <= HINT_FILES)
    strange = asked.join(best.select("conv", "key"), ["conv", "key"], "left_anti").join(first, "conv")
    return keyed.join(best.unionByName(strange), ["conv", "key"]).drop("key")


_NAMED = lambda x: f"list_filter(list_distinct(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+')), lambda w: w NOT IN ({', '.join(map(lit, S.HINT_STOP_WORDS))}, ''))"
HINTED = f"""
    SELECT conv, hint, to_file, to_doc, shared, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY conv, hint ORDER BY shared DESC, to_doc) AS rank, max(shared) OVER (PARTITION BY conv, hint) AS most
        FROM (SELECT h.conv, h.hint, f.file_id AS to_file, f.doc_id AS to_doc, len(list_intersect({_NAMED("h.hint")}, {_NAMED("f.file_name")})) AS shared
              FROM (SELECT DISTINCT conv, hint FROM crossrefs WHERE hint IS NOT NULL) h JOIN files f USING (conv)))
    WHERE rank <= 3 AND (shared > 0 OR most = 0)"""


@query("xrf_05_hint_files", oracle("SELECT conv, hint, to_file, shared, rank FROM hinted", hinted=HINTED))
@C.parse_once
def hint_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each hint of a conversation stands for, best first."""
    hints = C.crossrefs(spark, sf_dir).where("hint is not null").select("conv", "hint")
    return hint_files(hints, C.files(spark, sf_dir)).drop("to_doc")


def _targets(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, id, to_file, to_doc, to_section, stage): what an id stands for in each file, the section with it (0), else its first child (1); and the sections alone."""
    s = sections.select("conv", F.col("file_id").alias("to_file"), F.col("doc_id").alias("to_doc"), F.col("section_id").alias("to_section"))
    child = s.where(F.col("to_section").contains(".")).withColumn("id", X.parent_id(F.col("to_section")))
    child = child.where("id is not null").groupBy("conv", "id", "to_file", "to_doc").agg(F.min("to_section").alias("to_section"))
    offers = s.withColumn("id", F.col("to_section")).withColumn("stage", F.lit(0)).unionByName(child.withColumn("stage", F.lit(1)))
    return offers.groupBy("conv", "id", "to_file", "to_doc").agg(F.min_by("to_section", "stage").alias("to_section"), F.min("stage").alias("stage")), s


def _resolve_hinted(refs: DataFrame, in_file: DataFrame, s: DataFrame, files: DataFrame) -> DataFrame:
    """References with a hint: the files it stands for in their order, then the parent's id in the same files; nothing elsewhere."""
    asked = refs.join(hint_files(refs.select("conv", "hint"), files).select("conv", "hint", "to_file", "rank"), ["conv", "hint"])
    asked = asked.join(in_file.select("conv", F.col("id").alias("ref"), "to_file", F.col("to_section").alias("own")), ["conv", "ref", "to_file"], "left")
    asked = asked.join(s.select("conv", F.col("to_section").alias("parent"), "to_file", F.col("to_section").alias("up")), ["conv", "parent", "to_file"], "left")
    offer = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("rank", "to_file", F.col(c).alias("to_section"))))
    best = asked.groupBy("conv", "file_id", "section_id", "ref", "hint").agg(F.coalesce(offer("own"), offer("up")).alias("t"))
    return best.select("conv", "file_id", "section_id", "ref", "hint", "t.to_file", "t.to_section")


def resolve(refs: DataFrame, sections: DataFrame, files: DataFrame) -> DataFrame:
    """refs (conv, file_id, section_id, ref, hint) with the target. With a hint: as in _resolve_hinted. Without: own file first, then the others by order; in each
    file the exact id, else its first child; the parent's id only if no file has either. Targets join by conversation and id, never file by file."""
    in_file, s = _targets(sections)
    refs = refs.withColumn("parent", X.parent_id(F.col("ref")))
    # one target for each (conversation, id) outside the own file is enough: the first by order, and the own file's
    anywhere = in_file.groupBy("conv", "id").agg(F.min_by(F.struct("to_file", "to_section"), "to_doc").alias("t"))
    exact = s.groupBy("conv", F.col("to_section").alias("id")).agg(F.min_by(F.struct("to_file", "to_section"), "to_doc").alias("t"))
    own = in_file.select("conv", F.col("id").alias("ref"), F.col("to_file").alias("file_id"), F.col("to_section").alias("own"))
    j = refs.where("hint is null").join(own, ["conv", "ref", "file_id"], "left").join(anywhere.select("conv", F.col("id").alias("ref"), F.col("t").alias("other")), ["conv", "ref"], "left")
    own_up = s.select("conv", F.col("to_section").alias("parent"), F.col("to_file").alias("file_id"), F.col("to_section").alias("own_up"))
    j = j.join(own_up, ["conv", "parent", "file_id"], "left").join(exact.select("conv", F.col("id").alias("parent"), F.col("t").alias("up")), ["conv", "parent"], "left")
    target = (
        F.when(F.col("own").isNotNull(), F.struct(F.col("file_id").alias("to_file"), F.col("own").alias("to_section")))
        .when(F.col("other").isNotNull(), F.col("other"))
        .when(F.col("own_up").isNotNull(), F.struct(F.col("file_id").alias("to_file"), F.col("own_up").alias("to_section")))
        .otherwise(F.col("up"))
    )
    plain = j.select("conv", "file_id", "section_id", "ref", "hint", target.alias("t")).select("conv", "file_id", "section_id", "ref", "hint", "t.to_file", "t.to_section")
    return plain.unionByName(_resolve_hinted(refs.where("hint is not null"), in_file, s, files))


RESOLVED = f"""
    WITH hinted AS ({HINTED}),
    hits AS (
        SELECT r.file_id, r.section_id, r.ref, c.to_file, c.to_section,
               row_number() OVER (PARTITION BY r.file_id, r.section_id, r.ref ORDER BY pass, coalesce(h.rank, CASE WHEN c.to_file = r.file_id THEN 0 ELSE 1 END), c.to_doc, c.stage, c.to_section) AS n
        FROM (SELECT *, {parent('ref')} AS up FROM crossrefs) r
        JOIN (SELECT conv, section_id AS id, file_id AS to_file, doc_id AS to_doc, section_id AS to_section, 0 AS stage, 0 AS pass FROM sections
              UNION ALL SELECT conv, {parent('section_id')}, file_id, doc_id, section_id, 1, 0 FROM sections WHERE contains(section_id, '.')
              UNION ALL SELECT conv, 'up:' || section_id, file_id, doc_id, section_id, 0, 1 FROM sections) c
        ON c.conv = r.conv AND (c.id = r.ref OR c.id = 'up:' || r.up)
        LEFT JOIN hinted h ON h.conv = r.conv AND h.hint = r.hint AND h.to_file = c.to_file
        WHERE r.hint IS NULL OR h.rank IS NOT NULL)
    SELECT r.conv, r.file_id, r.section_id, r.ref, r.hint, h.to_file, h.to_section FROM crossrefs r LEFT JOIN (SELECT * FROM hits WHERE n = 1) h USING (file_id, section_id, ref)"""


@query("xrf_07_resolved", oracle("SELECT * FROM resolved", resolved=RESOLVED))
@C.parse_once
@C.once
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference with its target section, if any: by the document it names, or by its own file first (XRF-06, XRF-07)."""
    return resolve(C.crossrefs(spark, sf_dir).drop("doc_id"), C.sections(spark, sf_dir), C.files(spark, sf_dir))


@query("xrf_07_unresolved_summary", oracle("SELECT ref, count(*) AS n FROM resolved WHERE to_file IS NULL GROUP BY ref", resolved=RESOLVED))
@C.parse_once
def unresolved_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).where("to_file is null").groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


@query("xrf_08_resolved_sections", oracle("SELECT s.file_id, s.section_id, s.clause_type FROM sections s SEMI JOIN resolved r ON s.file_id = r.to_file AND s.section_id = r.to_section", resolved=RESOLVED))
@C.parse_once
def resolved_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that others point to (XRF-08, XRF-09)."""
    t = resolved(spark, sf_dir).select(F.col("to_file").alias("file_id"), F.col("to_section").alias("section_id"))
    return C.sections(spark, sf_dir).join(t, ["file_id", "section_id"], "left_semi").select("file_id", "section_id", "clause_type")

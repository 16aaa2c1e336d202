"""People, organisations and references of files: names, groups of aliases, lookups and threads (ENT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans import contract as C
from ..plans.sql import lit, oracle
from ..registry import query

_NAMES = ["Mainstay Asia Ltd", "Mainstay HK", "The Mainstay (HK) Limited", "Eames Consulting Limited", "Asia Group", "AIAIM"]
_BAGS = f"SELECT conv, file_id, doc_id, person, org, {{names}}[doc_id % {len(_NAMES)} + 1] AS alias, 'WO-' || (doc_id % 7) AS reference, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'PRJ ' || (doc_id % 9) END AS project FROM files".replace("{names}", "[" + ", ".join(map(lit, _NAMES)) + "]")
INDEX = """
    SELECT conv, file_id, doc_id, kind, value, trim(regexp_replace(regexp_replace(lower(value), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM (
        SELECT conv, file_id, doc_id, 'person' AS kind, person AS value FROM bags UNION ALL SELECT conv, file_id, doc_id, 'organization', org FROM bags UNION ALL
        SELECT conv, file_id, doc_id, 'organization', alias FROM bags UNION ALL SELECT conv, file_id, doc_id, 'agreement_ref', reference FROM bags UNION ALL
        SELECT conv, file_id, doc_id, 'project_code', project FROM bags) WHERE trim(value) <> ''"""
FRAMES = {"bags": _BAGS, "entity_index": INDEX}


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extraction gives for each file: arrays of entities by kind."""
    alias = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    project = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("PRJ "), F.col("doc_id") % 9))
    return C.files(spark, sf_dir).select("conv", "file_id", "doc_id", F.array("person").alias("person"), F.array(F.col("org"), alias).alias("organization"), F.array(F.concat(F.lit("WO-"), F.col("doc_id") % 7)).alias("agreement_ref"), F.array(project).alias("project_code"))


def entity_index(bag: DataFrame) -> DataFrame:
    """A row for each filled value (ENT-05): one pass with a generator, no union of scans."""
    kinds = ("person", "organization", "agreement_ref", "project_code")
    each = F.concat(*[F.transform(F.col(k), _tagged(k)) for k in kinds])
    a = bag.select("conv", "file_id", "doc_id", F.inline(each)).where(F.trim("value") != "")
    return a.withColumn("key", X.normalize_name(F.col("value")))


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_index(bags(spark, sf_dir))


@query("ent_05_entity_index", oracle("SELECT conv, file_id, kind, value, key FROM entity_index", **FRAMES))
def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity rows with normalised keys (ENT-01, ENT-05)."""
    return index(spark, sf_dir).drop("doc_id")


@query("ent_07_files_by_entity", oracle("SELECT DISTINCT conv, file_id FROM entity_index WHERE kind = 'organization' AND contains(key, 'mainstay')", **FRAMES))
def files_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).where((F.col("kind") == "organization") & F.col("key").contains("mainstay")).select("conv", "file_id").distinct()


@query("ent_08_entity_summary", oracle("SELECT conv, kind || ':' || key AS entity, count(DISTINCT file_id) AS n_files, string_agg(DISTINCT file_id, ',' ORDER BY file_id) AS files FROM entity_index GROUP BY ALL", **FRAMES))
def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = index(spark, sf_dir).groupBy("conv", F.concat_ws(":", "kind", "key").alias("entity")).agg(F.sort_array(F.collect_set("file_id")).alias("f"))
    return g.select("conv", "entity", F.size("f").cast("long").alias("n_files"), F.array_join("f", ",").alias("files"))


_THREAD = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.THREAD_ORDER.items()) + " ELSE 99 END"


@query("ent_09_person_documents", oracle(f"SELECT conv, person, file_id, row_number() OVER (PARTITION BY conv, person ORDER BY {_THREAD}, coalesce(effective_date, ''), doc_id) AS n FROM files"))
def person_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each person by role and date."""
    w = Window.partitionBy("conv", "person").orderBy(thread_order(), F.coalesce("effective_date", F.lit("")), "doc_id")
    return C.files(spark, sf_dir).select("conv", "person", "file_id", F.row_number().over(w).alias("n"))


def thread_order():
    return X.any_of([(F.col("role") == k, F.lit(v)) for k, v in P.THREAD_ORDER.items()], F.lit(99))


@query("ent_14_thread_text", oracle(f"SELECT conv, person, string_agg('[' || upper(role) || '] ' || file_name || coalesce(' (' || effective_date || ')', ''), chr(10) ORDER BY {_THREAD}, coalesce(effective_date, ''), doc_id) AS thread FROM files GROUP BY conv, person"))
def thread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), "file_name", F.coalesce(F.concat(F.lit(" ("), "effective_date", F.lit(")")), F.lit("")))
    rows = C.files(spark, sf_dir).select("conv", "person", F.struct(thread_order().alias("o"), F.coalesce("effective_date", F.lit("")).alias("d"), "doc_id", line.alias("line")).alias("r"))
    return rows.groupBy("conv", "person").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"]), "\n").alias("thread"))


_SUFFIX = "[" + ", ".join(map(lit, P.LEGAL_SUFFIXES)) + "]"
_WORDS = "list_filter(string_split(regexp_replace(regexp_replace(lower(trim(value)), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'the', 'a', 'an'))"
_STRONG = f"list_filter({_WORDS}, lambda w: NOT list_contains({_SUFFIX}, w) AND length(w) >= 3)"
ALIAS = f"CASE WHEN len({_STRONG}) > 0 THEN array_to_string({_STRONG}, ' ') ELSE array_to_string({_WORDS}, ' ') END"
GROUPS = f"SELECT conv, {ALIAS} AS alias_key, arg_min(kind, doc_id * 10 + CASE kind WHEN 'person' THEN 0 ELSE 1 END) AS kind, arg_max(value, {{'l': length(value), 'v': value}}) AS label, list_sort(list(DISTINCT value)) AS aliases, list_sort(list(DISTINCT file_id)) AS file_ids FROM entity_index WHERE kind IN ('person', 'organization') GROUP BY ALL"


def alias_groups(rows: DataFrame) -> DataFrame:
    """People and organisations grouped by alias key (ENT-10, ENT-11): type of the first seen, the longest name as label (of equals the last by text)."""
    seen = F.col("doc_id") * 10 + F.when(F.col("kind") == "person", 0).otherwise(1)
    g = rows.where("kind in ('person', 'organization')").groupBy("conv", X.alias_key(F.col("value")).alias("alias_key"))
    return g.agg(
        F.min_by("kind", seen).alias("kind"), F.max_by("value", F.struct(F.length("value"), F.col("value"))).alias("label"), F.sort_array(F.collect_set("value")).alias("aliases"), F.sort_array(F.collect_set("file_id")).alias("file_ids")
    )


@query("ent_11_alias_groups", oracle("SELECT conv, alias_key, kind, label, array_to_string(aliases, '|') AS aliases, CAST(len(file_ids) AS BIGINT) AS n_files FROM grouped", **FRAMES, grouped=GROUPS))
def alias_group_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias_groups(index(spark, sf_dir)).select("conv", "alias_key", "kind", "label", F.array_join("aliases", "|").alias("aliases"), F.size("file_ids").cast("long").alias("n_files"))


QUESTION = "what fee does mainstay asia pay to eames"


@query("ent_12_query_aliases", oracle(f"SELECT conv, string_agg(DISTINCT a, '|' ORDER BY a) AS names FROM (SELECT conv, unnest(aliases) AS a FROM grouped WHERE len(list_intersect(list_filter(regexp_split_to_array(lower(array_to_string(aliases, ' ')), '[^a-z0-9]+'), lambda w: length(w) >= 3), string_split({lit(QUESTION)}, ' '))) > 0) GROUP BY conv", **FRAMES, grouped=GROUPS))
def query_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of the entities that share a word of three letters or more with a question; the question is a literal."""
    asked = F.array(*[F.lit(w) for w in QUESTION.split() if len(w) >= 3])
    hit = alias_groups(index(spark, sf_dir)).where(F.arrays_overlap(X.tokens(F.array_join("aliases", " ")), asked))
    return hit.select("conv", F.explode("aliases").alias("a")).groupBy("conv").agg(F.array_join(F.sort_array(F.collect_set("a")), "|").alias("names"))


@query("ent_13_question_entity", oracle("SELECT conv, coalesce(min(key) FILTER (kind = 'person' AND contains('the fee of person 7 and mainstay', key)), min(key) FILTER (kind = 'organization' AND len(list_filter(string_split(key, ' '), lambda t: length(t) >= 3 AND contains('the fee of person 7 and mainstay', t))) > 0)) AS entity FROM entity_index GROUP BY conv", **FRAMES))
def question_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person a question names, else an organisation with a word in it."""
    q = F.lit("the fee of person 7 and mainstay")
    person = F.min(F.when((F.col("kind") == "person") & q.contains(F.col("key")), F.col("key")))
    token = F.exists(F.split("key", " "), lambda t: (F.length(t) >= 3) & q.contains(t))
    org = F.min(F.when((F.col("kind") == "organization") & token, F.col("key")))
    return index(spark, sf_dir).groupBy("conv").agg(F.coalesce(person, org).alias("entity"))

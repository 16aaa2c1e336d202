"""Further retrieval guards and injectors, relation helpers, lookups and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..plans import contract as C
from ..plans import fixed as S
from ..plans.sql import cases, lit, oracle
from ..registry import query



@query("ret_26_table_guard", f"SELECT doc_id, regexp_matches(text, '\\|[^|\\n]+\\|') AND regexp_matches(text, {lit(S.MONEY)}) AS needs_table FROM documents")
def table_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a piped row and a money or percent value, which a table model would rewrite."""
    t = F.col("text")
    return C.table(spark, sf_dir, "documents").select("doc_id", (t.rlike("\\|[^|\\n]+\\|") & t.rlike(P.MONEY)).alias("needs_table"))


_SAID = "see Source: Addendum 41, Page 2 and Source: Addendum 7, Page 1"


@query("ret_30_inline_citations", oracle(f"SELECT f.file_id, f.conv, n.page FROM files f JOIN (VALUES ('addendum 41', 2), ('addendum 7', 1)) n(name, page) ON contains(lower(f.file_name), n.name)"))
def inline_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and pages cited inside an answer, with the files that have the name."""
    found = F.regexp_extract_all(F.lit(_SAID), F.lit("Source: ([^,]+), Page [0-9]+"), F.lit(1))
    pages = F.regexp_extract_all(F.lit(_SAID), F.lit("Source: [^,]+, Page ([0-9]+)"), F.lit(1))
    each = F.explode(F.arrays_zip(found.alias("name"), pages.alias("page")))
    f = C.files(spark, sf_dir).select("file_id", "conv", F.lower("file_name").alias("n"), each.alias("c"))
    return f.where(F.col("n").contains(F.lower("c.name"))).select("file_id", "conv", F.col("c.page").cast("int").alias("page"))


@query("rel_01_role_fallback", oracle(f"SELECT file_id, {cases([('role_rank % 2 = 0', 'role')], cases([('doc_id % 3 = 0', lit('modification')), ('doc_id % 3 = 1', lit('transaction'))], lit('standalone')))} AS role FROM files"))
def role_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's role, or what its document type says where the role is missing."""
    kind = F.element_at(F.array(F.lit("amendment"), F.lit("work_order"), F.lit("agreement")), (F.col("doc_id") % 3 + 1).cast("int"))
    by_type = F.when(kind.isin("amendment", "addendum", "novation"), "modification").when(kind == "work_order", "transaction").when(kind == "termination_notice", "termination").when(kind == "framework", "master_agreement").otherwise("standalone")
    known = F.when(F.col("role_rank") % 2 == 0, F.col("role"))
    return C.files(spark, sf_dir).select("file_id", F.coalesce(known, by_type).alias("role"))


#: Letters of the pieces by which identifiers meet, and the least letters of an identifier.
GRAM = 4


def containing(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """refs (conv, file_id, key), ids (conv, master, doc_id, key): (conv, file_id, master), the first master by order of those with a key that holds the reference's, or is
    held by it; keys of fewer than GRAM letters match nothing.

    If one key holds the other, all pieces of GRAM letters of the shorter are pieces of the longer. So each key asks by its rarest piece among the pieces
    of the others, and what meets is compared: no key meets all masters of its conversation.
    """
    pieces = lambda df: df.where(F.length("key") >= GRAM).withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - GRAM + 1), lambda i: F.col("key").substr(i, F.lit(GRAM))))))
    short, long = pieces(refs.select("conv", "key").distinct()), pieces(ids.select("conv", F.col("key")).distinct())
    seldom = lambda df, other: df.join(other.groupBy("conv", "gram").agg(F.count(F.lit(1)).alias("n")), ["conv", "gram"]).groupBy("conv", "key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    held = seldom(short, long).select("conv", "gram", F.col("key").alias("ref_key")).join(long.withColumnRenamed("key", "id_key"), ["conv", "gram"])
    holds = seldom(long, short).select("conv", "gram", F.col("key").alias("id_key")).join(short.withColumnRenamed("key", "ref_key"), ["conv", "gram"])
    met = held.unionByName(holds).where(F.col("id_key").contains(F.col("ref_key")) | F.col("ref_key").contains(F.col("id_key"))).select("conv", "ref_key", "id_key").distinct()
    first = ids.groupBy("conv", F.col("key").alias("id_key")).agg(F.min(F.struct("doc_id", "master")).alias("m"))
    best = met.join(first, ["conv", "id_key"]).groupBy("conv", F.col("ref_key").alias("key")).agg(F.min("m")["master"].alias("master"))
    return refs.join(best, ["conv", "key"]).select("conv", "file_id", "master")


_REF_KEY = "'frameworkagreement' || (f.doc_id % 10) || CASE WHEN f.doc_id % 3 = 0 THEN 'xannex' ELSE '' END"
_ID_KEY = "'frameworkagreement' || m.doc_id || 'x'"


@query("rel_05_identifier_match", oracle(f"SELECT f.file_id, arg_min(m.file_id, m.doc_id) AS master FROM files f JOIN files m ON m.conv = f.conv AND m.role = 'master_agreement' AND (contains({_ID_KEY}, {_REF_KEY}) OR contains({_REF_KEY}, {_ID_KEY})) WHERE f.role = 'transaction' GROUP BY f.file_id"))
def identifier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first master of a conversation whose identifier holds the one that a transaction names, or is held by it (letters and digits only)."""
    squeeze = lambda *c: F.regexp_replace(F.lower(F.concat(*c)), "[^a-z0-9]", "")
    f = C.files(spark, sf_dir)
    ids = f.where("role = 'master_agreement'").select("conv", F.col("file_id").alias("master"), "doc_id", squeeze("file_name", F.lit(" x")).alias("key"))
    named = squeeze(F.lit("Framework Agreement "), F.col("doc_id") % 10, F.when(F.col("doc_id") % 3 == 0, " x annex").otherwise(""))
    return containing(f.where("role = 'transaction'").select("conv", "file_id", named.alias("key")), ids).select("file_id", "master")


@query("rel_13_extractions", oracle("SELECT file_id, 'k' || (doc_id % 3) || '=' || effective_date AS fields FROM files WHERE effective_date IS NOT NULL AND doc_id % 4 <> 0"))
def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named fields of a file as a map; nulls, blanks and `Not Found` go."""
    raw = F.array(F.struct(F.concat(F.lit("k"), F.col("doc_id") % 3).alias("name"), F.when(F.col("doc_id") % 4 == 0, "Not Found").otherwise(F.col("effective_date")).alias("value")), F.struct(F.lit("z").alias("name"), F.lit("").alias("value")))
    kept = F.filter(raw, lambda x: x["value"].isNotNull() & ~x["value"].isin("", "Not Found"))
    m = F.map_from_entries(kept)
    return C.files(spark, sf_dir).select("file_id", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("fields")).where("fields <> ''")


#: A money term: an amount with its currency before or behind it, or a percentage.
_TERM = r"[£€$][ \t]*[0-9][0-9,]*|[0-9]+(?:\.[0-9]+)?[ \t]*%"


@query("rel_14_fee_text", oracle(f"SELECT file_id, array_to_string(regexp_extract_all(string_agg(line, chr(10) ORDER BY p), {lit(_TERM)})[1:3], '; ') AS fee FROM lines GROUP BY file_id"))
def fee_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three money terms of a file as text: those of each line in order, three a line at most, then the first three of all."""
    t = C.lines(spark, sf_dir).select("file_id", "p", F.slice(F.regexp_extract_all("line", F.lit(_TERM), F.lit(0)), 1, 3).alias("t"))
    found = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("t") > 0, F.struct("p", "t")))), lambda x: x["t"]))
    return t.groupBy("file_id").agg(F.array_join(F.slice(found, 1, 3), "; ").alias("fee"))


@query("snk_06_null_safe_upsert", oracle("SELECT conv, from_file, to_file, kind, CASE WHEN to_file IS NULL THEN 'open' ELSE 'old' END AS state FROM (SELECT conv, file_id AS from_file, CASE WHEN doc_id % 3 <> 0 THEN 'f0' END AS to_file, 'renewal' AS kind FROM files)"))
def null_safe_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations merged on four keys of which the target may be null."""
    from .stores import upsert

    base = C.files(spark, sf_dir).select("conv", F.col("file_id").alias("from_file"), F.when(F.col("doc_id") % 3 != 0, "f0").alias("to_file"), F.lit("renewal").alias("kind"), F.lit("old").alias("state"))
    return upsert(base, base.where("to_file is null").withColumn("state", F.lit("open")), ["conv", "from_file", "to_file", "kind"])


@query("snk_07_bulk_upsert", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def bulk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last writer of each key of a bulk write, by an aggregate and not a sort."""
    return C.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", "event_id").alias("event_id"))


@query("src_18_message_files", "SELECT conv_id, turn, 'file ' || k AS name FROM (SELECT conv_id, turn, unnest(range(0, turn % 3)) AS k FROM conversations)")
def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of each message."""
    n = F.col("turn") % 3
    files = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda k: k < n), lambda k: F.struct(F.concat(F.lit("file "), k).alias("name")))
    return C.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(files))


@query("src_22_category_scan", "SELECT label, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY label")
def category_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload columns alone: the vectors are not read."""
    return C.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


@query("bkp_09_user_input", "SELECT conv_id, arg_min(text, turn) AS input FROM conversations WHERE role = 'user' GROUP BY conv_id")
def user_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user text of each conversation."""
    return C.table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("input"))


@query("cnv_08_payload", "SELECT event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the client: internal fields dropped, times as ISO text."""
    return C.table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("plb_02_playbook_text", "SELECT vec_id, 'Category: ' || label || ' | CIF: ' || ['CIF', 'Non CIF', 'Both'][label % 3 + 1] || CASE WHEN vec_id % 2 = 0 THEN ' | Guidance: g' || vec_id ELSE '' END AS entry FROM embeddings")
def playbook_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as piped text; optional fields without a value are left out."""
    cif = F.element_at(F.array(F.lit("CIF"), F.lit("Non CIF"), F.lit("Both")), (F.col("label") % 3 + 1).cast("int"))
    more = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("Guidance: g"), "vec_id"))
    return C.table(spark, sf_dir, "embeddings").select("vec_id", F.concat_ws(" | ", F.concat(F.lit("Category: "), "label"), F.concat(F.lit("CIF: "), cif), more).alias("entry"))

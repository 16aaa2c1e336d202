"""Excerpts and answers of the entity step, stamped payloads, verified points, lookups and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..plans import contract as C
from ..plans import fixed as S
from ..plans.sql import lit, oracle
from ..registry import query
from .bookkeeping import _PROMPTS_OF, prompts_of_types


def _text(column: str = "line") -> Column:
    """The lines of a group in order, as one text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", column))), lambda x: x[column]), "\n")


@query("src_05_flat_text", oracle("SELECT file_id, length(string_agg(line, chr(10) ORDER BY p)) AS n_chars, md5(string_agg(line, chr(10) ORDER BY p)) AS text_md5 FROM lines GROUP BY file_id"))
def flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's text without its pages."""
    t = C.lines(spark, sf_dir).groupBy("file_id").agg(_text().alias("t"))
    return t.select("file_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query("src_19_lookup", "SELECT n.n_nationkey * 7 AS c_custkey, c.c_name, CASE WHEN c.c_custkey IS NULL THEN 'not found' END AS error FROM nation n LEFT JOIN customer c ON c.c_custkey = n.n_nationkey * 7")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each key asked for, or an error."""
    keys = C.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).alias("c_custkey"))
    found = C.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(True).alias("_found"))
    return keys.join(found, "c_custkey", "left").select("c_custkey", "c_name", F.when(F.col("_found").isNull(), "not found").alias("error"))


@query("snk_12_all_elements", "SELECT conv_id, string_agg(turn || ':' || (role = 'user')::VARCHAR || ':true', ',' ORDER BY turn, role) AS flags FROM conversations GROUP BY conv_id")
def all_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of every element of an array set."""
    g = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.lit(False).alias("processed")))).alias("t"))
    new = F.transform("t", lambda x: x.withField("processed", F.lit(True)))
    return g.select("conv_id", F.array_join(F.transform(new, lambda x: F.concat_ws(":", x["turn"], x["role"] == "user", x["processed"])), ",").alias("flags"))


#: Points of a batch.
BATCH = 25


@query("snk_14_verified_points", oracle(f"SELECT f.file_id, count(s.section_id) AS points, ceil(count(s.section_id) / {BATCH})::BIGINT AS batches, count(s.section_id) > 0 AS embedded FROM files f LEFT JOIN sections s USING (file_id) GROUP BY f.file_id"))
def verified_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with stable ids are numbered in batches, written, read back and counted; a file is flagged by what was found, not by what was sent. A lost task writes
    its batches again, so retries need no code."""
    from ..functions import text as X

    path = C.written_to(spark, "points")
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("section_id"))
    s = C.sections(spark, sf_dir).select("file_id", X.point_id(F.col("file_id"), F.col("section_id")).alias("point_id"), F.ceil(n / BATCH).alias("batch"), "clause_type")
    s.write.parquet(path)
    found = spark.read.parquet(path).groupBy("file_id").agg(F.count_distinct("point_id").alias("n"), F.max("batch").alias("b"))
    n, b = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "b"))
    return C.files(spark, sf_dir).select("file_id").join(found, "file_id", "left").select("file_id", n.alias("points"), b.alias("batches"), (n > 0).alias("embedded"))


@query("snk_22_stamped", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[{\"k\":' || json_extract_string(props, '$.k') || ',\"batchId\":' || (user_id % 50) || ',\"fileId\":\"f' || user_id || '\"}]' ELSE props END AS payload FROM events")
def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch and file in each element of payloads that are lists; others stay as they are."""
    e = C.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")).alias("sent"))
    items = F.from_json("sent", "array<struct<k: bigint>>")
    new = F.transform(items, lambda x: F.struct(x["k"].alias("k"), (F.col("user_id") % 50).alias("batchId"), F.concat(F.lit("f"), "user_id").alias("fileId")))
    return e.select("event_id", F.when(F.ltrim("sent").startswith("["), F.to_json(new)).otherwise(F.col("sent")).alias("payload"))


@query("prs_04_contents_by_page", oracle(f"SELECT file_id, page, n AS dotted, n >= 3 AND 4 * n >= filled AS contents FROM (SELECT file_id, page, count(*) FILTER (regexp_matches(x, {lit(S.TOC_LINE)})) AS n, count(*) FILTER (trim(x) <> '') AS filled FROM (SELECT *, CASE WHEN (doc_id + page) % 5 = 0 AND p % 3 <> 0 THEN line || ' ..... ' || p ELSE line END AS x FROM lines) GROUP BY file_id, page)"))
def contents_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a table of contents: three lines or more that end in dots and a number, and a quarter of the lines with text. The tables have no such lines, so some
    pages get them by arithmetic."""
    x = F.when(((F.col("doc_id") + F.col("page")) % 5 == 0) & (F.col("p") % 3 != 0), F.concat("line", F.lit(" ..... "), "p")).otherwise(F.col("line"))
    a = C.lines(spark, sf_dir).withColumn("x", x).groupBy("file_id", "page").agg(F.count(F.when(F.col("x").rlike(P.TOC_LINE), 1)).alias("dotted"), F.count(F.when(F.trim("x") != "", 1)).alias("filled"))
    return a.select("file_id", "page", "dotted", ((F.col("dotted") >= 3) & (4 * F.col("dotted") >= F.col("filled"))).alias("contents"))


# --- entities --------------------------------------------------------------------------------------------------------------------

# What counts as money in an excerpt. Codes stand as whole words.
CODES = "HKD|SGD|USD|GBP|EUR|AUD|JPY|CNY|MYR|THB|NZD|CAD|CHF|INR|IDR|KRW|PHP|TWD|BRL|ZAR|AED|SAR|QAR|DKK|SEK|NOK|CZK|PLN|HUF"
AMOUNTS = (
    r"HK\$|S\$|US\$|A\$|NZ\$|RM\s*\d|(?:Hong\s+Kong|Singapore|US|Australian|New\s+Zealand)\s+Dollar|(?:Pound\s+Sterling|Sterling\s+Pound|British\s+Pound)"
    r"|Indian\s+Rupee|Indonesian\s+Rupiah|Philippine\s+Peso|(?:Euro|Euros)\s*\d|[\$£€¥₹]\s*\d"
)
HEAD_PAGES, HEAD_CHARS, SNIPPETS, BEFORE, AFTER = 3, 2000, 4, 120, 200
_CODE_AT, _AMOUNT_AT = rf"(?is)^((?:.*?[^\p{{L}}\p{{N}}_])?)({CODES})(?:[^\p{{L}}\p{{N}}_]|$)", rf"(?is)^(.*?)({AMOUNTS})"
_MONEY_AT = f"CASE WHEN regexp_matches(t, {lit(_CODE_AT)}) THEN [length(regexp_extract(t, {lit(_CODE_AT)}, 1)), length(regexp_extract(t, {lit(_CODE_AT)}, 2))] END AS c, CASE WHEN regexp_matches(t, {lit(_AMOUNT_AT)}) THEN [length(regexp_extract(t, {lit(_AMOUNT_AT)}, 1)), length(regexp_extract(t, {lit(_AMOUNT_AT)}, 2))] END AS a"
_EXCERPTS = f"""
    SELECT file_id, left(head, {HEAD_CHARS}) || CASE WHEN later IS NULL THEN '' ELSE chr(10) || chr(10) || '[FINANCIAL TERMS IN LATER PAGES]' || chr(10) || later END AS excerpt FROM (
        SELECT file_id, string_agg(t, chr(10) ORDER BY page) FILTER (n <= {HEAD_PAGES}) AS head, string_agg(snippet, chr(10) ORDER BY page) FILTER (k <= {SNIPPETS}) AS later FROM (
            SELECT *, CASE WHEN snippet IS NOT NULL THEN row_number() OVER (PARTITION BY file_id, snippet IS NULL ORDER BY page) END AS k FROM (
                SELECT file_id, page, n, t, CASE WHEN n > {HEAD_PAGES} AND hit IS NOT NULL THEN '[Page ' || page || '] ...' || trim(substr(t, greatest(0, hit[1] - {BEFORE}) + 1, hit[1] + hit[2] + {AFTER} - greatest(0, hit[1] - {BEFORE})), chr(10) || chr(9) || chr(13) || ' ') || '...' END AS snippet
                FROM (SELECT *, CASE WHEN c IS NULL OR a IS NOT NULL AND a[1] < c[1] THEN a ELSE c END AS hit
                      FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page) AS n, {_MONEY_AT} FROM (SELECT file_id, page, string_agg(line, chr(10) ORDER BY p) AS t FROM lines GROUP BY file_id, page))))) GROUP BY file_id)"""


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, excerpt): the start of a file's first pages, and what stands around the first money of up to four later pages (ENT-02)."""
    pages = C.lines(spark, sf_dir).groupBy("file_id", "page").agg(_text().alias("t"))
    pages = pages.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy("page")))
    at = lambda p: F.when(F.col("t").rlike(p), F.struct(F.length(F.regexp_extract("t", p, 1)).alias("at"), F.length(F.regexp_extract("t", p, 2)).alias("n")))
    first = F.least(at(_CODE_AT), at(_AMOUNT_AT))
    a = pages.withColumn("m", F.when(F.col("n") > HEAD_PAGES, first))
    a = a.withColumn("m", F.when(F.col("m").isNotNull() & (at(_CODE_AT)["at"] == F.col("m")["at"]), at(_CODE_AT)).otherwise(F.col("m")))
    begin = F.greatest(F.lit(0), F.col("m")["at"] - BEFORE)
    around = F.substring("t", begin + 1, F.col("m")["at"] + F.col("m")["n"] + AFTER - begin)
    a = a.withColumn("snippet", F.when(F.col("m").isNotNull(), F.concat(F.lit("[Page "), "page", F.lit("] ..."), F.btrim(around, F.lit("\n\t\r ")), F.lit("..."))))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct("page", c.alias("x"))))), lambda x: x["x"])
    g = a.groupBy("file_id").agg(F.array_join(ordered(F.when(F.col("n") <= HEAD_PAGES, F.col("t"))), "\n").alias("head"), F.slice(ordered(F.col("snippet")), 1, SNIPPETS).alias("later"))
    tail = F.when(F.size("later") > 0, F.concat(F.lit("\n\n[FINANCIAL TERMS IN LATER PAGES]\n"), F.array_join("later", "\n"))).otherwise("")
    return g.select("file_id", F.concat(F.substring("head", 1, HEAD_CHARS), tail).alias("excerpt"))


@query("ent_02_excerpt", oracle("SELECT file_id, length(excerpt) AS n_chars, md5(excerpt) AS excerpt_md5 FROM excerpts", excerpts=_EXCERPTS))
def excerpt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excerpts(spark, sf_dir).select("file_id", F.length("excerpt").cast("long").alias("n_chars"), F.md5("excerpt").alias("excerpt_md5"))


# Fixed value: the fields of an answer besides the role.
FIELDS = ["persons", "organizations", "financial_terms", "dates", "references", "identifiers"]
_SAID_SQL = """'{"functionalRole": "' || role || '", "persons": [{"name": "' || person || '", "role": "consultant"}, {"name": null}], "organizations": [{"name": "' || org || '"}], "dates": [{"value": "' || coalesce(effective_date, '') || '", "key": "effective"}], "identifiers": [{"value": "F-' || doc_id || '"}]}'"""
_ANSWERS = f"SELECT file_id, doc_id, role, CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || {_SAID_SQL} || chr(10) || '```' WHEN 1 THEN 'Found: ' || {_SAID_SQL} || ' as asked.' WHEN 2 THEN '{{\"functionalRole\": ' ELSE file_name END AS answer FROM files"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, answer): what a model says of each file: fenced, in prose, cut off, or no JSON at all."""
    f = C.files(spark, sf_dir)
    k = F.col("doc_id") % 4
    said = F.format_string(
        '{"functionalRole": "%s", "persons": [{"name": "%s", "role": "consultant"}, {"name": null}], "organizations": [{"name": "%s"}], "dates": [{"value": "%s", "key": "effective"}], "identifiers": [{"value": "F-%s"}]}',
        "role", "person", "org", F.coalesce("effective_date", F.lit("")), "doc_id",
    )
    whole = F.when(k == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Found: "), said, F.lit(" as asked."))).when(k == 2, '{"functionalRole": ').otherwise(F.col("file_name"))
    return f.select("file_id", whole.alias("answer"))


def parsed_answers(given: DataFrame) -> DataFrame:
    """(file_id, role, FIELDS): answers by their outermost braces as JSON; fields without a value are empty, the role is standalone (ENT-03)."""
    item = "array<struct<name: string, value: string, key: string, role: string>>"
    read = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), "functionalRole string, " + ", ".join(f"`{k}` {item}" for k in FIELDS))
    none = F.array().cast(item)
    return given.select("file_id", F.coalesce(read["functionalRole"], F.lit("standalone")).alias("role"), *[F.coalesce(read[k], none).alias(k) for k in FIELDS])


_READ = "SELECT *, CASE WHEN doc_id % 4 < 2 THEN regexp_extract(answer, '(?s)\\{.*\\}', 0) ELSE '{}' END AS j FROM (" + _ANSWERS + ")"


@query(
    "ent_03_parsed_answers",
    oracle(
        """SELECT file_id, coalesce(json_extract_string(j, '$.functionalRole'), 'standalone') AS role, coalesce(json_extract_string(j, '$.persons[0].name'), '') AS persons, coalesce(json_extract_string(j, '$.organizations[0].name'), '') AS organizations,
        '' AS financial_terms, coalesce(json_extract_string(j, '$.dates[0].value'), '') AS dates, '' AS "references", coalesce(json_extract_string(j, '$.identifiers[0].value'), '') AS identifiers FROM read""",
        read=_READ,
    ),
)
def parsed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and the filled names or values of each field, joined."""
    text = lambda k: F.array_join(F.filter(F.transform(k, lambda x: F.coalesce(x["name"], x["value"])), lambda v: v.isNotNull()), "|")
    return parsed_answers(answers(spark, sf_dir)).select("file_id", "role", *[text(k).alias(k) for k in FIELDS])


@query("ent_04_addendum_net", oracle(f"SELECT f.file_id, CASE WHEN f.role IN ('master_agreement', 'standalone') AND regexp_matches(e.excerpt, {lit(S.ADDENDUM)}) THEN 'modification' ELSE f.role END AS role FROM files f JOIN excerpts e USING (file_id)", excerpts=_EXCERPTS))
def addendum_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masters and standalone files whose excerpt calls itself an addendum are modifications."""
    said = F.col("role").isin("master_agreement", "standalone") & F.col("excerpt").rlike(P.ADDENDUM)
    return C.files(spark, sf_dir).select("file_id", "role").join(excerpts(spark, sf_dir), "file_id").select("file_id", F.when(said, "modification").otherwise(F.col("role")).alias("role"))


@query("ent_06_role_back", oracle("SELECT file_id, CASE WHEN doc_id % 4 < 2 THEN role ELSE 'standalone' END AS role, CASE WHEN doc_id % 4 < 2 THEN role_rank ELSE 0 END AS role_rank FROM files"))
def role_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was extracted overwrites the role that file names gave, and its rank."""
    new = parsed_answers(answers(spark, sf_dir)).select("file_id", F.col("role").alias("_new"))
    from ..functions import text as X

    role = F.coalesce("_new", "role")
    return C.files(spark, sf_dir).select("file_id", "role").join(new, "file_id", "left").select("file_id", role.alias("role"), X.role_rank(role).cast("long").alias("role_rank"))


# --- retrieval, bookkeeping, conversations, learning -----------------------------------------------------------------------------


@query("ret_02_sub_queries", "SELECT conv_id, len(s) AS n, array_to_string(s, ' | ') AS queries FROM (SELECT conv_id, list_concat([q[1]], list_filter(q[2:], lambda x: x <> q[1])[1:4]) AS s FROM (SELECT conv_id, list(text ORDER BY turn) AS q FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id))")
def sub_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original question first, then up to four others that differ from it (here a conversation's further questions stand for a model's)."""
    asked = C.table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("q"))
    first = F.get("q", F.lit(0))
    out = F.concat(F.array(first), F.slice(F.filter(F.slice("q", 2, F.greatest(F.size("q"), F.lit(1))), lambda x: x != F.col("q")[0]), 1, 4))
    return asked.select("conv_id", out.alias("s")).select("conv_id", F.size("s").cast("long").alias("n"), F.array_join("s", " | ").alias("queries"))


@query("bkp_05_obligation_prompts", f"SELECT document_type, prompt_id FROM ({_PROMPTS_OF}) WHERE kind = 'Obligation'")
def obligation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts_of_types(spark, sf_dir).where("kind = 'Obligation'").select("document_type", "prompt_id")


@query("bkp_06_prompt_by_id", "SELECT s_suppkey AS prompt_id, p_name AS prompt FROM supplier LEFT JOIN part ON p_partkey = s_suppkey")
def prompt_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each prompt asked for by its id; null where there is none."""
    prompts = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("prompt"))
    return C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("prompt_id")).join(prompts, "prompt_id", "left")


@query("bkp_06_id_by_name", "SELECT p_name AS prompt, min(p_partkey) AS prompt_id FROM part GROUP BY p_name")
def id_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("prompt")).agg(F.min("p_partkey").alias("prompt_id"))


# Fixed value: the layout of a question with what was said before.
_GAP = " " * 28


@query(
    "bkp_12_context",
    f"""SELECT conv_id, CASE WHEN len(m) > 1 THEN 'Previous Messages Context : ' || array_to_string(list_transform(m[1:len(m) - 1], lambda x: x.role || ': ' || x.text), chr(10)) || chr(10) || '{_GAP}User Query : ' ELSE 'User Query : ' END || m[len(m)].text AS input
    FROM (SELECT conv_id, list({{'role': role, 'text': coalesce(text, '')}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)""",
)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message of each conversation with those before it as context."""
    m = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    before = F.array_join(F.transform(F.slice("m", 1, F.size("m") - 1), lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n")
    head = F.when(F.size("m") > 1, F.concat(F.lit("Previous Messages Context : "), before, F.lit(f"\n{_GAP}User Query : "))).otherwise("User Query : ")
    return m.select("conv_id", F.concat(head, F.element_at("m", -1)["text"]).alias("input"))


@query("cnv_09_file_status", "SELECT 'f' || doc_id AS file_id, CASE quality WHEN 1 THEN 'Processed' WHEN 0 THEN 'Failed' ELSE 'unknown' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's status, unknown where none is told."""
    told = C.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Processed").when(F.col("quality") == 0, "Failed").alias("status"))
    return C.table(spark, sf_dir, "documents").select("doc_id").join(told, "doc_id", "left").select(F.concat(F.lit("f"), "doc_id").alias("file_id"), F.coalesce("status", F.lit("unknown")).alias("status"))


@query("mle_04_split", "SELECT label, count(*) AS n, count(*) FILTER (('0x' || substr(md5(label || ':' || vec_id), 1, 4))::BIGINT < 6554) AS held_out FROM embeddings GROUP BY label")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each label held out by a hash of its rows, so no sort and no draw is needed."""
    out = F.conv(F.substring(F.md5(F.concat_ws(":", "label", "vec_id")), 1, 4), 16, 10).cast("long") < 6554
    return C.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(out, 1)).alias("held_out"))

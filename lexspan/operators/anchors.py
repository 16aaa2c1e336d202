"""A second parse from given headings, the choice between two parses, and what a file's first pages tell (PRS-12 to PRS-16).

Headings are given for each file, as rows (file_id, k, anchor, title): a model picks them among the candidate lines, and here those candidates with
a number, or of a few words, stand for its answer. Lines meet the headings of their own file by the first word of both, and the rule decides the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans import contract as C
from ..plans import fixed as S
from ..plans.sql import cases, lit, oracle, parent
from ..registry import query
from .parsing import anchor_candidates

#: Below this confidence a second parse is tried; headings without a number have so many words at most.
DOUBTFUL, FEW_WORDS = 0.7, 6
# Fixed value: what may stand behind a heading's id on its line.
_BOUNDARY = "[\\s.:\\-\\u2013\\u2014]"


def given_anchors(candidates: DataFrame) -> DataFrame:
    """candidates (file_id, p, line): (file_id, k, anchor, title), each id once, in the order of its first line, with its last title."""
    numbered = F.regexp_extract("line", "^[A-Z]+ [0-9]+", 0)
    short = F.when(F.size(F.split("line", "\\s+")) <= FEW_WORDS, F.regexp_extract("line", "^[\\p{L}\\p{N}_]+", 0))
    said = F.coalesce(X.header_id(F.col("line")), F.when(numbered != "", numbered), short)
    named = candidates.select("file_id", "p", said.alias("anchor"), X.header_title(F.col("line")).alias("title")).where("anchor <> ''")
    return named.groupBy("file_id", "anchor").agg(F.min("p").alias("k"), F.max_by("title", "p").alias("title"))


def _first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, "^[^\\s.:\\-\\u2013\\u2014]*", 0))


def reparse(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """lines (conv, file_id, doc_id, p, page, line) cut at the lines that begin with an anchor of their file: (conv, file_id, doc_id, pos, section_id, title,
    page, parent_id, content). The first anchor in order wins a line; no schedules are kept and nothing before the first heading."""
    t, a = F.trim("line"), F.col("anchor")
    keyed = anchors.withColumn("word", _first_word(a))
    behind = t.substr(F.length(a) + 1, F.lit(1))
    begins = F.lower(t).startswith(F.lower(a)) & ((F.length(t) == F.length(a)) | behind.rlike(_BOUNDARY))
    met = lines.select("file_id", "p", "line", _first_word(t).alias("word")).join(keyed, ["file_id", "word"]).where(begins)
    opens = met.groupBy("file_id", "p").agg(F.min_by(F.struct("anchor", "title"), "k").alias("opens"))
    w = Window.partitionBy("file_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.join(opens, ["file_id", "p"], "left").withColumn("pos", F.count("opens").over(w)).where("pos > 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.trim("line").alias("t")))), lambda x: x["t"]), "\n")
    s = cut.groupBy("conv", "file_id", "doc_id", "pos").agg(F.first("opens", True).alias("o"), F.min("page").alias("page"), F.btrim(text, F.lit("\n ")).alias("content"))
    kept = s.where(F.length("content") >= C.MIN_CONTENT)
    return kept.select("conv", "file_id", "doc_id", "pos", F.col("o.anchor").alias("section_id"), F.col("o.title").alias("title"), "page", X.parent_id(F.col("o.anchor")).alias("parent_id"), "content")


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reparse(C.lines(spark, sf_dir), given_anchors(anchor_candidates(spark, sf_dir)))


_CANDIDATES = r"""
    SELECT file_id, p, trim(line) AS line FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY p) AS n FROM lines WHERE length(trim(line)) BETWEEN 1 AND 150
        AND (regexp_matches(trim(line), '^[0-9]|^[A-Z][A-Z]') OR length(trim(line)) <= 80 AND regexp_matches(trim(line), '^[A-Z][a-z]') AND NOT contains(trim(line), '.'))) WHERE n <= 150"""
_ANCHORS = f"""
    SELECT file_id, anchor, min(p) AS k, arg_max(title, p) AS title FROM (
        SELECT c.file_id, c.p, h.title, coalesce(h.section_id, nullif(regexp_extract(c.line, '^[A-Z]+ [0-9]+', 0), ''), CASE WHEN len(regexp_split_to_array(c.line, '\\s+')) <= {FEW_WORDS} THEN regexp_extract(c.line, '^[\\p{{L}}\\p{{N}}_]+', 0) END) AS anchor
        FROM candidates c JOIN headed h USING (file_id, p)) WHERE anchor <> '' GROUP BY file_id, anchor"""
_CUT = """
    SELECT *, count(anchor) OVER (PARTITION BY file_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos FROM (
        SELECT l.*, a.anchor, a.title FROM lines l LEFT JOIN (
            SELECT l.file_id, l.p, a.anchor, a.title, row_number() OVER (PARTITION BY l.file_id, l.p ORDER BY a.k) AS n FROM lines l JOIN anchors a ON a.file_id = l.file_id
            WHERE starts_with(lower(trim(l.line)), lower(a.anchor)) AND (length(trim(l.line)) = length(a.anchor) OR regexp_matches(substr(trim(l.line), length(a.anchor) + 1, 1), '^[\\s.:–—-]'))) a
        ON a.file_id = l.file_id AND a.p = l.p AND a.n = 1)"""
_ANCHORED = f"""
    SELECT *, {parent("section_id")} AS parent_id FROM (
        SELECT conv, file_id, doc_id, pos, max(anchor) AS section_id, max(title) AS title, min(page) AS page, trim(string_agg(trim(line), chr(10) ORDER BY p), chr(10) || ' ') AS content
        FROM cut WHERE pos > 0 GROUP BY conv, file_id, doc_id, pos) WHERE length(content) >= {S.MIN_CONTENT}"""
FRAMES = {"candidates": _CANDIDATES, "anchors": _ANCHORS, "cut": _CUT, "anchored": _ANCHORED}


@query("prs_12_anchor_parse", oracle("SELECT file_id, pos, section_id, title, page, parent_id, md5(content) AS content_md5 FROM anchored", **FRAMES))
def anchor_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections cut from the headings that were given for each file."""
    return anchored(spark, sf_dir).select("file_id", "pos", "section_id", "title", F.col("page").cast("long").alias("page"), "parent_id", F.md5("content").alias("content_md5"))


def chosen(first: DataFrame, second: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two parses (file_id, section_id, content, ...) of the files of pages (file_id, pages): (file_id, first, fallback, accepted), and the sections of
    the parse that each file keeps. The second is tried where the first is doubtful and replaces it only if it is strictly more plausible."""
    count = lambda s, name: s.groupBy("file_id").agg(F.count(F.lit(1)).alias(name))
    both = pages.join(count(first, "a"), "file_id", "left").join(count(second, "b"), "file_id", "left").na.fill(0, ["a", "b"])
    score = both.select("file_id", X.confidence(F.col("a"), F.col("pages")).alias("first"), X.confidence(F.col("b"), F.col("pages")).alias("fallback"))
    score = score.withColumn("accepted", (F.col("first") < DOUBTFUL) & (F.col("fallback") > F.col("first")))
    of = lambda s, name, take: s.join(score.where(take).select("file_id"), "file_id", "left_semi").select("file_id", F.lit(name).alias("parse"), "section_id", "content")
    return score, of(first, "headers", "not accepted").unionByName(of(second, "anchors", "accepted"))


def _parses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = anchored(spark, sf_dir)
    longest = F.row_number().over(Window.partitionBy("file_id", "section_id").orderBy(F.desc(F.length("content")), "pos"))
    pages = C.lines(spark, sf_dir).groupBy("file_id").agg(F.max("page").alias("pages"))
    return chosen(C.sections(spark, sf_dir), raw.withColumn("_n", longest).where("_n = 1").drop("_n"), pages)


_CONF = lambda n: cases([(f"{n} = 0", "0.0"), (f"{n} / greatest(pages, 1) < 0.3", "0.3"), (f"{n} / greatest(pages, 1) > 8.0", "0.4")], "0.9") + "::DOUBLE"
_SCORED = f"""
    SELECT *, first < 0.7 AND fallback > first AS accepted FROM (
        SELECT file_id, {_CONF("a")} AS first, {_CONF("b")} AS fallback FROM (
            SELECT l.file_id, max(page) AS pages, coalesce(any_value(s.n), 0) AS a, coalesce(any_value(t.n), 0) AS b FROM lines l LEFT JOIN (SELECT file_id, count(*) AS n FROM sections GROUP BY file_id) s USING (file_id)
            LEFT JOIN (SELECT file_id, count(DISTINCT section_id) AS n FROM anchored GROUP BY file_id) t USING (file_id) GROUP BY l.file_id))"""


@query("prs_13_accept_fallback", oracle("SELECT * FROM scored", **FRAMES, scored=_SCORED))
@C.parse_once
def accept_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How plausible both parses of each file are, and whether the second replaces the first."""
    return _parses(spark, sf_dir)[0]


@query(
    "prs_13_chosen_sections",
    oracle(
        """SELECT file_id, parse, section_id, md5(content) AS content_md5 FROM (
            SELECT file_id, 'headers' AS parse, section_id, content FROM sections WHERE file_id IN (SELECT file_id FROM scored WHERE NOT accepted)
            UNION ALL SELECT file_id, 'anchors', section_id, arg_max(content, length(content) * 1000000 - pos) FROM anchored WHERE file_id IN (SELECT file_id FROM scored WHERE accepted) GROUP BY file_id, section_id)""",
        **FRAMES, scored=_SCORED,
    ),
)
@C.parse_once
def chosen_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of the parse that each file keeps."""
    return _parses(spark, sf_dir)[1].select("file_id", "parse", "section_id", F.md5("content").alias("content_md5"))


# --- first pages -----------------------------------------------------------------------------------------------------------------

#: Pages that a date is looked for in, and characters of the first one that tell a file's kind.
DATE_PAGES, KIND_CHARS = 2, 1500


def first_pages(lines: DataFrame, pages: int) -> DataFrame:
    """(file_id, text) of each file's first pages, as one group by file."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    return lines.where(F.col("page") <= pages).groupBy("file_id").agg(text.alias("text"))


def document_date(text: Column) -> Column:
    """The first date behind a word that tells what it is, else the first bare one, as YYYY-MM-DD; the calendar isn't checked."""
    told = F.regexp_extract(text, P.DATE_TOLD, 1)
    return X.iso_date(F.when(told != "", told).otherwise(F.regexp_extract(text, P.DATE_BARE, 1)))


_FIRST = "SELECT file_id, string_agg(line, chr(10) ORDER BY p) FILTER (page <= 2) AS text, any_value(file_name) || chr(10) || left(string_agg(line, chr(10) ORDER BY p) FILTER (page = 1), 1500) AS head FROM lines JOIN files USING (file_id) GROUP BY file_id"
_SAID = f"coalesce(nullif(regexp_extract(text, {lit(S.DATE_TOLD)}, 1), ''), regexp_extract(text, {lit(S.DATE_BARE)}, 1))"
_MONTHS = "['january','february','march','april','may','june','july','august','september','october','november','december']"
_ISO = f"""
    SELECT file_id, CASE WHEN regexp_matches(d, '^[0-9]{{4}}-') THEN d
        WHEN regexp_matches(d, '[A-Za-z]') THEN right(d, 4) || '-' || lpad(list_position({_MONTHS}, lower(regexp_extract(d, '([A-Za-z]{{3,}})', 1)))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(d, '^[0-9]+', 0), 2, '0')
        WHEN d <> '' THEN right(d, 4) || '-' || lpad(regexp_extract(d, '^[0-9]+[/.-]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(d, '^[0-9]+', 0), 2, '0') END AS document_date
    FROM (SELECT file_id, {_SAID} AS d FROM first_pages)"""


@query("prs_14_document_date", oracle(_ISO, first_pages=_FIRST))
def document_date_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_pages(C.lines(spark, sf_dir), DATE_PAGES).select("file_id", document_date(F.col("text")).alias("document_date"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, head): a file's name and the start of its first page."""
    first = first_pages(C.lines(spark, sf_dir), 1)
    return C.files(spark, sf_dir).select("file_id", "file_name").join(first, "file_id").select("file_id", F.concat("file_name", F.lit("\n"), F.substring("text", 1, KIND_CHARS)).alias("head"))


_KIND = lambda values, default: cases([(f"regexp_matches(head, {lit(p)})", v) for v, p in values], default)


@query("prs_15_document_type", oracle(f"SELECT file_id, {_KIND([(lit(n), p) for n, _, p in S.DOCUMENT_TYPES], lit('agreement'))} AS document_type, {_KIND([(str(r), p) for _, r, p in S.DOCUMENT_TYPES], '1')} AS document_rank FROM first_pages", first_pages=_FIRST))
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("head")
    return _heads(spark, sf_dir).select("file_id", X.document_type(h).alias("document_type"), X.document_rank(h).alias("document_rank"))


@query("prs_16_functional_role", oracle(f"SELECT file_id, {_KIND([(lit(n), p) for n, p in S.ROLES], lit('standalone'))} AS functional_role FROM first_pages", first_pages=_FIRST))
def functional_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir).select("file_id", X.functional_role(F.col("head")).alias("functional_role"))

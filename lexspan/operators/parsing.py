"""Text to sections: headers, segmentation, preambles, duplicates, dates, types and flags (PRS)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans import contract as C
from ..plans import fixed as S
from ..plans.sql import cases, lit, oracle, parent
from ..registry import query


@query("prs_01_header_lines", oracle("SELECT file_id, p, section_id, title FROM headed WHERE section_id IS NOT NULL"))
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open a section, with normalised id and title (PRS-01, PRS-02)."""
    a = C.lines(spark, sf_dir).select("file_id", "p", X.header_id(F.col("line")).alias("section_id"), X.header_title(F.col("line")).alias("title"))
    return a.where(F.col("section_id").isNotNull())


@query("prs_03_segmentation", oracle("SELECT file_id, CAST(pos AS BIGINT) AS pos, section_id, title, CAST(page AS BIGINT) AS page, md5(content) AS content_md5 FROM raw_sections"))
def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.raw_sections(spark, sf_dir).select("file_id", "pos", "section_id", "title", F.col("page").cast("long").alias("page"), F.md5("content").alias("content_md5"))


_TOC = f"SELECT 'f' || doc_id AS file_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {lit(S.TOC_LINE)}))) AS dotted, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS filled FROM documents"


@query("prs_04_contents_pages", f"SELECT file_id, dotted >= 3 AND 4 * dotted >= filled AS is_contents FROM ({_TOC})")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with three lines or more that end in dots and a number, a quarter of the filled lines at least."""
    rows = F.split("text", "\n")
    dotted, filled = F.size(F.filter(rows, lambda x: x.rlike(P.TOC_LINE))), F.size(F.filter(rows, lambda x: F.trim(x) != ""))
    return C.table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), "doc_id").alias("file_id"), ((dotted >= 3) & (4 * dotted >= filled)).alias("is_contents"))


def preambles(headed: DataFrame) -> DataFrame:
    """The text before a file's first header, from the first page with agreement language on; none if the file has no header."""
    w = Window.partitionBy("file_id")
    opened = F.min(F.when(F.col("line").rlike(P.OPENING), F.col("page"))).over(w)
    a = headed.withColumns({"_open": opened, "_sections": F.max("pos").over(w)}).where("pos = 0 and _sections > 0 and page >= _open and trim(line) <> ''")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.trim("line").alias("t")))), lambda x: x["t"]), "\n")
    return a.groupBy("conv", "file_id").agg(F.first("_open").alias("page"), text.alias("content")).where(F.length("content") >= C.MIN_CONTENT)


# The projection opens each file with a header, so the query sees its files from the line after next to the first cue on.
_LATE = "SELECT conv, file_id, CASE WHEN p < 3 THEN 'This Agreement is entered into by line ' || p ELSE line END AS line, p, page, CASE WHEN p < 3 THEN 0 ELSE pos END AS pos FROM headed"


@query(
    "prs_05_preambles",
    oracle(
        f"""SELECT conv, file_id, any_value(open) AS page, md5(string_agg(trim(line), chr(10) ORDER BY p)) AS content_md5
        FROM (SELECT *, min(CASE WHEN regexp_matches(line, {lit(S.OPENING)}) THEN page END) OVER (PARTITION BY file_id) AS open, max(pos) OVER (PARTITION BY file_id) AS n FROM late)
        WHERE pos = 0 AND n > 0 AND page >= open AND trim(line) <> '' GROUP BY conv, file_id HAVING length(string_agg(trim(line), chr(10) ORDER BY p)) >= {C.MIN_CONTENT}""",
        late=_LATE,
    ),
)
def preamble_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("p") < 3
    a = C.headed(spark, sf_dir).withColumns({"line": F.when(early, F.concat(F.lit("This Agreement is entered into by line "), F.col("p"))).otherwise(F.col("line")), "pos": F.when(early, 0).otherwise(F.col("pos"))})
    return preambles(a).select("conv", "file_id", F.col("page").cast("long").alias("page"), F.md5("content").alias("content_md5"))


@query("prs_06_schedule_context", oracle("SELECT file_id, CAST(pos AS BIGINT) AS pos, section_id, schedule FROM raw_sections WHERE schedule IS NOT NULL"))
def schedule_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.raw_sections(spark, sf_dir).where("schedule is not null").select("file_id", "pos", "section_id", "schedule")


@query("prs_07_parents", oracle(f"SELECT DISTINCT section_id, {parent('section_id')} AS parent_id FROM raw_sections"))
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.raw_sections(spark, sf_dir).select("section_id", "parent_id").distinct()


@query("prs_09_longest_section", oracle("SELECT file_id, section_id, CAST(pos AS BIGINT) AS pos, CAST(first_pos AS BIGINT) AS first_pos, length(content) AS n_chars FROM sections"))
def longest_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(spark, sf_dir).select("file_id", "section_id", "pos", "first_pos", F.length("content").cast("long").alias("n_chars"))


_COUNTS = "SELECT file_id, max(page) AS pages, count(DISTINCT CASE WHEN pos > 0 THEN pos END) AS n FROM headed GROUP BY file_id"


@query("prs_10_parse_confidence", oracle(f"SELECT file_id, n, {cases([('n = 0', '0.0'), ('n / greatest(pages, 1) < 0.3', '0.3'), ('n / greatest(pages, 1) > 8.0', '0.4')], '0.9')}::DOUBLE AS confidence FROM counts", counts=_COUNTS))
def parse_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.headed(spark, sf_dir).groupBy("file_id").agg(F.max("page").alias("pages"), F.max("pos").alias("n"))
    return a.select("file_id", "n", X.confidence(F.col("n"), F.col("pages")).alias("confidence"))


# What a line that may be a heading looks like.
_HEADING = r"^\d|^[A-Z]{2,}|^(?:SCHEDULE|APPENDIX|EXHIBIT|ARTICLE|PART|SECTION)"
_SHORT = r"^[A-Z][a-z][^.]*$"


@query("prs_11_anchor_candidates", oracle(f"SELECT file_id, p, trim(line) AS line FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY p) AS n FROM lines WHERE length(trim(line)) BETWEEN 1 AND 150 AND (regexp_matches(trim(line), {lit(_HEADING)}) OR length(trim(line)) <= 80 AND regexp_matches(trim(line), {lit(_SHORT)}))) WHERE n <= 150"))
def anchor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that may be headings when few sections were found; the first 150 of a file."""
    t = F.trim("line")
    may = C.lines(spark, sf_dir).where(F.length(t).between(1, 150) & (t.rlike(_HEADING) | (F.length(t) <= 80) & t.rlike(_SHORT)))
    return may.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy("p"))).where("n <= 150").select("file_id", "p", t.alias("line"))


_GIVEN = "SELECT file_id, section_id, clause_type, CASE WHEN pos % 4 = 0 THEN 'nonsense' ELSE clause_type END AS said_type, CASE WHEN pos % 5 = 0 THEN 'abc' WHEN pos % 5 = 1 THEN '7' ELSE CAST(risk - 1 AS VARCHAR) END AS said_risk FROM sections WHERE pos % 3 <> 0"


@query("prs_17_clause_risk", oracle(f"SELECT s.file_id, s.section_id, CASE WHEN g.said_type IN ({', '.join(map(lit, S.CLAUSE_TYPES))}) THEN g.said_type ELSE 'other' END AS clause_type, CASE WHEN g.file_id IS NULL THEN NULL ELSE least(greatest(coalesce(TRY_CAST(g.said_risk AS INTEGER), 2), 1), 5) END AS risk_level FROM sections s LEFT JOIN given g USING (file_id, section_id)", given=_GIVEN))
def clause_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model says of a clause, held to the known labels and to 1..5 (given here by arithmetic; any scorer can take its place)."""
    s = C.sections(spark, sf_dir)
    five = F.col("pos") % 5
    said = s.where("pos % 3 <> 0").select("file_id", "section_id", F.when(F.col("pos") % 4 == 0, "nonsense").otherwise(F.col("clause_type")).alias("t"), F.when(five == 0, "abc").when(five == 1, "7").otherwise((F.col("risk") - 1).cast("string")).alias("r"))
    level = F.least(F.greatest(F.coalesce(F.expr("try_cast(r as int)"), F.lit(2)), F.lit(1)), F.lit(5))
    j = s.select("file_id", "section_id").join(said.withColumn("_hit", F.lit(1)), ["file_id", "section_id"], "left")
    return j.select("file_id", "section_id", F.when(F.col("t").isin(P.CLAUSE_TYPES), F.col("t")).otherwise("other").alias("clause_type"), F.when(F.col("_hit") == 1, level).alias("risk_level"))


@query("prs_19_qualifiers", oracle("SELECT file_id, section_id FROM sections WHERE qualifier"))
def qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(spark, sf_dir).where("qualifier").select("file_id", "section_id")


@query("prs_20_risk_summary", oracle("SELECT file_id, count(*) AS n, string_agg(section_id || ':' || risk, ',' ORDER BY section_id) AS flags FROM sections WHERE risk >= 4 GROUP BY file_id"))
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.sections(spark, sf_dir).where("risk >= 4").select("file_id", "section_id", F.concat_ws(":", "section_id", "risk").alias("f"))
    return s.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_id", "f"))), lambda x: x["f"]), ",").alias("flags"))


def inline_children(sections: DataFrame) -> DataFrame:
    """Numbered children inside sections with a bare number (PRS-08): each `id.n` at a line start or after two blanks, to the next one."""
    mark = F.concat(F.lit("(?:^|\\n|  )("), F.col("section_id"), F.lit("\\.[0-9]{1,3}(?:\\.[0-9]{1,3})?)[ \\t]"))
    a = sections.where(F.col("section_id").rlike("^[0-9]+$") & (F.length("content") >= 50))
    found = a.withColumn("_ids", F.regexp_extract_all("content", mark, F.lit(1)))
    cut = F.split(F.col("content"), F.concat(F.lit("(?:^|\\n|  )(?="), F.col("section_id"), F.lit("\\.[0-9]{1,3}(?:\\.[0-9]{1,3})?[ \\t])")))
    pieces = F.filter(cut, lambda x: F.trim(x) != "")
    tail = F.slice(pieces, F.greatest(F.size(pieces) - F.size("_ids") + 1, F.lit(1)), F.greatest(F.size("_ids"), F.lit(0)))
    each = found.select("conv", "file_id", "pos", F.posexplode(F.arrays_zip(F.col("_ids").alias("id"), F.transform(tail, F.trim).alias("text"))).alias("k", "c"))
    kids = each.select("conv", "file_id", "pos", "k", F.col("c.id").alias("section_id"), F.col("c.text").alias("content")).where(F.length("content") >= C.MIN_CONTENT)
    new = kids.join(sections.select("file_id", "section_id"), ["file_id", "section_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("file_id", "section_id").orderBy("pos", "k"))
    return new.withColumn("_n", first).where("_n = 1").select("conv", "file_id", "section_id", "content")

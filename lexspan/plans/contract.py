"""Contract frames over the driver's tables: lines, sections, file facts, references, entities.

The tables hold prose without clauses, so fixed arithmetic on (doc_id, line) puts headers, schedules and cue phrases in. Every frame
is lazy; windows and groups are by file, so a file is the unit of work. A query that needs sections or references in several places
parses once: within `parse_once` these frames are written tables of the shared folder, of which each use reads the columns it needs.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

MIN_CONTENT = 15
SUFFIXES = {
    1: " subject to clause 2.1 of the Framework Agreement", 2: " a fee of $1,200 is payable", 3: " at 5% per annum", 4: " see Schedule 2", 5: " notwithstanding clause 3.1",
    6: " located at 12 High street", 7: " for acts or omissions before the effective date", 8: " as in section 4.2 of the Initial Addendum", 9: " under clause 12.3(a) of the Work Order Agreement",
    10: ' "Charges" means the sums of schedule 3', 11: " dated 3rd March 2021", 12: " Service Credit means a part of the fee", 13: " it incorporates the terms of the framework",
    14: " effective as of 2022-05-06 under paragraph 61 and clause 2.2 of the SOW", 15: " on 7 June 2019 by a Work Order",
}


Frame = Callable[[SparkSession, str], DataFrame]
#: Paths written by each session.
_PATHS: dict[int, list[str]] = {}
_written: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("_written", default=None)


def parse_once(query: Frame) -> Frame:
    """query, with each frame of `once` that it uses written to a table the first time."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _written.get() is not None:
            return query(spark, sf_dir)
        token = _written.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _written.reset(token)

    return run


@contextlib.contextmanager
def prepared(spark: SparkSession) -> Iterator[None]:
    """Within, all queries share the frames of `once`: each is written the first time that a query needs it. Their tables go at the end."""
    held: dict[tuple[str, str], DataFrame] = {}
    token = _written.set(held)
    try:
        yield
    finally:
        _written.reset(token)
        clear(spark)


def clear(spark: SparkSession) -> None:
    """Removes the tables that queries of this session have written so far; what reads them must be done."""
    for path in _PATHS.pop(id(spark), []):
        gone = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def written_to(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which `clear` removes."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(id(spark), []).append(path)
    return path


def once(frame: Frame) -> Frame:
    """frame, which within parse_once is made once and then read."""

    @functools.wraps(frame)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = _written.get()
        if held is None:
            return frame(spark, sf_dir)
        key = (frame.__name__, sf_dir)
        if key not in held:
            path = written_to(spark, frame.__name__)
            frame(spark, sf_dir).write.parquet(path)
            held[key] = spark.read.parquet(path)
        return held[key]

    return get


def is_written(frame: Frame, sf_dir: str) -> bool:
    """Whether frame, one of `once`, has been written within parse_once."""
    return (frame.__name__, sf_dir) in (_written.get() or {})


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not hasattr(spark, "_lexspan_tables"):
        spark._lexspan_tables = tempfile.TemporaryDirectory(prefix="lexspan-")
    return "file://" + spark._lexspan_tables.name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_of(doc_id: Column, p: Column, x: Column) -> Column:
    """Line p, x in the table, with the header, schedule or cue phrase that stands there."""
    div = lambda n: F.call_function("div", p, F.lit(n))
    cue = (doc_id * 31 + p * 7) % 23
    tail = X.any_of([(cue == k, F.lit(s)) for k, s in SUFFIXES.items()], F.lit(""))
    number = F.concat(div(9) % 12 + 1, F.lit("."), div(3) % 3 + 1, F.lit("  "))
    part = F.concat(F.lit("PART "), div(3) + 1, F.lit(": "), F.substring(x, 1, 60))  # headings of every ninth file that only a second parse finds
    heads = F.when(p % 20 == 19, F.concat(F.lit("Schedule "), div(20) + 1, F.lit(" - Terms"))).when((p % 3 == 0) & (doc_id % 9 == 4), F.concat(part, tail))
    return heads.when(p % 3 == 0, F.concat(number, x, tail)).otherwise(F.concat(x, tail))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, file_id, doc_id, lang, p, page, line)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("conv"), F.posexplode(F.split("text", "\n")).alias("p", "x"))
    line = line_of(F.col("doc_id"), F.col("p"), F.col("x"))
    return d.select("conv", F.concat(F.lit("f"), "doc_id").alias("file_id"), "doc_id", "lang", "p", F.expr("p div 12 + 1").alias("page"), line.alias("line"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with section_id and title where a header stands, the running number of the section and the schedule in force."""
    w = Window.partitionBy("file_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    a = lines(spark, sf_dir).withColumns({"section_id": X.header_id(F.col("line")), "title": X.header_title(F.col("line"))})
    scheduled = F.when(F.col("section_id").rlike(P.SCHEDULE_LIKE), F.col("section_id"))
    return a.withColumns({"pos": F.count("section_id").over(w), "schedule": F.last_value(scheduled, True).over(w)})


def raw_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as parsed, before copies of an id are dropped."""
    g = headed(spark, sf_dir).where("pos > 0").groupBy("conv", "file_id", "doc_id", "pos")
    s = g.agg(
        F.first("section_id", True).alias("section_id"),
        F.min_by("title", "p").alias("title"),
        F.min("page").alias("page"),
        F.min_by("schedule", "p").alias("schedule"),
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.trim("line").alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n ")).alias("content"),
    )
    return s.where(F.length("content") >= MIN_CONTENT).withColumn("parent_id", X.parent_id(F.col("section_id")))


@once
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section for each id of a file: the longest, of equals the first, at the place of the first."""
    same = Window.partitionBy("file_id", "section_id")
    best = F.row_number().over(same.orderBy(F.desc(F.length("content")), "pos"))
    s = raw_sections(spark, sf_dir).withColumns({"_n": best, "first_pos": F.min("pos").over(same)}).where("_n = 1").drop("_n")
    kind = F.element_at(F.array(*[F.lit(t) for t in P.CLAUSE_TYPES]), ((F.col("doc_id") * 7 + F.col("pos") * 3) % 20 + 1).cast("int"))
    return s.withColumns({"clause_type": kind, "risk": (F.col("doc_id") + F.col("pos")) % 5 + 1, "qualifier": F.col("content").rlike(P.QUALIFIER)})


def found_in_sections(spark: SparkSession, sf_dir: str, find: Callable[[Column], Column]) -> DataFrame:
    """(conv, file_id, section_id, found): of each of `sections` what find, an array, finds in its lines, each by itself. Lengths tell which copy of an id counts, so no text is shuffled."""
    w = Window.partitionBy("file_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    t = F.trim("line")
    a = lines(spark, sf_dir).select("conv", "file_id", "doc_id", "p", X.header_id(F.col("line")).alias("section_id"), F.length(t).alias("n"), find(t).alias("found"))
    g = a.withColumn("pos", F.count("section_id").over(w)).where("pos > 0").groupBy("conv", "file_id", "doc_id", "pos")
    filled = F.transform(F.sort_array(F.collect_list(F.struct("p", "n"))), lambda x: x["n"] > 0)
    s = g.agg(F.first("section_id", True).alias("section_id"), F.sum("n").alias("n"), filled.alias("filled"), F.flatten(F.collect_list("found")).alias("found"))
    first, last = F.array_position("filled", True), F.array_position(F.reverse("filled"), True)  # empty lines before and behind don't count
    s = s.withColumn("n", F.when(first > 0, F.col("n") + F.size("filled") + 1 - first - last).otherwise(0)).where(F.col("n") >= MIN_CONTENT)
    best = F.row_number().over(Window.partitionBy("file_id", "section_id").orderBy(F.desc("n"), "pos"))
    return s.withColumn("_n", best).where("_n = 1").select("conv", "file_id", "section_id", "found")


def outlined(spark: SparkSession, sf_dir: str, find: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(conv, file_id, doc_id, section_id, parent_id) of `sections` with what find gives for their contents. A text is parsed in its own row, and of a section only this goes on to where
    copies of an id are dropped: no text is shuffled."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("conv"), F.concat(F.lit("f"), "doc_id").alias("file_id"), "doc_id", F.split("text", "\n").alias("x"))
    d = d.withColumn("t", F.transform("x", lambda x, p: F.trim(line_of(F.col("doc_id"), p, x)))).withColumn("ids", F.transform("t", X.header_id))
    d = d.withColumn("heads", F.filter(F.transform("ids", lambda h, p: F.when(h.isNotNull(), p)), lambda p: p.isNotNull()))

    def section(p: Column, k: Column) -> Column:
        below = F.slice("t", p + 1, F.coalesce(F.get("heads", k + 1), F.size("t")) - p)
        return F.struct((k + 1).alias("pos"), F.get("ids", p).alias("section_id"), F.trim(F.array_join(below, "\n"), F.lit("\n ")).alias("content"))

    key = ["conv", "file_id", "doc_id"]
    s = d.select(*key, F.inline(F.transform("heads", section))).where(F.length("content") >= MIN_CONTENT)
    found = find(F.col("content"))
    s = s.select(*key, "pos", "section_id", F.length("content").alias("n"), *[c.alias(k) for k, c in found.items()])
    best = F.row_number().over(Window.partitionBy("file_id", "section_id").orderBy(F.desc("n"), "pos"))
    return s.withColumn("_n", best).where("_n = 1").select(*key, "section_id", X.parent_id(F.col("section_id")).alias("parent_id"), *found)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, file_id, doc_id, file_name, role, role_rank, effective_date, person, org)."""
    d = table(spark, sf_dir, "documents")
    k = F.expr("doc_id div 20 % 5")  # a conversation (doc_id mod 20) has files of all roles
    role = X.any_of([(k == i, F.lit(r)) for i, r in enumerate(("master_agreement", "transaction", "modification", "termination"))], F.lit("standalone"))
    name = X.any_of([(k == i, F.lit(r)) for i, r in enumerate(("Framework Agreement ", "Work Order ", "Addendum ", "Termination Notice "))], F.lit("Policy "))
    return d.select(
        F.col("source").alias("conv"),
        F.concat(F.lit("f"), "doc_id").alias("file_id"),
        "doc_id",
        F.concat(name, "doc_id").alias("file_name"),
        role.alias("role"),
        X.role_rank(role).alias("role_rank"),
        F.when(F.col("doc_id") % 11 != 0, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")), "yyyy-MM-dd")).alias("effective_date"),
        F.concat(F.lit("person "), (F.col("doc_id") % 40).cast("string")).alias("person"),
        F.concat(F.lit("The "), F.upper("lang"), F.lit(" Holdings Ltd")).alias("org"),
    )


@once
def crossrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, file_id, doc_id, section_id, ref, hint): references of each section but to itself, with the document named behind them."""
    found = sections(spark, sf_dir).select("conv", "file_id", "doc_id", "section_id", F.inline(X.hinted_refs(F.col("content"))))
    return found.where("ref <> section_id")

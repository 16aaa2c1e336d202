"""From a question to its cited context: seeds, injection, first-writer-wins, re-ranking, gaps, conflicts, precedence and citations (RET-08 to RET-25, RET-27).

Each conversation has a question, and guards on it are columns. A section is looked at once: an array holds the tags of all injectors that bring
it. The least tag that takes a section keeps it, and caps count what lower tags have not taken. Opening pages and definitions are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..plans import contract as C
from ..plans import fixed as S
from ..plans.sql import lit, oracle
from ..registry import query
from . import definitions as D
from . import entities as E
from . import graph as G
from . import names as N
from .crossrefs import RESOLVED, resolved
from .retrieval import _COS, LEAST_SCORE, TOP_K, cosine

KEY = ["conv", "file_id", "doc_id", "section_id", "pos"]
_S = ", ".join(KEY)
QUESTIONS = [
    "compare fee due under schedule 2 of framwork agreement for each buyer after 2021-01-01",
    "which service level and uptime apply at office address of mainstay under terminaton notice",
    "who is liable for an act on 12 March 2021 under schedule 1 by charges",
    "what is service credit",
]
#: Vectors of a conversation's questions: the question's own and its expansions.
ASKED = 3
# How many new sections an injector adds, how many it looks at, characters of an opening page, and slots of definitions.
CAP = {6: 5, 11: 15}
OF_SCHEDULE, MONEY_FIRST, ADDRESS_FIRST, OPENING_CHARS = 30, 300, 200, 3000
ASKED_TERMS, TERMS, SCANNED_SECTIONS, SCANNED_LINES = 5, 10, 5, 15
IMMUNE = (2, 3, 4, 5, 10, 11, 12, 13, 14, 15)
KEEP, KEEP_COMPARED = 20, 25
GAP_ID, GAP_TITLE, GRAPH_SCORE = 5, 3, 0.8
DEFINITION_ASKED = P.whole(r"what\s+is|what\s+are|who\s+is|define|definition\s+of|meaning\s+of")
_SUBJECT_STOP = r"(?i)(?<![A-Za-z0-9_])(?:what\s+is|what\s+are|who\s+is|define|definition\s+of|meaning\s+of|the|a|an|in|of|this|that|agreement|contract|please|tell|me)(?![A-Za-z0-9_])"
#: What a model asks for when it has seen the sections (pluggable): ids and words of titles.
GAPS = ["§3.1", "Schedule 7 §1.2", "Terms"]


def questions(df: DataFrame) -> Column:
    """The question asked of a conversation."""
    return F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.ascii(F.substring("conv", -1, 1)) % len(QUESTIONS) + 1).cast("int"))


def _n(by: list, *order) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*(order or ("doc_id", "pos"))))


# --- seeds and injection ---------------------------------------------------------------------------------------------------------


@C.once
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(KEY, score): the sections that vector search finds: for each conversation the best points of several question vectors, as far as they are near
    enough, and the first section of each point's document. Every seventh document has no section vector."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("conv")).where("doc_id % 7 <> 6")
    points = C.table(spark, sf_dir, "embeddings").join(d, F.col("vec_id") == F.col("doc_id")).select("conv", "doc_id", "embedding")
    asked = points.withColumn("q", _n(["conv"], "doc_id")).where(F.col("q") <= ASKED)
    met = points.join(asked.select("conv", "q", F.col("embedding").alias("asked")), "conv").withColumn("score", F.round(cosine(F.col("embedding"), F.col("asked")), 6))
    ranked = met.withColumn("rank", _n(["conv", "q"], F.desc("score"), "doc_id")).where((F.col("rank") <= TOP_K) & (F.col("score") >= LEAST_SCORE))
    near = C.sections(spark, sf_dir).join(ranked.groupBy("doc_id").agg(F.max("score").alias("score")), "doc_id")
    return near.withColumn("_n", _n(["file_id"], "pos")).where("_n = 1").select(*KEY, "score")


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(KEY, page, content): each file's first page with agreement language that is no table of contents, else its first page with text (RET-13)."""
    return _openings(C.lines(spark, sf_dir))


@C.once
def party_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The openings of conversations whose question asks for parties: no others join the pool."""
    every = C.lines(spark, sf_dir)
    return _openings(every.where(questions(every).rlike(P.PARTY_ASKED)))


def _openings(lines: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    dotted, filled = F.count(F.when(F.col("line").rlike(P.TOC_LINE), 1)), F.count(F.when(F.trim("line") != "", 1))
    dealt = lines.select("conv", "file_id", "doc_id", "page", "p", "line").repartition("file_id")  # a file's lines and its pages meet once
    pages = dealt.groupBy("conv", "file_id", "doc_id", "page").agg(text.alias("t"), ((dotted >= 3) & (4 * dotted >= filled)).alias("contents")).where("trim(t) <> ''")
    order = F.when(F.col("t").rlike(P.OPENING) & ~F.col("contents"), 0).otherwise(1) * 100000 + F.col("page")
    best = pages.groupBy("conv", "file_id", "doc_id").agg(F.min_by(F.struct("page", "t"), order).alias("b"))
    return best.select("conv", "file_id", "doc_id", F.lit("__raw_page1_preamble").alias("section_id"), F.lit(0).cast("long").alias("pos"), F.col("b.page").alias("page"), F.substring(F.btrim("b.t", F.lit(" \n\t\r")), 1, OPENING_CHARS).alias("content"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, file_id) of files that the conversation's question names, spelt as it likes (RET-19b)."""
    f = C.files(spark, sf_dir).select("conv", "file_id", "file_name")
    return N.hinted_files(f.withColumn("question", questions(f)))


def organisation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, file_id) of files with an organisation that has a word of three letters or more in the question (RET-19c)."""
    e = E.index(spark, sf_dir)
    q = F.lower(questions(e))
    hit = F.exists(F.split("key", " "), lambda t: (F.length(t) >= 3) & q.contains(t))
    return e.where((F.col("kind") == "organization") & hit).select("conv", "file_id").distinct()


@C.once
def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY and _by, the injectors that bring a section, in order, each with whether it is immune: every section is looked at once.

    0 seeds; 1 order of precedence; 2 governing law; 3 disputes, by type or title; 4 service levels if asked; 5 opening pages if parties are asked; 6 qualifiers
    of seed files; 7, 8 references out of and into seeds; 9 the first sections of each schedule named; 10 term clauses of transactions (`chain` asks for those in the
    pool); 11 money if asked, among the first sections by role; 12 files named; 13 organisations named; 14 addresses among the first sections of seed files if asked; 15
    kept liability in modifications and terminations if a date is asked. A conversation without seeds gets nothing.
    """
    found = seeds(spark, sf_dir)
    yes = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    ids, seed_files, answered = found.select("conv", "section_id").distinct(), found.select("file_id").distinct(), found.select("conv").distinct()
    refs = resolved(spark, sf_dir).where("to_file is not null")
    # the two conditions are independent: a seed file, and an id that any seed of the conversation has
    out = refs.join(seed_files, "file_id", "left_semi").join(ids, ["conv", "section_id"], "left_semi").select(F.col("to_file").alias("file_id"), F.col("to_section").alias("section_id"))
    into = refs.join(seed_files.withColumnRenamed("file_id", "to_file"), "to_file", "left_semi").join(ids.withColumnRenamed("section_id", "to_section"), ["conv", "to_section"], "left_semi").select("file_id", "section_id")
    # what is asked is found once a conversation, not once a section
    asks = lambda p: questions(answered).rlike(p)
    asked = answered.select(
        "conv", asks(P.SERVICE_ASKED).alias("asks_service"), asks(P.FINANCIAL).alias("asks_money"), asks(P.LOCATION_ASKED).alias("asks_place"), asks(P.DATE_ASKED).alias("asks_date"),
        F.array_distinct(F.regexp_extract_all(F.lower(questions(answered)), F.lit(P.SCHEDULE_NAMED), F.lit(1))).alias("labels"),
    )
    s = C.sections(spark, sf_dir).join(asked.drop("labels"), "conv").join(C.files(spark, sf_dir).select("file_id", "role"), "file_id")
    for frame, name in ((seed_files, "in_seed_file"), (named_files(spark, sf_dir).select("file_id"), "in_named_file"), (organisation_files(spark, sf_dir).select("file_id"), "in_organisation")):
        s = s.join(yes(frame, name), "file_id", "left")
    # what injectors look at first: group limits, so a task keeps so many rows a group before the shuffle
    bare = C.sections(spark, sf_dir).join(answered, "conv", "left_semi").select(*KEY, "schedule")
    labelled = bare.where("schedule is not null").join(asked.select("conv", F.explode("labels").alias("label")), "conv")
    labelled = labelled.where(F.regexp_like("schedule", F.concat(F.lit("(?i)(?:^|[^A-Za-z0-9_])"), F.regexp_replace("label", "\\s+", "\\\\s+"), F.lit("(?:[^A-Za-z0-9_]|$)"))))
    of_schedule = labelled.withColumn("_n", _n(["conv", "label"])).where(F.col("_n") <= OF_SCHEDULE)
    early = bare.withColumn("_n", _n(["conv"])).where(F.col("_n") <= MONEY_FIRST)
    near = bare.join(seed_files, "file_id", "left_semi").withColumn("_n", _n(["conv"])).where(F.col("_n") <= ADDRESS_FIRST)
    for frame, name in ((found, "is_seed"), (out, "out"), (into, "into"), (of_schedule, "in_named_schedule"), (early, "early"), (near, "near")):
        s = s.join(yes(frame.select("file_id", "section_id"), name), ["file_id", "section_id"], "left")
    s = s.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("early", "near")})  # behind a null the text would be searched all the same
    said, kind, late = F.col("content"), F.col("clause_type"), F.col("role").isin("modification", "termination")
    rules = [
        (0, F.col("is_seed")),
        (1, kind == "order_of_precedence"),
        (2, kind == "governing_law"),
        (3, (kind == "dispute_resolution") | F.col("title").rlike(P.DISPUTE_TITLE)),
        (4, F.col("asks_service") & kind.isin(P.SERVICE_TYPES)),
        (6, F.col("qualifier") & F.col("in_seed_file")),
        (7, F.col("out")),
        (8, F.col("into")),
        (9, F.col("in_named_schedule")),
        (10, (F.col("role") == "transaction") & F.col("section_id").rlike("^(6|10)(\\.[0-9]+)?$")),
        (11, F.col("asks_money") & F.col("early") & said.rlike(P.MONEY)),
        (12, F.col("in_named_file")),
        (13, F.col("in_organisation")),
        (14, F.col("asks_place") & F.col("near") & said.rlike(P.ADDRESS)),
        (15, F.col("asks_date") & late & said.rlike(P.RETAINED)),
    ]
    tags = F.array(*[F.when(when, F.lit(n)) for n, when in rules])
    brought = F.filter(F.array(F.filter(tags, lambda x: x.isNotNull())), lambda by: F.size(by) > 0)  # exploded, for a condition on the tags would find them twice
    s = s.select(*KEY, F.explode(brought).alias("_by"))
    first = party_openings(spark, sf_dir).join(answered, "conv", "left_semi")
    return s.unionByName(first.select(*KEY, F.array(F.lit(5)).alias("_by")))


def first_wins(candidates: DataFrame) -> DataFrame:
    """candidates (KEY, injector), a row for each injector that brings a section, as `chain` settles them."""
    return chain(candidates.groupBy(*KEY).agg(F.sort_array(F.collect_set("injector")).alias("_by")), F.lit(0))


def chain(left: DataFrame, rank: Column) -> DataFrame:
    """One row for each section, of the first injector in order of tags that takes it. rank: of a section's role, for the order of money.

    A capped injector takes, in each conversation, as many as its cap of the sections that lower tags haven't taken; the rest stay open to the later
    injectors that bring them too. Term clauses (10) count for files of which a tag up to 9 has kept a section.
    """
    left = left.withColumn("_rank", rank)
    left = _capped_by(left, 6, ["doc_id", "pos"])
    have = F.max(F.get("_by", F.lit(0)) < 10).over(Window.partitionBy("conv", "file_id"))
    left = left.withColumn("_have", have).withColumn("_by", F.when(F.col("_have"), F.col("_by")).otherwise(F.filter("_by", lambda x: x != 10))).drop("_have").where(F.size("_by") > 0)
    left = _capped_by(left, 11, [F.desc("_rank"), "doc_id", "pos"])
    injector = F.get("_by", F.lit(0))
    return left.select(*KEY, injector.alias("injector"), injector.isin(*IMMUNE).alias("immune"))


def _capped_by(left: DataFrame, k: int, order: list) -> DataFrame:
    """left, with the tag k gone where it comes first but beyond its cap: a group limit, so that a task keeps CAP[k] rows a conversation before the shuffle."""
    now = F.get("_by", F.lit(0)) == k
    taken = left.where(now).withColumn("_n", _n(["conv"], *order)).where(F.col("_n") <= CAP[k]).select("file_id", "section_id", F.lit(True).alias("_taken"))
    left = left.join(taken, ["file_id", "section_id"], "left")
    return left.withColumn("_by", F.when(now & F.col("_taken").isNull(), F.filter("_by", lambda x: x != k)).otherwise(F.col("_by"))).drop("_taken").where(F.size("_by") > 0)


@C.once
def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY, injector, immune, score: what injectors 0 to 15 bring."""
    ranks = C.files(spark, sf_dir).select("file_id", "role_rank")
    found = chain(injected(spark, sf_dir).join(ranks, "file_id"), F.col("role_rank"))
    hit = seeds(spark, sf_dir).select("file_id", "section_id", "score")
    return found.join(hit, ["file_id", "section_id"], "left").select(*KEY, "injector", "immune", F.coalesce("score", F.lit(0.0)).alias("score"))


# --- definitions and the graph ---------------------------------------------------------------------------------------------------


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, section_id, title, content, page, schedule, clause_type, risk) of sections and of the opening pages that may join a pool."""
    none = F.lit(None).cast("string")
    s = C.sections(spark, sf_dir).select("file_id", "section_id", "title", "content", "page", "schedule", "clause_type", "risk")
    first = party_openings(spark, sf_dir).select("file_id", "section_id", F.lit("Page 1 (Preamble / Parties)").alias("title"), "content", "page", none.alias("schedule"), F.lit("general").alias("clause_type"), F.lit(1).cast("long").alias("risk"))
    return s.unionByName(first)


@C.once
def pool_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that files of the pool define."""
    return D.combined(D.defined_terms(C.sections(spark, sf_dir).join(pool(spark, sf_dir).select("file_id").distinct(), "file_id", "left_semi")))


@C.once
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY, immune, content: definitions of terms that the question or what the pool holds uses (RET-19f), as rows `__def_...` of the file that defines the term; pos is the slot.

    Terms of the question come first, the longest first, ASKED_TERMS at most; then those of the pool's texts in order of use, TERMS in all. A question
    for a meaning also brings the lines with its subject from the first of the first SCANNED_SECTIONS sections of definitions that has it.
    """
    p, terms = pool(spark, sf_dir), pool_terms(spark, sf_dir)
    asked = terms.where(F.lower(questions(terms)).contains(F.lower("term")))
    asked = asked.withColumn("slot", _n(["conv"], F.desc(F.length("term")), "doc_id", "k")).where(F.col("slot") <= ASKED_TERMS)
    held = p.join(texts(spark, sf_dir).select("file_id", "section_id", "content"), ["file_id", "section_id"])
    uses = D.used_terms(held.select("conv", F.struct("injector", "doc_id", "pos", "section_id").alias("key"), "content"), terms)
    first = uses.groupBy("conv", "term").agg(F.min(F.struct("key", "at")).alias("use")).join(asked.select("conv", "term"), ["conv", "term"], "left_anti")
    taken = asked.groupBy("conv").agg(F.max("slot").alias("taken"))
    used = first.withColumn("_n", _n(["conv"], "use")).join(taken, "conv", "left").withColumn("slot", F.col("_n") + F.coalesce("taken", F.lit(0))).where(F.col("slot") <= TERMS)
    used = used.select("conv", "term", "slot").join(terms, ["conv", "term"])
    every = asked.select("conv", "term", "slot", "file_id", "doc_id", "definition", F.lit(True).alias("immune")).unionByName(used.select("conv", "term", "slot", "file_id", "doc_id", "definition", F.lit(False).alias("immune")))
    name = F.concat(F.lit("__def_"), F.replace(F.lower("term"), F.lit(" "), F.lit("_")))
    rows = every.select("conv", "file_id", "doc_id", name.alias("section_id"), F.col("slot").cast("long").alias("pos"), "immune", F.concat(F.lit('"'), "term", F.lit('" means '), "definition").alias("content"))
    return rows.unionByName(_scanned(spark, sf_dir, p))


def _scanned(spark: SparkSession, sf_dir: str, p: DataFrame) -> DataFrame:
    s = C.sections(spark, sf_dir).where("clause_type = 'definitions'").join(p.select("conv").distinct(), "conv", "left_semi").select(*KEY, "content")
    s = s.where(questions(s).rlike(DEFINITION_ASKED)).withColumn("_n", _n(["conv"])).where(F.col("_n") <= SCANNED_SECTIONS)
    subject = F.lower(F.btrim(F.regexp_replace(questions(s), _SUBJECT_STOP, " "), F.lit(" \t\n?.,")))
    s = s.withColumn("subject", subject).where((F.length("subject") >= 3) & F.lower("content").contains(F.col("subject")))
    lines = F.slice(F.filter(F.split("content", "\n"), lambda x: F.lower(x).contains(F.col("subject"))), 1, SCANNED_LINES)
    s = s.withColumn("_n", _n(["conv"])).where("_n = 1")
    name = F.concat(F.lit("__def_scan_"), F.replace(F.substring("subject", 1, 40), F.lit(" "), F.lit("_")))
    return s.select("conv", "file_id", "doc_id", name.alias("section_id"), F.lit(TERMS + 1).cast("long").alias("pos"), F.lit(True).alias("immune"), F.array_join(lines, "\n").alias("content"))


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY of the sections one semantic edge from a seed that the pool doesn't have (RET-21)."""
    near = G.neighbours(spark, sf_dir, seeds(spark, sf_dir).select("conv", "file_id", "section_id"))
    new = near.join(pool(spark, sf_dir).select("file_id", "section_id"), ["file_id", "section_id"], "left_anti")
    return C.sections(spark, sf_dir).select(*KEY).join(new.select("file_id", "section_id"), ["file_id", "section_id"], "left_semi").select(*KEY)


@C.once
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY, injector, immune, score: the pool, definitions (16) and neighbours in the graph (17)."""
    defs = definitions(spark, sf_dir).select(*KEY, F.lit(16).alias("injector"), "immune", F.lit(0.0).alias("score"))
    more = graph_neighbours(spark, sf_dir).select(*KEY, F.lit(17).alias("injector"), F.lit(True).alias("immune"), F.lit(GRAPH_SCORE).alias("score"))
    return pool(spark, sf_dir).unionByName(defs).unionByName(more)


# --- after the pool --------------------------------------------------------------------------------------------------------------

_SCORE = "(doc_id * 17 + pos * 5) % 101"


def rerank(found: DataFrame, score: Column) -> DataFrame:
    """Immune rows stay; of the others the best by score: KEEP, or KEEP_COMPARED where the question compares; up to five candidates pass as they are (RET-22)."""
    keep = F.when(questions(found).rlike(P.COMPARISON_ASKED), KEEP_COMPARED).otherwise(KEEP)
    ranked = found.where(~F.col("immune")).withColumn("_n", _n(["conv"], F.desc(score), "doc_id", "pos", "section_id")).where(F.col("_n") <= KEEP_COMPARED)
    return found.where("immune").unionByName(ranked.where(F.col("_n") <= keep).drop("_n"))  # five are among the best anyway


@C.once
def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank(candidates(spark, sf_dir), F.expr(_SCORE))


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY, gap: what the named gaps ask for, by id (GAP_ID a gap) and by words of the title (GAP_TITLE a gap), as far as it isn't confirmed (RET-23)."""
    c = confirmed(spark, sf_dir)
    gap = F.explode(F.array(*map(F.lit, GAPS)))
    s = C.sections(spark, sf_dir).join(c.select("conv").distinct(), "conv", "left_semi").select(*KEY, "title", gap.alias("gap"))
    number = F.regexp_extract("gap", r"([0-9][0-9.]*[0-9]|[0-9])", 1)
    words = F.trim(F.regexp_replace("gap", r"[§0-9.\s]+", " "))
    by_id = s.where((number != "") & (F.col("section_id") == number)).withColumn("_n", _n(["conv", "gap"])).where(F.col("_n") <= GAP_ID)
    by_title = s.where((F.length(words) > 3) & F.lower("title").contains(F.lower(words))).withColumn("_n", _n(["conv", "gap"])).where(F.col("_n") <= GAP_TITLE)
    both = by_id.union(by_title).groupBy(*KEY).agg(F.min("gap").alias("gap"))
    return both.join(c.select("file_id", "section_id"), ["file_id", "section_id"], "left_anti").select(*KEY, "gap")


def conflicts(found: DataFrame, texts: DataFrame, files: DataFrame) -> DataFrame:
    """Clause types on which several files of the candidates speak, with the file that counts: the latest; where no file is dated, the one of highest document rank; the first
    candidate of equals (RET-24). Definitions have no say."""
    of = files.select("file_id", "effective_date", "document_rank")
    a = found.where("injector <> 16").join(texts.where(F.col("clause_type").isin(P.CONFLICT_TYPES)).select("file_id", "section_id", "clause_type"), ["file_id", "section_id"]).join(of, "file_id")
    place = [F.col("immune"), -F.col("injector"), -F.col("doc_id"), -F.col("pos"), F.col("file_id")]
    most = lambda c: F.max(F.struct(c, *[x.alias(f"_{k}") for k, x in enumerate(place)]))["_4"]
    g = a.groupBy("conv", "clause_type").agg(F.when(F.max("effective_date").isNotNull(), most("effective_date")).otherwise(most("document_rank")).alias("latest"), F.count_distinct("file_id").alias("n_files"))
    return g.where("n_files > 1")


@C.once
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is confirmed, and what fills the gaps (18)."""
    more = gap_rows(spark, sf_dir).select(*KEY, F.lit(18).alias("injector"), F.lit(False).alias("immune"), F.lit(0.0).alias("score"))
    return confirmed(spark, sf_dir).unionByName(more)


def ranked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, file_name, role_rank, effective_date, document_rank)."""
    from ..functions import text as X

    f = C.files(spark, sf_dir)
    return f.select("file_id", "file_name", "role_rank", "effective_date", X.document_rank(F.col("file_name")).alias("document_rank"))


def assemble(found: DataFrame, texts: DataFrame, files: DataFrame) -> DataFrame:
    """The context in order: schedules first, then the newest, then by role, then by score; numbered, with headers and tags (RET-25). Definitions stand in it without a number."""
    s = found.join(texts.select("file_id", "section_id", "content", "page", "schedule", "clause_type", "risk"), ["file_id", "section_id"]).join(files, "file_id")
    s = s.where(F.trim("content") != "").join(conflicts(found, texts, files).select("conv", "clause_type", "latest"), ["conv", "clause_type"], "left")
    order = [F.col("schedule").isNull().cast("int"), F.desc(F.coalesce("effective_date", F.lit("0000-00-00"))), F.desc("role_rank"), F.desc("score"), "injector", "doc_id", "pos", "section_id"]
    w = Window.partitionBy("conv").orderBy(*order)
    background = F.col("injector") == 16
    n = F.count(F.when(~background, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    clause = (
        F.when(F.col("schedule").isNotNull() & (F.col("section_id") != F.col("schedule")), F.concat(F.lit(", "), F.initcap("schedule"), F.lit(" §"), "section_id"))
        .when(~F.col("section_id").startswith("__"), F.concat(F.lit(", §"), "section_id"))
        .otherwise("")
    )
    dated = F.coalesce(F.concat(F.lit(" [effective "), "effective_date", F.lit("]")), F.lit(""))
    old = F.when(F.col("latest").isNotNull() & (F.col("latest") != F.col("file_id")), " [HISTORICAL VERSION — superseded by more recent document]").otherwise("")
    risk = F.when(F.col("risk") == 5, " [⚠ HIGH RISK]").when(F.col("risk") == 4, " [⚠ ABOVE MARKET]").otherwise("")
    head = F.concat(F.lit("[Source "), n, F.lit(": "), "file_name", clause, F.lit(", Page "), "page", dated, old, risk, F.lit("]"))
    s = s.select("conv", F.row_number().over(w).alias("place"), F.when(~background, n).alias("source"), "file_id", "section_id", F.when(background, "[Background definition]").otherwise(head).alias("header"), F.md5("content").alias("content_md5"))
    return s


def definition_texts(defs: DataFrame) -> DataFrame:
    """Definitions in the columns of `texts`."""
    none = F.lit(None).cast("string")
    kind = F.when(F.col("section_id").startswith("__def_scan_"), "definitions").otherwise("other")
    return defs.select("file_id", "section_id", F.lit("Definition").alias("title"), "content", F.lit(0).alias("page"), none.alias("schedule"), kind.alias("clause_type"), F.lit(1).cast("long").alias("risk"))


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir)
    return t.unionByName(definition_texts(definitions(spark, sf_dir)).withColumn("page", F.col("page").cast(t.schema["page"].dataType)))


# --- SQL twins -------------------------------------------------------------------------------------------------------------------

_POINTS = "SELECT d.source AS conv, d.doc_id, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.doc_id % 7 <> 6"
_ASKED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY doc_id) AS n FROM points) WHERE n <= {ASKED}"
_HITS = f"SELECT doc_id, max(s) AS score FROM (SELECT e.doc_id, {_COS} AS s, row_number() OVER (PARTITION BY e.conv, q.n ORDER BY {_COS} DESC, e.doc_id) AS rank FROM points e JOIN asked q USING (conv)) WHERE rank <= {TOP_K} AND s >= {LEAST_SCORE} GROUP BY doc_id"
_SEED_SQL = f"SELECT {_S}, score FROM (SELECT s.*, h.score, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS n FROM sections s JOIN hits h USING (doc_id)) WHERE n = 1"
_QUESTION = f"list_value({', '.join(map(lit, QUESTIONS))})[ascii(right(conv, 1)) % {len(QUESTIONS)} + 1]"
_ASKING = f"SELECT s.*, {_QUESTION} AS question FROM sections s WHERE conv IN (SELECT conv FROM seeds)"
_IN_SEEDS = "file_id IN (SELECT file_id FROM seeds)"
_OPENINGS = f"""
    SELECT conv, file_id, doc_id, '__raw_page1_preamble' AS section_id, 0::BIGINT AS pos, page, left(trim(t, ' ' || chr(10) || chr(9) || chr(13)), 3000) AS content FROM (
        SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN regexp_matches(t, {lit(S.OPENING)}) AND NOT contents THEN 0 ELSE 1 END, page) AS n FROM (
            SELECT conv, file_id, doc_id, page, string_agg(line, chr(10) ORDER BY p) AS t, count(*) FILTER (regexp_matches(line, {lit(S.TOC_LINE)})) >= 3 AND 4 * count(*) FILTER (regexp_matches(line, {lit(S.TOC_LINE)})) >= count(*) FILTER (trim(line) <> '') AS contents
            FROM lines GROUP BY conv, file_id, doc_id, page) WHERE trim(t) <> '') WHERE n = 1"""
# The blocks of two tokens by recursion: each step takes the longest common part, of equals the first, and goes on to the left and right of it.
_TOKENS = f"SELECT DISTINCT question, token FROM (SELECT {_QUESTION} AS question, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(file_name, '(?i)\\.pdf$|\\.docx?$|\\b(dd|the|and|for|of|in|to|a|an)\\b', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 3)) AS token FROM files)"
_TOKEN_PAIRS = "SELECT *, contains(token, word) OR contains(word, token) AS part FROM (SELECT question, token, unnest(list_filter(regexp_split_to_array(lower(question), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) AS word FROM name_tokens)"
_BLOCKS = """
    WITH RECURSIVE seg(token, word, a, b, m) AS (
        SELECT DISTINCT token, word, token, word, 0 FROM token_pairs WHERE NOT part AND 2 * least(length(token), length(word)) >= 0.82 * (length(token) + length(word))
        UNION ALL
        SELECT token, word, CASE side WHEN 0 THEN left(a, i - 1) WHEN 1 THEN substr(a, i + k) ELSE '' END, CASE side WHEN 0 THEN left(b, j - 1) WHEN 1 THEN substr(b, j + k) ELSE '' END, CASE side WHEN 2 THEN k ELSE 0 END
        FROM (SELECT token, word, a, b, best.k AS k, -best.i AS i, -best.j AS j, unnest([0, 1, 2]) AS side FROM (
            SELECT token, word, a, b, list_max(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i: flatten(list_transform(range(1, length(b) + 1), lambda j: list_transform(range(1, least(length(a) - i, length(b) - j) + 2), lambda k:
                CASE WHEN substr(a, i, k) = substr(b, j, k) THEN {'k': k, 'i': -i, 'j': -j} END))))), lambda x: x IS NOT NULL)) AS best FROM seg WHERE a <> '' AND b <> '' AND m = 0) WHERE best IS NOT NULL))
    SELECT token, word FROM seg GROUP BY token, word HAVING 2.0 * sum(m) / (length(token) + length(word)) >= 0.82"""
_NAMED_FILES = f"""
    SELECT conv, file_id FROM (SELECT conv, file_id, {_QUESTION} AS question, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(file_name, '(?i)\\.pdf$|\\.docx?$|\\b(dd|the|and|for|of|in|to|a|an)\\b', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 3)) AS token FROM files)
    WHERE (question, token) IN (SELECT (question, token) FROM token_pairs WHERE part OR (token, word) IN (SELECT (token, word) FROM alike)) GROUP BY conv, file_id HAVING count(*) >= 2"""
_ORG_FILES = f"SELECT DISTINCT conv, file_id FROM entity_index WHERE kind = 'organization' AND len(list_filter(string_split(key, ' '), lambda t: length(t) >= 3 AND contains(lower({_QUESTION}), t))) > 0"
_OF_SCHEDULE = f"""
    SELECT file_id, section_id FROM (SELECT *, row_number() OVER (PARTITION BY conv, label ORDER BY doc_id, pos) AS n FROM (SELECT *, unnest(list_distinct(regexp_extract_all(lower(question), {lit(S.SCHEDULE_NAMED)}, 1))) AS label FROM asking)
    WHERE regexp_matches(schedule, '(?i)\\b' || replace(label, ' ', '\\s+') || '\\b')) WHERE n <= {OF_SCHEDULE}"""
_EARLY = f"SELECT file_id, section_id FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY doc_id, pos) AS n FROM asking) WHERE n <= {MONEY_FIRST}"
_NEAR = f"SELECT file_id, section_id FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY doc_id, pos) AS n FROM asking WHERE {_IN_SEEDS}) WHERE n <= {ADDRESS_FIRST}"
_AT = lambda frame: f"(file_id, section_id) IN (SELECT (file_id, section_id) FROM {frame})"
_BROUGHT = f"""
    SELECT {_S}, list_sort(list_distinct(list(injector))) AS tags FROM (
        SELECT {_S}, 0 AS injector FROM seeds
        UNION ALL SELECT {_S}, 1 FROM asking WHERE clause_type = 'order_of_precedence'
        UNION ALL SELECT {_S}, 2 FROM asking WHERE clause_type = 'governing_law'
        UNION ALL SELECT {_S}, 3 FROM asking WHERE clause_type = 'dispute_resolution' OR regexp_matches(title, {lit(S.DISPUTE_TITLE)})
        UNION ALL SELECT {_S}, 4 FROM asking WHERE regexp_matches(question, {lit(S.SERVICE_ASKED)}) AND clause_type IN ('warranties', 'payment_terms', 'service_levels')
        UNION ALL SELECT {_S}, 5 FROM openings WHERE conv IN (SELECT conv FROM seeds) AND regexp_matches({_QUESTION}, {lit(S.PARTY_ASKED)})
        UNION ALL SELECT {_S}, 6 FROM asking WHERE qualifier AND {_IN_SEEDS}
        UNION ALL SELECT {_S}, 7 FROM asking WHERE (file_id, section_id) IN (SELECT (to_file, to_section) FROM resolved WHERE to_file IS NOT NULL AND {_IN_SEEDS} AND (conv, section_id) IN (SELECT (conv, section_id) FROM seeds))
        UNION ALL SELECT {_S}, 8 FROM asking WHERE (file_id, section_id) IN (SELECT (file_id, section_id) FROM resolved WHERE to_file IN (SELECT file_id FROM seeds) AND (conv, to_section) IN (SELECT (conv, section_id) FROM seeds))
        UNION ALL SELECT {_S}, 9 FROM asking WHERE {_AT("of_schedule")}
        UNION ALL SELECT {_S}, 10 FROM asking WHERE regexp_matches(section_id, '^(6|10)(\\.[0-9]+)?$') AND file_id IN (SELECT file_id FROM files WHERE role = 'transaction')
        UNION ALL SELECT {_S}, 11 FROM asking WHERE regexp_matches(question, {lit(S.FINANCIAL)}) AND {_AT("early")} AND regexp_matches(content, {lit(S.MONEY)})
        UNION ALL SELECT {_S}, 12 FROM asking WHERE file_id IN (SELECT file_id FROM named_files)
        UNION ALL SELECT {_S}, 13 FROM asking WHERE file_id IN (SELECT file_id FROM org_files)
        UNION ALL SELECT {_S}, 14 FROM asking WHERE regexp_matches(question, {lit(S.LOCATION_ASKED)}) AND {_AT("near_seeds")} AND regexp_matches(content, {lit(S.ADDRESS)})
        UNION ALL SELECT {_S}, 15 FROM asking WHERE regexp_matches(question, {lit(S.DATE_ASKED)}) AND regexp_matches(content, {lit(S.RETAINED)}) AND file_id IN (SELECT file_id FROM files WHERE role IN ('modification', 'termination')))
    GROUP BY {_S}"""


def _capped(frame: str, k: int, cap: int, order: str = "doc_id, pos") -> str:
    """frame with the tag k taken from those of its sections that the cap leaves out."""
    rank = f"SELECT *, row_number() OVER (PARTITION BY conv, tags[1] = {k} ORDER BY {order}) AS n FROM {frame}"
    return f"SELECT * FROM (SELECT {_S}, CASE WHEN tags[1] = {k} AND n > {cap} THEN list_filter(tags, lambda x: x <> {k}) ELSE tags END AS tags FROM ({rank})) WHERE len(tags) > 0"


_TERM = f"SELECT * FROM (SELECT {_S}, CASE WHEN bool_or(tags[1] <= 9) OVER (PARTITION BY conv, file_id) THEN tags ELSE list_filter(tags, lambda x: x <> 10) END AS tags FROM cap6) WHERE len(tags) > 0"
_POOL = f"SELECT {_S}, tags[1] AS injector, tags[1] IN (2, 3, 4, 5, 10, 11, 12, 13, 14, 15) AS immune, coalesce(score, 0) AS score FROM cap11 LEFT JOIN (SELECT file_id, section_id, score FROM seeds) USING (file_id, section_id)"
_TEXTS = "SELECT file_id, section_id, title, content, page, schedule, clause_type, risk FROM sections UNION ALL SELECT file_id, section_id, 'Page 1', content, page, NULL, 'general', 1 FROM openings"
_DEFINED = r"(?:[“”‘’\"`„«»‹›]([A-Z][A-Za-z\s\-]{1,60}?)[“”‘’\"`„«»‹›]|(?:^|[^\p{L}\p{N}_])((?:[A-Z][a-z]{0,30}\s+){1,5}[A-Z][a-z]{0,30}|[A-Z][A-Z]{3,30}))\s+means\s+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
DEFINED_SQL = f"""
    SELECT conv, file_id, doc_id, term, min(k) AS k, arg_max(said, k) AS definition FROM (
        SELECT conv, file_id, doc_id, k, term, CASE WHEN length(said) > 350 AND contains(said, '. ') THEN CASE WHEN contains(left(said, 350), '. ') THEN regexp_extract(left(said, 350), '(?s)^(.*)\\. ', 1) || '.' ELSE '' END ELSE said END AS said FROM (
            SELECT conv, file_id, doc_id, k, trim(CASE WHEN q[k] <> '' THEN q[k] ELSE b[k] END, {_BLANKS}) AS term,
                   replace(trim(left(parts[k + 1] || coalesce(CASE WHEN q[k + 1] = '' AND NOT starts_with(whole[k + 1], b[k + 1]) THEN left(whole[k + 1], 1) END, ''), 400), {_BLANKS}), chr(10), ' ') AS said
            FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM (
                SELECT *, regexp_extract_all(t, {lit(_DEFINED)}) AS whole, regexp_extract_all(t, {lit(_DEFINED)}, 1) AS q, regexp_extract_all(t, {lit(_DEFINED)}, 2) AS b, string_split_regex(t, {lit(_DEFINED)}) AS parts
                FROM (SELECT conv, file_id, doc_id, string_agg(content, chr(10) ORDER BY pos) AS t FROM sections WHERE clause_type = 'definitions' GROUP BY conv, file_id, doc_id)))))
    WHERE length(term) > 1 AND said <> '' GROUP BY conv, file_id, doc_id, term"""
_TERMS_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv, term ORDER BY doc_id) AS n FROM defined WHERE file_id IN (SELECT file_id FROM pool)) WHERE n = 1"
_ASKED_TERMS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY length(term) DESC, doc_id, k) AS slot FROM terms WHERE contains(lower({_QUESTION}), lower(term))) WHERE slot <= {ASKED_TERMS}"
_USED_TERMS = f"""
    SELECT t.*, u.n + coalesce(a.taken, 0) AS slot FROM (
        SELECT conv, term, row_number() OVER (PARTITION BY conv ORDER BY place) AS n FROM (
            SELECT conv, term, min({{'i': injector, 'd': doc_id, 'p': pos, 's': section_id, 'k': k}}) AS place FROM (
                SELECT conv, injector, doc_id, pos, section_id, unnest(uses) AS term, unnest(range(len(uses))) AS k FROM (
                    SELECT p.*, regexp_extract_all(x.content, m.pattern, 1) AS uses FROM pool p JOIN texts x USING (file_id, section_id)
                    JOIN (SELECT conv, '\\b(' || string_agg(term, '|' ORDER BY length(term) DESC, term) || ')\\b' AS pattern FROM terms GROUP BY conv) m USING (conv))) GROUP BY conv, term)
        WHERE (conv, term) NOT IN (SELECT (conv, term) FROM asked_terms)) u JOIN terms t USING (conv, term) LEFT JOIN (SELECT conv, max(slot) AS taken FROM asked_terms GROUP BY conv) a USING (conv) WHERE u.n + coalesce(a.taken, 0) <= {TERMS}"""
_SCANNED_SQL = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY doc_id, pos) AS m FROM (
        SELECT *, lower(trim(regexp_replace(question, '(?i)\\b(what\\s+is|what\\s+are|who\\s+is|define|definition\\s+of|meaning\\s+of|the|a|an|in|of|this|that|agreement|contract|please|tell|me)\\b', ' ', 'g'), ' ?.,' || chr(9) || chr(10))) AS subject,
               row_number() OVER (PARTITION BY conv ORDER BY doc_id, pos) AS n FROM asking WHERE clause_type = 'definitions' AND regexp_matches(question, '(?i)\\b(what\\s+is|what\\s+are|who\\s+is|define|definition\\s+of|meaning\\s+of)\\b'))
        WHERE n <= {SCANNED_SECTIONS} AND length(subject) >= 3 AND contains(lower(content), subject)) WHERE m = 1"""
_DEFS = f"""
    SELECT conv, file_id, doc_id, '__def_' || replace(lower(term), ' ', '_') AS section_id, slot AS pos, immune, '"' || term || '" means ' || definition AS content
    FROM (SELECT conv, file_id, doc_id, term, definition, slot, true AS immune FROM asked_terms UNION ALL SELECT conv, file_id, doc_id, term, definition, slot, false FROM used_terms)
    UNION ALL SELECT conv, file_id, doc_id, '__def_scan_' || replace(left(subject, 40), ' ', '_'), {TERMS + 1}, true, array_to_string(list_filter(string_split(content, chr(10)), lambda x: contains(lower(x), subject))[1:{SCANNED_LINES}], chr(10)) FROM scanned"""
_CANDIDATES = f"""
    SELECT {_S}, injector, immune, score FROM pool UNION ALL SELECT {_S}, 16, immune, 0 FROM defs
    UNION ALL SELECT {_S}, 17, true, {GRAPH_SCORE} FROM sections WHERE {_AT("near")} AND NOT {_AT("pool")}"""
_RANKED = f"SELECT {_S}, injector, immune, score FROM (SELECT *, row_number() OVER (PARTITION BY conv, immune ORDER BY {_SCORE} DESC, doc_id, pos, section_id) AS n, count(*) OVER (PARTITION BY conv) AS total FROM candidates) WHERE immune OR total <= 5 OR n <= CASE WHEN regexp_matches({_QUESTION}, {lit(S.COMPARISON_ASKED)}) THEN 25 ELSE 20 END"
_GAPS = ", ".join(f"({lit(g)})" for g in GAPS)
_GAP_ROWS = f"""
    SELECT {_S}, min(gap) AS gap FROM (
        SELECT *, row_number() OVER (PARTITION BY conv, gap ORDER BY doc_id, pos) AS n, {GAP_ID} AS most FROM sections, (VALUES {_GAPS}) g(gap) WHERE section_id = nullif(regexp_extract(gap, '([0-9][0-9.]*[0-9]|[0-9])', 1), '')
        UNION ALL SELECT *, row_number() OVER (PARTITION BY conv, gap ORDER BY doc_id, pos) AS n, {GAP_TITLE} FROM sections, (VALUES {_GAPS}) g(gap) WHERE length(trim(regexp_replace(gap, '[§0-9.\\s]+', ' ', 'g'))) > 3 AND contains(lower(title), lower(trim(regexp_replace(gap, '[§0-9.\\s]+', ' ', 'g')))))
    WHERE n <= most AND conv IN (SELECT conv FROM ranked) AND NOT {_AT("ranked")} GROUP BY {_S}"""
_EVIDENCE = f"SELECT {_S}, injector, immune, score FROM ranked UNION ALL SELECT {_S}, 18, false, 0 FROM gap_rows"
_ALL_TEXTS = "SELECT * FROM texts UNION ALL SELECT file_id, section_id, 'Definition', content, 0, NULL, CASE WHEN starts_with(section_id, '__def_scan_') THEN 'definitions' ELSE 'other' END, 1 FROM defs"
_RANK_BY_NAME = "CASE WHEN regexp_matches(file_name, '(?i)\\btermination\\b') THEN 3 WHEN regexp_matches(file_name, '(?i)\\bwork\\s+order\\b') THEN 2 WHEN regexp_matches(file_name, '(?i)\\baddendum\\b') THEN 1 WHEN regexp_matches(file_name, '(?i)\\bframework\\b') THEN 0 ELSE 1 END"
_CONFLICTS = f"""
    SELECT conv, clause_type, file_id AS latest, n_files FROM (
        SELECT *, row_number() OVER (PARTITION BY conv, clause_type ORDER BY CASE WHEN any_date THEN coalesce(effective_date, '0000') ELSE '' END DESC, CASE WHEN any_date THEN 0 ELSE -document_rank END, immune DESC, injector, doc_id, pos) AS n FROM (
            SELECT e.*, x.clause_type, f.effective_date, {_RANK_BY_NAME} AS document_rank, bool_or(f.effective_date IS NOT NULL) OVER (PARTITION BY e.conv, x.clause_type) AS any_date, dense_rank() OVER (PARTITION BY e.conv, x.clause_type ORDER BY e.file_id) + dense_rank() OVER (PARTITION BY e.conv, x.clause_type ORDER BY e.file_id DESC) - 1 AS n_files
            FROM evidence e JOIN texts x USING (file_id, section_id) JOIN files f USING (file_id) WHERE e.injector <> 16 AND x.clause_type IN ({', '.join(map(lit, S.CONFLICT_TYPES))}))) WHERE n = 1 AND n_files > 1"""
FRAMES = {
    "bags": E.FRAMES["bags"], "entity_index": E.FRAMES["entity_index"], "resolved": RESOLVED, "points": _POINTS, "asked": _ASKED, "hits": _HITS, "seeds": _SEED_SQL, "asking": _ASKING, "openings": _OPENINGS, "name_tokens": _TOKENS,
    "token_pairs": _TOKEN_PAIRS, "alike": _BLOCKS, "named_files": _NAMED_FILES, "org_files": _ORG_FILES, "of_schedule": _OF_SCHEDULE, "early": _EARLY, "near_seeds": _NEAR, "brought": _BROUGHT, "cap6": _capped("brought", 6, 5), "term": _TERM,
    "cap11": _capped("(SELECT term.*, role_rank FROM term JOIN (SELECT file_id, role_rank FROM files) USING (file_id))", 11, 15, "role_rank DESC, doc_id, pos"), "pool": _POOL,
}
AFTER = FRAMES | {
    "texts": _TEXTS, "defined": DEFINED_SQL, "terms": _TERMS_SQL, "asked_terms": _ASKED_TERMS, "used_terms": _USED_TERMS, "scanned": _SCANNED_SQL, "defs": _DEFS, "cue": G._CUE, "near": G.NEIGHBOURS, "candidates": _CANDIDATES, "ranked": _RANKED,
    "gap_rows": _GAP_ROWS, "evidence": _EVIDENCE, "all_texts": _ALL_TEXTS, "conflicts": _CONFLICTS,
}


# --- queries ---------------------------------------------------------------------------------------------------------------------


@query("ret_06_section_hits", oracle("SELECT s.conv, s.file_id, s.section_id, round(s.score, 6)::DOUBLE AS score, f.file_name, coalesce(f.effective_date, '') AS effective_date, f.role, f.role_rank, coalesce(x.schedule, '') AS schedule, x.risk FROM seeds s JOIN files f USING (file_id) JOIN sections x USING (file_id, section_id)", **{k: FRAMES[k] for k in ("points", "asked", "hits", "seeds")}))
@C.parse_once
def section_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of vector search joined to their sections, with what is known of their files and defaults where nothing is (RET-06)."""
    s = seeds(spark, sf_dir).join(C.files(spark, sf_dir).select("file_id", "file_name", "effective_date", "role", "role_rank"), "file_id")
    s = s.join(C.sections(spark, sf_dir).select("file_id", "section_id", "schedule", "risk"), ["file_id", "section_id"])
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return s.select("conv", "file_id", "section_id", F.round("score", 6).alias("score"), "file_name", blank("effective_date"), "role", "role_rank", blank("schedule"), "risk")


@query("ret_08_candidate_pool", oracle("SELECT conv, file_id, section_id, injector, immune FROM pool", **FRAMES))
@C.parse_once
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injectors 0 to 15 and the first-writer rule (RET-08 to RET-19, RET-27)."""
    return pool(spark, sf_dir).select("conv", "file_id", "section_id", "injector", "immune")


@query("ret_13_preamble_fallback", oracle("SELECT file_id, section_id, page, md5(content) AS content_md5 FROM openings", openings=_OPENINGS))
def preamble_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openings(spark, sf_dir).select("file_id", "section_id", "page", F.md5("content").alias("content_md5"))


@query("ret_19b_name_hints", oracle("SELECT * FROM named_files", **{k: FRAMES[k] for k in ("name_tokens", "token_pairs", "alike", "named_files")}))
def name_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_files(spark, sf_dir)


@query("ret_19c_organisation_sections", oracle("SELECT file_id, section_id FROM sections WHERE file_id IN (SELECT file_id FROM org_files)", **E.FRAMES, org_files=_ORG_FILES))
def organisation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of files whose organisations have a word in the question."""
    return C.sections(spark, sf_dir).join(organisation_files(spark, sf_dir).select("file_id").distinct(), "file_id", "left_semi").select("file_id", "section_id")


#: Names that a question is asked with besides its own words.
NAMES = 4


@query("ret_05_augmented_query", oracle(f"SELECT c.conv, c.question || CASE WHEN n.names IS NULL THEN '' ELSE ' [' || n.names || ']' END AS query FROM (SELECT DISTINCT conv, {_QUESTION} AS question FROM files) c LEFT JOIN (SELECT conv, string_agg('\"' || a || '\"', ' OR ' ORDER BY a) AS names FROM (SELECT conv, a, row_number() OVER (PARTITION BY conv ORDER BY a) AS n FROM (SELECT DISTINCT conv, unnest(aliases) AS a FROM grouped WHERE len(list_filter(string_split(alias_key, ' '), lambda t: length(t) >= 3 AND contains(lower({_QUESTION}), t))) > 0)) WHERE n <= {NAMES} GROUP BY conv) n USING (conv)", **E.FRAMES, grouped=E.GROUPS))
def augmented_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's question with the first names of the people and organisations that it names (RET-05)."""
    g = E.alias_groups(E.index(spark, sf_dir))
    q = F.lower(questions(g))
    hit = g.where(F.exists(F.split("alias_key", " "), lambda t: (F.length(t) >= 3) & q.contains(t)))
    names = hit.select("conv", F.explode("aliases").alias("a")).distinct().withColumn("n", _n(["conv"], "a")).where(F.col("n") <= NAMES)
    quoted = F.array_join(F.transform(F.sort_array(F.collect_list("a")), lambda a: F.concat(F.lit('"'), a, F.lit('"'))), " OR ")
    c = C.files(spark, sf_dir).select("conv").distinct()
    c = c.join(names.groupBy("conv").agg(quoted.alias("names")), "conv", "left")
    return c.select("conv", F.concat(questions(c), F.coalesce(F.concat(F.lit(" ["), "names", F.lit("]")), F.lit(""))).alias("query"))


@query("prs_18_defined_terms", oracle("SELECT file_id, term, definition FROM defined", defined=DEFINED_SQL))
def defined_term_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.defined_terms(C.sections(spark, sf_dir)).select("file_id", "term", "definition")


@query("ret_19f_definition_slots", oracle("SELECT conv, file_id, section_id, pos AS slot, immune, content FROM defs", **AFTER))
@C.parse_once
def definition_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions that join the pool of each conversation."""
    return definitions(spark, sf_dir).select("conv", "file_id", "section_id", F.col("pos").alias("slot"), "immune", "content")


@query("ret_21_graph_neighbours", oracle("SELECT conv, file_id, section_id FROM candidates WHERE injector = 17", **AFTER))
@C.parse_once
def graph_neighbour_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_neighbours(spark, sf_dir).select("conv", "file_id", "section_id")


@query("ret_22_rerank", oracle("SELECT conv, file_id, section_id, immune FROM ranked", **AFTER))
@C.parse_once
def rerank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirmed(spark, sf_dir).select("conv", "file_id", "section_id", "immune")


@query("ret_23_gap_fill", oracle("SELECT conv, gap, file_id, section_id FROM gap_rows", **AFTER))
@C.parse_once
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_rows(spark, sf_dir).select("conv", "gap", "file_id", "section_id")


@query("ret_24_conflicts", oracle("SELECT conv, clause_type, latest, n_files FROM conflicts", **AFTER))
@C.parse_once
def conflict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(evidence(spark, sf_dir), texts(spark, sf_dir), ranked_files(spark, sf_dir))


@query(
    "ret_20_cited_context",
    oracle(
        """SELECT conv, place, CASE WHEN injector <> 16 THEN n END AS source, file_id, section_id, CASE WHEN injector = 16 THEN '[Background definition]' ELSE '[Source ' || n || ': ' || file_name
            || CASE WHEN schedule IS NOT NULL AND section_id <> schedule THEN ', ' || upper(left(schedule, 1)) || substr(schedule, 2) || ' §' || section_id WHEN NOT starts_with(section_id, '__') THEN ', §' || section_id ELSE '' END
            || ', Page ' || page || coalesce(' [effective ' || effective_date || ']', '') || CASE WHEN latest IS NOT NULL AND latest <> file_id THEN ' [HISTORICAL VERSION — superseded by more recent document]' ELSE '' END
            || CASE risk WHEN 5 THEN ' [⚠ HIGH RISK]' WHEN 4 THEN ' [⚠ ABOVE MARKET]' ELSE '' END || ']' END AS header, md5(content) AS content_md5
        FROM (SELECT *, row_number() OVER w AS place, count(*) FILTER (injector <> 16) OVER w AS n FROM (
                  SELECT e.*, x.content, x.page, x.schedule, x.risk, f.file_name, f.effective_date, f.role_rank, c.latest FROM evidence e JOIN all_texts x USING (file_id, section_id) JOIN files f USING (file_id) LEFT JOIN conflicts c ON c.conv = e.conv AND c.clause_type = x.clause_type WHERE trim(x.content) <> '')
              WINDOW w AS (PARTITION BY conv ORDER BY CASE WHEN schedule IS NULL THEN 1 ELSE 0 END, coalesce(effective_date, '0000-00-00') DESC, role_rank DESC, score DESC, injector, doc_id, pos, section_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        **AFTER,
    ),
)
@C.parse_once
def cited_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's whole way: seeds, injectors, first-writer rule, definitions, graph, re-rank, gaps, conflicts, order and citations."""
    return assemble(evidence(spark, sf_dir), all_texts(spark, sf_dir), ranked_files(spark, sf_dir))

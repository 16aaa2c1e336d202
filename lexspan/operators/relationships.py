"""Links between documents: masters, novations, terminations and renewal chains (REL)."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans import contract as C
from ..plans.sql import name_tokens, oracle
from ..registry import query

_UNDATED = "CASE WHEN effective_date IS NULL THEN 1 ELSE 0 END, effective_date, doc_id"


def _by_date():
    return [F.col("effective_date").isNull().cast("int"), "effective_date", "doc_id"]


@query("rel_02_parsed_dates", oracle("SELECT doc_id, coalesce(TRY_CAST(try_strptime(left(d, 10), '%Y-%m-%d') AS DATE), TRY_CAST(try_strptime(left(d, 10), '%d/%m/%Y') AS DATE), TRY_CAST(try_strptime(left(d, 10), '%d-%m-%Y') AS DATE)) AS parsed FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-02-29T10' WHEN 1 THEN '05/06/2023' WHEN 2 THEN '07-08-2022' ELSE 'n/a' END AS d FROM documents)"))
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    d = F.substring(X.any_of([(k == 0, F.lit("2024-02-29T10")), (k == 1, F.lit("05/06/2023")), (k == 2, F.lit("07-08-2022"))], F.lit("n/a")), 1, 10)
    return C.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(*[F.try_to_date(d, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")]).alias("parsed"))


def sim(a: str, b: str) -> str:
    return f"len(list_intersect({name_tokens(a)}, {name_tokens(b)})) / len(list_distinct(list_concat({name_tokens(a)}, {name_tokens(b)})))"


_WANTED = "Framework Agreement 10"
_SIM = sim("file_name", f"'{_WANTED}'")


@query("rel_03_name_similarity", oracle(f"SELECT file_id, round({_SIM}, 6) AS similarity FROM files"))
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(spark, sf_dir).select("file_id", F.round(X.jaccard(F.col("file_name"), F.lit(_WANTED)), 6).alias("similarity"))


@query("rel_04_best_name", oracle(f"SELECT conv, file_id FROM (SELECT conv, file_id, s, row_number() OVER (PARTITION BY conv ORDER BY s DESC, doc_id) AS n FROM (SELECT conv, file_id, doc_id, {_SIM} AS s FROM files)) WHERE n = 1 AND s >= 0.25"))
def best_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the file whose name is most like a fragment, if like enough; an argmax, not a sort."""
    s = X.jaccard(F.col("file_name"), F.lit(_WANTED))
    best = C.files(spark, sf_dir).groupBy("conv").agg(F.max_by("file_id", F.struct(s, -F.col("doc_id"))).alias("file_id"), F.max(s).alias("s"))
    return best.where("s >= 0.25").select("conv", "file_id")


#: Another agreement by name in a clause, and how like a file's name it must be.
NAMED, LEAST_LIKE = r"of the ((?:[A-Z][a-z]+ )+Agreement)", 0.25
#: Values that extraction gives for a file, by name, where clauses and people don't tell.
MASTER, NOVATED, TERMINATED, CONSULTANT = "Master Agreement Reference", "Novated Agreements", "Agreement Being Terminated", "Consultant Name"
_BEST = "SELECT conv, ref, to_file FROM (SELECT r.conv, r.ref, f.file_id AS to_file, {sim} AS s, row_number() OVER (PARTITION BY r.conv, r.ref ORDER BY {sim} DESC, f.doc_id) AS n FROM (SELECT conv, ref FROM refs UNION SELECT conv, ref FROM fragments) r JOIN files f ON f.conv = r.conv{only}) WHERE n = 1 AND s >= " + str(LEAST_LIKE)
LAYERS = {
    "extracted": """
        SELECT conv, file_id, 'Master Agreement Reference' AS name, CASE doc_id % 4 WHEN 1 THEN 'Framework Agreement ' || doc_id // 100 * 100 WHEN 2 THEN 'Not Found' END AS value FROM files
        UNION ALL SELECT conv, file_id, 'Novated Agreements', CASE WHEN doc_id % 6 IN (1, 2) THEN 'Work Order ' || (doc_id - 20) || '; nothing like it ;' END FROM files
        UNION ALL SELECT conv, file_id, 'Agreement Being Terminated', CASE WHEN doc_id % 5 = 2 THEN 'Work Order ' || (doc_id - 40) END FROM files
        UNION ALL SELECT conv, file_id, 'Consultant Name', CASE doc_id % 8 WHEN 3 THEN ' Person  ' || (doc_id + 20) % 40 WHEN 4 THEN 'Not Found' END FROM files""",
    "fragments": "SELECT conv, file_id, name, trim(unnest(string_split(value, CASE WHEN name = 'Novated Agreements' THEN ';' ELSE chr(0) END))) AS ref FROM extracted WHERE value IS NOT NULL AND value <> 'Not Found' AND name <> 'Consultant Name'",
    "refs": f"SELECT DISTINCT conv, file_id, unnest(regexp_extract_all(content, '{NAMED}', 1)) AS ref FROM sections",
    "named": _BEST.format(sim=sim("f.file_name", "r.ref"), only=""),
    "named_master": _BEST.format(sim=sim("f.file_name", "r.ref"), only=" AND f.role = 'master_agreement'"),
    "by_person": "SELECT f.conv, f.file_id AS from_file, f.role, t.file_id AS to_file FROM files f JOIN files t ON t.conv = f.conv AND t.person = f.person AND t.role = 'transaction' WHERE f.role IN ('modification', 'termination')",
    "by_name": "SELECT DISTINCT f.conv, f.file_id AS from_file, f.role, n.to_file FROM files f JOIN refs r ON r.file_id = f.file_id JOIN named n ON n.conv = r.conv AND n.ref = r.ref WHERE n.to_file <> f.file_id AND f.role IN ('modification', 'termination')",
    "by_value": "SELECT f.file_id AS from_file, f.name, n.to_file FROM fragments f LEFT JOIN named n ON n.conv = f.conv AND n.ref = f.ref WHERE f.ref <> ''",
    "master_child": """
        SELECT f.conv, f.file_id AS from_file, f.role AS from_role, coalesce(l.to_file, m.file_id, v.to_file, o.only_one) AS to_file, coalesce(l.to_file, m.file_id, v.to_file, o.only_one) IS NOT NULL AS resolved FROM files f
        JOIN (SELECT conv, CASE WHEN count(*) = 1 THEN min(file_id) END AS only_one FROM files WHERE role = 'master_agreement' GROUP BY conv) o ON o.conv = f.conv
        LEFT JOIN (SELECT r.file_id, arg_min(n.to_file, r.ref) AS to_file FROM refs r JOIN named_master n ON n.conv = r.conv AND n.ref = r.ref GROUP BY r.file_id) l ON l.file_id = f.file_id
        LEFT JOIN (SELECT conv, file_id, doc_id % 13 AS ident, row_number() OVER (PARTITION BY conv, doc_id % 13 ORDER BY doc_id) AS n FROM files WHERE role = 'master_agreement') m ON m.conv = f.conv AND m.ident = f.doc_id % 13 AND m.n = 1
        LEFT JOIN (SELECT f.file_id, n.to_file FROM fragments f JOIN named_master n ON n.conv = f.conv AND n.ref = f.ref WHERE f.name = 'Master Agreement Reference') v ON v.file_id = f.file_id
        WHERE f.role IN ('transaction', 'modification')""",
    "novation": """
        SELECT DISTINCT f.conv, f.file_id AS from_file, l.to_file FROM files f LEFT JOIN (
            SELECT from_file, to_file FROM by_name UNION SELECT from_file, to_file FROM by_person
            UNION SELECT from_file, to_file FROM by_value WHERE name = 'Novated Agreements' AND from_file NOT IN (SELECT from_file FROM by_name UNION SELECT from_file FROM by_person)) l ON l.from_file = f.file_id
        WHERE f.role = 'modification' AND f.file_id NOT IN (SELECT from_file FROM master_child WHERE resolved)""",
    "termination": """
        SELECT f.conv, f.file_id AS from_file, l.to_file FROM files f LEFT JOIN (
            SELECT from_file, to_file FROM by_person UNION ALL SELECT from_file, to_file FROM by_name WHERE from_file NOT IN (SELECT from_file FROM by_person)
            UNION ALL SELECT from_file, to_file FROM by_value WHERE name = 'Agreement Being Terminated' AND from_file NOT IN (SELECT from_file FROM by_person UNION SELECT from_file FROM by_name)) l ON l.from_file = f.file_id
        WHERE f.role = 'termination'""",
}


def extracted(files: DataFrame) -> DataFrame:
    """(conv, file_id, name, value): what extraction prompts gave for each file, here by arithmetic; nulls and `Not Found` go."""
    d = F.col("doc_id")
    said = {
        MASTER: F.when(d % 4 == 1, F.expr("concat('Framework Agreement ', doc_id div 100 * 100)")).when(d % 4 == 2, "Not Found"),
        NOVATED: F.when((d % 6).isin(1, 2), F.concat(F.lit("Work Order "), d - 20, F.lit("; nothing like it ;"))),
        TERMINATED: F.when(d % 5 == 2, F.concat(F.lit("Work Order "), d - 40)),
        CONSULTANT: F.when(d % 8 == 3, F.concat(F.lit(" Person  "), (d + 20) % 40)).when(d % 8 == 4, "Not Found"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in said.items()])
    return files.select("conv", "file_id", F.inline(each)).where("value is not null and value <> 'Not Found'")


def _named_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAMED), F.lit(1))


@C.once
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, file_id, doc_id, section_id, parent_id, refs, named): sections without their texts, but with the references (ref, hint) and the agreements that these hold."""
    return C.outlined(spark, sf_dir, lambda text: {"refs": X.hinted_refs(text), "named": F.array_distinct(_named_in(text))})


@C.once
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, file_id, ref): the agreements that a file's clauses name. No name goes over two lines; unless sections are written anyway, they aren't made for this."""
    if C.is_written(outlines, sf_dir):
        found = outlines(spark, sf_dir).select("conv", "file_id", F.col("named").alias("found"))
    elif C.is_written(C.sections, sf_dir):
        found = C.sections(spark, sf_dir).select("conv", "file_id", _named_in(F.col("content")).alias("found"))
    else:
        found = C.found_in_sections(spark, sf_dir, _named_in)
    return found.select("conv", "file_id", F.explode(F.array_distinct("found")).alias("ref")).distinct()


@C.once
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, file_id, name, ref): the agreements that extracted values name; a value of several names is split."""
    v = extracted(C.files(spark, sf_dir)).where(F.col("name") != CONSULTANT)
    parts = F.when(F.col("name") == NOVATED, F.split("value", ";")).otherwise(F.array("value"))
    return v.select("conv", "file_id", "name", F.explode(F.transform(parts, F.trim)).alias("ref")).where("ref <> ''")


#: A word in the names of more files of a conversation than this is common: names that share nothing else meet by the set of such words, not file by file.
COMMON = 64


def named(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(conv, ref, to_file): for each name the file whose name is most like it, if like enough.

    Names meet by their words, never all files of a conversation. A pair that shares a word which isn't common is compared in full; there are COMMON such pairs a word
    at most. For all others only their common words can agree: the first file of each set of common words and size stands for all of them, and names with the same set and size
    ask once. Such a comparison by common words alone never says too much, so the best of both is the best of all.
    """
    words = lambda df, c: df.withColumns({"words": X.tokens(F.col(c)), "size": F.size(X.tokens(F.col(c)))})
    asked = words(refs.select("conv", "ref").distinct(), "ref").select("conv", "ref", "size", F.explode("words").alias("word"))
    each = words(files.select("conv", "doc_id", F.col("file_id").alias("to_file"), "file_name"), "file_name").select("conv", "doc_id", "to_file", "size", F.explode("words").alias("word"))
    each = each.join(asked.select("conv", "word").distinct(), ["conv", "word"], "left_semi")
    known = each.groupBy("conv", "word").agg((F.count(F.lit(1)) > COMMON).alias("is_common"))

    def parted(df: DataFrame, *key: str) -> DataFrame:
        """The key with its common and its other words, both in order."""
        of = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("word"))))
        return df.join(known, ["conv", "word"]).groupBy("conv", *key).agg(of(F.col("is_common")).alias("common"), of(~F.col("is_common")).alias("rare"))

    asked = parted(asked, "ref", "size")
    shared = parted(each, "doc_id", "to_file", "size").groupBy("conv", "common", "rare", "size").agg(F.min(F.struct("doc_id", "to_file")).alias("first"))
    sets = shared.groupBy("conv", "common", "size").agg(F.min("first").alias("first"))

    def best(names: DataFrame, found: DataFrame, by: str, compared: list[str], key: list[str]) -> DataFrame:
        """The best of found for each key of names, among those that share a word of by."""
        theirs = found.select("conv", "first", F.col("size").alias("_size"), *[F.col(c).alias("_" + c) for c in compared], F.explode(by).alias("word"))
        pairs = names.select("conv", *key, *[c for c in ("size", *compared) if c not in key], F.explode(by).alias("word")).join(theirs, ["conv", "word"])
        same = sum((F.size(F.array_intersect(c, "_" + c)) for c in compared), F.lit(0))
        like = same / (F.col("size") + F.col("_size") - same)
        return pairs.groupBy("conv", *key).agg(F.max(F.struct(like.alias("s"), (-F.col("first.doc_id")).alias("before"), F.col("first.to_file").alias("to_file"))).alias("best"))

    full = best(asked, shared, "rare", ["common", "rare"], ["ref"])
    by_set = best(asked.select("conv", "common", "size").distinct(), sets, "common", ["common"], ["common", "size"])
    every = full.unionByName(asked.join(by_set, ["conv", "common", "size"]).select("conv", "ref", "best"))
    return every.groupBy("conv", "ref").agg(F.max("best").alias("best")).where(F.col("best.s") >= LEAST_LIKE).select("conv", "ref", "best.to_file")


def by_name(files: DataFrame, refs: DataFrame, found: DataFrame) -> DataFrame:
    """(from_file, to_file): files with the others that their clauses name. found: `named` of these names."""
    links = refs.join(files.select("file_id"), "file_id", "left_semi").join(found, ["conv", "ref"]).select(F.col("file_id").alias("from_file"), "to_file")
    return links.where("from_file <> to_file").distinct()


def deals_of(files: DataFrame) -> DataFrame:
    """(conv, person, to_file): the transactions of each person."""
    return files.where("role = 'transaction'").select("conv", "person", F.col("file_id").alias("to_file"))


#: One person's files are dealt over this many keys where they meet the person's transactions.
SPREAD = 16


def by_person(own: DataFrame, deals: DataFrame) -> DataFrame:
    """(conv, from_file, to_file): own (conv, from_file, person) with the transactions of their person, which all count as affected.

    The rows grow with the square of a person's files, so nothing behind the join may shuffle or keep them. Both sides are dealt by number: by their bytes, which are few, they would go to one task.
    """
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * SPREAD)
    key = ["conv", "person", "_k"]
    own = own.withColumn("_k", F.pmod(F.crc32(F.col("from_file").cast("binary")), F.lit(SPREAD)).cast("int")).repartition(parts, *key)
    deals = deals.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).repartition(parts, *key)
    return own.join(deals.hint("shuffle_hash"), key).select("conv", "from_file", "to_file")


def by_value(values: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """(from_file, to_file): what a file's extracted value names, null where no file is like it."""
    return values.where(F.col("name") == name).join(found, ["conv", "ref"], "left").select(F.col("file_id").alias("from_file"), "to_file")


def master_child(files: DataFrame, refs: DataFrame, values: DataFrame) -> DataFrame:
    """Each transaction and modification with its master: the one that its clauses name, else the first with the identifier it has, else what the extracted
    value names, else the conversation's only one; unresolved without any (REL-06)."""
    masters = files.where("role = 'master_agreement'")
    told = values.where(F.col("name") == MASTER).select("conv", "file_id", "ref")
    found = named(refs.select("conv", "ref").union(told.select("conv", "ref")), masters)
    said = refs.join(found, ["conv", "ref"]).groupBy("file_id").agg(F.min_by("to_file", "ref").alias("_named"))
    valued = told.join(found, ["conv", "ref"]).select("file_id", F.col("to_file").alias("_valued"))
    first = masters.groupBy("conv", F.expr("doc_id % 13").alias("ident")).agg(F.min_by("file_id", "doc_id").alias("_first"))
    only = masters.groupBy("conv").agg(F.when(F.count(F.lit(1)) == 1, F.min("file_id")).alias("_only"))
    kids = files.where("role in ('transaction', 'modification')").join(only, "conv").withColumn("ident", F.expr("doc_id % 13"))
    to = F.coalesce("_named", "_first", "_valued", "_only")
    links = kids.join(said, "file_id", "left").join(first, ["conv", "ident"], "left").join(valued, "file_id", "left")
    return links.select("conv", F.col("file_id").alias("from_file"), F.col("role").alias("from_role"), to.alias("to_file"), to.isNotNull().alias("resolved"))


@C.once
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master_child(C.files(spark, sf_dir), references(spark, sf_dir), fragments(spark, sf_dir))


@C.once
def names_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`named` of all that clauses and values name, among all files."""
    every = references(spark, sf_dir).select("conv", "ref").union(fragments(spark, sf_dir).where(F.col("name") != MASTER).select("conv", "ref"))
    return named(every, C.files(spark, sf_dir))


@query("rel_06_master_child", oracle("SELECT * FROM master_child", **LAYERS))
@C.parse_once
def master_child_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children(spark, sf_dir)


def _own(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """(conv, from_file, person): the files of a role."""
    return C.files(spark, sf_dir).where(F.col("role") == role).select("conv", F.col("file_id").alias("from_file"), "person")


def _layers(spark: SparkSession, sf_dir: str, own: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(conv, from_file, person, to_file) of own by names in clauses, and (from_file, to_file) by an extracted value."""
    found = names_found(spark, sf_dir)
    names = by_name(own.select(F.col("from_file").alias("file_id")), references(spark, sf_dir), found)
    return own.join(names, "from_file"), by_value(fragments(spark, sf_dir), value, found)


def _free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, from_file, person): modifications without a master."""
    return _own(spark, sf_dir, "modification").join(children(spark, sf_dir).where("resolved").select("from_file"), "from_file", "left_anti")


def novations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modifications without a master, with what their clauses name and the transactions of the same person; without these, with what the extracted value
    names; unresolved without any (REL-07).

    (own, deals, others): own (conv, from_file, person) link to all deals (conv, person, to_file) of their person; others (conv, from_file, to_file) are the links besides, few a file.
    """
    own, deals = _free(spark, sf_dir).distinct(), deals_of(C.files(spark, sf_dir)).distinct()
    names, values = _layers(spark, sf_dir, own, NOVATED)
    rest = own.join(deals, ["conv", "person"], "left_anti").join(names, "from_file", "left_anti").join(values.distinct(), "from_file", "left")
    others = names.join(deals, ["conv", "person", "to_file"], "left_anti").unionByName(rest)
    return own, deals, others.select("conv", "from_file", "to_file").distinct()


def all_links(own: DataFrame, deals: DataFrame, others: DataFrame) -> DataFrame:
    return by_person(own, deals).unionByName(others)


@query("rel_07_novations", oracle("SELECT * FROM novation", **LAYERS))
@C.parse_once
def novation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_links(*novations(spark, sf_dir))


def terminations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terminations with the transactions of the same person, else with what their clauses name, else with what the extracted value names;
    unresolved without any (REL-08). As `novations`."""
    own, deals = _own(spark, sf_dir, "termination"), deals_of(C.files(spark, sf_dir))
    alone = own.join(deals, ["conv", "person"], "left_anti")
    names, values = _layers(spark, sf_dir, alone, TERMINATED)
    rest = alone.join(names, "from_file", "left_anti").join(values, "from_file", "left")
    return own, deals, names.unionByName(rest.select(names.columns)).select("conv", "from_file", "to_file")


@query("rel_08_terminations", oracle("SELECT * FROM termination", **LAYERS))
@C.parse_once
def termination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_links(*terminations(spark, sf_dir))


PEOPLE = "SELECT conv, file_id, doc_id, effective_date, person FROM files WHERE role = 'transaction' UNION SELECT f.conv, f.file_id, f.doc_id, f.effective_date, lower(regexp_replace(trim(e.value), '\\s+', ' ', 'g')) FROM files f JOIN extracted e USING (file_id) WHERE f.role = 'transaction' AND e.name = 'Consultant Name' AND e.value <> 'Not Found'"
RENEWALS = f"SELECT conv, person, file_id AS from_file, prev AS to_file FROM (SELECT *, lag(file_id) OVER (PARTITION BY conv, person ORDER BY {_UNDATED}) AS prev FROM people) WHERE prev IS NOT NULL"
CHAIN = {"extracted": LAYERS["extracted"], "people": PEOPLE, "renewals": RENEWALS}


def people_of_deals(files: DataFrame) -> DataFrame:
    """(conv, person, file_id, doc_id, effective_date): the people of each transaction, by entity and by the extracted consultant."""
    deals = files.where("role = 'transaction'").select("conv", "file_id", "doc_id", "effective_date", "person")
    name = F.lower(F.regexp_replace(F.trim("value"), "\\s+", " "))
    told = extracted(files).where(F.col("name") == CONSULTANT).select("file_id", name.alias("person"))
    return deals.unionByName(deals.drop("person").join(told, "file_id")).distinct()


def renewals(files: DataFrame) -> DataFrame:
    """Each transaction with the one before it of the same person; undated ones last (REL-09)."""
    w = Window.partitionBy("conv", "person").orderBy(*_by_date())
    a = people_of_deals(files).withColumn("to_file", F.lag("file_id").over(w))
    return a.where("to_file is not null").select("conv", "person", F.col("file_id").alias("from_file"), "to_file")


@query("rel_09_renewals", oracle("SELECT * FROM renewals", **CHAIN))
def renewal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renewals(C.files(spark, sf_dir))


ALL = {
    **LAYERS, **CHAIN,
    "relations": """
        SELECT conv, from_file, to_file, 'master_child' AS kind FROM master_child
        UNION ALL SELECT conv, from_file, to_file, 'novation' FROM novation
        UNION ALL SELECT conv, from_file, to_file, 'termination' FROM termination
        UNION ALL SELECT DISTINCT conv, from_file, to_file, 'renewal' FROM renewals""",
}


#: Links of a kind: own and deals as in `novations`, or none of them, and the others.
Parts = dict[str, tuple[DataFrame | None, DataFrame | None, DataFrame]]


def relation_parts(spark: SparkSession, sf_dir: str) -> Parts:
    """Links by kind, those by people not yet made."""
    few = lambda d: (None, None, d.select("conv", "from_file", "to_file"))
    return {"master_child": few(children(spark, sf_dir)), "novation": novations(spark, sf_dir), "termination": terminations(spark, sf_dir), "renewal": few(renewals(C.files(spark, sf_dir)).select("conv", "from_file", "to_file").distinct())}


def other_relations(parts: Parts) -> DataFrame:
    """(conv, from_file, to_file, kind) of all links but those by people."""
    return reduce(DataFrame.unionByName, [d.withColumn("kind", F.lit(k)) for k, (_, _, d) in parts.items()])


def relations(parts: Parts) -> DataFrame:
    """All links (conv, from_file, to_file, kind), unresolved ones with a null target."""
    people = [by_person(own, deals).withColumn("kind", F.lit(k)) for k, (own, deals, _) in parts.items() if own is not None]
    return reduce(DataFrame.unionByName, people, other_relations(parts))


@query("rel_10_counts", oracle("SELECT c.conv, k.kind, count(r.from_file) AS n FROM (SELECT DISTINCT conv FROM files) c CROSS JOIN (VALUES ('master_child'), ('novation'), ('termination'), ('renewal')) k(kind) LEFT JOIN relations r ON r.conv = c.conv AND r.kind = k.kind GROUP BY c.conv, k.kind", **ALL))
@C.parse_once
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by conversation and kind, with zeros. Links by people are counted, a person's transactions times its other files, and never made."""
    deals = deals_of(C.files(spark, sf_dir)).groupBy("conv", "person").agg(F.count(F.lit(1)).alias("n"))
    parts = relation_parts(spark, sf_dir)
    every = C.files(spark, sf_dir).select("conv", F.lit("").alias("kind"), F.lit(0).cast("long").alias("rows"))
    every = every.unionByName(other_relations(parts).select("conv", "kind", F.lit(1).cast("long").alias("rows")))
    for k, (own, _, _) in parts.items():
        if own is not None:
            every = every.unionByName(own.join(deals, ["conv", "person"]).select("conv", F.lit(k).alias("kind"), F.col("n").alias("rows")))
    kinds = list(P.RELATION_EDGE)
    wide = every.groupBy("conv").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rows")).otherwise(0)).alias(k) for k in kinds])
    return wide.unpivot("conv", kinds, "kind", "n")


@query("rel_11_touching", oracle("SELECT conv, from_file, to_file, kind FROM relations WHERE from_file = 'f41' OR to_file = 'f41'", **ALL))
@C.parse_once
def touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from or to one file; of the links by people only the file's own are made."""
    here = {}
    for k, (own, deals, others) in relation_parts(spark, sf_dir).items():
        made = others.where("from_file = 'f41' or to_file = 'f41'")
        if own is not None:
            into = own.where("from_file <> 'f41'").join(deals.where("to_file = 'f41'"), ["conv", "person"]).select(made.columns)
            made = made.unionByName(own.where("from_file = 'f41'").join(deals, ["conv", "person"]).select(made.columns)).unionByName(into)
        here[k] = (None, None, made)
    return other_relations(here)


@query("rel_12_order_chain", oracle(f"SELECT conv, person, file_id, n, prev, ended, NOT ended AND row_number() OVER (PARTITION BY conv, person, ended ORDER BY n DESC) = 1 AS is_current FROM (SELECT conv, person, file_id, row_number() OVER w AS n, lag(file_id) OVER w AS prev, file_id IN (SELECT to_file FROM relations WHERE kind = 'termination' AND to_file IS NOT NULL) AS ended FROM files WHERE role = 'transaction' WINDOW w AS (PARTITION BY conv, person ORDER BY {_UNDATED}))", **ALL))
@C.parse_once
def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's transactions in order, with what came before, whether ended, and which one is in force: the last that isn't ended."""
    f = C.files(spark, sf_dir).where("role = 'transaction'")
    own, deals, others = terminations(spark, sf_dir)  # a termination ends all transactions of its person
    ended = deals.join(own, ["conv", "person"], "left_semi").select("to_file").union(others.where("to_file is not null").select("to_file"))
    ended = ended.select(F.col("to_file").alias("file_id")).distinct().withColumn("ended", F.lit(True))
    w = Window.partitionBy("conv", "person").orderBy(*_by_date())
    a = f.join(ended, "file_id", "left").withColumns({"ended": F.coalesce("ended", F.lit(False)), "n": F.row_number().over(w), "prev": F.lag("file_id").over(w)})
    last = F.max(F.when(~F.col("ended"), F.col("n"))).over(Window.partitionBy("conv", "person"))
    return a.select("conv", "person", "file_id", "n", "prev", "ended", F.coalesce(~F.col("ended") & (F.col("n") == last), F.lit(False)).alias("is_current"))


@query("rel_15_shared_person", oracle("SELECT a.conv, a.file_id, count(*) AS others FROM files a JOIN files b ON a.conv = b.conv AND a.person = b.person AND a.file_id <> b.file_id GROUP BY a.conv, a.file_id"))
def shared_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other files share a file's person; a count over the person, not a self-join."""
    n = F.count(F.lit(1)).over(Window.partitionBy("conv", "person")) - 1
    return C.files(spark, sf_dir).select("conv", "file_id", n.alias("others")).where("others > 0")


#: The most bytes of a text: an array of the JVM, less what the row around it takes.
LONGEST = 2**31 - 1024


def _written_map(links: pa.Table) -> pa.Table:
    """links (conv, kind, from_file, person, to_file) of one conversation: a link by name has both files, a file of a person no to_file, a transaction of a person no from_file. The text is
    held once, as bytes that the column is made of."""
    deals, named, people = defaultdict(list), defaultdict(list), defaultdict(list)
    for kind, file, person, to in zip(*[links[c].to_pylist() for c in ("kind", "from_file", "person", "to_file")], strict=True):
        if file is None:
            deals[kind, person].append(to.encode())
        elif to is None:
            people[kind, file].append(person)
        else:
            named[kind, file].append(to.encode())
    for d in deals.values():
        d.sort()
    text = bytearray()
    for kind, file in sorted(named.keys() | people.keys()):
        lists = [d for d in [named[kind, file], *[deals.get((kind, p), []) for p in people[kind, file]]] if d]
        if not lists:
            continue
        to = sorted(chain(*lists)) if len(lists) > 1 or named[kind, file] else lists[0]
        begin = f"{kind}: {file} -> ".encode()
        if text:
            text += b"\n"
        text += begin + (b"\n" + begin).join(to)
        if len(text) > LONGEST:
            raise ValueError(f"the links of {links['conv'][0]} are beyond {LONGEST} bytes, the most that one text can have")
    bounds = pa.array([0, len(text)], pa.int32()).buffers()[1]
    return pa.table({"conv": links["conv"].slice(0, 1), "map": pa.StringArray.from_buffers(1, bounds, pa.py_buffer(text))})


@query("rel_17_map_text", oracle("SELECT conv, string_agg(kind || ': ' || from_file || ' -> ' || coalesce(to_file, '?'), chr(10) ORDER BY kind, from_file, coalesce(to_file, '?')) AS map FROM relations GROUP BY conv", **ALL))
@C.parse_once
def map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of a conversation as one text. A person's links meet where the text is written, so that only files and transactions are shuffled, never lines."""
    rows, none = [], F.lit(None).cast("string")
    for k, (own, deals, others) in relation_parts(spark, sf_dir).items():
        line = lambda df, *ends, kind=F.lit(k).alias("kind"): df.select("conv", kind, *[c.alias(n) for c, n in zip(ends, ("from_file", "person", "to_file"), strict=True)])
        rows.append(line(others, F.col("from_file"), none, F.coalesce("to_file", F.lit("?"))))
        if own is not None:
            rows += [line(own, F.col("from_file"), F.col("person"), none), line(deals.where("conv is not null and person is not null"), none, F.col("person"), F.col("to_file"))]
    every = reduce(DataFrame.unionByName, rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv")
    return every.groupBy("conv").applyInArrow(_written_map, "conv string, map string")

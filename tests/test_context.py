"""Names, definitions, headings, cells, kept graphs and listeners against plain Python on small cases."""

import datetime as dt
import difflib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.functions import patterns as P
from lexspan.functions import text as X
from lexspan.operators import anchors, classify, context, crossrefs, definitions, graph, kept, more, names, neighbours, relationships, stores
from lexspan.plans import contract


def test_likeness_is_that_of_longest_blocks():
    """All pairs of distinct tokens, with letters of several alphabets, against the standard library's ratio."""
    rng = np.random.default_rng(7)
    tokens = ["framework", "framwork", "macdonald", "mcdonald", "alexander", "alex", "aab", "abab", "ba", "straße", "strasse", "日本語", "x" * 40, "xyx" * 9]
    tokens += ["".join(rng.choice(list("abcdé"), int(rng.integers(1, 14)))) for _ in range(60)]
    pairs = [(a, b) for a in tokens for b in tokens]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    common = names.common_letters([a for a, _ in pairs], [b for _, b in pairs])
    assert [2 * n / (len(a) + len(b)) for n, (a, b) in zip(common, pairs, strict=True)] == pytest.approx(want)
    got = names.likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert [g >= names.LEAST_LIKE for g in got] == [w >= names.LEAST_LIKE for w in want]  # the filter loses no match


def test_hinted_files(spark):
    question = "was notice followed for joy clarke under the framwork agrement"
    files = spark.createDataFrame([("c", "f1", "Termination Notice Joi Clark.pdf", question), ("c", "f2", "Framework Agreement 7.docx", question), ("c", "f3", "Policy on the Notice", question), ("c", "f4", None, question)], "conv string, file_id string, file_name string, question string")

    def hits(name):
        clean = re.sub(r"\.pdf$|\.docx?$|\b(dd|the|and|for|of|in|to|a|an)\b", " ", name or "", flags=re.I).lower()
        words = [w for w in re.split(r"\W+", question) if w]
        return sum(any(t in w or w in t or difflib.SequenceMatcher(None, t, w).ratio() >= 0.82 for w in words) for t in re.split(r"\W+", clean) if len(t) >= 3)

    want = {r["file_id"] for r in files.collect() if hits(r["file_name"]) >= 2}
    assert {r["file_id"] for r in names.hinted_files(files).collect()} == want == {"f1", "f2"}


def test_used_terms_are_those_of_a_scan(spark):
    """One automaton against an alternation of all terms, the longest first; terms within terms, at ends, in words, and none."""
    terms = ["Subscription Period", "Period", "Escrow Agent", "Agent", "Fee", "Fees", "Fee-"]
    texts = ["Period of the Subscription Period, an Agent", "Fees and Fee, not Feed or aFee", "Escrow Agents; Escrow Agent", "", None, "SubscriptionPeriod Fee- x", "Period" * 3]
    rng = np.random.default_rng(3)
    texts += [" ".join(rng.choice(["Subscription", "Period", "Fee", "Fees", "Escrow", "Agent", "x"], 12)) for _ in range(40)]
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")\b")
    want = set()
    for k, t in enumerate(texts):
        seen = set()
        for m in pattern.finditer(t or ""):
            if m[1] not in seen:
                seen.add(m[1])
                want.add((k, m[1], m.start()))
    rows = spark.createDataFrame([("c", k, t) for k, t in enumerate(texts)] + [("d", 99, "Period")], "conv string, key int, content string")
    got = definitions.used_terms(rows, spark.createDataFrame([("c", t) for t in terms], "conv string, term string")).collect()
    assert {(r["key"], r["term"], r["at"]) for r in got} == want and len(got) == len(want)


def test_defined_terms(spark):
    long = "one. " * 90
    body = f'“Fee” means the sum payable.\nSaaS Service Levels means those of clause 2. VENDOR means us. "Term" means {long}"Fee" means the final sum. "Empty" means '
    s = spark.createDataFrame([("c", "f", 1, 1, body, "definitions"), ("c", "f", 1, 2, '"Other" means nothing here', "general")], "conv string, file_id string, doc_id long, pos long, content string, clause_type string")
    got = {r["term"]: r["definition"] for r in definitions.defined_terms(s).collect()}
    assert got == {"Fee": "the final sum.", "Service Levels": "those of clause 2.", "VENDOR": "us.", "Term": ("one. " * 70).strip()}


def test_hints_of_references(spark):
    said = "Under clause 2.1 of the Framework Agreement, clause 2.1 of the SOW, Section 4.2(b) of Initial\nAddendum; subclause 9.1; schedule  3 of " + "x " * 60 + "Agreement; clause 61, paragraph 7 of the SOW."
    rows = spark.range(1).select(F.inline(X.hinted_refs(F.lit(said)))).collect()
    assert [tuple(r) for r in rows] == [("2.1", "Framework Agreement"), ("4.2(b)", "Initial\nAddendum"), ("schedule 3", None), ("7", "the SOW")]
    files = spark.createDataFrame([("c", f"f{k}", k, n) for k, n in enumerate(["Policy", "Framework Agreement A", "Work Order", "Framework Addendum", "Initial Framework Agreement"])], "conv string, file_id string, doc_id long, file_name string")
    hints = spark.createDataFrame([("c", "Framework Agreement"), ("c", "the SOW"), ("c", "the Initial Agreement")], "conv string, hint string")
    got = {}
    for r in crossrefs.hint_files(hints, files).orderBy("rank").collect():
        got.setdefault(r["hint"], []).append(r["to_file"])
    first = ["f0", "f1", "f2"]
    assert got == {"Framework Agreement": ["f1", "f3", "f4"], "the SOW": first, "the Initial Agreement": first}


def test_reparse(spark):
    lines = ["intro", "1.2 Fees are due", "12 more", "1 Terms", "", "PART 3: all else is here", "part 3-b again and again", "1.20 is not that one"]
    frame = spark.createDataFrame([("c", "f", 0, p, 1 + p // 4, t) for p, t in enumerate(lines)], "conv string, file_id string, doc_id long, p int, page int, line string")
    given = spark.createDataFrame([("f", "1", 0, "T"), ("f", "1.2", 1, "Fees"), ("f", "PART 3", 2, "")], "file_id string, anchor string, k int, title string")
    got = [(r["section_id"], r["content"]) for r in anchors.reparse(frame, given).orderBy("pos").collect()]
    # the first anchor in order wins: `1` also begins 1.2 and 1.20, for a dot may stand behind it
    assert got == [("1", "1.2 Fees are due\n12 more"), ("PART 3", "PART 3: all else is here"), ("PART 3", "part 3-b again and again"), ("1", "1.20 is not that one")]


def test_cells_are_exact_with_bounds_and_near_without(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 40)  # several parts a cell
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).astype("float32")
    x[100:130], x[5] = x[100], 0  # copies and a null vector
    points = spark.createDataFrame([(k, int(k % 3), v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    asked = neighbours.asked_vectors(points)
    u = neighbours.unit(x.astype(float))
    want = set()
    for q in range(0, 700, 100):
        score = np.round(u @ u[q], 6)
        score[[q, 5]] = -2
        want |= {(q, int(k), r + 1) for r, k in enumerate(np.lexsort((np.arange(700), -score))[:10])}
    assert {(r["q"], r["vec_id"], r["rank"]) for r in neighbours.nearest(points, asked, 10, exact=True).collect()} == want
    near = {(r["q"], r["vec_id"]) for r in neighbours.nearest(points, asked, 10).collect()}
    assert len(near & {(q, k) for q, k, _ in want}) >= 0.9 * len(want)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_cells(spark, sf):
    p = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, e = ({(r["q"], r["vec_id"]) for r in neighbours.nearest(p, neighbours.asked_vectors(p), 10, exact=x).collect()} for x in (False, True))
    assert len(a & e) >= 0.9 * len(e)


def test_names_meet_by_classes_of_words(spark):
    """The most alike file of each name against all pairs."""
    rng = np.random.default_rng(2)
    words = ["framework", "agreement", "order", "work", "side", "letter", "nine", "x1", "x2"]
    files = [("c" if k % 3 else "d", k, f"f{k}", " ".join(rng.choice(words, int(rng.integers(1, 6))))) for k in range(80)]
    refs = [(c, " ".join(rng.choice([*words, "strange"], int(rng.integers(1, 4))))) for c in "cd" for _ in range(25)] + [("e", "work order")]
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = set()
    for c, r in set(refs):
        best = max(((jac(r, n), -k, i) for f, k, i, n in files if f == c), default=(0, 0, None))
        if best[0] >= relationships.LEAST_LIKE:
            want.add((c, r, best[2]))
    got = relationships.named(spark.createDataFrame(refs, "conv string, ref string"), spark.createDataFrame(files, "conv string, doc_id long, file_id string, file_name string"))
    assert {tuple(r) for r in got.collect()} == want


def test_a_text_of_many_references_is_searched_once(spark):
    """Searched again for each reference it has, this text takes minutes."""
    import time

    n = 4000
    text = " ".join(f"under Clause {k % (n - 100) + 1}.1(a) of the Initial Addendum," for k in range(n)) + " clause 99, Clause 7(b)(c)section 4, ſection 5; subclause 6"
    given = spark.createDataFrame([(text,)], "content string")
    given.select(F.inline(X.hinted_refs(F.lit("clause 1")))).collect()
    began = time.time()
    rows = [tuple(r) for r in given.select(F.inline(X.hinted_refs(F.col("content")))).collect()]
    assert time.time() - began < 20
    assert rows == [(f"{k + 1}.1(a)", "Initial Addendum") for k in range(n - 100)] + [("7(b)(c)", None), ("4", None)]


@pytest.mark.parametrize("common", [0, 1, 5, 30])
def test_names_that_share_common_words(spark, monkeypatch, common):
    """However few files make a word common, each name finds the file that it is most like, the first among equals; words of many files make no pair of a name and a file."""
    monkeypatch.setattr(relationships, "COMMON", common)
    rng = np.random.default_rng(common)
    words = [["work", "order"], ["order"], ["framework", "agreement"], ["agreement", "of", "order"], []]
    name = lambda n: " ".join([*words[int(rng.integers(0, 5))], *map(str, rng.choice(n, int(rng.integers(0, 3))))])
    files = [("cd"[k % 2], k, f"f{k}", name(60)) for k in range(150)]
    refs = sorted({(c, name(70)) for c in "cd" for _ in range(60)})
    bag = lambda x: set(x.split())
    want = set()
    for c, r in refs:
        best = max(((len(bag(r) & bag(n)) / max(1, len(bag(r) | bag(n))), -k, i) for f, k, i, n in files if f == c), default=(0, 0, None))
        if best[0] >= relationships.LEAST_LIKE:
            want.add((c, r, best[2]))
    got = relationships.named(spark.createDataFrame(refs, "conv string, ref string"), spark.createDataFrame(files, "conv string, doc_id long, file_id string, file_name string"))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("query", [relationships.relation_counts, relationships.touching, relationships.order_chain, relationships.map_text, graph.overview, kept.graph_summary])
def test_links_by_people_are_not_made(spark, sf_dir, monkeypatch, query):
    """What only counts, looks up or keeps links by people never makes them: they grow with the square of a person's files."""

    def made(*_):
        raise AssertionError("links by people were made")

    monkeypatch.setattr(relationships, "by_person", made)
    assert query(spark, sf_dir).columns


@pytest.mark.parametrize("query", [relationships.termination_query, graph.edge_query])
def test_links_by_people_are_not_shuffled(spark, sf_dir, query):
    """No row of the join that makes them goes through an exchange."""
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*("))
    joins = [k for k, x in enumerate(plan) if "ShuffledHashJoin" in x and "_k#" in x]
    assert joins
    for k in joins:
        at = depth(plan[k])
        for x in reversed(plan[:k]):
            if depth(x) < at:
                at = depth(x)
                assert "Exchange" not in x, x


def test_map_text_shuffles_no_lines(spark, sf_dir):
    """Lines are made where a conversation's text is written: no exchange or aggregation below holds a file's lines or the list of its links."""
    plan = relationships.map_text(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "lines#" not in plan and "array_join(" not in plan and "deals#" not in plan


def test_map_text_of_links(monkeypatch):
    """Names and people of a file in one order, each link of a file as often as it is there, people without transactions nothing; a text that no value can hold is an error."""
    cols = ["conv", "kind", "from_file", "person", "to_file"]
    rows = [
        ("c", "termination", "f2", "p", None), ("c", "termination", "f10", "p", None), ("c", "termination", "f3", "q", None), ("c", "novation", "f2", "p", None), ("c", "termination", None, "p", "f9"), ("c", "termination", None, "p", "f81"),
        ("c", "novation", "f2", None, "f5"), ("c", "novation", "f4", None, "?"), ("c", "novation", None, "p", "f9"), ("c", "novation", None, "p", "f1"), ("c", "novation", None, "z", "f7"), ("c", "renewal", "é", None, "f1"),
    ]
    links = pa.table({c: pa.array(v, pa.string()) for c, v in zip(cols, zip(*rows, strict=True), strict=True)})
    want = ["novation: f2 -> f1", "novation: f2 -> f5", "novation: f2 -> f9", "novation: f4 -> ?", "renewal: é -> f1", "termination: f10 -> f81", "termination: f10 -> f9", "termination: f2 -> f81", "termination: f2 -> f9"]
    assert relationships._written_map(links).to_pylist() == [{"conv": "c", "map": "\n".join(want)}]
    monkeypatch.setattr(relationships, "LONGEST", 100)
    with pytest.raises(ValueError, match="links of c"):
        relationships._written_map(links)


@pytest.mark.parametrize("query", [relationships.termination_query, relationships.relation_counts, relationships.touching, relationships.order_chain])
def test_links_need_no_written_sections(spark, sf_dir, query):
    """Only the names in clauses are wanted, so neither texts nor sections go to disk."""
    contract.clear(spark)
    query(spark, sf_dir)
    written = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in contract._PATHS[id(spark)]}
    contract.clear(spark)
    assert "references" in written and "sections" not in written


def test_names_found_by_line_are_those_of_sections(spark, tmp_path):
    """Line by line as in whole sections: of copies of an id the longest counts, empty lines at its ends do not, and short ones go."""
    rng = np.random.default_rng(5)
    said = ["", " ", "\t", "  of the Master Agreement ", "of the", "Side Agreement", "as of the Work Order Agreement and of the Side Letter Agreement", "1.1 Fees", "1.1 Fees and of the Long Agreement", "2.1  Term", "Schedule 1", "x" * 14, "é of the Über Agreement"]
    docs = [(k, "\n".join(rng.choice(said, int(rng.integers(0, 40)))) if k % 17 else None, f"c{k % 3}", "en") for k in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = relationships.references(spark, str(tmp_path))
    find = F.explode(F.regexp_extract_all("content", F.lit(relationships.NAMED), F.lit(1)))
    want = contract.sections(spark, str(tmp_path)).select("conv", "file_id", find.alias("ref")).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_outlines_are_those_of_sections(spark, tmp_path):
    """A text parsed in its row gives the sections, their references with hints, also over the end of a line, and the agreements named, as the sections' contents do."""
    texts = [
        "a\n\nunder clause 3.1 of the\nService Agreement\n \n", "x\n" * 130 + "of the Master Service Agreement, clause\n12.1 of the Work Order", "", " \n\n ", "short", "é straße section\n2021 paragraph\n4(b) of the Big Big Agreement",
        "1.1  once clause 1.1\n1.1  twice and longer, clause 2\n1.1  twice and longer, clause 3\n1.2\n\n", "no header\nSchedule 3 - Terms\n\n\n", None,
    ]
    docs = [(k * 47 + n, t, f"c{k % 2}", "en") for n, t in enumerate(texts) for k in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    of = contract.sections(spark, str(tmp_path))
    got = relationships.outlines(spark, str(tmp_path))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    cols = ["conv", "file_id", "doc_id", "section_id", "parent_id"]
    assert rows(got.select(cols)) == rows(of.select(cols)) and got.count() > 100
    want = contract.crossrefs(spark, str(tmp_path)).drop("doc_id")
    refs = got.select("conv", "file_id", "section_id", F.inline("refs")).where("ref <> section_id")
    assert rows(refs) == rows(want) and want.where("hint is not null").count()
    named = lambda df, c: rows(df.select("file_id", "section_id", F.explode(F.array_distinct(c))))
    assert named(got, "named") == named(of, F.regexp_extract_all("content", F.lit(relationships.NAMED), F.lit(1))) != []


def test_edges_write_and_shuffle_no_texts(spark, sf_dir):
    """Edges hold ids only: neither sections with their texts nor the lines they are made of go to disk."""
    contract.clear(spark)
    graph.edge_query(spark, sf_dir)
    written = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in contract._PATHS[id(spark)]}
    contract.clear(spark)
    assert "outlines" in written and "sections" not in written
    plan = relationships.outlines(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "content#" not in plan[: plan.index("Exchange")]



def test_a_section_is_searched_once_for_what_injects_it(spark, sf_dir):
    """Each search of a section's text stands once in the plan, and none of the question by section."""
    plan = context.injected(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (P.MONEY, P.ADDRESS, P.RETAINED):
        assert plan.count(f", {pattern})") + plan.count(f"RLIKE {pattern}") == 1, pattern


def test_neighbours_do_not_search_all_references_for_cues(spark, sf_dir, monkeypatch):
    """Cue words are looked for in the clauses of references from or to a seed, not in all that have a reference."""

    def searched(*_):
        raise AssertionError("all clauses were searched")

    monkeypatch.setattr(graph, "cue_edges", searched)
    seeds = contract.sections(spark, sf_dir).where("clause_type = 'governing_law'").select("conv", "file_id", "section_id")
    assert graph.neighbours(spark, sf_dir, seeds).columns == ["conv", "file_id", "section_id"]


def test_identifiers_that_hold_each_other(spark):
    rng = np.random.default_rng(4)
    key = lambda n: "".join(rng.choice(list("ab1"), n))
    ids = [("c", f"m{k}", k, key(int(rng.integers(0, 9)))) for k in range(60)]
    refs = [("c", f"f{k}", key(int(rng.integers(0, 9)))) for k in range(60)] + [("d", "g", "aaaa")]
    want = {(c, f, min((k, m) for i, m, k, x in ids if i == c and len(x) >= 4 and (x in r or r in x))[1]) for c, f, r in refs if len(r) >= 4 and any(i == c and len(x) >= 4 and (x in r or r in x) for i, _, _, x in ids)}
    got = more.containing(spark.createDataFrame(refs, "conv string, file_id string, key string"), spark.createDataFrame(ids, "conv string, master string, doc_id long, key string"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_kept_graph(spark, tmp_path):
    """A second build of one conversation rewrites its partition alone, and building twice changes nothing."""
    n = spark.createDataFrame([(f"c{k % 9}", f"n{k}", "section", f"label {k}", None) for k in range(90)], "conv string, node_id string, kind string, label string, file_id string")
    folder = f"file://{tmp_path}/kept"
    files = lambda: {str(p) for p in Path(tmp_path, "kept", "nodes").rglob("part-*.parquet")}
    rows = lambda: sorted(map(tuple, spark.read.parquet(f"{folder}/nodes").drop("part").collect()), key=repr)
    kept.keep(n, f"{folder}/nodes", "node_id")
    before, had = files(), rows()
    assert len(had) == 90
    kept.keep(n.where("conv = 'c1'"), f"{folder}/nodes", "node_id")
    assert rows() == had and len(before - files()) == 1
    kept.keep(n.where("conv = 'c2' and node_id <> 'n2'").withColumn("label", F.lit("new")), f"{folder}/nodes", "node_id")
    assert sum(r[3] == "new" for r in rows()) == 9 and len(rows()) == 89
    assert not [p for p in Path(tmp_path, "kept").iterdir() if "staged" in p.name]


def test_given_edges(spark):
    s = spark.createDataFrame([("f", "1"), ("f", "2")], "file_id string, section_id string")
    g = [("c", "f", "1", "2", "CONDITIONS", "EXTRACTED", 0.9), ("c", "f", "1", "2", "CONDITIONS", "x", 0.6), ("c", "f", "1", "9", "CONDITIONS", "EXTRACTED", 0.9), ("c", "f", "2", "1", "LIKES", "EXTRACTED", 0.9), ("c", "f", "2", "1", "DEFINES", None, 0.5), ("c", "f", "2", "2", "DEFINES", "INFERRED", 0.4)]
    got = graph.valid_edges(spark.createDataFrame(g, "conv string, file_id string, source string, target string, kind string, provenance string, confidence double"), s).collect()
    assert {(r["source"], r["target"], r["kind"], r["provenance"], r["confidence"]) for r in got} == {("1", "2", "CONDITIONS", "EXTRACTED", 0.9), ("2", "1", "DEFINES", "AMBIGUOUS", 0.5)}


def test_update_tells_what_changed(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "k int, x string, y int")
    delta = spark.createDataFrame([(1, "a", None), (2, None, 5), (9, "z", 9)], "k int, x string, y int")
    assert {tuple(r) for r in stores.update(base, delta, ["k"]).collect()} == {(1, "a", 1, False), (2, "b", 5, True), (3, "c", None, False)}


def test_classifier_learns_and_stops(spark):
    rows = spark.createDataFrame([(k, ("junk !!! sale now" if k % 3 == 0 else "the fee is due under clause") + f" w{k % 17}", int(k % 3 != 0)) for k in range(300)], "id int, text string, label int").withColumn("held_out", classify.held_out(F.col("id")))
    model, history = classify.train(rows)
    assert history[-1][1] == 1.0 and len(history) < len(classify.STEPS)
    assert all(r["guess"] == r["label"] and r["confidence"] > 0.5 for r in classify.classified(rows, model).collect())
    text = spark.createDataFrame([("T", "x" * 400), (None, "y"), ("  ", None)], "t string, c string").select(classify.section_text(F.col("t"), F.col("c")).alias("s"))
    assert [r["s"] for r in text.collect()] == ["T [SEP] " + "x" * 300, "y", ""]


def test_conflicts_by_date_else_rank(spark):
    found = spark.createDataFrame([("c", f, d, s, p, i, m, 0.0) for f, d, s, p, i, m in [("a", 1, "1", 1, 2, True), ("b", 2, "1", 1, 3, True), ("b", 2, "2", 2, 16, True), ("x", 3, "1", 1, 0, False), ("y", 4, "1", 1, 0, False)]], "conv string, file_id string, doc_id long, section_id string, pos long, injector int, immune boolean, score double")
    texts = spark.createDataFrame([("a", "1", "warranties"), ("b", "1", "warranties"), ("b", "2", "confidentiality"), ("x", "1", "confidentiality"), ("y", "1", "confidentiality")], "file_id string, section_id string, clause_type string")
    files = spark.createDataFrame([("a", "2021-01-01", 0), ("b", None, 3), ("x", None, 1), ("y", None, 2)], "file_id string, effective_date string, document_rank int")
    assert {tuple(r) for r in context.conflicts(found, texts, files).collect()} == {("c", "warranties", "a", 2), ("c", "confidentiality", "y", 2)}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_listeners_are_told_once(rocks, tmp_path):
    """Ends, time-outs and new elements over several starts from one checkpoint; the batch forms give the same rows."""
    from lexspan.streaming import status as S

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    cases = [
        (S.Answers, S.told_answers, "message long, ts timestamp, status string", [[(1, at(0), "Processing"), (2, at(5), "Processing"), (3, at(6), "Processing")], [(1, at(100), "Processed"), (1, at(101), "Failed")], [(4, at(2000), "Processing")], [(4, at(2100), "Failed")], [(9, at(9000), "Failed")]]),
        (S.Elements, S.told_elements, "message long, ts timestamp, n long, done boolean", [[(1, at(0), 2, False)], [(1, at(3), 2, False), (1, at(4), 5, True), (2, at(4), 1, False)], [(1, at(6), 7, False), (2, at(300), 4, False)]]),
    ]
    for listener, batch, schema, files in cases:
        folder, out = tmp_path / listener.__name__, []
        for k, rows in enumerate(files):
            rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            q = S.told(rocks.readStream.schema(schema).parquet(f"{folder}/in"), listener).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).foreachBatch(lambda d, _: out.extend(map(tuple, d.collect()))).start()
            assert q.awaitTermination(120), k
        every = rocks.createDataFrame([r for rows in files for r in rows], schema)
        if listener is S.Answers:
            want = {(r["message"], r["event"], r["at"], None) for r in batch(every).collect()}
        else:
            want = {(r["message"], "Element", r["at"], r["element"]) for r in batch(every).collect()}
            out = [r for r in out if r[1] == "Element"]
        assert len(out) == len(set(out)) and set(out) == want


def plain_split(text, separators=("\n\n", "\n", " ", ""), size=2000, overlap=200):
    """A recursive splitter with lists of pieces, as a check."""
    sep = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        parts = text.split(sep)
        pieces = [p for p in [parts[0], *(sep + p for p in parts[1:])] if p]
    else:
        pieces = list(text)
    out, good = [], []

    def merge():
        held, total = [], 0
        for p in good:
            if total + len(p) > size:
                if held:
                    out.append("".join(held).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        out.append("".join(held).strip())
        good.clear()

    for p in pieces:
        if len(p) < size:
            good.append(p)
        else:
            if good:
                merge()
            out.extend(plain_split(p, rest, size, overlap) if rest else [p])
    if good:
        merge()
    return [c for c in out if c]


def test_recursive_split(spark, sf_dir):
    from lexspan.sources import loaders

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(6)
    odd = ["", None, " \n\n ", "x" * 5000, ("y" * 2500 + " ") * 3, "a\n\nb" * 900, "\n" * 4100]
    odd += ["".join(rng.choice(["ab", " ", "\n", "\n\n", "z" * 300, "word"], int(rng.integers(1, 900)))) for _ in range(60)]
    every = docs.union(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = {}
    for r in loaders.split_texts(every, "doc_id").orderBy("doc_id", "page").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for r in every.collect():
        assert got.get(r["doc_id"], []) == (plain_split(r["text"]) if r["text"] else []), r["doc_id"]


def test_prepared_frames_are_shared_and_go(spark, sf_dir):
    """Queries within share written frames, and nothing of them is left at the end."""
    from lexspan import catalog
    from lexspan.plans import contract

    contract.clear(spark)
    with contract.prepared(spark):
        first = catalog.QUERIES["xrf_08_resolved_sections"](spark, sf_dir).count()
        paths = list(contract._PATHS[id(spark)])
        assert first and catalog.QUERIES["xrf_07_resolved"](spark, sf_dir).count() and contract._PATHS[id(spark)] == paths
    assert paths and not any(Path(p.removeprefix("file://")).exists() for p in paths)


def test_pages_of_files(spark, tmp_path):
    """Text and Word files by kind; broken and unknown ones have no pages."""
    import zipfile

    from lexspan.sources import loaders

    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>Paragraph {k}</w:t><w:tab/><w:t>of it</w:t></w:r></w:p><w:p/>" for k in range(150))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "b.txt").write_text("one\ntwo é")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    got = {}
    for r in loaders.pages(loaders.binary_files(spark, str(tmp_path))).orderBy("path", "page").collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append(r["text"])
    text = "\n\n".join(f"Paragraph {k}\tof it" for k in range(150))
    assert got == {"a.docx": plain_split(text), "b.txt": ["one\ntwo é"]} and len(got["a.docx"]) == 2

"""Scalar functions on worked examples, and the operators that SQL cannot express on a worked document."""

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lexspan.functions import text as X
from lexspan.operators import context, definitions, evaluation, parsing, retrieval, stores
from lexspan.sources import loaders


def scalars(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parents_and_refs(spark):
    given = ["12.1", "12.1.1", "4.2(b)", "2.01", "article i", "schedule 4", "12"]
    assert scalars(spark, X.parent_id, given) == ["12", "12.1", "4.2", "2", None, None, None]
    assert scalars(spark, X.normalize_ref, ["clause 12.1", "Section 4.2(b)", "Schedule 4", "paragraph 3.1", "1.1."]) == ["12.1", "4.2(b)", "schedule 4", "3.1", "1.1"]
    assert scalars(spark, X.refs, ["see clause 0, clause 51, clause 50 and Schedule 2, clause 50", ""]) == [["50", "schedule 2"], []]


def test_alias_keys(spark):
    given = ["Mainstay Asia Ltd", "Eames Consulting Limited", "Mainstay HK", "Mainstay (HK) Limited", "Mainstay Asia of Hong Kong", "AIAIM", "Asia Group"]
    assert scalars(spark, X.alias_key, given) == ["mainstay", "eames", "mainstay", "mainstay", "mainstay hong kong", "aiaim", "asia group"]


def test_headers(spark):
    lines = ["SCHEDULE 2 - Charges", "Article IV", "Section 2.01 – Terms", "1.1 The Fee", "1 Definitions", "3.", "plain words", "  4.2(b) x"]
    assert scalars(spark, X.header_id, lines) == ["schedule 2", "article iv", "2.01", "1.1", "1", None, None, "4.2(b)"]
    assert scalars(spark, X.header_title, lines)[:5] == ["Charges", "", "Terms", "The Fee", "Definitions"]


def test_ids(spark):
    row = spark.range(1).select(X.node_id("section", F.lit("f1"), F.lit("12.1")).alias("n"), X.point_id(F.lit("f1"), F.lit("12.1")).alias("p")).first()
    assert row["n"] == "ed2618f4f400c832" and row["p"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "f1:12.1"))


def test_dates(spark):
    assert scalars(spark, X.iso_date, ["Dated 3rd March 2021", "on 2022-05-06", "made 7/8/2020", "31.02.2023", "none"]) == ["2021-03-03", "2022-05-06", "2020-08-07", "2023-02-31", None]


def test_inline_children_and_terms(spark):
    body = "1 Charges\n1.1 The fee is due each month in full\n1.2 Interest runs at five per cent a year"
    s = spark.createDataFrame([("c", "f", 1, "1", body, "payment_terms"), ("c", "f", 2, "1.2", "1.2 there already, and long enough", "other"), ("c", "f", 3, "9", '"Fee" means the sum payable. "Term" means one year. "Fee" means the final sum.', "definitions")], "conv string, file_id string, pos long, section_id string, content string, clause_type string")
    assert [(r["section_id"], r["content"]) for r in parsing.inline_children(s).collect()] == [("1.1", "1.1 The fee is due each month in full")]
    assert {r["term"]: r["definition"] for r in definitions.defined_terms(s.withColumn("doc_id", F.lit(1))).collect()} == {"Fee": "the final sum.", "Term": "one year."}


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    (tmp_path / "c.csv").write_text("query,positive\n a , b \n,x\n")
    assert [r["text"] for r in loaders.text_files(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo"]
    assert {r["path"][-5:]: r["kind"] for r in loaders.binary_files(spark, str(tmp_path)).collect()} == {"a.txt": "txt", "b.PDF": "pdf", "c.csv": None}
    assert [tuple(r) for r in loaders.pair_file(spark, str(tmp_path / "c.csv")).collect()] == [("a", "b")]
    assert scalars(spark, loaders.page_number, ["Page-12", "x", "page_3"]) == [12, 0, 3]


def test_merges(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None), (None, "n", 0)], "k int, x string, y int")
    delta = spark.createDataFrame([(2, None, 5), (3, "c", 3), (None, "m", None)], "k int, x string, y int")
    assert {tuple(r) for r in stores.upsert(base, delta, ["k"]).collect()} == {(1, "a", 1), (2, "b", 5), (3, "c", 3), (None, "m", 0)}
    assert {tuple(r) for r in stores.insert_absent(base, delta, ["k"]).collect()} == {(1, "a", 1), (2, "b", None), (None, "n", 0), (3, "c", 3)}


def test_defaults(spark):
    row = spark.range(1).select(evaluation.embed(F.lit("one two two")).alias("e"), evaluation.overlap_score(F.lit("a b"), F.lit("b c")).alias("s"), retrieval.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c")).first()
    assert abs(sum(v * v for v in row["e"]) - 1) < 1e-9 and row["s"] == 0.5 and abs(row["c"] - 0.5**0.5) < 1e-9


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from lexspan.streaming import progress as S

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    got = {}
    q = S.follow(S.progress(S.events_stream(spark, str(tmp_path / "in")), late="60 days"), lambda d, _: got.update({(r["start"], r["event_type"]): r["n"] for r in d.collect()}), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    assert got == {(r["start"], r["event_type"]): r["n"] for r in S.progress(spark.read.parquet(str(tmp_path / "in"))).collect()}


def test_sections_beyond_a_cap_stay_open(spark):
    """What qualifiers (6) lose to their cap goes to the later injectors that bring it too; term clauses (10) need their file in the pool."""
    rows = [("c", f"f{i}", i, "1", 1, 6, False) for i in range(8)]
    rows += [("c", "f6", 6, "1", 1, 11, True), ("c", "f5", 5, "1", 1, 8, False), ("c", "f0", 0, "1", 1, 11, True)]
    rows += [("c", "f1", 1, "6", 2, 10, True), ("c", "f7", 7, "6", 2, 10, True), ("d", "g", 9, "1", 1, 6, False)]
    got = context.first_wins(spark.createDataFrame(rows, "conv string, file_id string, doc_id long, section_id string, pos int, injector int, immune boolean")).collect()
    want = [("c", f"f{i}", "1", 6, False) for i in range(5)] + [("c", "f5", "1", 8, False), ("c", "f6", "1", 11, True), ("c", "f1", "6", 10, True), ("d", "g", "1", 6, False)]
    assert sorted((r["conv"], r["file_id"], r["section_id"], r["injector"], r["immune"]) for r in got) == sorted(want)


def test_areas_are_added_in_the_order_of_the_table(spark, tmp_path):
    """Shares at the bound itself, the lines of a file in several Parquet files of several sizes: as if all were added one after the other."""
    rng, rows, folder = np.random.default_rng(11), [], tmp_path / "lineitem.parquet"
    folder.mkdir()
    for k in range(400):
        tax = rng.integers(1, 9, 4)
        rows += [(k, n, float(t) / 100, float(q)) for n, (t, q) in enumerate(zip(tax, [1, 1, 1, 5 * tax.sum() - 3], strict=True))]
    for part, size in enumerate([(1,), (0, 3), (2,)]):
        lines = sorted((r for r in rows if r[1] in size), key=lambda r: (r[0] * 7 % 400, r[1]))
        pq.write_table(pa.table({"l_orderkey": [r[0] for r in lines], "l_tax": [r[2] for r in lines], "l_quantity": [r[3] for r in lines]}), folder / f"p{part}.parquet")
    want = {}
    for k in range(400):
        own = [rows[4 * k + n] for n in (1, 0, 3, 2)]
        want[k] = reduce(float.__add__, (r[2] for r in own)) / sum(r[3] for r in own) < 0.002  # sum() of Python makes up for what rounding loses
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    for cost in ("1k", "4m"):  # files apart and together
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        got = dict(map(tuple, loaders.scan_detector(spark, str(tmp_path)).collect()))
        assert got == want
    spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert 0 < sum(want.values()) < 400

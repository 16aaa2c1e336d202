"""More edges of operators and stages: hot ids, clashing names, very long values, and the pipeline on odd tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspan.llm import chat, html_text, packing, quality, shared, simhash, token_files, warc

WORDS = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_all_ids_alike(spark, doc_id):
    """Every row has no id, or the same."""
    d = spark.createDataFrame([(doc_id, f"{WORDS} number {k}") for k in range(30)], "doc_id long, text string")
    packed = packing.pack(d, budget=100).collect()
    assert len(packed) == 30 and len({(r["bucket"], r["batch"], r["slot"]) for r in packed}) == 30
    rows = simhash.with_next(d)
    assert rows.where("not _halo").count() == 30 and rows.where("_halo").count() <= 1
    uri = shared.fresh_dir(spark, "ids")
    assert token_files.write_shards(d, uri) is not None


def test_packing_ties_and_long_documents(spark):
    """Batches hold at most their budget, but for a document beyond it, and each slot once; lengths at a bucket's end stay in it."""
    texts = [(k, " ".join(["w"] * n)) for k, n in enumerate([3, 3, 3, 7, 7, 15, 15, 15, 500])]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), buckets=3, budget=32).collect()
    by = {}
    for r in rows:
        assert r["n_tokens"] <= r["bucket_tokens"]
        by.setdefault((r["bucket"], r["batch"]), []).append(r)
    assert all(len(b) == 1 or sum(r["bucket_tokens"] for r in b) <= 32 for b in by.values())
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in by.values()) and max(r["bucket_tokens"] for r in rows) == 501


def test_quality_with_clashing_columns(spark):
    """Columns with the names of counts or of the steps in between give way in counts, and stay as they are in the filter."""
    names = ["_w", "_lines", "_win", "_room", "_s", "_again", "n_words", "kept", "quality_probability"]
    d = spark.createDataFrame([(1, WORDS, *"abcdefghi"), (2, None, *"abcdefghi"), (2, None, *"abcdefghi")], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = quality.with_stats(d).collect()
    assert sorted(r["n_words"] for r in got) == [0, 0, 40] and "_w" not in got[0].asDict()
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and [tuple(r)[2:] for r in kept.collect()] == [tuple("abcdefghi")]


def test_chat_with_long_texts_and_clashing_columns(spark):
    long = "<|im_end|> " * 100_000
    c = spark.createDataFrame([(1, 0, "user", long, "x", "y"), (1, 1, "assistant", long, "x", "y"), (2, 0, None, None, "x", "y")], "conv_id long, turn long, role string, text string, _fp string, turns string")
    rows = {r["conv_id"]: r for r in chat.digest(chat.render(chat.canonical(chat.as_messages(c), "conv_id")).select("conv_id", "formatted", "loss"), "conv_id").collect()}
    assert rows[1]["n_turns"] == 2 and rows[1]["loss_chars"] == len(long) and rows[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert rows[1]["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest() and rows[2]["loss_chars"] == 0


def test_long_pages(spark):
    """Very long html and payloads through Spark, and one payload that most rows have."""
    body = " ".join(f"<p>Paragraph number {k} of a very long article.</p>" for k in range(40_000))
    pages = [(k, f"http://h/{k}", f"<article>{body}</article>" if k == 0 else "<article><p>One page as many others are.</p></article>") for k in range(40)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(d).collect()}
    assert got[0]["text"].count("Paragraph number") == 40_000 and got[0]["n_chars"] == len(got[0]["text"])
    uri = shared.fresh_dir(spark, "long")
    back = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(d, uri), uri, 1000).collect()}
    assert bytes(back[0]["payload"]).decode() == pages[0][2] and back[1]["record_type"] == "response"
    assert all(back[k]["refers_to"] == 1 and back[k]["payload_digest"] == back[1]["payload_digest"] for k in range(2, 40))


ODD = [(1, None, "a"), (2, "", "a"), (None, WORDS, "a"), (None, WORDS, "b"), (3, WORDS + " three", "c"), (3, WORDS + " three", "c"), (4, "short", None)]


def odd_stages(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text"), "kept": F.lit(1), "score": F.lit("x"), "component_id": F.lit(0), "batch": F.lit("b")})
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        path = shared.fresh_dir(spark, "odd")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        yield name, docs


def test_pipeline_on_odd_rows(spark, sf_dir):
    """Nulls, repeated rows and columns with the operators' own names."""
    sizes = {name: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=repr) for name, d in odd_stages(spark, sf_dir, ODD) if "text" in d.columns}
    assert len(sizes["toxicity"]) == len(ODD)
    assert sorted((i for i, _ in sizes["quality rules"]), key=repr) == [3, 3, None, None]
    assert sorted((i for i, _ in sizes["n-gram Jaccard join"]), key=repr) == [3, None, None]


def test_pipeline_on_no_rows(spark, sf_dir):
    assert [d.count() for _, d in odd_stages(spark, sf_dir, [])] == [0, 0, 0, 0]


def test_release_gives_back_what_the_driver_no_longer_uses(spark, monkeypatch):
    """The driver's Python gives unused memory back, that of Arrow and the rest, before the JVM collects its garbage."""
    done = []

    class Pool:
        def release_unused(self):
            done.append("arrow")

    monkeypatch.setattr(shared.pa, "default_memory_pool", Pool)
    monkeypatch.setattr(shared.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(lambda _: done.append("rest"))}))
    shared.release(spark)
    assert done == ["arrow", "rest"]

"""Documents in: files to pages, page maps, scans and file lists (SRC)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import contract as C
from ..registry import query

CHUNK, OVERLAP = 2000, 200


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as page 1 (SRC-03)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.lit(1).alias("page"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their kind by extension; unknown kinds have kind null (SRC-01)."""
    ext = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.when(ext.isin("pdf", "docx", "txt"), ext).alias("kind"))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """The paragraphs with text of a Word document, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    said = {f"{_WORD}t": lambda e: e.text or "", f"{_WORD}tab": lambda e: "\t", f"{_WORD}br": lambda e: "\n", f"{_WORD}cr": lambda e: "\n"}
    paragraphs = ("".join(said[e.tag](e) for e in p.iter() if e.tag in said).strip() for p in root.iter(f"{_WORD}p"))
    return "\n\n".join(p for p in paragraphs if p)


def pages(files: DataFrame) -> DataFrame:
    """files (path, content, kind), as binary_files gives them: (path, page, text) by kind: a text file is page 1, a Word document is split as split_text does. A
    file that can't be read and one of another kind have no pages; PDF pages need a parser that isn't here (SRC-01)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for path, content, kind in zip(d["path"], d["content"], d["kind"], strict=True):
                try:
                    found = [bytes(content).decode()] if kind == "txt" else split_text(docx_text(bytes(content))) if kind == "docx" else []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    found = []
                rows += [(path, n, t) for n, t in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content", "kind").mapInPandas(read, "path string, page int, text string")


def pair_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (query, positive): nulls count as empty, blanks go, rows without either go (SRC-23)."""
    d = spark.read.schema("query string, positive string").csv(path, header=True)
    return d.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("query", "positive")]).where("query <> '' and positive <> ''")


def chunked(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Pieces of size characters that share overlap with the one before (SRC-04)."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.floor((F.length(text) - overlap - 1) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(size)))


def page_number(key: Column) -> Column:
    """`Page-12` to 12; without digits 0."""
    return F.coalesce(F.nullif(F.regexp_replace(key, "[^0-9]", ""), F.lit("")).cast("int"), F.lit(0))


@query("src_04_chunks", f"SELECT doc_id, i AS k, md5(substr(text, CAST(i * {CHUNK - OVERLAP} + 1 AS BIGINT), {CHUNK})) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(0, floor((length(text) - {OVERLAP} - 1) / {CHUNK - OVERLAP})) AS BIGINT))) AS i FROM documents)")
def chunk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunked(F.col("text"))).alias("k", "c"))
    return d.select("doc_id", F.col("k").cast("long").alias("k"), F.md5("c").alias("chunk_md5"))


# What a text is split at, the first that it has; pieces begin with it.
SEPARATORS = ("\n\n", "\n", " ", "")


def _runs(text: str, begin: int, end: int, level: int, size: int) -> Iterator[list[int]]:
    """The bounds of the pieces of text[begin:end], in runs of neighbours shorter than size; longer pieces are split at the next separators."""
    while SEPARATORS[level] and text.find(SEPARATORS[level], begin, end) < 0:
        level += 1
    if not SEPARATORS[level]:
        yield list(range(begin, end + 1))
        return
    found = re.compile(re.escape(SEPARATORS[level])).finditer(text, begin, end)
    bounds = sorted({begin, end, *(m.start() for m in found)})
    run: list[int] = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < size:
            run += [b] if run else [a, b]
        else:
            if run:
                yield run
            run = []
            yield from _runs(text, a, b, level + 1, size)
    if run:
        yield run


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most size characters that end between pieces; each goes on with the last pieces of the one before, overlap characters at most."""
    out = []
    for run in _runs(text, 0, len(text), 0, size) if text else ():
        first = 0
        for k in range(len(run) - 1):
            if run[k + 1] - run[first] > size:
                if k > first:
                    out.append(text[run[first] : run[k]].strip())
                while run[k] - run[first] > overlap or run[k + 1] - run[first] > size and k > first:
                    first += 1
        out.append(text[run[first] : run[-1]].strip())
    return [c for c in out if c]


def split_texts(docs: DataFrame, key: str) -> DataFrame:
    """docs (key, text): (key, page, text), the chunks of a text as its pages from 1 on; none for a null or blank text."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [(k, n, c) for k, t in zip(d[key], d["text"], strict=True) for n, c in enumerate(split_text(t or ""), 1)]
            yield pd.DataFrame(rows, columns=[key, "page", "text"])

    return docs.select(key, "text").mapInPandas(pages, f"{key} {docs.schema[key].dataType.simpleString()}, page int, text string")


@query("src_04_recursive_chunks")
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split at paragraphs, lines, words and letters in turn, with what chunks share carried over."""
    return split_texts(C.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "page", F.length("text").alias("n_chars"), F.md5("text").alias("chunk_md5"))


@query("src_06_scan_detector", "SELECT l_orderkey, sum(l_tax) / nullif(sum(l_quantity), 0) < 0.002 AS is_scan FROM lineitem GROUP BY l_orderkey")
def scan_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose text areas are a small share of its page areas is a scan; without area too. Line tax stands in for text area. Areas are added in the table's order: sums of doubles depend
    on it, and where a file's lines are in several splits, sums of their sums would put a share at the bound now here, now there."""
    lines = C.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", "l_quantity", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    w = Window.partitionBy("l_orderkey").orderBy("_file", "_row")
    total = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ratio = F.try_divide(total("l_tax"), total("l_quantity"))
    return lines.select("l_orderkey", F.coalesce(ratio < 0.002, F.lit(True)).alias("is_scan"), F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")


@query("src_11_one_line", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS text_md5 FROM documents")
def one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))).alias("text_md5"))


@query("src_14_page_map", "SELECT doc_id, p // 12 + 1 AS page, count(*) AS n_lines FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents) GROUP BY ALL")
def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a JSON map with keys `Page-n` and read back by number."""
    rows = C.lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    maps = rows.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("Page-"), "page"), F.col("n").cast("string"))))).alias("j"))
    back = maps.select("doc_id", F.explode(F.from_json("j", "map<string,string>")).alias("k", "v"))
    return back.select("doc_id", page_number(F.col("k")).cast("long").alias("page"), F.col("v").cast("long").alias("n_lines"))


_PAGES_SQL = "SELECT source AS conv, doc_id, p // 12 + 1 AS page, string_agg(x, chr(10) ORDER BY p) AS t FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents) GROUP BY ALL"


def filled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, doc_id, page, t): pages with text."""
    d = C.table(spark, sf_dir, "documents").select(F.col("source").alias("conv"), "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]), "\n")
    return d.groupBy("conv", "doc_id", F.expr("p div 12 + 1").alias("page")).agg(text.alias("t")).where("trim(t) <> ''")


def numbered(pages: DataFrame) -> DataFrame:
    """pages with n, their number in the conversation by file and page: a page's place in its file, and what the files before have. Only files are ordered by conversation."""
    in_file = F.row_number().over(Window.partitionBy("conv", "doc_id").orderBy("page"))
    counts = pages.groupBy("conv", "doc_id").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("conv").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.join(counts.select("conv", "doc_id", before.alias("_before")), ["conv", "doc_id"]).withColumn("n", in_file + F.col("_before")).drop("_before")


@query("src_15_numbered_sources", f"SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY doc_id, page) AS n, 'f' || doc_id AS file_id, page, length(t) // 4 AS tokens FROM ({_PAGES_SQL}) WHERE trim(t) <> ''")
def numbered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filled pages of a conversation in order, numbered, with estimated tokens."""
    return numbered(filled_pages(spark, sf_dir)).select("conv", "n", F.concat(F.lit("f"), "doc_id").alias("file_id"), "page", F.expr("length(t) div 4").alias("tokens"))


@query("src_15_citation_map", f"SELECT s.conv, s.n AS source, 'f' || s.doc_id AS file_id, ['Framework Agreement ', 'Work Order ', 'Addendum ', 'Termination Notice ', 'Policy '][s.doc_id // 20 % 5 + 1] || s.doc_id AS file_name, s.page::VARCHAR AS page_number, md5('[Source ' || s.n || ': ' || ['Framework Agreement ', 'Work Order ', 'Addendum ', 'Termination Notice ', 'Policy '][s.doc_id // 20 % 5 + 1] || s.doc_id || ', Page ' || s.page || ']' || chr(10) || s.t || chr(10)) AS block_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY doc_id, page) AS n FROM ({_PAGES_SQL}) WHERE trim(t) <> '') s")
def citation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source number stands for, and the block of text that is shown under it."""
    a = numbered(filled_pages(spark, sf_dir)).join(C.files(spark, sf_dir).select("doc_id", "file_id", "file_name"), "doc_id")
    block = F.concat(F.lit("[Source "), "n", F.lit(": "), "file_name", F.lit(", Page "), "page", F.lit("]\n"), "t", F.lit("\n"))
    return a.select("conv", F.col("n").alias("source"), "file_id", "file_name", F.col("page").cast("string").alias("page_number"), F.md5(block).alias("block_md5"))


@query("src_16_summary", f"SELECT conv, doc_id, count(*) AS pages, sum(length(t))::BIGINT AS n_chars, sum(length(t))::BIGINT // 4 AS tokens, count(DISTINCT doc_id) AS files FROM ({_PAGES_SQL}) WHERE trim(t) <> '' GROUP BY ROLLUP (conv, doc_id)")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled pages, their characters and estimated tokens by file, by conversation and in all: counted by file first, so that the rollup sees files only."""
    d = filled_pages(spark, sf_dir).groupBy("conv", "doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("t")).alias("c"))
    g = d.rollup("conv", "doc_id").agg(F.sum("pages").alias("pages"), F.sum("c").alias("n_chars"), F.count(F.lit(1)).alias("files"))
    return g.select("conv", "doc_id", "pages", "n_chars", F.expr("n_chars div 4").alias("tokens"), "files")


@query("src_17_conversation_files", "SELECT DISTINCT source AS conv, doc_id, CASE WHEN source IN (SELECT source FROM documents WHERE doc_id % 50 = 3) THEN 'attached' ELSE 'stored' END AS origin FROM documents WHERE doc_id % 50 = 3 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 3)")
def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attached files of a conversation; where none is attached, its stored ones."""
    d = C.table(spark, sf_dir, "documents").select(F.col("source").alias("conv"), "doc_id")
    attached = d.where("doc_id % 50 = 3")
    stored = d.join(attached.select("conv").distinct(), "conv", "left_anti").withColumn("origin", F.lit("stored"))
    return attached.withColumn("origin", F.lit("attached")).unionByName(stored).distinct()


@query("src_20_filter_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 OR o_totalprice > 300000")
def filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "orders").where("o_custkey = 7 or o_totalprice > 300000").select("o_orderkey", "o_orderstatus")


@query("src_24_training_rows", "SELECT doc_id, md5(coalesce(lang, '') || ' [SEP] ' || text) AS text_md5, CASE WHEN lower(trim(lang)) IN ('en', 'de') THEN lower(trim(lang)) ELSE 'other' END AS label FROM documents WHERE text <> ''")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.lower(F.trim("lang"))
    return C.table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.md5(F.concat(F.coalesce("lang", F.lit("")), F.lit(" [SEP] "), "text")).alias("text_md5"), F.when(lang.isin("en", "de"), lang).otherwise("other").alias("label"))

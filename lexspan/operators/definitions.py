"""Defined terms of files and where texts use them (PRS-18, RET-19f)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A term in quotes, or without them as several capital-led words or one word in capitals, before `means`.
_QUOTE = "[“”‘’\"`„«»‹›]"
DEFINED = rf"(?:{_QUOTE}([A-Z][A-Za-z\s\-]{{1,60}}?){_QUOTE}|(?<![\p{{L}}\p{{N}}_])((?:[A-Z][a-z]{{0,30}}\s+){{1,5}}[A-Z][a-z]{{0,30}}|[A-Z][A-Z]{{3,30}}))\s+means\s+"
MOST_CHARS, LONG_CHARS = 400, 350
#: Texts of a conversation that one automaton scans.
SCANNED = 2000


def defined_terms(sections: DataFrame) -> DataFrame:
    """(conv, file_id, doc_id, k, term, definition) of a file's sections of definitions (PRS-18): each text up to the next term or MOST_CHARS, long ones cut at
    their last sentence; of equal terms the last text, in the place of the first."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    a = sections.where("clause_type = 'definitions'").groupBy("conv", "file_id", "doc_id").agg(joined.alias("t"))
    pattern = F.lit(DEFINED)
    quoted, bare = (F.regexp_extract_all("t", pattern, F.lit(k)) for k in (1, 2))
    # what stands between two terms is what a split by the terms leaves
    texts = F.slice(F.split("t", DEFINED), 2, F.greatest(F.size(quoted), F.lit(0)))
    each = a.select("conv", "file_id", "doc_id", F.posexplode(F.arrays_zip(quoted.alias("q"), bare.alias("b"), texts.alias("text"))).alias("k", "m"))
    strip = lambda c: F.btrim(c, F.lit(" \t\n\r"))
    term = strip(F.when(F.col("m.q") != "", F.col("m.q")).otherwise(F.col("m.b")))
    said = F.replace(strip(F.substring(F.col("m.text"), 1, MOST_CHARS)), F.lit("\n"), F.lit(" "))
    a = each.select("conv", "file_id", "doc_id", "k", term.alias("term"), said.alias("said"))
    start = F.substring("said", 1, LONG_CHARS)
    cut = F.when(start.rlike("\\. "), F.concat(F.regexp_extract(start, "(?s)^(.*)\\. ", 1), F.lit("."))).otherwise("")
    a = a.withColumn("said", F.when((F.length("said") > LONG_CHARS) & F.col("said").contains(". "), cut).otherwise(F.col("said")))
    a = a.where((F.length("term") > 1) & (F.col("said") != ""))
    return a.groupBy("conv", "file_id", "doc_id", "term").agg(F.min("k").alias("k"), F.max_by("said", "k").alias("definition"))


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a word begins or ends at both places."""
    before = start > 0 and _is_word(text[start - 1])
    after = end < len(text) and _is_word(text[end])
    return before != _is_word(text[start]) and after != _is_word(text[end - 1])


def first_uses(text: str, automaton) -> Iterator[tuple[str, int]]:
    """(term, place) of the terms in a text, each at its first use: from left to right, at each place the longest whole term, no overlaps."""
    found: dict[int, int] = {}
    for last, size in automaton.iter(text):
        at = last - size + 1
        if size > found.get(at, 0) and _bounded(text, at, last + 1):
            found[at] = size
    seen, free = set(), 0
    for at in sorted(found):
        if at >= free:
            free = at + found[at]
            term = text[at:free]
            if term not in seen:
                seen.add(term)
                yield term, at


def used_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """texts (conv, key, content), terms (conv, term): (conv, key, term, at), where each text uses each term first.

    One automaton holds all terms of a conversation; its texts are dealt by SCANNED, so that a large one has many tasks, each with the terms.
    """
    parts = texts.groupBy("conv").agg(F.ceil(F.count(F.lit(1)) / SCANNED).alias("parts"))
    dealt = texts.join(parts, "conv").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).select("conv", "part", "key", "content")
    held = terms.select("conv", "term").distinct().join(parts, "conv").select("conv", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "term")
    key_type = texts.schema["key"].dataType.simpleString()

    def scan(given: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        rows = []
        if len(given) and len(wanted):
            automaton = ahocorasick.Automaton()
            for t in wanted["term"]:
                automaton.add_word(t, len(t))
            automaton.make_automaton()
            for conv, key, content in zip(given["conv"], given["key"], given["content"], strict=True):
                rows += [(conv, key, term, at) for term, at in first_uses(content or "", automaton)]
        return pd.DataFrame(rows, columns=["conv", "key", "term", "at"])

    return dealt.groupBy("conv", "part").cogroup(held.groupBy("conv", "part")).applyInPandas(scan, f"conv string, key {key_type}, term string, at int")


def combined(terms: DataFrame) -> DataFrame:
    """The terms of a conversation's files, each as its first file by order has it."""
    first = F.row_number().over(Window.partitionBy("conv", "term").orderBy("doc_id"))
    return terms.withColumn("_n", first).where("_n = 1").drop("_n")

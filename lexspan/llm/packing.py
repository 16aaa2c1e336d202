"""Packing by optimal length buckets.

The global histogram of document lengths is small; dynamic programming over it chooses the bucket boundaries with the
least padding. Inside each bucket, documents in doc_id order fill batches of at most a token budget, padded to the boundary.

Lengths up to EXACT are told apart one by one, longer ones in cells of 1/EXACT of their power of two, so the histogram has
O(EXACT * log2(longest)) cells whatever the input; a cell counts as its longest document, so nothing is cut. Boundaries are the best among the ends of
cells; against boundaries at any length they cost less than 1/EXACT of a document's tokens more, and nothing where all lengths are up to EXACT.

Defined results: a null or empty text has length 1 (its end token); a document longer than the budget is a batch of its own;
a null doc_id comes first; repeated rows take a slot each; an empty table gives no batches; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import SPLIT, WHITE
from .shared import checkpoint, empty_text, n_parts, range_parts, table

BUCKETS = 16
BUDGET = 65_536
EXACT = 2048


def n_tokens(text: str = "text") -> Column:
    """Words plus an end token."""
    t = F.btrim(empty_text(text), F.lit(WHITE))
    return F.when(t == "", F.lit(1)).otherwise(F.size(F.split(t, SPLIT)) + 1).cast("long")


def cell(n: Column) -> Column:
    """The histogram cell of a length, as the length at its upper end."""
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - int(np.log2(EXACT))))
    return (F.ceil(n / step) * step).cast("long")


def boundaries(longest: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Of ascending cells (longest document, documents): at most so many boundaries, ascending, with the least total padding.

    Every cell's documents are padded to the first boundary that holds them. best[j] is the least number of padded tokens of the
    first j cells; a last bucket over the cells i..j-1 costs longest[j-1] for each of its documents.
    """
    m = len(longest)
    if not m:
        return []
    before = np.concatenate(([0], np.cumsum(count))).astype(float)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        line = np.full(m + 1, np.inf)
        cut = np.zeros(m + 1, np.int64)
        line[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + longest[j - 1] * (before[j] - before[:j])
            cut[j] = int(np.argmin(cost))
            line[j] = cost[cut[j]]
        cuts.append(cut)
        best = line
    out, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(longest[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs (doc_id, text): (doc_id, n_tokens, bucket, bucket_tokens, batch, slot)."""
    n = n_parts(docs.sparkSession)
    lengths = checkpoint(docs.select("doc_id", n_tokens().alias("n_tokens")))
    cells = lengths.groupBy(cell(F.col("n_tokens")).alias("c")).agg(F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("n")).orderBy("c").collect()
    ends = boundaries(np.array([r["longest"] for r in cells], float), np.array([r["n"] for r in cells]), buckets)
    if not ends:
        return lengths.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_tokens"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    limits = F.lit(ends).cast("array<bigint>")
    parts, _ = range_parts(lengths, "doc_id", n)
    marked = parts.withColumn("bucket", F.size(F.filter(limits, lambda e: e < F.col("n_tokens"))))
    # a rank within each bucket without a task for each bucket: ranks within ranges of doc_id, plus what lies before
    counts = marked.groupBy("bucket", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", "_part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("_part")) - F.col("n")).alias("_before"))  # buckets x parts rows at most
    rank = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy("_k", "n_tokens")) - 1 + F.col("_before")
    ranked = marked.join(F.broadcast(before), ["bucket", "_part"]).withColumn("_rank", rank)
    size = F.get(limits, F.col("bucket"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / size).cast("long"))
    return ranked.select("doc_id", "n_tokens", "bucket", size.alias("bucket_tokens"), F.floor(F.col("_rank") / room).alias("batch"), (F.col("_rank") % room).alias("slot"))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))

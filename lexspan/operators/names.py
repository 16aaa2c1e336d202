"""Likeness of names by their longest common blocks, for questions that spell a file's name in their own way (RET-19b)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# How alike two tokens must be, the least letters of a token, how many must match, and what doesn't count in a file's name.
LEAST_LIKE, LEAST_CHARS, LEAST_HITS = 0.82, 3, 2
NAME_STOP = r"(?i)\.pdf$|\.docx?$|(?<![A-Za-z0-9_])(?:dd|the|and|for|of|in|to|a|an)(?![A-Za-z0-9_])"
BAG = 64


def _codes(texts: list[str], width: int, blank: int) -> np.ndarray:
    out = np.full((len(texts), width), blank, np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """How many letters of each pair stand in common blocks: the longest one (of equals the first in a, then in b), and those left and right of it in turn.

    All pairs go through each step together; a step's work is pairs x letters of a x letters of b.
    """
    left, right = _codes(a, max(map(len, a), default=0), -1), _codes(b, max(map(len, b), default=0), -2)
    total = np.zeros(len(a), np.int64)
    pair = np.arange(len(a))
    alo, blo = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    ahi, bhi = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    columns = np.arange(right.shape[1])
    while len(pair):
        run = np.zeros((len(pair), right.shape[1] + 1), np.int64)
        size, ai, bi = np.zeros(len(pair), np.int64), alo.copy(), blo.copy()
        within = (columns >= blo[:, None]) & (columns < bhi[:, None])
        for i in range(int(alo.min()), int(ahi.max())):
            same = (left[pair, i][:, None] == right[pair]) & within & ((alo <= i) & (i < ahi))[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            j = run[:, 1:].argmax(axis=1)
            best = run[np.arange(len(pair)), j + 1]
            more = best > size
            size[more], ai[more], bi[more] = best[more], i - best[more] + 1, (j - best + 1)[more]
        np.add.at(total, pair, size)
        hit = size > 0
        pair, alo, ahi, blo, bhi, ai, bi, size = (x[hit] for x in (pair, alo, ahi, blo, bhi, ai, bi, size))
        pair, alo, ahi, blo, bhi = np.tile(pair, 2), np.r_[alo, ai + size], np.r_[ai, ahi], np.r_[blo, bi + size], np.r_[bi, bhi]
        some = (alo < ahi) & (blo < bhi)
        pair, alo, ahi, blo, bhi = pair[some], alo[some], ahi[some], blo[some], bhi[some]
    return total


def likeness(a: list[str], b: list[str], least: float = LEAST_LIKE) -> np.ndarray:
    """Twice the common letters by all letters, where that may be least; 0 where lengths or the bags of letters already rule it out, which they do
    only rightly: no block holds more than the shorter text, nor more of a letter than both have."""
    la, lb = np.array([len(x) for x in a], float), np.array([len(x) for x in b], float)
    letters = np.maximum(la + lb, 1)
    out = np.zeros(len(a))
    some = np.flatnonzero(2 * np.minimum(la, lb) >= least * letters - 1e-9)
    bags = []
    for texts in (a, b):
        bag = np.zeros((len(some), BAG), np.int32)
        for k, x in enumerate(some.tolist()):
            np.add.at(bag[k], np.frombuffer(texts[x].encode("utf-32-le"), np.int32) % BAG, 1)
        bags.append(bag)
    some = some[2 * np.minimum(*bags).sum(axis=1) >= least * letters[some] - 1e-9] if len(some) else some
    if len(some):
        out[some] = 2 * common_letters([a[x] for x in some], [b[x] for x in some]) / letters[some]
    return out


@F.pandas_udf(DoubleType())
def like(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(likeness(a.tolist(), b.tolist()))


def name_tokens(file_name: Column) -> Column:
    """The tokens of a file's name that count, each as often as it is there."""
    clean = F.lower(F.regexp_replace(file_name, NAME_STOP, " "))
    return F.filter(F.split(clean, "[^\\p{L}\\p{N}_]+"), lambda t: F.length(t) >= LEAST_CHARS)


def hinted_files(files: DataFrame) -> DataFrame:
    """files (conv, file_id, file_name, question): (conv, file_id) of those with LEAST_HITS tokens of their name in the question: part of a word of it, holding one, or
    like one. Each pair of token and question is looked at once; only pairs that hold no part of each other go to the kernel."""
    tokens = files.select("conv", "file_id", "question", F.explode(name_tokens(F.col("file_name"))).alias("token"))
    words = F.filter(F.split(F.lower("question"), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")
    pairs = tokens.select("question", "token").distinct().withColumn("words", words)
    part = F.exists("words", lambda w: w.contains(F.col("token")) | F.col("token").contains(w))
    held = pairs.where(part).select("question", "token")
    lengths = 2 * F.least(F.length("word"), F.length("token")) >= LEAST_LIKE * (F.length("word") + F.length("token")) - 1e-9
    rest = pairs.where(~part).select("question", "token", F.explode("words").alias("word")).where(lengths)
    alike = rest.select("token", "word").distinct().where(like("token", "word") >= LEAST_LIKE)
    hits = held.union(rest.join(alike, ["token", "word"], "left_semi").select("question", "token")).distinct()
    return tokens.join(hits, ["question", "token"]).groupBy("conv", "file_id").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= LEAST_HITS).select("conv", "file_id")

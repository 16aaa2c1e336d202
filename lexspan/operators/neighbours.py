"""Nearest vectors by an index of cells: seeded centroids, a table by cell, multi-probe, and bounds that make it exact where asked (RET-06, MLE-06).

Centroids are fitted on a bounded sample; every vector lies in the cells of its HOMES nearest centroids, the first of which is its home, and each cell knows the widest
angle of those at home. A question looks into the cells of the SHARE of centroids nearest to it. Since angles obey the triangle inequality, a cell whose centroid is further away than the question's k-th hit and the
cell's widest angle together can't hold a nearer one: with exact, all other cells are looked into as well.

Cells and the questions sent to them are dealt in parts of PART rows, so a cell with a third of all vectors has as many tasks as it needs. A part is a
matrix product; only its k best a question leave it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import contract as C
from ..registry import query

#: The most centroids, vectors of the sample for each, rounds of fitting, and rows of a part.
CELLS, SAMPLE, ROUNDS, PART = 1024, 32, 5, 4096
#: Cells of a vector, and the share of cells that a question looks into: what vectors without any clusters need for nine of ten; such with clusters need less.
HOMES, SHARE = 2, 0.5
#: Room for rounding in the bounds.
SLACK = 2e-6
_HIT = "q long, vec_id long, label int, score double"


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def centroids(points: DataFrame) -> np.ndarray:
    """Unit centroids from CELLS * SAMPLE vectors at most, those of least hash: the square root of their number as cells, fitted by cosine from seeded starts."""
    n = points.count()
    cells = max(1, min(CELLS, round(math.sqrt(n))))
    rows = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells * SAMPLE).select("embedding").toPandas()["embedding"]
    if not len(rows):
        return np.zeros((0, 0))
    sample = unit(np.array([np.asarray(r, float) for r in rows]))
    found = sample[:cells].copy()
    for _ in range(ROUNDS):
        of = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        found = np.where((sums != 0).any(axis=1, keepdims=True), unit(sums), found)
    return found


def indexed(points: DataFrame, found: np.ndarray) -> DataFrame:
    """points (vec_id, label, embedding) with cell, home, and angle, that to the centroid: HOMES rows a vector, one pass."""
    homes = min(HOMES, len(found))

    def assign(batches):
        for d in batches:
            if len(d):
                close = unit(np.array([np.asarray(e, float) for e in d["embedding"]])) @ found.T
                cells = np.argsort(-close, axis=1, kind="stable")[:, :homes]
                d = d.loc[d.index.repeat(homes)].reset_index(drop=True)
                yield d.assign(cell=cells.ravel().astype("int32"), home=np.arange(len(d)) % homes == 0, angle=np.arccos(np.clip(np.take_along_axis(close, cells, axis=1).ravel(), -1, 1)))

    return points.select("vec_id", "label", "embedding").mapInPandas(assign, "vec_id long, label int, embedding array<float>, cell int, home boolean, angle double")


def _probes(found: np.ndarray, choose: Callable) -> Callable:
    """Questions (q, embedding, least) to a row for each cell they look into."""

    def look(batches):
        for d in batches:
            rows = []
            for q, e, least in zip(d["q"], d["embedding"], d["least"], strict=True):
                angle = np.arccos(np.clip(unit(np.asarray(e, float)[None]) @ found.T, -1, 1))[0]
                rows += [(q, e, int(c)) for c in choose(angle, least)]
            yield pd.DataFrame(rows, columns=["q", "embedding", "cell"])

    return look


def _best_of_parts(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, label, score): for each question (q, embedding, cell) the k best of each part of its cells, itself left out."""
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias(name))
    both = parts(index, "nv").join(parts(asked, "nq"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    here = index.join(both, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "nv").alias("v"), every("nq").alias("u"), "vec_id", "label", "embedding")
    there = asked.join(both, "cell").select("cell", every("nv").alias("v"), F.pmod(F.xxhash64("q"), "nq").alias("u"), "q", F.col("embedding").alias("asked"))

    def compare(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(wanted):
            return pd.DataFrame({"q": [], "vec_id": [], "label": [], "score": []}).astype({"q": "int64", "vec_id": "int64", "label": "int32"})
        held = held.sort_values("vec_id")
        vectors, ids = np.array([np.asarray(e, float) for e in held["embedding"]]), held["vec_id"].to_numpy()
        asks, q = np.array([np.asarray(e, float) for e in wanted["asked"]]), wanted["q"].to_numpy()
        norms = np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((asks * asks).sum(axis=1))[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.round(asks @ vectors.T / norms, 6)
        score[~np.isfinite(score) | (ids == q[:, None])] = -2
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ties by id
        out = pd.DataFrame({"q": np.repeat(q, top.shape[1]), "vec_id": ids[top.ravel()], "label": held["label"].to_numpy()[top.ravel()], "score": np.take_along_axis(score, top, axis=1).ravel()})
        return out[out["score"] >= -1]

    return here.groupBy("cell", "v", "u").cogroup(there.groupBy("cell", "v", "u")).applyInPandas(compare, _HIT)


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each question, each vector once, though several cells have it."""
    hits = hits.groupBy("q", "vec_id").agg(F.first("label").alias("label"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(points: DataFrame, questions: DataFrame, k: int, exact: bool = False, index: DataFrame | None = None, found: np.ndarray | None = None) -> DataFrame:
    """(q, vec_id, label, score, rank): the k nearest points (vec_id, label, embedding) of each of questions (q, embedding) by cosine, ties by id, a point of the
    same id left out. index and found: a table that `indexed` made, kept from before, and its centroids."""
    found = centroids(points) if found is None else found
    index = indexed(points, found) if index is None else index
    if not len(found):
        return spark_empty(points)
    few = lambda angle, least: np.argsort(angle, kind="stable")[: max(4, math.ceil(SHARE * len(angle)))]
    ask = questions.select("q", "embedding", F.lit(-2.0).alias("least"))
    shape = "q long, embedding array<float>, cell int"
    first = _top(_best_of_parts(index, ask.mapInPandas(_probes(found, few), shape), k), k)
    if not exact:
        return first
    wide = np.full(len(found), -1.0)
    index = index.where("home")
    for r in index.groupBy("cell").agg(F.max("angle").alias("w")).collect():  # a number a cell, CELLS at most
        wide[r["cell"]] = r["w"]

    def may_hold(angle: np.ndarray, least: float) -> np.ndarray:
        bound = np.cos(np.maximum(0, angle - wide))
        left = np.ones(len(angle), bool)
        left[few(angle, least)] = False
        return np.flatnonzero(left & (wide >= 0) & (bound + SLACK >= least))

    kth = first.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("least"))
    again = questions.join(kth, "q", "left").select("q", "embedding", F.coalesce("least", F.lit(-2.0)).alias("least"))
    more = _best_of_parts(index, again.mapInPandas(_probes(found, may_hold), shape), k)
    return _top(first.drop("rank").unionByName(more), k)


def spark_empty(points: DataFrame) -> DataFrame:
    return points.sparkSession.createDataFrame([], _HIT + ", rank int")


def asked_vectors(points: DataFrame) -> DataFrame:
    """Every hundredth vector as a question."""
    return points.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")


@query("ret_06_cell_search")
def cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector by the cells of its nearest centroids: approximate, so tests measure its recall."""
    p = C.table(spark, sf_dir, "embeddings")
    return nearest(p, asked_vectors(p), 10).select("q", "vec_id", "rank", "score")

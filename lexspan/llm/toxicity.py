"""Toxicity from the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Terms are words and runs of 4 and 6 bytes (A-Z as a-z), so inflected and compounded insults share terms. The vocabulary comes from a bounded
sample of labelled rows: all words that neither too few nor too many of them have, whatever their label, which give each text a vector of
its own; and all terms whose presence depends on the label beyond chance. Document frequencies are counted over all
documents. Every text also has a term that all texts share, so texts without any of the kept terms are alike, not undefined.

The index holds the examples' distinct vectors in blocks. By term and block it knows the largest weight, which bounds the
cosine of any example in the block; a query opens blocks by falling bound until the bound is below its k-th best: the k
nearest are exact. Votes weigh by distance; leave-one-out votes of the examples calibrate them (a logistic curve).

Defined results: a null text counts as empty and scores as any text without terms; rows with a null label don't teach; of
several labels of a document the largest counts, and of several texts the least; repeated rows score alike; a null doc_id scores, isn't held out and teaches
nothing; without labels every score is the prior; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Words, checkpoint, chunks, release, table, text_bytes

#: The bounds of the labelled rows that teach: the rows with the least hash of their id, so many and with so many bytes of text together. They bound the index, which goes
#: to every task: a posting and its cell take 24 bytes at most, and a text has fewer postings than a third of its bytes.
EXAMPLES, EXAMPLE_BYTES = 8192, 32 << 20
NEAREST = 16
#: Examples of a block, and how many blocks a query opens before it looks which of the others may still hold a nearer one.
BLOCK, FEW = 64, 8
#: How fast a vote fades with cosine distance from the nearest, and the weight of the prior among the votes.
FADE, PRIOR_WEIGHT = 0.1, 0.5
GRAMS = (4, 6)
#: The least and the largest share of the sampled texts that have a word of the vocabulary.
WORD_SHARES = (0.004, 0.05)
#: A term tells of the label if so large a share of the sampled texts that have it are toxic, beyond chance.
LEAST_SHARE = 0.3
#: How much more such a term weighs than its inverse document frequency.
TELLING = 16.0
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _terms(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, byte position) of the terms of a batch, kind by kind."""
    yield words.hashes(), words.starts
    n = len(words.raw)
    for k in GRAMS:
        at = np.arange(max(0, n - k + 1))
        salt = np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        yield words.span_hash(at, at + k) ^ salt, at


def _text_of(words: Words, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each position, and whether a run of k bytes stays within it."""
    text = np.searchsorted(words.bounds, at, "right") - 1
    return text, at + k < words.bounds[text + 1]


class Lookup:
    """Finds kept terms among many hashes."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.may = np.zeros(1 << 20, bool)
        self.may[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term) of the hashes that are kept terms."""
        at = np.flatnonzero(self.may[(h >> np.uint64(44)).view(np.int64)])
        if not len(self.sorted) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spot = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        ok = self.sorted[spot] == h[at]
        return at[ok], self.order[spot[ok]]


def count_terms(texts: list[bytes | None], lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) sorted by text and term."""
    n_terms = len(lookup.sorted)
    found = []
    for i, j in chunks(texts):
        words = Words(texts[i:j], lower=True)
        for kind, (h, at) in enumerate(_terms(words)):
            spot, term = lookup(h)
            text, inside = _text_of(words, at[spot], 1 if kind == 0 else GRAMS[kind - 1])
            found.append((text[inside] + i) * n_terms + term[inside])
    code, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return code // max(1, n_terms), code % max(1, n_terms), count


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (term, word, toxic, n): in how many texts of the task a term is."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {(w, y): [] for w in (0, 1) for y in (0, 1)}

    def merged():
        for kind, parts in held.items():
            if parts:
                term, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                held[kind] = [(term, np.bincount(of, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]

    for batch in batches:
        toxic, texts = batch.column(0).to_numpy(), text_bytes(batch.column(1))
        for i, j in chunks(texts):
            words = Words(texts[i:j], lower=True)
            for kind, (h, at) in enumerate(_terms(words)):
                of, inside = _text_of(words, at, 1 if kind == 0 else GRAMS[kind - 1])
                h, of = h[inside], of[inside]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
                h, y = h[new], toxic[i:j][of[new]]
                for k in (0, 1):
                    held[int(kind == 0), k].append(np.unique(h[y == k], return_counts=True))
        if sum(len(p[0]) for parts in held.values() for p in parts) > 2_000_000:
            merged()
    merged()
    for (word, y), parts in held.items():
        for term, n in parts:
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.full(len(term), word)), pa.array(np.full(len(term), y)), pa.array(n.astype(np.int64))], names=["term", "word", "toxic", "n"])


def choose_terms(examples: DataFrame, n: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words within WORD_SHARES, and of the terms whose log-likelihood ratio against the label is beyond what chance gives among
    all candidates; and which these are. As many as EXAMPLES texts have; each word has n * WORD_SHARES[0] of them at least."""
    told = examples.select("toxic", "text").mapInArrow(_tell, "term long, word long, toxic long, n long")
    both = told.groupBy("term").agg(F.max("word").alias("word"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("all"))
    a, m = F.col("a").cast("double"), F.col("all").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    b, c, d = m - a, F.lit(float(n_toxic)) - a, F.lit(float(n - n_toxic)) - (m - a)
    p = n_toxic / n
    ratio = 2 * (part(a, m * p) + part(b, m * (1 - p)) + part(c, (n - m) * p) + part(d, (n - m) * (1 - p)))
    least, most = WORD_SHARES
    ordinary = (F.col("word") == 1) & (m >= max(2, n * least)) & (m <= max(2, n * most))
    tells = (a >= 3) & (a > m * max(p, LEAST_SHARE)) & (ratio > float(2 * np.log(max(2, n)) + 20))
    found = sorted((r["term"], r["tells"]) for r in both.where(ordinary | tells).select("term", tells.alias("tells")).collect())
    return np.array([t for t, _ in found], np.int64).view(np.uint64), np.array([x for _, x in found], bool)


@dataclass
class Model:
    terms: np.ndarray
    idf: np.ndarray
    prior: float
    index: Index | None = None
    slope: float = 1.0
    shift: float = 0.0
    cache: dict = field(default_factory=dict)

    def vectors(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit vectors as (terms, weights); the term after the last kept one is that of every text."""
        text, term, count = count_terms(texts, Lookup(self.terms))
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        every, out = len(self.terms), []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            t = np.append(term[a:b], every)
            w = np.append((1 + np.log(count[a:b])) * self.idf[term[a:b]], 1.0)
            out.append((t, w / np.sqrt(w @ w)))
        return out

    def score(self, texts: list[bytes | None]) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids and cosines of the nearest examples) of each text."""
        out = []
        for t, w in self.vectors(texts):
            key = (t.tobytes(), np.round(w, 9).tobytes())
            if key not in self.cache:
                if len(self.cache) > 5_000:
                    self.cache.clear()
                self.cache[key] = self._score(t, w)
            out.append(self.cache[key])
        return out

    def _score(self, t: np.ndarray, w: np.ndarray) -> tuple[float, list[int], list[float]]:
        if self.index is None:
            return self.prior, [], []
        who, cos = self.index.nearest(t, w, NEAREST)
        z = self.slope * _logit(self.index.vote(who, cos, self.prior)) + self.shift
        return float(1 / (1 + np.exp(-z))), self.index.ids[who[:3]].tolist(), np.round(cos[:3], 6).tolist()


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return float(np.log(p / (1 - p)))


class Index:
    """Distinct example vectors in an inverted index with block maxima."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], ids: list[int], n_terms: int):
        by: dict[tuple[bytes, bytes], list[int]] = {}
        for k, (t, w) in enumerate(vectors):
            by.setdefault((t.tobytes(), np.round(w, 9).tobytes()), []).append(k)
        # vectors with the same heaviest terms stand together, which makes the block maxima tight
        first = {key: own[0] for key, own in by.items()}
        heaviest = lambda key: vectors[first[key]][0][np.argsort(-vectors[first[key]][1], kind="stable")].astype(">i8").tobytes()
        keys = sorted(by, key=heaviest)
        self.n = np.array([len(by[k]) for k in keys])
        self.toxic = np.array([sum(toxic[i] for i in by[k]) for k in keys])
        self.ids = np.array([min(ids[i] for i in by[k]) for k in keys])
        self.of = {i: g for g, k in enumerate(keys) for i in by[k]}
        keys = [vectors[first[k]] for k in keys]
        self.n_blocks = -(-len(keys) // BLOCK)
        term = np.concatenate([t for t, _ in keys])
        row = np.repeat(np.arange(len(keys)), [len(k[0]) for k in keys])
        weight = np.concatenate([w for _, w in keys])
        order = np.lexsort((row, term))
        self.row, self.weight = row[order].astype(np.int32), weight[order]
        # the postings of a term in a block are a cell; only those that are there are kept, with their largest weight
        place = term[order] * self.n_blocks + self.row // BLOCK
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.block = (place[first] % self.n_blocks).astype(np.int32)
        self.most = np.nextafter(np.maximum.reduceat(self.weight, first).astype(np.float32), np.float32(2))  # never below
        self.start = np.append(first, len(place)).astype(np.int32)
        self.cells = np.searchsorted(place[first] // self.n_blocks, np.arange(n_terms + 1)).astype(np.int32)

    def _cells_of(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of terms, and of which term (its place in t) each is."""
        lo, many = self.cells[t], self.cells[t + 1] - self.cells[t]
        return np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum())), np.repeat(np.arange(len(t)), many)

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest cosine, ties by row, and the cosines. Exact."""
        cell, of = self._cells_of(t)
        bound = np.bincount(self.block[cell], weights=w[of] * self.most[cell], minlength=self.n_blocks) + 1e-6
        order = np.argsort(-bound, kind="stable")
        who, cos = self._best(order[:FEW], cell, w[of], k)
        left = order[FEW:]
        if len(cos) >= k:
            left = left[bound[left] >= cos[k - 1]]
        if len(left):
            more, more_cos = self._best(left, cell, w[of], k)
            who, cos = np.concatenate((who, more)), np.concatenate((cos, more_cos))
            best = np.lexsort((who, -cos))[:k]
            who, cos = who[best], cos[best]
        return who, cos

    def _best(self, blocks: np.ndarray, cell: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of some blocks; cell, weight: the cells of a query's terms, and the terms' weights."""
        rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rows = rows[rows < len(self.n)]
        opened = np.zeros(self.n_blocks, bool)
        opened[blocks] = True
        some = opened[self.block[cell]]
        cell, weight = cell[some], weight[some]
        lo, many = self.start[cell], self.start[cell + 1] - self.start[cell]
        spot = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        got = np.bincount(self.row[spot], weights=np.repeat(weight, many) * self.weight[spot], minlength=len(self.n))[rows]
        if len(got) > k:  # only what is among the best, ties included
            some = got >= np.partition(got, -k)[-k]
            rows, got = rows[some], got[some]
        best = np.lexsort((rows, -got))[:k]
        return rows[best], got[best]

    def vote(self, who: np.ndarray, cos: np.ndarray, prior: float, less: tuple[int, int] | None = None) -> float:
        """The weighted share of toxic examples; less: (row, label) of an example that doesn't count."""
        n, y = self.n[who].astype(float), self.toxic[who].astype(float)
        if less is not None:
            n[who == less[0]] -= 1
            y[who == less[0]] -= less[1]
        some = np.flatnonzero(n > 0)[:NEAREST]
        n, y, cos = n[some], y[some], cos[some]
        weight = (1 + np.log(n)) * np.exp((cos - cos.max(initial=-1)) / FADE)
        return float((weight @ (y / n) + PRIOR_WEIGHT * prior) / (weight.sum() + PRIOR_WEIGHT))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's steps, held near (1, 0) by two pseudo-observations."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((p - y) * x).sum() + 2 * (a - 1), (p - y).sum() + 2 * b])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 2, (v * x).sum()], [(v * x).sum(), v.sum() + 2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.05), float(b)


def _frequencies(terms: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total, n = Lookup(terms), np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            texts = text_bytes(batch.column(0))
            total += np.bincount(count_terms(texts, lookup)[1], minlength=len(total))
            n += len(texts)
        total[-1] = n  # texts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["term", "n"])

    return count


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs (doc_id, text); labels (doc_id, toxic): the rows that may teach."""
    taught = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    examples = checkpoint(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))  # EXAMPLES rows at most
    sizes = examples.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of EXAMPLES numbers
    examples = examples.join(F.broadcast(sizes.withColumn("so_far", so_far).where(F.col("so_far") <= EXAMPLE_BYTES).select("doc_id")), "doc_id", "left_semi")
    n, n_toxic = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (n_toxic + 1) / (n + 20)
    terms, tells = choose_terms(examples, n, n_toxic) if n_toxic else (np.zeros(0, np.uint64), np.zeros(0, bool))
    counts = dict(docs.select("text").mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row a term
    n_docs = counts.pop(len(terms), 0)
    idf = np.array([np.log((1 + n_docs) / (1 + counts.get(k, 0))) + 1 for k in range(len(terms))])
    model = Model(terms, idf * np.where(tells, TELLING, 1.0), prior)
    rows = examples.select("doc_id", "toxic", "text").mapInArrow(_vectors(model), "doc_id long, toxic long, terms array<long>, weights array<double>").toArrow()  # EXAMPLES rows
    if not rows.num_rows:
        return model
    rows = rows.sort_by("doc_id").combine_chunks()
    cut = np.concatenate(([0], np.cumsum(pc.list_value_length(rows["terms"]).to_numpy())))
    terms_of, weights_of = (pc.list_flatten(rows[c]).to_numpy() for c in ("terms", "weights"))
    vectors = [(terms_of[i:j], weights_of[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    toxic = rows["toxic"].to_pylist()
    index = Index(vectors, toxic, rows["doc_id"].to_pylist(), len(terms) + 1)
    votes = [_logit(index.vote(*index.nearest(*v, NEAREST + 1), prior, (index.of[k], toxic[k]))) for k, v in enumerate(vectors)]
    model.slope, model.shift = _calibrate(np.array(votes), np.array(toxic, float))
    model.index = index
    del rows, vectors, terms_of, weights_of
    release(docs.sparkSession)
    return model


def _vectors(model: Model):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = model.vectors(text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in v], pa.list_(pa.int64())), pa.array([w for _, w in v], pa.list_(pa.float64()))], names=["doc_id", "toxic", "terms", "weights"])

    return make


_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, nearest_ids array<long>, nearest_cosines array<double>"


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(text_bytes(batch.column(2)))
            scores = np.array([s for s, _, _ in got], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([i for _, i, _ in got], pa.list_(pa.int64())), pa.array([c for _, _, c in got], pa.list_(pa.float64()))],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )

    return score


def teaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, teaching(spark, sf_dir))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scorer(model), _SCHEMA)


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, as they are."""
    model = fit(docs.select("doc_id", "text"), labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s, _, _ in model.score(text_bytes(batch.column(at)))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

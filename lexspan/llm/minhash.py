"""Near-duplicate documents: MinHash signatures and an inverted join of their coordinates.

A document's set of word shingles has COORDINATES minima, each under an order of its own; two sets have the same minimum at a coordinate with
the probability of their Jaccard similarity. Sets are posted under each (coordinate, value). At the threshold of 0.85, fewer than MATCHES of
the 64 coordinates agree for one pair in 400,000, so sets that agree in fewer are no candidates. That leaves short merges:

* prefixes: a set's postings ascend by how many sets share them (all alike, so one order for all). Of two sets with MATCHES common postings the
  first common one is among the first COORDINATES - MATCHES + 1 of both. Postings of one set come first, so a set that has more than that of
  its own is no candidate of any;
* skips: lists of one component are never merged, and in the others a set is only compared with those of other components, the
  largest component's sets not among each other. Collisions are counted on a byte of each value (which can only add some), by blocks of coordinates, and
  sets that can't reach MATCHES any more are skipped. Lists beyond TILE sets are dealt in parts.

Pairs above MATCHES are held against parity sketches, whose Hamming distance bounds how many shingles two sets differ in, and what stays is verified on the whole sets. First each set with the one centre it shares most lists with, then the nearest of other components, then
all the rest. Exact copies of a set are one node throughout.

Defined results: null or wordless texts have no shingles, link with nothing and are their own component; a null doc_id
links with nothing, has a null component and is kept; repeated rows give repeated rows; an empty table gives an empty result;
further columns of the input are ignored. Texts are read whole, twice; memory follows the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .ngram_join import DEALT, GROUP, SEND, _dense, _fold, _set_hash, count_pairs, dealt_pairs, most_apart, stars_of, verify
from .shared import Words, checkpoint, chunks, fresh_dir, mix, n_parts, remove_dir, shingles, small_batches, swept, table, text_bytes

WIDTH, P, Q = 3, 85, 100
COORDINATES, MATCHES = 64, 40
#: Coordinates counted between two looks at which sets can still reach MATCHES; probes of a long list, and pairs of short ones compared at a time.
STRIDE, PROBES, POOLED = 16, 256, 20_000
#: Sets of a list that one task holds while others pass by (some 300 bytes each).
TILE = 16_384

_ORDERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n rows of COORDINATES values; keys: shingles of the sets, of: the set of each, ascending. The rows of empty sets are zeros."""
    out = np.zeros((n, COORDINATES), np.uint64)
    if len(keys):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for c, a in enumerate(_ORDERS):
            out[of[first], c] = mix(np.minimum.reduceat(keys * a, first) ^ mix(a[None])[0])
    return out


_PROFILE = "doc_id long, n long, h long, signature binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the size, hash and signature of each set."""
    for batch in batches:
        ids, texts = batch.column(0), text_bytes(batch.column(1))
        for i, j in chunks(texts):
            n = j - i
            keys, of = shingles(Words(texts[i:j], lower=True), WIDTH)
            size = np.bincount(of, minlength=n)
            rows = [r.tobytes() if k else None for r, k in zip(signatures(keys, of, n), size.tolist(), strict=True)]
            arrays = [ids.slice(i, n), pa.array(size), pa.array(_set_hash(keys, of, n).view(np.int64)), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PROFILE.split(", ")])


def _dealer(n_groups: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, signature), each h once, to packed (posting, set) pairs."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held, turn = 0, 0

        def flush():
            nonlocal n_held, turn
            keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            n_held, turn = 0, turn + 1
            return dealt_pairs(keys, ids, n_groups, turn)

        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
                held.append((keys, np.repeat(batch.column(0).to_numpy().view(np.uint64), COORDINATES)))
                n_held += len(keys)
                if n_held > 1_000_000:
                    yield flush()
        if held:
            yield flush()

    return deal


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures to a byte of each value, which collisions are counted on."""
    for batch in batches:
        rows = [np.frombuffer(x, np.uint64).astype(np.uint8).tobytes() for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], names=["h", "n", "posts", "low"])


def candidates(classes: DataFrame) -> DataFrame:
    """classes (h, n, signature), each h once: (h, n, posts, low) of the sets with MATCHES postings that other sets have too, rarest postings first."""
    groups = max(1, -(-classes.count() * COORDINATES // GROUP))
    parts = max(n_parts(classes.sparkSession), 2 * groups)
    dealt = classes.select("h", "signature").mapInArrow(_dealer(groups), DEALT)
    held = dealt.repartition(parts, "g").groupBy("g").applyInArrow(count_pairs, "key long, id long, held long")
    posts = F.sort_array(F.collect_list(F.struct("held", "key")))  # COORDINATES at most
    several = held.groupBy(F.col("id").alias("h")).agg(posts.alias("posts")).where(F.size("posts") >= MATCHES)
    keys = F.transform("posts", lambda p: p["key"])
    return several.join(classes, "h").select("h", "n", keys.alias("posts"), "signature").mapInArrow(_low, "h long, n long, posts array<long>, low binary")


def first_common() -> Column:
    """How many of a set's posts, which come after its own ones, may be the first common one of a link."""
    return F.size("posts") - MATCHES + 1


_SETS = "h long, n long, shingles binary, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, h) to the sets whose hash is h: sorted shingle hashes and a parity sketch."""
    for batch in batches:
        texts, wanted = text_bytes(batch.column(0)), batch.column(1).to_numpy()
        for i, j in chunks(texts):
            keys, of = shingles(Words(texts[i:j], lower=True), WIDTH)
            cut = np.searchsorted(of, np.arange(j - i + 1))
            h = _set_hash(keys, of, j - i).view(np.int64)
            some = np.flatnonzero((h == wanted[i:j]) & (np.diff(cut) > 0)).tolist()
            own = [keys[cut[x] : cut[x + 1]] for x in some]
            arrays = [pa.array(h[some]), pa.array(np.diff(cut)[some]), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([_dense(x).tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _SETS.split(", ")])


def _written_sets(docs: DataFrame, near: DataFrame, classes: DataFrame) -> str:
    """Where the whole sets of near are written, in the shared folder."""
    wanted = checkpoint(near.select("h").join(classes, "h").select("doc_id", "h"))
    few = wanted.count() <= SEND  # a proven bound before anything is sent to all
    path = fresh_dir(docs.sparkSession, "sets")
    found = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "h").mapInArrow(_sets, _SETS)
    found.dropDuplicates(["h"]).write.parquet(path)  # repeated rows have the same id
    return path


def _best(near: DataFrame) -> DataFrame:
    """(a, b): each set b with the centre a that it shares most lists with, of those whose size allows a link."""
    stars = stars_of(near.select(F.explode(F.slice("posts", 1, first_common())).alias("key"), "h", "n"))
    sized = stars.where((F.col("h") != F.col("a")) & (F.col("na") * Q >= F.col("n") * P) & (F.col("n") * Q >= F.col("na") * P))
    shared = sized.groupBy("a", F.col("h").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    return shared.groupBy("b").agg(F.max_by("a", F.struct("lists", "a")).alias("a")).select("a", "b")


def _mixed(lists: DataFrame) -> DataFrame:
    """lists (key, root, ...): (key, m, main) of those of several components: how many sets, and the largest component."""
    by_root = lists.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"))
    sums = by_root.groupBy("key").agg(F.sum("held").alias("m"), F.max_by("root", F.struct("held", "root")).alias("main"), F.max("held").alias("top"))
    return sums.where("m > top").select("key", "m", "main")


class _Rows:
    """Rows (h, root, n, low, sketch) as columns."""

    def __init__(self, rows: list[list]):
        self.h, self.root, self.n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.low = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        self.sketch = [r[4] for r in rows]
        self.width = np.array([len(x) // 8 for x in self.sketch])


def _near_enough(a: _Rows, x: np.ndarray, b: _Rows, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows x of a and y of b may differ in as few shingles as their sketches say."""
    out = np.zeros(len(x), bool)
    code = a.width[x].astype(np.int64) << 32 | b.width[y]
    for v in np.unique(code).tolist():
        at = np.flatnonzero(code == v)
        wide = (v >> 32, v & 0xFFFFFFFF)
        for part in np.array_split(at, max(1, len(at) * min(wide) >> 20)):
            left, right = (_fold(np.frombuffer(b"".join(r.sketch[k] for k in z[part].tolist()), np.uint64).reshape(len(part), -1), min(wide)) for r, z in ((a, x), (b, y)))
            out[part] = np.bitwise_count(left ^ right).sum(axis=1) <= most_apart(a.n[x[part]], b.n[y[part]], P, Q)
    return out


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (Q * a >= P * b) & (Q * b >= P * a)


class _Pool:
    """Pairs of rows of many short lists, to be compared together."""

    def __init__(self):
        self.rows: list[list] = []
        self.x: list[np.ndarray] = []
        self.y: list[np.ndarray] = []
        self.pairs = 0

    def add(self, base: list, probes: list) -> None:
        at = len(self.rows)
        self.rows += base + probes
        self.x.append(np.repeat(np.arange(len(probes)) + at + len(base), len(base)))
        self.y.append(np.tile(np.arange(len(base)) + at, len(probes)))
        self.pairs += len(base) * len(probes)

    def met(self, nearest: bool) -> np.ndarray:
        if not self.pairs:
            return np.zeros((0, 2), np.int64)
        r, x, y = _Rows(self.rows), np.concatenate(self.x), np.concatenate(self.y)
        self.__init__()
        fits = (r.root[x] != r.root[y]) & _sizes_fit(r.n[x], r.n[y])
        x, y = x[fits], y[fits]
        for at in range(0, COORDINATES, STRIDE):  # those that can't reach MATCHES any more are skipped
            count = (r.low[x, : at + STRIDE] == r.low[y, : at + STRIDE]).sum(axis=1)
            live = count >= MATCHES - (COORDINATES - at - STRIDE)
            x, y, count = x[live], y[live], count[live]
        fits = _near_enough(r, x, r, y)
        x, y, count = x[fits], y[fits], count[fits]
        if nearest:
            order = np.lexsort((-count, x))
            order = order[np.r_[True, x[order][1:] != x[order][:-1]][: len(order)]]
            x, y = x[order], y[order]
        return _sorted_pairs(r.h[x], r.h[y])


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.sort(np.stack((a, b), axis=1), axis=1), axis=0)


def _collisions(base: _Rows, probes: _Rows, nearest: bool) -> np.ndarray:
    """The pairs of a long list's probes and base, a coordinate at a time."""
    low = base.low.T.copy()
    fits = (base.root != probes.root[:, None]) & _sizes_fit(base.n, probes.n[:, None])
    count = np.zeros(fits.shape, np.uint8)
    live = np.flatnonzero(fits.any(axis=1))
    for at in range(0, COORDINATES, STRIDE):
        part = np.zeros((len(live), len(base.h)), np.uint8)
        for c in range(at, at + STRIDE):
            part += probes.low[live, c][:, None] == low[c]
        count[live] += part
        live = live[((count[live] >= MATCHES - (COORDINATES - at - STRIDE)) & fits[live]).any(axis=1)]
    x, y = np.nonzero(fits & (count >= MATCHES))
    some = _near_enough(probes, x, base, y)
    x, y = x[some], y[some]
    if nearest:
        order = np.lexsort((-count[x, y].astype(np.int64), x))
        order = order[np.r_[True, x[order][1:] != x[order][:-1]][: len(order)]]
        x, y = x[order], y[order]
    return _sorted_pairs(probes.h[x], base.h[y])


def _merger(nearest: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, part, probe, h, root, n, low, sketch), sorted by the first three: of each part the pairs (a, b) of a probe and another set with MATCHES
        collisions, sizes and sketches that allow a link and different roots; with nearest only the best of each probe."""
        of, base, probes, pool = None, [], [], _Pool()
        held: list[_Rows] = []  # the base as columns, once a part
        found: list[np.ndarray] = []

        def merged():
            nonlocal probes
            if len(base) * len(probes) > POOLED:
                held[:] = held or [_Rows(base)]
                found.append(_collisions(held[0], _Rows(probes), nearest))
            elif base and probes:
                pool.add(base, probes)
                if pool.pairs > POOLED:
                    found.append(pool.met(nearest))
            probes = []

        def out():
            pairs = np.unique(np.concatenate(found or [np.zeros((0, 2), np.int64)]), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, part, probe, *row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (key, part) != of or len(probes) >= PROBES:
                    merged()
                if (key, part) != of:
                    of, base = (key, part), []
                    held.clear()
                (probes if probe else base).append(row)
            yield out()
        merged()
        found.append(pool.met(nearest))
        yield out()

    return merge


def _further(near: DataFrame, found: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """The pairs (a, b) of sets of different components that share a list and MATCHES postings, as far as sketches allow a link."""
    rooted = near.join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    lists = rooted.select("h", "root", F.explode(F.slice("posts", 1, first_common())).alias("key"))
    members = lists.join(checkpoint(_mixed(lists)), "key")
    parts = F.ceil(F.col("m") / TILE)
    base = F.array(F.struct(F.pmod(F.xxhash64("h"), parts).alias("part"), F.lit(0).alias("probe")))
    probes = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.struct(k.alias("part"), F.lit(1).alias("probe")))
    dealt = members.select("key", "h", "root", F.inline(F.when(F.col("root") == F.col("main"), base).otherwise(F.concat(base, probes))))
    rows = dealt.join(near.select("h", "n", "low").join(sets.select("h", "sketch"), "h"), "h").select("key", "part", "probe", "h", "root", "n", "low", "sketch")
    together = rows.repartition(n_parts(near.sparkSession), "key", "part").sortWithinPartitions("key", "part", "probe")
    return together.mapInArrow(_merger(nearest), "a long, b long").distinct()


def _named(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """docs (doc_id, text) and the profiles of those that may link: (h, component_id) for each set."""
    spark = docs.sparkSession
    classes = checkpoint(linked.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    near = checkpoint(candidates(classes))
    path = _written_sets(docs, near, classes)
    sets = spark.read.parquet(path)
    links = checkpoint(verify(checkpoint(_best(near)), sets, P, Q))
    found = checkpoint(components(links))
    for nearest in (True, False):  # first what is nearest, so that most links are known before all pairs of components are named
        further = checkpoint(_further(near, found, sets, nearest))
        more = checkpoint(verify(further, sets, P, Q)) if not further.isEmpty() else further
        if not more.isEmpty():
            links = checkpoint(links.union(more))
            found = checkpoint(components(links))
    remove_dir(spark, path)
    roots = found.join(classes.select(F.col("h").alias("node"), "doc_id"), "node")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = roots.select("node", "root").join(least, "root").select(F.col("node").alias("h"), "component_id")
    return classes.select("h", "doc_id").join(joined, "h", "left").select("h", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text: (doc_id, n_shingles, component_id, kept) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    with swept(spark):
        prof = checkpoint(docs.mapInArrow(_profile, _PROFILE))
        named = checkpoint(_named(docs, prof.where("n > 0 and doc_id is not null")))
    out = prof.where("n > 0 and doc_id is not null").select("doc_id", "n", "h").join(named, "h").select("doc_id", "n", "component_id")
    rest = prof.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.union(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Near-duplicate documents: Jaccard similarity join of word-shingle sets by parity sketches.

A document's shingles are dealt to the blocks of a bit sketch, and each block keeps the XOR of its shingles' hashes: a
sparse parity sketch. A shingle that only one of two sets holds changes one block, so the number of blocks that differ is a
lower bound of the symmetric difference. At the threshold p/q two sets of sizes a and b may differ in
(q - p)(a + b)/(q + p) shingles at most, so at least B minus that many of the B blocks agree. Of all orders of the blocks
that depend on a block's content alone, any makes the first (difference + 1) blocks of both sets share one (the prefix
principle); we take blocks that few sets have first, counted over all sets. A set with more blocks of its own alone than it may
differ in links with nothing, and that is most sets. Sizes go in bands of a factor two, each with a number of blocks of its own; a set that may
match smaller ones of the band below appears in both.

Sets that share a block of their prefixes are first joined as stars: each set with the centre it shares most blocks with. Verified
links join sets to components. Blocks whose sets are still in different components are then compared in tiles of bounded size, by
dense parity sketches whose Hamming distance bounds the difference too, and only what these allow is verified: first the nearest of each set,
then, with the components that gives, all the rest. No row is made for a pair before that. Exact copies of a set are one node throughout. Links are decided on the whole sets of shingle hashes.

Defined results: null or wordless texts have no shingles, link with nothing and are their own component; a null doc_id
links with nothing and has a null component; repeated rows give repeated rows; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Words, checkpoint, chunks, fresh_dir, mix, release, remove_dir, shingles, small_batches, swept, table, text_bytes

WIDTH, P, Q = 5, 80, 100
#: Pairs of key and set for one group of the block count; the number of groups follows the input.
GROUP = 500_000
#: Blocks that so many sets have count as equally common, so a task that sees so many need not ask the others.
COMMON = 64
#: Sets of a block that are compared in one tile, and pairs of them in memory at a time.
TILE, PAIRS = 2048, 1 << 20
#: Members of a star that are compared with one copy of its centre.
ARM = 64
#: Up to so many ids are sent to all executors (16 bytes each); more are joined by a shuffle.
SEND = 200_000
#: Blocks for each block of the prefix, and the least bits of a dense sketch.
SPARE, BITS = 1.5, 1024


def most_apart(a, b, p: int = P, q: int = Q):
    """The largest symmetric difference that sets of sizes a and b may have."""
    return (q - p) * (a + b) // (q + p)


_EVEN = np.uint64((1 << 64) - 2)


def _set_hash(keys: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """An even hash of each text's set, 0 for none; the odd number after it stands for the set in the band below."""
    out = np.zeros(n, np.uint64)
    if len(keys):
        first = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]])
        sums = np.add.reduceat(mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
        out[texts[first]] = mix(sums + mix(np.diff(np.r_[first, len(keys)]).astype(np.uint64))) & _EVEN | np.uint64(2)
    return out


class Bands:
    """The bands that sets of shingles play in: their own, and the one below for those that may match smaller sets there."""

    def __init__(self, size: np.ndarray, p: int = P, q: int = Q):
        some = np.flatnonzero(size)
        band = np.floor(np.log2(size[some])).astype(np.int64)
        low = (np.int64(1) << band) - 1  # the largest size of the band below
        under = (-(-size[some] * p // q) <= low) & (low > 0)
        below = some[under]
        self.sets = np.concatenate((some, below))
        self.is_below = np.arange(len(self.sets)) >= len(some)
        self.band = np.concatenate((band, band[under] - 1))
        #: Of a set's blocks so many are its prefix: one more than it may differ in from any set of the band.
        self.length = np.concatenate((most_apart(size[some], size[some] * q // p, p, q), most_apart(low[under], size[below], p, q))) + 1
        top = (np.int64(2) << self.band) - 1
        self.blocks = np.maximum(np.ceil(SPARE * (most_apart(top, top * q // p, p, q) + 1)).astype(np.int64), self.length)


def _filled(keys: np.ndarray, of: np.ndarray, n: int, p: int = P, q: int = Q):
    """The bands of n sets (sorted shingles, the set of each); each shingle and its place among the bands' sets; where each filled block begins."""
    size = np.bincount(of, minlength=n)
    bands = Bands(size, p, q)
    first = np.searchsorted(of, np.arange(n + 1))
    many = size[bands.sets]
    owner = np.repeat(np.arange(len(many)), many)
    # the shingles of each (set, band), still sorted, so that a block's shingles stand together
    t = keys[np.repeat(first[bands.sets] - (np.cumsum(many) - many), many) + np.arange(len(owner))]
    block = ((t >> np.uint64(32)) * bands.blocks[owner].astype(np.uint64)) >> np.uint64(32)
    new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]) if len(t) else np.zeros(0, np.int64)
    return bands, t, block, owner, new


def block_keys(keys: np.ndarray, of: np.ndarray, n: int, p: int = P, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key for each filled block of n sets, the set of each, and whether it is of the band below."""
    bands, t, block, owner, new = _filled(keys, of, n, p, q)
    if not len(t):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    xor = np.bitwise_xor.reduceat(mix(t ^ np.uint64(0x3C6EF372FE94F82B)), new)
    count, who = np.diff(np.r_[new, len(t)]), owner[new]
    out = mix(xor + mix(block[new] * np.uint64(64) + bands.band[who].astype(np.uint64)) + mix(count.astype(np.uint64)))
    # A set whose filled blocks are fewer than its prefix would go on with empty blocks, which many share. Two sets that agree
    # in an empty block only are both of this kind, so among these the least shingles (a plain prefix) stand for empty blocks.
    bare = np.flatnonzero(np.bincount(who, minlength=len(bands.sets)) < bands.length)
    begin, size = np.searchsorted(owner, bare), np.bincount(owner, minlength=len(bands.sets))
    for x, i in zip(bare.tolist(), begin.tolist(), strict=True):
        own = t[i : i + int(size[x]) - (-(-int(size[x]) * p // q)) + 1]
        out = np.concatenate((out, mix(own + np.uint64(0x9E6D))))
        who = np.concatenate((who, np.full(len(own), x)))
    return out, bands.sets[who], bands.is_below[who]


_PROFILE = "doc_id long, n long, h long, room long, room_below long"


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the size and a hash of each set, and its prefix less its filled blocks in both bands (null for a band it isn't in)."""
    for batch in batches:
        ids, texts = batch.column(0), text_bytes(batch.column(1))
        for i, j in chunks(texts):
            n = j - i
            keys, of = shingles(Words(texts[i:j], lower=True), WIDTH)
            bands, _, _, owner, new = _filled(keys, of, n)
            room = bands.length - np.bincount(owner[new], minlength=len(bands.sets))
            rooms = []
            for side in (False, True):
                held, mine = np.zeros(n, np.int64), bands.is_below == side
                held[bands.sets[mine]] = room[mine]
                none = np.ones(n, bool)
                none[bands.sets[mine]] = False
                rooms.append(pa.array(held, mask=none))
            yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(np.bincount(of, minlength=n)), pa.array(_set_hash(keys, of, n).view(np.int64)), *rooms], names=[c.split()[0] for c in _PROFILE.split(", ")])


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, sorted by key, and how many pairs the key of each has."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])] if len(keys) else np.zeros(0, bool)
    keys, ids = keys[new], ids[new]
    count = np.diff(np.r_[_groups(keys), len(keys)])
    return keys, ids, np.repeat(count, count)


def dealt_pairs(keys: np.ndarray, ids: np.ndarray, n_groups: int, turn: int) -> pa.RecordBatch:
    """(key, set) pairs, packed: for the group of the key those that are rare here, with the common keys named (kind 1);
    the pairs of common keys go to any group (kind 2), from turn on."""
    keys, ids, count = _distinct(keys, ids)
    common = count >= COMMON
    rows = []
    named = keys[common]
    for kind, k, v in ((0, keys[~common], ids[~common]), (1, named[_groups(named)], None)):
        to = (k % np.uint64(n_groups)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        k, v = k[order], None if v is None else v[order]
        cut = np.searchsorted(to[order], np.arange(n_groups + 1)).tolist()
        rows += [(g, kind, k[a:b].tobytes(), None if v is None else v[a:b].tobytes()) for g, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
    for a in range(0, len(named), 100_000):
        turn += 1
        rows.append(((int(named[a] >> np.uint64(40)) + turn) % n_groups, 2, named[a : a + 100_000].tobytes(), ids[common][a : a + 100_000].tobytes()))
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["g", "kind", "keys", "ids"])


DEALT = "g long, kind int, keys binary, ids binary"


def _dealer(n_groups: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to packed (key, set) pairs of the sets' blocks."""
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held, turn = 0, 0

        def flush():
            nonlocal n_held, turn
            keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            turn += -(-n_held // 100_000)
            n_held = 0
            return dealt_pairs(keys, ids, n_groups, turn)

        for batch in batches:
            texts = text_bytes(batch.column(0))
            for i, j in chunks(texts):
                keys, of = shingles(Words(texts[i:j], lower=True), WIDTH)
                h = _set_hash(keys, of, j - i)
                fresh = np.zeros(j - i, bool)
                for x, v in enumerate(h.tolist()):
                    if v and v not in seen:
                        seen.add(v)
                        fresh[x] = True
                pick = fresh[of]
                out, owner, below = block_keys(keys[pick], of[pick], j - i)
                held.append((out, h[owner] + below.astype(np.uint64)))
                n_held += len(out)
                if n_held > 1_000_000:
                    yield flush()
                    seen.clear()
        if n_held:
            yield flush()

    return deal


def count_pairs(group: pa.Table) -> pa.Table:
    """The packed pairs of one group to (key, id, held): the pairs whose key two sets have at least, and how many have it, COMMON at most."""
    kind = group.column("kind").to_numpy()

    def get(name: str, k: int) -> np.ndarray:
        return np.frombuffer(b"".join(x for x, y in zip(group.column(name).to_pylist(), kind, strict=True) if y == k), np.uint64)

    keys, ids, count = _distinct(get("keys", 0), get("ids", 0))
    named = np.isin(keys, get("keys", 1))
    count = np.where(named, COMMON, np.minimum(count, COMMON))
    some = count > 1
    far = get("keys", 2)
    columns = [np.concatenate((keys[some], far)).view(np.int64), np.concatenate((ids[some], get("ids", 2))).view(np.int64), np.concatenate((count[some], np.full(len(far), COMMON)))]
    return pa.table(dict(zip(("key", "id", "held"), columns, strict=True)))


_SETS = "h long, n long, shingles binary, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, h) to the sets whose hash is h: sorted shingle hashes, and a dense parity sketch of at least BITS bits and twice as many as shingles."""
    for batch in batches:
        texts, wanted = text_bytes(batch.column(0)), batch.column(1).to_numpy()
        for i, j in chunks(texts):
            keys, of = shingles(Words(texts[i:j], lower=True), WIDTH)
            h = _set_hash(keys, of, j - i).view(np.int64)
            cut = np.searchsorted(of, np.arange(j - i + 1))
            rows = []
            for x in np.flatnonzero((h == wanted[i:j]) & (np.diff(cut) > 0)).tolist():
                own = keys[cut[x] : cut[x + 1]]
                rows.append((int(h[x]), len(own), own.tobytes(), _dense(own).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in _SETS.split(", ")])


def _dense(keys: np.ndarray) -> np.ndarray:
    bits = max(BITS, 2 << len(keys).bit_length())
    odd = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _rows_of(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as those of width words: parities of places that are equal modulo the smaller size."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _tiler(nearest: bool):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, i, j, side, h, root, n, sketch), the rows of a tile together, to the pairs (a, b) of its sets that sizes and sketches allow to link, of
        different components; with nearest only the pair with the least distance of each set. Of a tile with two sides a pair has one set of each."""
        held: list[tuple] = []
        for batch in batches:
            for key, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if len(held) > 2 * TILE and held[-1][0] != (key, i, j):
                    yield _allowed(held, nearest)
                    held = []
                held.append(((key, i, j), int(i == j), *row))
        if held:
            yield _allowed(held, nearest)

    return tiles


def _allowed(rows: list[tuple], nearest: bool) -> pa.RecordBatch:
    """The pairs of rows (tile, whether it has one side, side, h, root, n, sketch), of the same tile, as _tiler says."""
    rows.sort(key=lambda r: (r[0], r[5]))  # by tile and size
    tile = np.cumsum([0] + [x[0] != y[0] for x, y in zip(rows, rows[1:], strict=False)])
    one, side, h, root, n = (np.array([r[k] for r in rows], np.int64) for k in range(1, 6))
    words = np.array([len(r[6]) // 8 for r in rows])
    place, matrix = np.zeros(len(rows), np.int64), {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        place[at] = np.arange(len(at))
        matrix[w] = np.frombuffer(b"".join(rows[x][6] for x in at.tolist()), np.uint64).reshape(len(at), w)
    scale = np.int64(1) << 32
    last = np.searchsorted(tile * scale + np.minimum(n, scale - 1), tile * scale + np.minimum(n * Q // P, scale - 1), "right")
    after = last - np.arange(len(rows)) - 1
    total = np.cumsum(after)
    found = []
    least, partner = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), -1)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        k = after[at:to]
        x = np.repeat(np.arange(at, to), k)
        y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + x + 1
        ok = (root[x] != root[y]) & ((one[x] == 1) | (side[x] != side[y]))
        x, y = x[ok], y[ok]
        code = words[x] << 32 | words[y]
        for v in np.unique(code).tolist():
            own = np.flatnonzero(code == v)
            w = (v >> 32, v & 0xFFFFFFFF)
            width = min(w)
            left, right = (_fold(matrix[k], width) for k in w)
            step = max(1, PAIRS // width)
            for c in range(0, len(own), step):
                part = own[c : c + step]
                flips = np.bitwise_count(left[place[x[part]]] ^ right[place[y[part]]]).sum(axis=1).astype(np.int64)
                good = flips <= most_apart(n[x[part]], n[y[part]])
                u, v2, flips = x[part[good]], y[part[good]], flips[good]
                if not nearest:
                    found.append(np.stack((u, v2)))
                    continue
                u, v2, flips = np.concatenate((u, v2)), np.concatenate((v2, u)), np.concatenate((flips, flips))
                order = np.lexsort((flips, u))
                first = order[_groups(u[order])]
                first = first[flips[first] < least[u[first]]]
                least[u[first]], partner[u[first]] = flips[first], v2[first]
        at = to
    if nearest:
        some = np.flatnonzero(partner >= 0)
        found = [np.stack((some, partner[some]))]
    pairs = np.sort(h[np.concatenate(found, axis=1)], axis=0) if found else np.zeros((2, 0), np.int64)
    pairs = np.unique(pairs, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0])), pa.array(np.ascontiguousarray(pairs[1]))], names=["a", "b"])


def _arms(p: int, q: int):
    def arms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, salt, b, shingles), sorted, the centre's own row (b null) first: the pairs (a, b) that link."""
        centre, of = np.zeros(0, np.uint64), None
        for batch in batches:
            a, salt, b = (batch.column(k).to_pylist() for k in range(3))
            rows = _rows_of(batch.column(3))
            out = []
            at = 0
            while at < len(rows):
                if b[at] is None:
                    centre, of, at = rows[at], (a[at], salt[at]), at + 1
                    continue
                to = at
                while to < len(rows) and b[to] is not None and (a[to], salt[to]) == of:
                    to += 1
                size = np.array([len(r) for r in rows[at:to]])
                all_of = np.concatenate(rows[at:to])
                spot = np.minimum(np.searchsorted(centre, all_of), len(centre) - 1)
                both = np.bincount(np.repeat(np.arange(to - at), size), weights=centre[spot] == all_of, minlength=to - at).astype(np.int64)
                out += [(a[at], b[at + x]) for x in np.flatnonzero(q * both >= p * (size + len(centre) - both)).tolist()]
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return arms


def verify(pairs: DataFrame, sets: DataFrame, p: int = P, q: int = Q) -> DataFrame:
    """pairs (a, b) of set hashes, distinct; the pairs that link, decided on the whole sets. A centre with many members is copied to its arms."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arms = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / ARM).alias("arms"))
    salted = pairs.join(arms, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("arms")).alias("salt"))
    own = arms.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("arms") - 1)).alias("salt"))
    held = sets.select(F.col("h"), "shingles")
    members = salted.join(held.withColumnRenamed("h", "b"), "b").select("a", "salt", "b", "shingles")
    centres = own.join(held.withColumnRenamed("h", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    together = members.union(centres).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return together.mapInArrow(_arms(p, q), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text: (doc_id, n_shingles, component_id) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    with swept(spark):
        prof = checkpoint(docs.mapInArrow(profile, _PROFILE))
        named = checkpoint(_named(docs, prof.where("n > 0 and doc_id is not null")))
    out = prof.where("n > 0 and doc_id is not null").select("doc_id", "n", "h").join(named, "h").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = prof.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(rest)


def _named(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """docs (doc_id, text) and the profiles of those that may link: (h, component_id) for each set."""
    spark = docs.sparkSession
    classes = checkpoint(linked.groupBy("h").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "room", "room_below")]))
    release(spark)
    stars = checkpoint(stars_of(_prefixes(docs, classes)))
    path = _written_sets(docs, stars.select("h").distinct().join(classes, "h").select("doc_id", "h"))
    sets = spark.read.parquet(path)
    links = checkpoint(verify(checkpoint(_best(stars)), sets))
    found = checkpoint(components(links))
    for nearest in (True, False):  # first what is nearest, so that most links are known before all pairs of components are named
        further = checkpoint(_further(stars, found, sets, nearest))
        release(spark)
        more = checkpoint(verify(further, sets)) if not further.isEmpty() else further
        if not more.isEmpty():
            links = checkpoint(links.union(more))
            found = checkpoint(components(links))
    remove_dir(spark, path)
    roots = found.join(classes.select(F.col("h").alias("node"), "doc_id"), "node")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = roots.select("node", "root").join(least, "root").select(F.col("node").alias("h"), "component_id")
    return classes.select("h", "doc_id").join(joined, "h", "left").select("h", F.coalesce("component_id", "doc_id").alias("component_id"))


def _prefixes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, h, n): the blocks of each set's prefixes that other sets have too."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-int(total * 0.55) // GROUP))
    dealt = docs.where("doc_id is not null").select("text").mapInArrow(_dealer(groups), DEALT)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * groups)
    held = dealt.repartition(parts, "g").groupBy("g").applyInArrow(count_pairs, "key long, id long, held long")
    both = held.select("key", "held", F.col("id").bitwiseAND(F.lit(-2)).alias("h"), (F.col("id").bitwiseAND(F.lit(1)) == 1).alias("below")).join(classes.drop("doc_id"), "h")
    of = Window.partitionBy("h", "below")
    # ranks of equal rows are equal, for copies of a set may have come from several tasks
    ranked = both.withColumn("rank", F.dense_rank().over(of.orderBy("held", "key")))
    ranked = ranked.withColumn("shared", F.max("rank").over(of))  # of the filled blocks the others are the set's own
    return ranked.where(F.col("rank") <= F.col("shared") + F.when(F.col("below"), F.col("room_below")).otherwise(F.col("room"))).select("key", "h", "n").distinct()


def stars_of(kept: DataFrame) -> DataFrame:
    """(key, h, n, a, na, m) of the keys that m > 1 sets have, a being the least of them, of size na."""
    kept = checkpoint(kept)
    centres = kept.groupBy("key").agg(F.min(F.struct("h", "n")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return kept.join(centres.select("key", F.col("c.h").alias("a"), F.col("c.n").alias("na"), "m"), "key")


def _written_sets(docs: DataFrame, wanted: DataFrame) -> str:
    """Where the sets of wanted (doc_id, h) are written, in the shared folder; a set may be there more than once."""
    spark = docs.sparkSession
    wanted = checkpoint(wanted)
    few = wanted.count() <= SEND  # a proven bound before anything is sent to all
    path = fresh_dir(spark, "sets")
    docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "h").mapInArrow(_sets, _SETS).write.parquet(path)
    return path


def _best(stars: DataFrame) -> DataFrame:
    """(a, b): each set b with the centre a that it shares most blocks with, of those whose size allows a link."""
    sized = stars.where((F.col("h") != F.col("a")) & (F.col("na") * Q >= F.col("n") * P) & (F.col("n") * Q >= F.col("na") * P))
    shared = sized.groupBy("a", F.col("h").alias("b")).agg(F.count(F.lit(1)).alias("blocks"))
    return shared.groupBy("b").agg(F.max_by("a", F.struct("blocks", "a")).alias("a")).select("a", "b")


def _further(stars: DataFrame, found: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """The pairs (a, b) of sets of different components that share a block, as far as sizes and dense sketches allow a link."""
    rooted = stars.join(found.withColumnRenamed("node", "h"), "h", "left").select("key", "h", "n", "m", F.coalesce("root", "h").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    rows = rooted.join(mixed, "key").join(sets.select("h", "sketch"), "h")
    count = F.ceil(F.col("m") / TILE)
    mine, other = F.pmod(F.xxhash64("h"), count), F.col("other")
    tiled = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    tiled = tiled.select("key", F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), (F.col("mine") > other).cast("long").alias("side"), "h", "root", "n", "sketch")
    n = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_tiler(nearest), "a long, b long").distinct()


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least doc_id, with its columns; documents without words or id stay.

    Of repeated rows with that doc_id one stays.
    """
    found = near_duplicates(docs)
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    copies = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    single = kept.join(copies, "doc_id", "left_anti")
    one = kept.join(copies, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.union(one).union(docs.where("doc_id is null")).select(*docs.columns)

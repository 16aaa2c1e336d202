"""Document fingerprints: SimHash, with permuted block tables for all fingerprints within a Hamming radius.

Every distinct pair of neighbouring words (the whole text, if it has one word) is a term with weight 1 + ln(count), in whole parts of 1 / SCALE.
Each of BITS bits of a term's hash votes with the weight for or against, and the fingerprint keeps the signs. Votes are summed by
byte: a histogram of the weight of each byte value, times the signs of that byte's bits. All sums are of whole numbers, so equal texts have equal
fingerprints in whatever batch they are.

Defined results: a null text counts as empty; a text without words has the fingerprint of no votes, all zero; a null
doc_id sorts before all others; repeated ids are ordered by text; with one document it is its own next one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, checkpoint, chunks, counted_shingles, empty_text, mix, n_parts, range_parts, table

BITS = 128
WIDTH = 2
RADIUS = 3
SCALE = 1 << 16
#: Up to so many queries are sent to all executors (some 1.5 kB each); more are joined by a shuffle.
SEND = 20_000
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float) * 2) - 1


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """BITS // 8 bytes for each text."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i, j in chunks(texts):
        keys, of, count = counted_shingles(Words(texts[i:j]), WIDTH)
        n = j - i
        weight = np.rint(SCALE * (1 + np.log(np.maximum(count, 1))))
        for word in range(BITS // 64):
            hashed = mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F * (word + 1) & (1 << 64) - 1)).view(np.uint8).reshape(len(keys), 8)
            for b in range(8):
                of_bytes = np.bincount(of * 256 + hashed[:, b], weights=weight, minlength=n * 256).reshape(n, 256)
                out[i:j, word * 8 + b] = np.packbits(of_bytes @ _SIGNS > 0, axis=1)[:, 0]
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _part, _halo) such that each part is sorted by doc_id and ends with the first row of the next one (_halo true)."""
    n = n_parts(docs.sparkSession)
    parts, found = range_parts(docs.select("doc_id", empty_text().alias("text")), "doc_id", n)
    after = {first: part for (part, _), (_, first) in zip(found, found[1:] + found[:1], strict=True)}  # at most n entries
    if not after:
        return parts.select("doc_id", "text", "_part", F.lit(False).alias("_halo"), "_k")
    halo = parts.where(F.col("_k").isin(list(after))).groupBy("_k").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))  # of equal ids the first row is enough
    to = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])
    both = parts.select("doc_id", "text", "_k", "_part").withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_part", to[F.col("_k")].cast("int")).withColumn("_halo", F.lit(True)))
    return both.select("doc_id", "text", "_part", "_halo", "_k").repartitionById(n, "_part").sortWithinPartitions("_part", "_halo", "_k", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, next text) of each row that isn't a halo."""
    held: tuple[int | None, str, int] | None = None
    for batch in batches:
        for doc_id, text, part, halo in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held is not None and held[2] == part:
                yield held[0], held[1], text
            held = None if halo else (doc_id, text, part)


def edited(text: str, after: str) -> str:
    """text with its last quarter replaced by as much of the start of after."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, str, str]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        own = [t.encode() for _, t, _ in held]
        changed = [edited(t, a).encode() for _, t, a in held]
        last = held[-1][2].encode()
        fp = fingerprints([*own, last])
        fe = fingerprints(changed)
        # the next document's fingerprint is the next row's, but where a part ends
        follows = fp[1:].copy()
        odd = [i for i in range(len(held) - 1) if held[i][2] != held[i + 1][1]]
        if odd:
            follows[odd] = fingerprints([held[i][2].encode() for i in odd])
        fp = fp[:-1]
        columns = [
            pa.array([r[0] for r in held], pa.int64()), pa.array([len(r[1]) for r in held], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
            pa.array([x.tobytes().hex() for x in fp]), pa.array([x.tobytes().hex() for x in fe]), pa.array(alike(fp, fe)), pa.array(alike(fp, follows)),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])

    for row in _rows(batches):
        held.append(row)
        size += len(row[1])
        if size > 2 << 20:
            yield flush()
            size = 0
    if held:
        yield flush()


def _blocks(fingerprint: Column, n: int) -> list[Column]:
    """n blocks of a hexadecimal fingerprint, of a whole number of digits each."""
    digits = BITS // 4
    cuts = [digits * i // n for i in range(n + 1)]
    return [F.substring(fingerprint, a + 1, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hexadecimal fingerprints differ."""
    parts = []
    for i in range(0, BITS // 4, 8):
        x, y = (F.conv(F.substring(c, i + 1, 8), 16, 10).cast("long") for c in (a, b))
        parts.append(F.bit_count(x.bitwiseXOR(y)))
    return sum(parts[1:], parts[0])


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (query, found, distance) of distinct values of the columns `fingerprint` at most radius bits apart, equal ones included.

    With radius + 2 blocks, two blocks at least agree in any such pair; each choice of two blocks is a table whose permutation puts
    them first, and a query looks up its own value in every table. A third key that all share can't arise: fingerprints are distinct
    here, so copies of a text are one row.
    """
    n = radius + 2

    def tables(df: DataFrame, name: str) -> DataFrame:
        b = _blocks(F.col("fingerprint"), n)
        keys = [F.struct(F.lit(k).alias("t"), F.concat(b[i], b[j]).alias("v")) for k, (i, j) in enumerate(combinations(range(n), 2))]
        return df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), F.explode(F.array(*keys)).alias("_key"))

    asked = tables(queries, "query")
    few = queries.limit(SEND + 1).count() <= SEND  # a proven bound before anything is sent to all
    met = tables(prints, "found").join(F.broadcast(asked) if few else asked, "_key").withColumn("distance", hamming(F.col("query"), F.col("found")))
    return met.where(F.col("distance") <= radius).select("query", "found", "distance").distinct()


def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of _SCHEMA, and for ids divisible by 100 n_within, the number of other fingerprints of the table at most RADIUS bits apart."""
    rows = checkpoint(with_next(table(spark, sf_dir, "documents")).select("doc_id", "text", "_part", "_halo").mapInArrow(_compare, _SCHEMA))
    asks = F.col("doc_id") % 100 == 0
    near = within(rows.where(asks).select("fingerprint").distinct(), rows).groupBy(F.col("query").alias("fingerprint")).agg((F.count(F.lit(1)) - 1).alias("_near"))
    return rows.join(near, "fingerprint", "left").select(*[c.split()[0] for c in _SCHEMA.split(", ")], F.when(asks, F.col("_near")).alias("n_within"))

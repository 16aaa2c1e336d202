"""What the operators of this subpackage share: tables, the shared folder, checkpoints and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator here.
SPACES = b" \t\n\x0b\x0c\r"


#: Rows of an Arrow batch: long texts must not fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches at BATCH_ROWS rows and BATCH_BYTES bytes, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_lexspan_dir", None)
        if not found:
            found = spark._lexspan_dir = "file://" + tempfile.mkdtemp(prefix="lexspan-")
    if "://" not in found:  # as Spark reads it: a path of the default file system
        jvm = spark._jvm.org.apache.hadoop.fs
        found = jvm.FileSystem.get(spark._jsc.hadoopConfiguration()).makeQualified(jvm.Path(found)).toString()
        found = re.sub("^file:/(?!/)", "file:///", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(fresh_dir(spark, "checkpoints"))
    return df.checkpoint()


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Within, the shuffle files of a job go when it ends; else loops of many jobs keep all until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: plans, broadcasts and shuffles of jobs that are over go, and its heap shrinks again; what its Python holds but no longer uses goes back as well.
    For places where many jobs follow each other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)
    spark._jvm.System.gc()


def remove_dir(spark: SparkSession, uri: str) -> None:
    """Deletes a folder made by fresh_dir; one that is gone already is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n at least, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for b in (_BASE, _INVERSE):
            p = np.ones(size, np.uint64)
            k, step = 1, b
            while k < size:  # doubling
                p[k : 2 * k] = p[:k] * np.uint64(step)
                step = step * step & _MASK
                k *= 2
            both.append(p)
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


class Words:
    """The words of a batch of texts: where they lie in the bytes, which text has them, and a 64-bit hash of each.

    texts: byte strings; a None has no words. Words are runs of bytes other than SPACES. With lower, A-Z count as a-z.
    The hash is a polynomial over random byte values, so that equal words have equal hashes wherever they stand.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        self.n_texts = len(texts)
        data = b" ".join(t or b"" for t in texts)  # the blank ends a text's last word
        raw = np.frombuffer(data, np.uint8)
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))  # where each text begins
        self.raw = _LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_SPACE[raw]
        turns = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = turns[::2], turns[1::2]
        self.text_of = np.searchsorted(self.bounds, self.starts, "right") - 1
        self.first = np.searchsorted(self.text_of, np.arange(self.n_texts + 1))  # each text's first word
        self._sums: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of the bytes from each start to its end."""
        forward, back = _powers(len(self.raw) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(_BYTES[self.raw] * forward[: len(self.raw)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * back[starts])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    return counted_shingles(words, width)[:2]


def counted_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's distinct width-word shingles, sorted within the text, the text of each, and how often it has it.

    A text with fewer words has its whole sequence as its one shingle, one without words has none.
    """
    h, counts = words.hashes(), words.counts
    total = np.zeros(len(h), np.uint64)
    if len(h):
        for k in range(min(width, len(h))):  # order matters: each place has its own multiplier
            inside = h[k:] * np.uint64(pow(_BASE, 3 * k + 1, 1 << 64))
            total[: len(h) - k] += inside
    whole = counts >= width
    left = words.first[1:][words.text_of] - np.arange(len(h))  # words from here to the text's end
    keep = left >= width
    keys, texts = mix(total[keep]), words.text_of[keep]
    short = np.flatnonzero(~whole & (counts > 0))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            a, b = words.first[t], words.first[t + 1]
            mult = np.array([pow(_BASE, 3 * k + 1, 1 << 64) for k in range(b - a)], np.uint64)
            extra[i] = (int((h[a:b] * mult).sum(dtype=np.uint64)) + int(b - a) * 0x632BE59BD9B4E019) & _MASK
        keys, texts = np.concatenate((keys, mix(extra))), np.concatenate((texts, short))
    if len(short):
        order = np.argsort(texts, kind="stable")
        keys, texts = keys[order], texts[order]
    bounds = np.searchsorted(texts, np.arange(words.n_texts + 1))
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i > 1:
            keys[i:j].sort()
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
        at = np.flatnonzero(new)
        return keys[new], texts[new], np.diff(np.r_[at, len(keys)])
    return keys, texts, np.zeros(0, np.int64)


def chunks(texts: list, limit: int = 1 << 20):
    """(from, to) ranges of texts that hold about limit bytes each, so that the arrays made from a chunk stay small."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t is not None else 0
        if held >= limit or i - at >= 20_000:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


LEAST_ID = -(1 << 63)


def range_parts(df: DataFrame, key: str, n: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """df with _k (key, null as the least long) and _part, a number that ascends with _k; and (part, least _k) of the parts that have rows.

    The bounds are n - 1 quantiles, so the parts are about equal; equal keys share a part. The driver gets 2n numbers.
    """
    k = df.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(LEAST_ID)))
    cuts = k.agg(F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("_k"))) if cuts else F.lit(0)
    out = k.withColumn("_part", part.cast("int"))
    found = out.groupBy("_part").agg(F.min("_k")).collect()
    return out, sorted((r[0], r[1]) for r in found)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column) -> list[bytes | None]:
    """An Arrow string column as byte strings."""
    return column.cast(pa.large_binary()).to_pylist()


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))

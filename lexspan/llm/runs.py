"""Periodic runs of words within a text, by power-of-two names.

Level k names every block of 2^k words of a text: a block's name is that of the pair of its halves' names (Karp, Miller and
Rosenberg). Blocks that a text has once only have no name, so that a level costs no more than what repeats of it. The longest
common extension of two places is found by going down the levels: where both have the same name the places move on by its length.

A run with period q of at least 4q words has a place i, a multiple of q, with the same name of the level of floor(log2(2q)) at i and
i + q. For each level only texts with names there look at their grids of q in [2^(k-1), 2^k), which are 0.7 places a word; the first
place of each row of equal names is extended both ways. Stretches found with several periods keep the smallest. All of it
is exact: words are numbered by a dictionary, names by sorting.

Defined results: null and wordless texts have no runs, and the digests of nothing; a null doc_id leaves its text as it is; repeated rows
give repeated rows; an empty table gives an empty result; further columns of the input are ignored. A text is one task's work; memory
follows the longest one (names of levels of which few words have one are kept sparse).
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import chunks, small_batches, table, text_bytes

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Places of the grids in memory at a time.
GRID = 1 << 21


class Names:
    """The names of all levels for the words of several texts. words: numbers; bounds: where each text begins, and the end of the last."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.n = len(words)
        sizes = np.diff(bounds)
        self.text_of = np.repeat(np.arange(len(sizes)), sizes)
        self.begin, self.end = bounds[:-1][self.text_of], bounds[1:][self.text_of]
        self.levels: list[tuple[np.ndarray | None, np.ndarray]] = []
        at = np.arange(self.n)
        code = self.text_of * (int(words.max(initial=0)) + 1) + words
        while len(at):
            at, name = self._repeated(at, code)
            if not len(at):
                break
            dense = len(at) * 4 > self.n
            if dense:
                full = np.zeros(self.n, np.int32)
                full[at] = name
            self.levels.append((None, full) if dense else (at, name))
            half = 1 << (len(self.levels) - 1)
            at = at[at + 2 * half <= self.end[at]]
            left, right = self.name(len(self.levels) - 1, at), self.name(len(self.levels) - 1, at + half)
            some = right > 0
            at, code = at[some], left[some].astype(np.int64) << 32 | right[some]

    @staticmethod
    def _repeated(at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose code others have too, ascending, and a name from 1 for each code."""
        order = np.argsort(code)
        by = code[order]
        new = np.r_[True, by[1:] != by[:-1]]
        first = np.flatnonzero(new)
        many = np.diff(np.r_[first, len(by)]) > 1
        number = np.where(many, np.cumsum(many), 0)[np.cumsum(new) - 1]
        name = np.zeros(len(at), np.int32)
        name[order] = number
        return at[name > 0], name[name > 0]

    def name(self, level: int, at: np.ndarray) -> np.ndarray:
        """The names at places within the words; 0 for a block that its text has once or that passes its end."""
        places, names = self.levels[level]
        if places is None:
            return names[at]
        k = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[k] == at, names[k], 0)

    def same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = self.name(level, i)
        return (x > 0) & (x == self.name(level, j))

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i on (with back: before i) are those from j on (before j), within their text; i < j."""
        i, j = i.copy(), j.copy()
        began, begin, end = i.copy(), self.begin[i], self.end[i]
        for level in range(len(self.levels) - 1, -1, -1):
            step = 1 << level
            fits = np.flatnonzero(i - step >= begin if back else j + step <= end)
            if back:
                hit = fits[self.same(level, i[fits] - step, j[fits] - step)]
                i[hit] -= step
                j[hit] -= step
            else:
                hit = fits[self.same(level, i[fits], j[fits])]
                i[hit] += step
                j[hit] += step
        return np.abs(i - began)

    def _grids(self, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, period) of the grids of [2^(level-1), 2^level), of the texts that have names at that level, rows of a grid together."""
        places, names = self.levels[level]
        texts = np.unique(self.text_of[np.flatnonzero(names) if places is None else places])
        first = np.searchsorted(self.text_of, texts)
        sizes = self.end[first] - self.begin[first]
        low = 1 << (level - 1)
        high = np.minimum(2 * low - 1, sizes // LEAST_PERIODS)
        many = np.maximum(high - low + 1, 0)
        row = np.repeat(np.arange(len(texts)), many)
        q = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low
        points = (sizes[row] - 1) // q  # k*q + q is within the text
        upto = np.cumsum(points)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GRID, "right")))
            p = points[at:to]
            period = np.repeat(q[at:to], p)
            k = np.arange(len(period)) - np.repeat(np.cumsum(p) - p, p)
            yield np.repeat(first[row[at:to]], p) + k * period, period
            at = to

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and smallest period of all runs, by start, then period. Starts and ends count over all texts."""
        found = []
        for level in range(1, len(self.levels)):
            for i, q in self._grids(level):
                ok = self.same(level, i, i + q)
                # the place before has the same name at its next one: the same stretch
                ok[1:] &= ~(ok[:-1] & (q[1:] == q[:-1]) & (i[1:] - i[:-1] == q[1:]))
                i, q = i[ok], q[ok]
                if len(i):
                    start = i - self.common(i, i + q, back=True)
                    end = i + q + self.common(i, i + q)
                    some = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
                    found.append(np.stack((start[some], end[some], q[some])))
        start, end, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.lexsort((q, end, start))
        start, end, q = start[order], end[order], q[order]
        new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
        start, end, q = start[new], end[new], q[new]
        order = np.lexsort((q, start))
        return start[order], end[order], q[order]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as numbers, equal words alike, and where each text begins, with the end of the last."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    bounds = np.cumsum([0] + [len(t) for t in texts])
    return np.fromiter((number[w] for t in texts for w in t), np.int64, int(bounds[-1])), bounds


def runs_of(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each list of words its runs: start, length and period, by start, then period."""
    words, bounds = numbered(texts)
    start, end, period = Names(words, bounds).runs()
    cut = np.searchsorted(start, bounds)
    return [(start[a:b] - begin, end[a:b] - start[a:b], period[a:b]) for a, b, begin in zip(cut[:-1].tolist(), cut[1:].tolist(), bounds[:-1].tolist(), strict=True)]


def collapse(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    start, length, period = runs
    if not len(start):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return [words[x] for x in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query takes them: a tenth of the documents repeat a stretch of theirs to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    stretch = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (stretch * (-(-(n - a) // len(stretch))))[: n - a]


_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _described(prepare):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for i, j in chunks(texts):
                words = [prepare((t or b"").split(), d) for t, d in zip(texts[i:j], ids[i:j], strict=True)]
                out = []
                for d, w, found in zip(ids[i:j], words, runs_of(words), strict=True):
                    start, length, period = found
                    best: tuple = (None, None, None, None)
                    if len(start):
                        k = int(np.argmax(length))  # the first of the greatest, and runs ascend by start and period
                        best = (int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k]))
                    said = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                    left = b" ".join(collapse(w, found))
                    out.append((d, len(start), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in out], schema=_SCHEMA)

    return rows


_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _RESULT.split(", ")])


def periodic_runs(docs: DataFrame, prepare=lambda words, doc_id: words) -> DataFrame:
    """docs with doc_id and text: for each row its number of runs, the longest one, and digests of all runs and of the text without repeats."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_described(prepare), _RESULT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted)


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = text_bytes(batch.column(at))
        out: list[bytes | None] = []
        for i, j in chunks(texts):
            words = [(t or b"").split() for t in texts[i:j]]
            out += [t if not len(r[0]) else b" ".join(collapse(w, r)) for t, w, r in zip(texts[i:j], words, runs_of(words), strict=True)]
        yield batch.set_column(at, batch.schema.field(at).name, pa.array(out, pa.binary()).cast(pa.string()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the texts that have runs cut to the first period of each, words joined by a blank; other texts stay as they are."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_collapsed, docs.schema)

"""Token ids in binary shards, with a minimal perfect hash index from document keys to offsets.

A shard is two files. NAME.ids: the ids of its documents end to end, 2 bytes each, or 4 for vocabularies beyond 65,535,
little-endian. NAME.idx: a JSON header line, then arrays: the documents in order (key, valid, offset, length) and the hash
index (bucket displacements; by slot a 32-bit key fingerprint and the document). A lookup hashes the key to its bucket, the bucket's
displacement gives the one slot, the stored fingerprint rejects keys that the shard doesn't hold: constant time.
manifest.json lists the shards, which hold ascending ranges of keys, with the number of ids before each.

Texts are cut at blanks and line ends and each distinct word is encoded once by the tokenizers library: the tokenizer drops white
space and no token or special token spans it, so that the ids are those of the whole text (tests/llm compares them).

Defined results: a null text is empty and has the end id only; a null key is written first and isn't indexed; of repeated
keys all rows are written, ordered by text, and the index has the first; an empty table gives no shards and no rows.
Every task writes under a name of its own and renames at the end, so a lost executor's work is done again without harm.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .shared import LEAST_ID, empty_text, fresh_dir, mix, n_parts, range_parts, table

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Distinct words that a task keeps encoded.
CACHE = 900_000
_STEP = 0x9E3779B97F4A7C15


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids of a tokenizer that drops white space, word by word.

    New words are encoded many at a time: each piece that the tokenizer's own rule cuts from a word ends in one token that
    carries the end-of-word mark, so the ids of a run of words fall apart again by counting pieces.
    """

    _opened: dict[str, Encoder] = {}

    @classmethod
    def open(cls, path: str) -> Encoder:
        """One for each Python worker; what it knows serves the worker's later tasks."""
        if path not in cls._opened:
            cls._opened[path] = cls(path)
        return cls._opened[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            rule = json.load(f)
        self.special = [t["content"] for t in rule["added_tokens"]]
        mark = rule["model"].get("end_of_word_suffix")
        self.ends = np.zeros(size, bool)
        self.piece = None
        if mark:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
            found = [p["pattern"]["Regex"] for p in rule["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
            self.piece = regex.compile(found[0]) if len(found) == 1 else None

    def _pieces(self, word: str) -> int:
        return len(self.piece.findall(unicodedata.normalize("NFC", word).lower()))

    def _learn(self, words: list[str]) -> None:
        alone = words
        if self.piece is not None:
            alone = [w for w in words if any(s in w for s in self.special)]
            words = [w for w in words if not alone or not any(s in w for s in self.special)]
            runs = [words[i : i + 500] for i in range(0, len(words), 500)]
            for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.kind)
                last = np.flatnonzero(self.ends[ids])
                pieces = np.cumsum([self._pieces(w) for w in run])
                if not len(last) or pieces[-1] != len(last):
                    alone.extend(run)
                    continue
                cut = [0, *np.where(pieces > 0, last[np.maximum(pieces, 1) - 1] + 1, 0).tolist()]
                raw = ids.tobytes()
                for w, i, j in zip(run, cut[:-1], cut[1:], strict=True):
                    self.known[w] = raw[i * self.width : j * self.width]
        for w, e in zip(alone, self.tokenizer.encode_batch(alone, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        new = list({w for ws in words for w in ws if w not in self.known})
        if len(self.known) + len(new) > CACHE:
            self.known = {"": b""}
            new = list({w for ws in words for w in ws if w})
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


def _hash(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64((salt + 1) * _STEP & (1 << 64) - 1))


def _slots(hashed: np.ndarray, shift: np.ndarray | int, n: int) -> np.ndarray:
    return (mix(hashed + np.asarray(shift).astype(np.uint64) * np.uint64(_STEP)) >> np.uint64(11)).astype(np.int64) % n


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys: (displacements by bucket, key fingerprint by slot, position in keys by slot).

    Buckets of two keys or more, largest first, try displacements until their keys fall in free slots; those of one key take what
    slots are left, kept as minus slot minus 1.
    """
    n = len(keys)
    n_buckets = max(1, n // 2)
    hashed, bucket = _hash(keys, 0), (_hash(keys, 1) >> np.uint64(11)).astype(np.int64) % n_buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    shift, taken, place = np.zeros(n_buckets, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    size = np.diff(cut)
    single = []
    for b in np.argsort(-size, kind="stable").tolist():
        own = order[cut[b] : cut[b + 1]]
        if not len(own):
            break
        if len(own) == 1:
            single.append((b, own[0]))
            continue
        first = 0
        while True:
            tries = np.arange(first, first + 64)
            at = _slots(hashed[own][None, :], tries[:, None], n)
            ok = ~taken[at].any(axis=1)
            ordered = np.sort(at, axis=1)
            ok &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if ok.any():
                d = int(np.argmax(ok))
                shift[b] = first + d
                taken[at[d]] = True
                place[own] = at[d]
                break
            first += 64
    for (b, k), slot in zip(single, np.flatnonzero(~taken).tolist(), strict=True):
        shift[b], place[k] = -slot - 1, slot
    at_slot = np.zeros(n, np.int64)
    at_slot[place] = np.arange(n)
    return shift, (_hash(keys, 2) >> np.uint64(32)).astype(np.uint32)[at_slot], at_slot


def find(keys: np.ndarray, shift: np.ndarray, prints: np.ndarray, at_slot: np.ndarray) -> np.ndarray:
    """The position of each key in the indexed keys, -1 if it isn't there (but for one unknown key in 2 ** 32)."""
    n = len(prints)
    if not n:
        return np.full(len(keys), -1)
    d = shift[(_hash(keys, 1) >> np.uint64(11)).astype(np.int64) % len(shift)]
    slot = np.where(d < 0, -d - 1, _slots(_hash(keys, 0), np.maximum(d, 0), n))
    return np.where(prints[slot] == (_hash(keys, 2) >> np.uint64(32)).astype(np.uint32), at_slot[slot], -1)


_ARRAYS = (("key", np.int64), ("valid", np.uint8), ("offset", np.int64), ("length", np.int64), ("row", np.int64), ("shift", np.int64), ("print", np.uint32), ("slot", np.int64))


class Shard:
    """One shard opened for reading."""

    def __init__(self, at: fs.FileSystem, path: str):
        with at.open_input_stream(f"{path}.idx") as f:
            head, _, rest = f.read().partition(b"\n")
        self.head = json.loads(head)
        self.kind = np.dtype(self.head["ids"])
        pos = 0
        for (name, kind), n in zip(_ARRAYS, self.head["sizes"], strict=True):
            setattr(self, f"{name}s", np.frombuffer(rest, kind, n, pos))
            pos += n * np.dtype(kind).itemsize
        self._payload = at.open_input_file(f"{path}.ids")

    def read(self, offset: int, length: int) -> np.ndarray:
        self._payload.seek(offset * self.kind.itemsize)
        return np.frombuffer(self._payload.read(length * self.kind.itemsize), self.kind)

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The (first) row of each key, -1 without one."""
        found = find(keys, self.shifts, self.prints, self.slots)
        return np.where(found < 0, -1, self.rows[np.maximum(found, 0)]) if len(self.rows) else found

    def ids(self, key: int) -> np.ndarray | None:
        row = int(self.rows_of(np.array([key]))[0])
        return None if row < 0 else self.read(int(self.offsets[row]), int(self.lengths[row]))


def _writer(uri: str, path: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(_part, doc_id, text) sorted by part and key; each part to a shard, one row of the manifest for it."""
        at, root = fs.FileSystem.from_uri(uri)
        encoder = Encoder.open(path)
        tail = np.array([end], encoder.kind).tobytes()
        part, out, temp = None, None, ""
        keys: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            out.close()
            name = f"{root}/shard-{part:06d}"
            valid = np.array([k is not None for k in keys], np.uint8)
            key = np.array([LEAST_ID if k is None else k for k in keys], np.int64)
            length = np.array(lengths, np.int64)
            offset = np.cumsum(length) - length
            known = np.flatnonzero(valid)
            _, first = np.unique(key[known], return_index=True)
            row = known[first]
            shift, prints, slots = build_index(key[row])
            arrays = (key, valid, offset, length, row, shift, prints, slots)
            with at.open_output_stream(f"{temp}.idx") as f:
                f.write(json.dumps({"ids": encoder.kind.str, "sizes": [len(a) for a in arrays]}).encode() + b"\n" + b"".join(a.astype(k).tobytes() for a, (_, k) in zip(arrays, _ARRAYS, strict=True)))
            for kind in ("ids", "idx"):
                at.move(f"{temp}.{kind}", f"{name}.{kind}")
            made = pa.RecordBatch.from_pylist([{"part": part, "docs": len(keys), "ids": int(length.sum())}], schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))
            keys.clear()
            lengths.clear()
            return made

        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if part != int(parts[a]):
                    if out is not None:
                        yield close()
                    part, temp = int(parts[a]), f"{root}/{uuid.uuid4().hex}"
                    out = at.open_output_stream(f"{temp}.ids")
                for i in range(a, b, 500):
                    n = min(500, b - i)
                    for ids in encoder.encode(batch.column(2).slice(i, n).to_pylist()):
                        out.write(ids + tail)
                        lengths.append(len(ids) // encoder.width + 1)
                    keys.extend(batch.column(1).slice(i, n).to_pylist())
        if out is not None:
            yield close()

    return write


def write_shards(docs: DataFrame, uri: str, tokenizer: str | None = None, end: int = END) -> list[dict]:
    """Writes docs (doc_id, text) in ascending doc_id order below uri. Returns the manifest: a row for each shard."""
    spark = docs.sparkSession
    at, root = fs.FileSystem.from_uri(uri)
    at.create_dir(root)
    n = n_parts(spark)
    parts, found = range_parts(docs.select("doc_id", empty_text().alias("text")), "doc_id", n)
    dealt = parts.repartitionById(n, "_part").sortWithinPartitions("_part", "_k", "text").select("_part", "doc_id", "text")
    made = {r["part"]: r for r in dealt.mapInArrow(_writer(uri, tokenizer or tokenizer_path(), end), "part int, docs long, ids long").collect()}
    manifest, before = [], 0
    for part, least in found:
        r = made[part]
        manifest.append({"shard": f"shard-{part:06d}", "least": least, "docs": r["docs"], "ids": r["ids"], "start": before})
        before += r["ids"]
    with at.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Reader:
    """Keyed access to a folder of shards."""

    def __init__(self, uri: str):
        self.at, self.root = fs.FileSystem.from_uri(uri)
        with self.at.open_input_stream(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.least = np.array([m["least"] for m in self.manifest], np.int64)
        self.shards: dict[str, Shard] = {}

    def ids(self, key: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.least, key, "right")) - 1
        if k < 0:
            return None
        name = self.manifest[k]["shard"]
        if name not in self.shards:
            self.shards[name] = Shard(self.at, f"{self.root}/{name}")
        return self.shards[name].ids(key)


_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, start) to the documents of the shard, each indexed one found by its key."""
        at, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(at, f"{root}/{name}")
                found = s.rows_of(s.keys)
                first = np.r_[True, s.keys[1:] != s.keys[:-1]]
                want = first & (s.valids == 1)
                if not (found[want] == np.flatnonzero(want)).all():
                    raise ValueError(f"{name}: the index misses keys")
                row = np.where(want, found, np.arange(len(s.keys)))  # repeated and null keys by their place
                for i in range(0, len(row), 5000):
                    r = row[i : i + 5000]
                    crc = [zlib.crc32(s.read(int(o), int(n)).astype("<u4").tobytes()) for o, n in zip(s.offsets[r], s.lengths[r], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.keys[r], mask=s.valids[r] == 0), pa.array(s.offsets[r] + start), pa.array(s.lengths[r]), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_shards(spark: SparkSession, uri: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents below uri."""
    if not manifest:
        return spark.createDataFrame([], _SCHEMA)
    shards = spark.createDataFrame([(m["shard"], m["start"]) for m in manifest], "shard string, start long").repartition(len(manifest))
    return shards.mapInArrow(_reader(uri), _SCHEMA)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_dir(spark, "tokens")
    return read_shards(spark, uri, write_shards(table(spark, sf_dir, "documents"), uri))

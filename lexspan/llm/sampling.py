"""SentencePiece segmentations by Gumbel top-k without replacement, and decoding.

A text's segmentations into a model's pieces are the paths of a lattice; a path's probability is proportional to the product
of its pieces' weights, 1 / (rank + 3) ** theta with the rank that the model's scores give (byte pieces: the last rank). Pieces never cross
from one word to the next, so the lattice is a chain of word lattices, whose edges get conditional log-probabilities
from a backward pass once for each distinct word that a task has met lately; words and pieces are looked up by 64-bit hashes.

Sampling is an A-star search over prefixes of whole words, ordered by perturbed log-probability. The root's value is a Gumbel variate. A child
has its parent's value with the child's own probability; the siblings' greatest value is then a Gumbel variate cut off at the
parent's. So the search runs straight down a drawn path to a full segmentation; at each word its other segmentations join the frontier as
one node with that greatest value, and the next sample starts at the frontier's best. A node of siblings that is opened gives one
segmentation of its word the value, drawn through the word's lattice past those taken, and goes back with the rest. Paths are drawn for all words of
a batch of texts at a time. The k best leaves are a sample of k distinct segmentations without replacement; an inclusion score is the
chance that a segmentation's value exceeds the frontier's best after the last draw.

Noise is a hash of the row's key and the place in the lattice, so results don't depend on batches or partitions.

Defined results: a null text is empty; an empty text has its one segmentation (that of the added blank); where a text has fewer than k
segmentations all are given, with inclusion 1 for the last frontier being empty; a null key counts as key 0; repeated rows get equal samples; an
empty table gives an empty result; further columns are ignored. Decoded texts have a blank for each U+2581 of the text, which the pieces use as their blank.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Words, chunks, mix, table

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
BLANK = "▁"
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
#: Words whose lattices a task keeps; with more it starts anew.
KEPT = 120_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary of a SentencePiece model with byte fallback, and the lattices of words."""

    _opened: dict[tuple, Pieces] = {}

    @classmethod
    def open(cls, path: str, theta: float) -> Pieces:
        if (path, theta) not in cls._opened:
            cls._opened[path, theta] = cls(path, theta)
        return cls._opened[path, theta]

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.byte_id = {b: self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        taken = set(self.byte_id.values())
        self.ids: dict[str, int] = {}
        self.weight: dict[str, float] = {}
        worst = 0.0
        for i in range(n):
            if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or i in taken:
                continue
            piece, rank = self.model.id_to_piece(i), -self.model.get_score(i)
            self.ids[piece] = i
            self.weight[piece] = -theta * float(np.log(rank + 3))
            worst = min(worst, self.weight[piece])
        self.byte_weight = worst
        self.longest = max(map(len, self.ids))
        self.by_length = {}
        self.opens = {n: np.zeros(1 << 18, bool) for n in range(1, self.longest + 1)}
        for n in range(1, self.longest + 1):
            own = [p for p in self.ids if len(p) == n]
            if own:
                h = np.zeros(len(own), _U)
                points = np.array([[ord(c) for c in p] for p in own], np.int64)
                for k in range(n):
                    h = h * _U(_STEP) + points[:, k].astype(_U) + _U(1)
                keys = mix(h)
                order = np.argsort(keys)
                may = np.zeros(1 << 18, bool)
                may[(keys >> _U(46)).astype(np.int64)] = True
                self.by_length[n] = (keys[order], np.array([self.ids[own[x]] for x in order], np.int64), np.array([self.weight[own[x]] for x in order]), may)
                for k in range(1, n):  # what may be the start of a longer piece
                    h = np.zeros(len(own), _U)
                    for c in range(k):
                        h = h * _U(_STEP) + points[:, c].astype(_U) + _U(1)
                    self.opens[k][(mix(h) >> _U(46)).astype(np.int64)] = True
        self.text = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte_id.items()}
        self.held = Lattices(self)

    def lattices(self, words: list[str]):
        """The lattices of distinct words: (nodes of each word, out-degree of each node, and by edge the to-node, the piece id or -1 - code point, the conditional
        log-probability). A word of n characters has n + 1 nodes, one after another; a node's edges stand together, the shortest first."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words], np.int64)
        number = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(points))
        ahead = np.cumsum(length)[number] - place  # characters from here to the word's end
        signs = points.astype(_U) + _U(1)
        found = []
        at, h = place, np.zeros(len(points), _U)
        for n in range(1, self.longest + 1):
            if n > 1:
                long = np.flatnonzero(self.opens[n - 1][code])
                long = long[ahead[at[long]] >= n]
                at, h = at[long], h[long]
            if not len(at):
                break
            h = h * _U(_STEP) + signs[at + n - 1]
            mixed = mix(h)
            code = (mixed >> _U(46)).view(np.int64)
            if n in self.by_length:
                keys, ids, weights, may = self.by_length[n]
                maybe = np.flatnonzero(may[code])
                spot = np.minimum(np.searchsorted(keys, mixed[maybe]), len(keys) - 1)
                ok = keys[spot] == mixed[maybe]
                found.append((at[maybe[ok]], n, ids[spot[ok]], weights[spot[ok]]))
            if n == 1:  # a character that isn't a piece goes as its bytes
                lone = np.ones(len(points), bool)
                if found:
                    lone[found[0][0]] = False
                lone = np.flatnonzero(lone)
                c = points[lone]
                found.append((lone, 1, -1 - c, self.byte_weight * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))))
        node = place + number
        n_nodes = len(points) + len(words)
        degree = np.bincount(np.concatenate([node[at] for at, *_ in found]) if found else np.zeros(0, np.int64), minlength=n_nodes)
        first = np.cumsum(degree) - degree
        filled = first.copy()
        to, ids, weight = np.zeros(int(degree.sum()), np.int64), np.zeros(int(degree.sum()), np.int64), np.zeros(int(degree.sum()))
        for at, n, i, w in found:
            here = node[at]
            spot = filled[here]
            to[spot], ids[spot], weight[spot] = here + n, i, w
            filled[here] += 1
        back, logs = np.zeros(n_nodes), np.zeros(len(to))
        order = np.argsort(ahead, kind="stable")
        cut = np.searchsorted(ahead[order], np.arange(1, int(length.max(initial=0)) + 2))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = node[order[i:j]]
            d = degree[own]
            begin = np.cumsum(d) - d
            of = np.repeat(np.arange(len(own)), d)
            edge = np.arange(len(of)) - begin[of] + first[own][of]
            value = weight[edge] + back[to[edge]]
            top = np.maximum.reduceat(value, begin)
            back[own] = top + np.log(np.add.reduceat(np.exp(value - top[of]), begin))
            logs[edge] = value - back[own][of]
        return length + 1, degree, to, ids, np.minimum(logs, 0.0)

    def expand(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Real ids, and where the cuts are then: each -1 - code point gives way to its bytes' ids."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, cuts
        spelled = [[self.byte_id[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in ids[odd].tolist()]
        many = np.ones(len(ids), np.int64)
        many[odd] = [len(x) for x in spelled]
        out = np.repeat(ids, many)
        out[np.repeat(ids < 0, many)] = np.concatenate(spelled)
        return out, np.concatenate(([0], np.cumsum(many)))[cuts]

    def decode(self, ids) -> str:
        """The text of ids, without the blank that encoding puts first."""
        return b"".join(self.text[int(i)] for i in ids).decode("utf-8", "surrogatepass").replace(BLANK, " ")[1:]


def _uniform(seed: np.ndarray, *at) -> np.ndarray:
    x = seed.copy()
    for k, a in enumerate(at):
        x = x + np.asarray(a).astype(_U) * _U((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)[k])
    return ((mix(x) >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def _mixed(x: int) -> int:
    """As shared.mix, for one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _cut_off(phi: np.ndarray, value: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Gumbel variates at phi (from exponential variates e), conditioned to be below value."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(phi), -np.inf, phi - np.log(np.exp(phi - value) + e))


class Lattices:
    """The lattices of the words met so far, one after another."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.hashes, self.number = np.zeros(0, _U), np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.first_edge = np.zeros(1, np.int64)
        self.to, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.logs, self.ladder = np.zeros(0), np.zeros(0)

    def find(self, hashes: np.ndarray, spell) -> np.ndarray:
        """The number of each distinct word; spell gives the texts of the words at some places among them."""
        if len(self.hashes) > KEPT:
            self.clear()
        spot = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = spot < len(self.hashes)
        known[inside] = self.hashes[spot[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self._add(hashes[new], spell(new))
        return self.number[np.searchsorted(self.hashes, hashes)]

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        size, degree, to, ids, logs = self.pieces.lattices(words)
        nodes, n = len(self.first_edge) - 1, len(self.start)
        owner = np.repeat(np.arange(len(degree)), degree)
        run = np.cumsum(np.exp(logs))
        first = np.cumsum(degree) - degree
        ladder = run - np.concatenate(([0.0], run))[first][owner]
        ladder[(first + degree - 1)[degree > 0]] = 2.0  # above any draw
        self.start = np.concatenate((self.start, nodes + np.cumsum(size) - size))
        self.first_edge = np.concatenate((self.first_edge, self.first_edge[-1] + np.cumsum(degree)))
        self.to = np.concatenate((self.to, (to + nodes).astype(np.int32)))
        self.ids, self.logs, self.ladder = (np.concatenate(x) for x in ((self.ids, ids.astype(np.int32)), (self.logs, logs), (self.ladder, ladder)))
        keys, number = np.concatenate((self.hashes, hashes)), np.concatenate((self.number, np.arange(n, n + len(hashes))))
        order = np.argsort(keys)
        self.hashes, self.number = keys[order], number[order]

    def word(self, start: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """The lattice of the word whose first node is start, in plain numbers from 0: each node's first edge (and an end), the edges' nodes and
        log-probabilities, and how many paths lead from each node to the end."""
        end = start
        while self.first_edge[end] < self.first_edge[end + 1]:
            end += 1
        a, b = int(self.first_edge[start]), int(self.first_edge[end])
        first, to = (self.first_edge[start : end + 2] - a).tolist(), (self.to[a:b] - start).tolist()
        paths = [1] * (end - start + 1)
        for x in range(end - start - 1, -1, -1):
            paths[x] = sum(paths[to[e]] for e in range(first[x], first[x + 1]))
        return first, to, self.logs[a:b].tolist(), paths


def _words(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts with a blank before each, their words' starts and ends, and each text's first word. A word is a run of blanks with the
    run of others after it."""
    words = Words([b" " + t.replace(BLANK, " ").encode("utf-8", "surrogatepass") for t in texts])
    blank = words.raw == 32
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    closing = words.bounds[1:] - 1  # the blank that Words puts after a text, but for the last
    begin[words.bounds[:-1]] = True
    begin[closing[:-1]] = False
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, words.bounds[:-1])
    ends = np.append(starts[1:], len(words.raw))
    ends[np.append(first[1:], len(starts)) - 1] = np.minimum(closing, len(words.raw))
    return words, starts, ends, np.append(first, len(starts))


class Batch:
    """The chain of word lattices of some texts, and draws from it, until the next batch of the same model is made."""

    def __init__(self, pieces: Pieces, texts: list[str], keys: np.ndarray):
        self.pieces, self.n, self.lattices = pieces, len(texts), pieces.held
        words, starts, ends, self.first_word = _words(texts)
        distinct, at, number = np.unique(words.span_hash(starts, ends), return_index=True, return_inverse=True)
        data = words.raw.tobytes()

        def spell(which: np.ndarray) -> list[str]:
            spans = zip(starts[at[which]].tolist(), ends[at[which]].tolist(), strict=True)
            return [data[i:j].decode("utf-8", "surrogatepass").replace(" ", BLANK) for i, j in spans]

        found = self.lattices.find(distinct, spell)[number]
        self.start = self.lattices.start[found]
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first_word))
        self.seed = mix(keys.view(_U) + _U(0x5851F42D4C957F2D))
        place = np.arange(len(starts)) - self.first_word[self.doc]
        self.word_seed = mix(self.seed[self.doc] + place.astype(_U) * _U(0xA0761D6478BD642F))

    def run(self, draw: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draws a path for each of the words. Returns the edges of all, where each word's begin (and an end), and each word's log-probability."""
        held = self.lattices
        first, parts = held.first_edge, []
        logs, steps = np.zeros(len(words)), np.zeros(len(words), np.int64)
        at, node, seed = np.arange(len(words)), self.start[words], self.word_seed[words] + _U(0xC2B2AE3D27D4EB4F * (draw + 1) & _ALL)
        step = 0
        while len(at):
            seed = seed + _U(_STEP)
            u = (mix(seed) >> _U(11)).astype(np.float64) * 2.0**-53
            edge = first[node]
            climb = np.flatnonzero(u >= held.ladder[edge])
            while len(climb):
                edge[climb] += 1
                climb = climb[u[climb] >= held.ladder[edge[climb]]]
            parts.append((at, edge))
            logs[at] += held.logs[edge]
            node = held.to[edge]
            step += 1
            steps[at] = step
            live = np.flatnonzero(first[node + 1] > first[node])
            at, node, seed = at[live], node[live], seed[live]
        begin = np.concatenate(([0], np.cumsum(steps)))
        out = np.zeros(int(begin[-1]), np.int64)
        for k, (at, edge) in enumerate(parts):
            out[begin[at] + k] = edge
        return out, begin, logs

    def samples(self, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k samples (ids, log-probability, perturbed value, inclusion), best first."""
        n, first = self.n, self.first_word
        value = _gumbel(_uniform(self.seed, 1, 2, 3))  # of each text's root
        before = np.zeros(n)  # log-probability of each text's fixed prefix
        told: list[list[tuple[float, float]]] = [[] for _ in range(n)]  # (log-probability, value)
        frontier: list[list[tuple]] = [[] for _ in range(n)]  # (value, sample, word, paths taken, log-probability before the word)
        pool: list[np.ndarray] = []  # edges of all draws; a sample has for each word where its edges are
        pooled = 0
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        docs, tail = np.arange(n), first[:-1].copy()
        for draw in range(k):
            left_words = first[docs + 1] - tail[docs]
            begin = np.cumsum(left_words) - left_words
            words = np.repeat(tail[docs] - begin, left_words) + np.arange(int(left_words.sum()))
            edges, cut, logs = self.run(draw, words)
            if not draw:
                spans.append((np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)))
            spans[draw][0][words], spans[draw][1][words] = cut[:-1] + pooled, cut[1:] + pooled
            pool.append(edges)
            pooled += len(edges)
            of = np.repeat(np.arange(len(docs)), left_words)
            ahead = np.cumsum(logs) - logs
            ahead += (before[docs] - np.append(ahead, 0.0)[begin])[of] if len(words) else 0.0
            total = before[docs] + np.bincount(of, weights=logs, minlength=len(docs))
            for d, t in zip(docs.tolist(), total.tolist(), strict=True):
                told[d].append((t, float(value[d])))
            with np.errstate(divide="ignore"):
                beside = np.log(-np.expm1(logs))  # of a word's other segmentations together
            e = -np.log(_uniform(self.word_seed[words], draw + 1, 7))
            left = _cut_off(ahead + beside, value[docs][of], e)
            some = np.flatnonzero(left_words)
            for _ in range(k - draw if len(words) else 0):  # of a path's frontier no more than these can be opened or be the bar
                best = np.maximum.reduceat(left, begin[some])
                top = np.flatnonzero((left == np.repeat(best, left_words[some])) & (left > -np.inf))
                for i in top[np.unique(of[top], return_index=True)[1]].tolist():
                    w = int(words[i])
                    frontier[docs[of[i]]].append((float(left[i]), draw, w, (tuple(edges[cut[i] : cut[i + 1]].tolist()),), float(ahead[i])))
                    left[i] = -np.inf
            if draw == k - 1:
                break
            spans.append(tuple(x.copy() for x in spans[draw]))
            go, own = [], []
            value, before = value.copy(), before.copy()
            for d in docs.tolist():
                if frontier[d]:
                    best = max(range(len(frontier[d])), key=lambda i: frontier[d][i][0])
                    v, sample, w, taken, ahead_w = frontier[d].pop(best)
                    path, log_p, rest = self._another(w, taken, draw)
                    if rest is not None:
                        e = -np.log(_uniform(self.word_seed[w : w + 1], draw + 1, 11))
                        frontier[d].append((float(_cut_off(np.array([ahead_w + rest]), np.array([v]), e)[0]), sample, w, (*taken, path), ahead_w))
                    for x, y in zip(spans[-1], spans[sample], strict=True):
                        x[first[d] : w] = y[first[d] : w]
                    spans[-1][0][w], spans[-1][1][w] = pooled, pooled + len(path)
                    own += path
                    pooled += len(path)
                    go.append(d)
                    value[d], before[d], tail[d] = v, ahead_w + log_p, w + 1
            pool.append(np.array(own, np.int64))
            if not go:
                break
            docs = np.array(go, np.int64)
        ids = self.lattices.ids[np.concatenate(pool)] if pooled else np.zeros(0, np.int64)
        out: list[list] = [[] for _ in range(n)]
        for draw in range(max(map(len, told), default=0)):
            a, z = spans[draw]
            have = np.array([len(t) > draw for t in told])[self.doc]
            size = np.where(have, z - a, 0)
            ends = np.cumsum(size)
            flat = ids[np.repeat(a - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            flat, cuts = self.pieces.expand(flat, np.concatenate(([0], ends))[first])
            for d in range(n):
                if len(told[d]) > draw:
                    log_p, v = told[d][draw]
                    bar = max((f[0] for f in frontier[d]), default=-np.inf)
                    out[d].append((flat[cuts[d] : cuts[d + 1]], log_p, v, float(-np.expm1(-np.exp(log_p - bar))) if bar > -np.inf else 1.0))
        return out

    def _another(self, w: int, taken: tuple[tuple[int, ...], ...], draw: int) -> tuple[tuple[int, ...], float, float | None]:
        """A segmentation of a word by its probability among those not taken: its edges and log-probability, and that of what is left then (None: nothing)."""
        first, to, logs, paths = self.lattices.word(int(self.start[w]))
        base = int(self.lattices.first_edge[self.start[w]])
        seed = int(self.word_seed[w]) + 0x9FB21C651E98DF25 * (draw + 1) + 0x165667B19E3779F9 * len(taken)
        on = [tuple(x - base for x in t) for t in taken]
        mass = {t: math.exp(sum(logs[x] for x in t)) for t in on}
        spent = sum(mass.values())
        path, log_p, node = [], 0.0, 0
        while first[node] < first[node + 1]:
            seed = seed + _STEP & _ALL
            free = []
            for x in range(first[node], first[node + 1]):
                through = [t for t in on if t[len(path)] == x]
                if len(through) < paths[to[x]]:
                    free.append((x, max(math.exp(log_p + logs[x]) - sum(mass[t] for t in through), 1e-300)))
            bar = (_mixed(seed) >> 11) * 2.0**-53 * sum(m for _, m in free)
            for x, m in free:
                bar -= m
                if bar < 0:
                    break
            on = [t for t in on if t[len(path)] == x]
            path.append(x)
            log_p += logs[x]
            node = to[x]
        rest = None if len(taken) + 1 >= paths[0] else math.log(max(1.0 - spent - math.exp(log_p), 1e-300))
        return tuple(x + base for x in path), log_p, rest


_SCHEMA = "doc_id long, sample int, ids array<int>, log_probability double, perturbed double, inclusion double"


def _sampler(path: str, k: int, theta: float):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.open(path, theta)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(texts, 512 << 10):
                got = Batch(pieces, texts[i:j], np.array([x or 0 for x in keys[i:j]], np.int64)).samples(k)
                rows = [(keys[i + d], s + 1, *x) for d, mine in enumerate(got) for s, x in enumerate(mine)]
                cols = list(zip(*rows, strict=True))
                ends = np.cumsum([0, *map(len, cols[2])])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cols[2]).astype(np.int32)))
                kinds = [pa.int64(), pa.int32(), None, pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([ids if t is None else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return sample


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, theta: float = 1.0, path: str | None = None) -> DataFrame:
    """docs (doc_id, text): k rows for each, best first, with the ids of the segmentation."""
    return docs.select("doc_id", "text").mapInArrow(_sampler(path or model_path(), k, theta), _SCHEMA)


def _ends(lists: pa.Array) -> np.ndarray:
    """Where each row's values end in the flat array, after a 0."""
    return np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)


@functools.cache
def _spelled(path: str) -> pa.Array:
    """The bytes of each id of a model: nothing for control pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    said = [b"" if m.is_control(i) else " \u2047 ".encode() if m.is_unknown(i) else m.id_to_piece(i).encode() for i in range(m.get_piece_size())]
    for b in range(256):
        said[m.piece_to_id(f"<0x{b:02X}>")] = bytes([b])
    return pa.array(said, pa.large_binary())


def _decoder(path: str, keep: bool):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _spelled(path)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            _, place, data = spelled.take(ids.flatten()).buffers()
            ends = _ends(ids)
            bounds = np.frombuffer(place, np.int64)[ends].tolist() if place and place.size else [0] * (len(ids) + 1)
            data = data.to_pybytes() if data else b""
            none = ids.is_null().to_numpy(zero_copy_only=False)
            texts = [data[a:b].decode("utf-8", "replace").replace(BLANK, " ").removeprefix(" ") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            numbers = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(numbers[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [*batch.columns[:-1], *([ids] if keep else []), pa.array(texts, pa.string(), mask=none), pa.array(sums, pa.int64(), mask=none)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *([batch.schema.names[-1]] if keep else []), "text", "ids_crc32"])

    return decoded


def decode(samples: DataFrame, ids: str = "ids", path: str | None = None, keep: bool = True) -> DataFrame:
    """Adds text, which the column of ids spells, and ids_crc32, the CRC-32 of the ids as little-endian 32-bit numbers; without keep the ids
    themselves go. Bytes that aren't UTF-8 become U+FFFD, control pieces nothing, unknown ones " \u2047 "; null ids a null text and checksum; ids that
    the model doesn't have are an error; columns named text or ids_crc32 give way."""
    others = [c for c in samples.columns if c not in (ids, "text", "ids_crc32")]
    given = samples.select(*others, F.col(ids).cast("array<int>").alias(ids))
    own = [T.StructField("text", T.StringType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([f for f in given.schema.fields if keep or f.name != ids] + own)
    return given.mapInArrow(_decoder(path or model_path(), keep), schema)


def op9_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sample_segmentations(table(spark, sf_dir, "documents")).withColumn("n_pieces", F.size("ids").cast("long"))
    return decode(drawn, keep=False).select("doc_id", "sample", "n_pieces", "ids_crc32", "log_probability", "perturbed", "inclusion", F.sha2("text", 256).alias("text_sha256"))

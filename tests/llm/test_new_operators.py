"""MinHash join, spelling variants and periodic runs: the queries against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import minhash, ngram_join, registry, runs, shared, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, n long, h string, word string, root string, form string, kept string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id at all here"), (6, LONG), (7, LONG + " x"), (8, "a b c d e f g h i j k"), (9, "A B C D E F G H I J K"), (10, "ünï ©ödé 日本語 😀")]


@pytest.fixture(scope="module")
def docs(spark):
    shared.small_batches(spark)
    return spark.createDataFrame([(*r, 1, "h", "w", "r", "f", "k") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def components(sets, p):
    """(size, least reachable id) of each set by comparing all pairs that share a shingle."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in holders[s]).items():
            if 100 * n >= p * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def shingle_set(text, k=3):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_op11(spark, sf_dir, corpus):
    rows = registry.QUERIES["op11_minhash"](spark, sf_dir).collect()
    want = components({i: shingle_set(t) for i, t in corpus.items()}, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("tile", [2048, 4])
def test_op11_chains_and_long_lists(spark, monkeypatch, tile):
    """Near copies just above and below the threshold, chains of them and common passages; with small tiles lists are dealt in parts."""
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "POOLED", 4 if tile < 10 else 20_000)
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(4000)]
    texts = []
    for n in (7, 12, 40, 150):
        b = list(rng.choice(words, n))
        for cut in range(0, n // 4 + 1, max(1, n // 40)):
            texts += [" ".join(b[cut:]), " ".join(b[: n - cut] + list(rng.choice(words, cut)))]
    passage = " ".join(rng.choice(words, 60))
    texts += [f"{' '.join(rng.choice(words, 12))} {passage} {' '.join(rng.choice(words, 6))}" for _ in range(40)]
    want = components({i: shingle_set(t) for i, t in enumerate(texts)}, 85)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_op11_collisions_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for shared_part in (1000, 2500, 2900):
        b = np.concatenate((a[:shared_part], rng.integers(0, 1 << 62, 3000 - shared_part).astype(np.uint64)))
        s = minhash.signatures(np.concatenate((np.sort(a), np.sort(b))), np.repeat([0, 1], 3000), 2)
        jaccard = shared_part / (6000 - shared_part)
        assert abs((s[0] == s[1]).mean() - jaccard) < 4 * np.sqrt(jaccard * (1 - jaccard) / minhash.COORDINATES)


def test_op11_edges(docs):
    rows = minhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == sorted((i for i, _ in ROWS), key=lambda x: (x is None, x))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert got[6] == (29_998, 6, True) and got[7] == (29_999, 6, False) and got[9] == (9, 8, False) and got[None][1:] == (None, True)
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    assert ngram_join.P == 80  # the other join keeps its own threshold


def spelled(corpus, lost=199):
    """(word, form, root, n, n_near, form_n) by comparing each word with all strings it becomes by dropping or blanking a letter."""
    count = Counter()
    for d, text in corpus.items():
        for w in re.findall("[A-Za-zÀ-ÿ]+", text):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{d}:{w}".encode())
            if lost and h % lost == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if n >= 5 and len(w) >= 6}
    near, blank = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            blank[w[:i], w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in words:
                near[w].add(x)
                near[x].add(w)
    for same in blank.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


@pytest.mark.parametrize("most", [128, 4])
def test_op12(spark, sf_dir, corpus, monkeypatch, most):
    monkeypatch.setattr(spelling, "LIST", most)
    got = sorted(tuple(r) for r in registry.QUERIES["op12_spelling_variants"](spark, sf_dir).collect())
    assert got == spelled(corpus) and any(r[4] for r in got)


@pytest.mark.parametrize("most", [128, 3])
def test_op12_edits_and_chains(spark, monkeypatch, most):
    """All one-letter edits of accented, repeated and long words, ties of counts, and forms of forms."""
    monkeypatch.setattr(spelling, "LIST", most)
    rng = np.random.default_rng(8)
    words = {}
    for base in ("banana", "éèéèéè", "aaaaaaa", "÷×division", "straßen", "x" * 70, "abcdefghij"):
        words[base] = 4000
        for _ in range(25):
            w = base
            for _ in range(int(rng.integers(1, 4))):
                i, c = int(rng.integers(0, len(w))), "abeéz"[int(rng.integers(0, 5))]
                w = [w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]][int(rng.integers(0, 3))]
            if len(w) >= 6:
                words.setdefault(w, int(rng.choice([5, 5, 30, 200, 1000])))
    text = " ".join(" ".join([w] * n) for w, n in words.items())
    docs = spark.createDataFrame([(1, text), (2, None), (None, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in spelling.spelling_groups(spelling.vocabulary(docs)).collect())
    assert got == spelled({1: text}, None) and any(r[1] != r[2] for r in got if r[1])


def test_op12_edges(spark, docs):
    assert spelling.spelling_groups(spelling.vocabulary(docs.where("false"))).count() == 0
    many = docs.where("doc_id is null or doc_id < 5").crossJoin(spark.range(5)).select("doc_id", F.lit("ABCDEF Ébcdef abcde").alias("text"), "word", "root")
    got = {r["word"]: (r["n"], r["n_near"], r["root"]) for r in spelling.spelling_groups(spelling.vocabulary(many)).collect()}
    assert got == {"abcdef": (25, 1, "abcdef"), "Ébcdef": (25, 1, "Ébcdef")}


def all_runs(w):
    """(start, length, period) by walking along each period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def described(doc_id, text):
    w = WORD.findall(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found), " ".join(x for i, x in enumerate(w) if i not in drop)))
    return (doc_id, len(found), s, m, q, m and 1000 * m // q, *digests)


def test_op13(spark, sf_dir, corpus):
    got = sorted(tuple(r) for r in registry.QUERIES["op13_periodic_runs"](spark, sf_dir).collect())
    assert got == sorted(described(i, t) for i, t in corpus.items()) and any(r[1] for r in got)


def test_op13_runs_of_random_words():
    """Few different words, powers, powers of powers, and runs that touch, overlap or end with the text; with small grids too."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(800):
        w = [b"%d" % x for x in rng.integers(0, rng.choice([1, 2, 3, 6]), int(rng.integers(0, 70)))]
        for _ in range(int(rng.integers(0, 3))):
            a = int(rng.integers(0, len(w) + 1))
            w = w[:a] + w[a : a + int(rng.integers(1, 12))] * int(rng.integers(1, 8)) + w[a:]
        texts.append(w)
    for grid in (runs.GRID, 50):
        before, runs.GRID = runs.GRID, grid
        try:
            got = [list(zip(*(x.tolist() for x in r), strict=True)) for r in runs.runs_of(texts)]
        finally:
            runs.GRID = before
        assert got == [all_runs(w) for w in texts] and sum(map(len, got)) > 500


def test_op13_edges(spark, docs):
    rows = runs.periodic_runs(docs, runs.planted)
    got = {r["doc_id"]: r for r in rows.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows.count() == len(ROWS) and got[1]["collapsed_sha256"] == got[3]["runs_sha256"] == nothing and got[1]["start"] is None
    assert tuple(got[8])[1:] == described(8, ROWS[9][1])[1:] and tuple(got[6])[1:] == described(6, LONG)[1:]
    assert runs.periodic_runs(docs.where("false")).count() == 0
    said = spark.createDataFrame([(1, "x " * 50_000 + "end", "t"), (2, "a b  c", "t"), (None, None, "t")], "id long, text string, n string")
    assert {r["id"]: r["text"] for r in runs.without_repeats(said).collect()} == {1: "x end", 2: "a b  c", None: None}
    many = spark.createDataFrame([(1, "a b " * 100_000)], "doc_id long, text string")
    assert tuple(runs.periodic_runs(many).first())[:6] == (1, 1, 0, 200_000, 2, 100_000_000)

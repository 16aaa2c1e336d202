"""The registered queries against brute force over a whole small table."""

import base64
import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from compare import oracle_rows, spark_rows

from lexspan.llm import packing, quality, registry, sampling, shared, simhash, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def result(spark, sf_dir, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, sf_dir).collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == oracle_rows(registry.ORACLES[name], sf_dir)


def components(sets):
    """(size, least reachable id) of each document by comparing all pairs that share a shingle."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def shingle_set(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_op1(spark, sf_dir, docs):
    rows = result(spark, sf_dir, "op1_toxicity")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op1_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in result(spark, sf, "op1_toxicity") if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in rows]) > 0.9


def test_op1_scores_from_dense_cosines(spark):
    """Nearest examples, cosines and scores of the query from dense vectors over all examples, and how seldom the nearest is a tie."""
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(table, toxicity.teaching(spark, sf))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}

    def dense(x):
        out = np.zeros(len(model.terms) + 1)
        for t, w in model.vectors([x]):
            out[t] = w
        return out

    kinds = defaultdict(list)
    for i in sorted(toxic):
        kinds[tuple(np.round(dense(texts[i]), 9))].append(i)
    held = {min(own): (len(own), sum(toxic[i] for i in own)) for own in kinds.values()}
    first = np.array(sorted(held))
    matrix = np.array([dense(texts[i]) for i in first])
    rows = {r["doc_id"]: r for r in result(spark, sf, "op1_toxicity")}
    ties = 0
    for i in sorted(texts)[:400]:
        cos = matrix @ dense(texts[i])
        r, best = rows[i], np.sort(cos)[::-1]
        assert r["nearest_cosines"] == pytest.approx(best[:3].tolist(), abs=2e-6)
        if best[0] - best[1] > 1e-6:
            assert r["nearest_ids"][0] == first[np.argmax(cos)]
        ties += best[0] - best[1] < 1e-6
        if best[15] - best[16] > 1e-6:
            near = np.argsort(-cos)[:16]
            n, y = np.array([held[k] for k in first[near]], float).T
            weight = (1 + np.log(n)) * np.exp((cos[near] - best[0]) / toxicity.FADE)
            vote = (weight @ (y / n) + toxicity.PRIOR_WEIGHT * model.prior) / (weight.sum() + toxicity.PRIOR_WEIGHT)
            vote = min(1 - 1e-6, max(1e-6, vote))
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-model.slope * np.log(vote / (1 - vote)) - model.shift)), abs=1e-5)
    assert ties < 40


def test_op2(spark, sf_dir, docs):
    want = components({i: shingle_set(t) for i, t in docs.items()})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, sf_dir, "op2_ngram_jaccard_join")} == want


def test_op4(spark, sf_dir, docs):
    tokenizer = token_files.Encoder.open(token_files.tokenizer_path()).tokenizer
    start, want = 0, []
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i], add_special_tokens=False).ids, 1]
        want.append({"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    assert sorted(result(spark, sf_dir, "op4_token_files"), key=lambda r: r["doc_id"]) == want


def test_op5(spark, sf_dir, docs):
    order = sorted(docs)
    rows = {r["doc_id"]: r for r in result(spark, sf_dir, "op5_simhash_fingerprints")}
    text = [docs[i] for i in order]
    changed = [t[: len(t) - len(t) // 4] + text[(k + 1) % len(text)][: len(t) // 4] for k, t in enumerate(text)]
    own, new = simhash.fingerprints([t.encode() for t in text]), simhash.fingerprints([t.encode() for t in changed])
    for k, i in enumerate(order):
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text[k]), hashlib.sha256(changed[k].encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own[k].tobytes().hex(), new[k].tobytes().hex())
        assert r["near_next"] == pytest.approx(float(simhash.alike(own[k : k + 1], own[[(k + 1) % len(text)]])[0]))
    assert np.mean([r["near_edited"] - r["near_next"] for r in rows.values()]) > 0.15
    distinct = np.unique(own, axis=0)
    for k, i in enumerate(order):
        apart = np.bitwise_count(distinct ^ own[k]).sum(axis=1)
        assert rows[i]["n_within"] == (None if i % 100 else int((apart <= simhash.RADIUS).sum()) - 1)


def test_op5_votes_one_by_one(docs):
    """Fingerprints from a loop over terms and bits; a text alone has the same one as in a batch."""
    texts = [docs[i].encode() for i in sorted(docs)[:12]] + [b"", b"one", b"two words", b"a b a b a b a"]
    got = simhash.fingerprints(texts)
    for t, f in zip(texts, got, strict=True):
        assert (simhash.fingerprints([t])[0] == f).all()
        keys, _, count = shared.counted_shingles(shared.Words([t]), simhash.WIDTH)
        votes = [0] * simhash.BITS
        for key, c in zip(keys, count.tolist(), strict=True):
            weight = round(simhash.SCALE * (1 + math.log(c)))
            for word in range(simhash.BITS // 64):
                hashed = int(shared.mix(np.array([key ^ np.uint64(0xC2B2AE3D27D4EB4F * (word + 1) & (1 << 64) - 1)]))[0])
                for byte in range(8):
                    for bit in range(8):
                        votes[word * 64 + byte * 8 + bit] += weight if hashed >> 8 * byte + 7 - bit & 1 else -weight
        assert "".join(str(int(v > 0)) for v in votes) == "".join(f"{b:08b}" for b in f.tolist())


def test_op6(spark, sf_dir, docs):
    rows = result(spark, sf_dir, "op6_length_buckets")
    by = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == len(WORD.findall(docs[r["doc_id"]])) + 1 <= r["bucket_tokens"]
        by[r["bucket"]].append(r)
    for members in by.values():
        members.sort(key=lambda r: r["doc_id"])
        room = max(1, packing.BUDGET // members[0]["bucket_tokens"])
        assert [(r["batch"], r["slot"]) for r in members] == [(k // room, k % room) for k in range(len(members))]
    assert len(rows) == len(docs)


def stats(text):
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    again = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_op7(spark, sf_dir, docs):
    rows = result(spark, sf_dir, "op7_quality_rules")
    for r in rows:
        n, *rest = stats(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n) and not (r["kept"] and r["base_failed"])
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = [r["kept"] for r in rows if marks.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert np.mean(kept) > 0.95
    assert not any(r["kept"] for r in rows if not r["base_failed"] and r["quality_probability"] < 0.5)


def test_op7_verdicts_by_hand(spark, sf_dir, docs):
    """kept, from votes taken with plain Python and expectation-maximisation over one row a document."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = list(quality.rules())
    votes, failed = [], []
    for t in texts.values():
        n, chars, symbols, dup, again = stats(t)
        w, m = WORD.findall(t), max(n, 1)
        c, lines = max(chars, 1), sum(1 for x in t.split("\n") if WORD.search(x))
        windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
        twice = (len(windows) - len(set(windows))) / max(n - 4, 1)
        letters, upper, bangs = (len(regex.findall(x, t)) for x in (r"\p{L}", r"\p{Lu}", "!!"))
        ends = len(re.findall(r"[.?!:;。](?=[\x20\x09-\x0D]|\Z)", t))
        spread = len(set(w)) * min(n, 400) ** 0.5
        tests = {
            "symbols": (symbols / m > 0.25, symbols / m < 0.05), "symbol_share": (symbols / c > 0.05, symbols / c < 0.01), "letters": (letters / c < 0.8, letters / c > 0.9),
            "word_length": (chars / m < 2 or chars / m > 15, 3 <= chars / m <= 10), "duplicate_lines": (lines >= 3 and dup / lines > 0.3, lines >= 3 and dup / lines < 0.1),
            "repeated_words": (again / m > 0.2, n >= 20 and again / m < 0.1), "repeated_windows": (n >= 10 and twice > 0.1, n >= 20 and twice < 0.02),
            "few_words": (n >= 20 and spread < 4 * n, n >= 20 and spread > 6 * n), "capitals": (upper / c > 0.3, upper / c < 0.1), "shouting": (bangs / m > 0.1, bangs == 0),
            "sentences": (n >= 40 and (ends / m > 0.6 or ends == 0), n >= 10 and 0.01 <= ends / m <= 0.4),
        }
        votes.append([-1 if tests[k][0] else int(tests[k][1]) for k in names])
        failed.append(n < 10 or 100 * again > 20 * n)
    model = quality.expectation_maximisation(sorted((list(p), n) for p, n in Counter(map(tuple, votes)).items()), names)
    share, rate, votes = np.array(model["share"]), np.array(model["rate"]), np.array(votes)
    like = share * np.exp((votes < 0) @ np.log(rate).T + (votes > 0) @ np.log(1 - rate).T)
    want = dict(zip(texts, (like[:, 0] / like.sum(axis=1) >= 0.5) & ~np.array(failed), strict=True))
    assert {r["doc_id"]: r["kept"] for r in result(spark, sf, "op7_quality_rules")} == want


def test_op8(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = result(spark, sf_dir, "op8_html_text")
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]]["html"], re.S)[1]
        plain = re.sub(r"<[a-zA-Z/][^>]*\Z", "", re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?(?:p|h1)>", " ", inner)))
        assert r["text"] == " ".join(html.unescape(plain).split()) and r["n_chars"] == len(r["text"])


def test_op9(spark, sf_dir, docs):
    rows = result(spark, sf_dir, "op9_sampled_segmentations")
    assert Counter(r["doc_id"] for r in rows).keys() == docs.keys()
    pieces = sampling.Pieces.open(sampling.model_path(), 1.0)
    by = {(r["doc_id"], r["sample"]): r for r in rows}
    for i in sorted(docs)[:20]:
        drawn = sampling.Batch(pieces, [docs[i]], np.array([i])).samples(sampling.SAMPLES)[0]
        for k, (ids, log_p, value, _) in enumerate(drawn, 1):
            assert pieces.decode(ids) == docs[i]
            r = by[i, k]
            assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
            assert r["log_probability"] == pytest.approx(log_p) and r["perturbed"] == pytest.approx(value)


def test_op10(spark, sf_dir):
    pages = sorted((r["page_id"], r["url"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect())
    first, want = {}, []
    for i, url, body in pages:
        same = first.setdefault(body, i)
        want.append({"page_id": i, "url": url, "payload_bytes": len(body), "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode(), "record_type": "response" if same == i else "revisit", "refers_to": None if same == i else same})
    assert sorted(result(spark, sf_dir, "op10_warc"), key=lambda r: r["page_id"]) == want


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = frame.columns
    toxic = {r["doc_id"] for r in result(spark, sf_dir, "op1_toxicity") if r["predicted"]}
    a = corpus_pipeline.STAGES[0][1](spark, frame, sf_dir)
    assert a.columns == names and {r["doc_id"] for r in a.select("doc_id").collect()} == docs.keys() - toxic
    b = corpus_pipeline.STAGES[1][1](spark, a, sf_dir)
    stayed = {r["doc_id"]: r["text"] for r in b.collect()}
    assert b.columns == names and stayed.keys() <= docs.keys() - toxic
    assert all(n >= 10 and 100 * again <= 20 * n for n, *_, again in map(stats, stayed.values()))
    c = corpus_pipeline.STAGES[2][1](spark, b, sf_dir)
    want = {i for i, (_, root) in components({i: shingle_set(t) for i, t in stayed.items()}).items() if root == i}
    assert c.columns == names and {r["doc_id"] for r in c.select("doc_id").collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == want

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import chat, components, html_text, ngram_join, packing, quality, sampling, shared, simhash, token_files, toxicity, warc

DOCS = "doc_id long, text string, n long, h string, score double, bucket string, kept string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id at all here"), (6, LONG), (7, LONG + " x"), (8, "a b c d e f g h i j k"), (9, "A B C D E F G H I J K"), (10, "ünï ©ödé 日本語 😀")]


@pytest.fixture(scope="module")
def docs(spark):
    shared.small_batches(spark)
    return spark.createDataFrame([(*r, 1, "h", 0.5, "b", "k") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids(df):
    return sorted(([r["doc_id"] for r in df.collect()]), key=lambda x: (x is None, x))


ALL = sorted((i for i, _ in ROWS), key=lambda x: (x is None, x))


def test_near_duplicates(docs, none):
    rows = ngram_join.near_duplicates(docs).collect()
    assert ids(ngram_join.near_duplicates(docs)) == ALL
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == got[5] == (1, 4)
    assert got[6] == (29_996, 6) and got[7] == (29_997, 6) and got[9] == (7, 8) and got[None][1] is None
    assert ngram_join.near_duplicates(none).count() == 0
    assert ids(ngram_join.keep_one(docs)) == [1, 2, 3, 4, 6, 8, 10, None]
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_near_duplicate_chains_and_thresholds(spark):
    """Sets at and just below the threshold, chains, and common passages, against all pairs."""
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(4000)]
    texts, base = [], [list(rng.choice(words, n)) for n in (6, 9, 12, 24, 60, 150)]
    for b in base:
        for cut in range(0, len(b) // 3 + 1):
            texts.append(" ".join(b[cut:]))
            texts.append(" ".join(b[: len(b) - cut] + list(rng.choice(words, cut))))
    passage = " ".join(rng.choice(words, 55))
    texts += [f"{' '.join(rng.choice(words, 80))} {passage} {' '.join(rng.choice(words, 20))}" for _ in range(40)]
    from test_queries import components as brute
    from test_queries import shingle_set

    want = brute({i: shingle_set(t) for i, t in enumerate(texts)})
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def prefixes(keys, of, held):
    """What of each of two sets' prefixes is known after keys of one set alone are gone, as the join finds it."""
    k, o, below = ngram_join.block_keys(keys, of, 2)
    bands, _, _, owner, new = ngram_join._filled(keys, of, 2)
    filled = np.bincount(owner[new], minlength=len(bands.sets))
    shared = set(k[o == 0].tolist()) & set(k[o == 1].tolist())
    out = [set(), set()]
    for s, under, room in zip(bands.sets.tolist(), bands.is_below.tolist(), (bands.length - filled).tolist(), strict=True):
        own = sorted(shared & set(k[(o == s) & (below == under)].tolist()), key=lambda x: (held(x), x))
        out[s] |= set(own[: max(0, room + len(own))])
    return out


def test_prefixes_meet():
    """Any two sets within the threshold share a key of their prefixes, whatever the order of keys, also across bands and where blocks are empty."""
    rng = np.random.default_rng(0)
    for n in [*range(2, 40), 63, 64, 65, 127, 128, 300]:
        for _ in range(6):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            apart = ngram_join.most_apart(n, n)
            drop = int(rng.integers(0, apart + 1))
            b = np.concatenate((a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, apart - drop + 1))).astype(np.uint64)))
            if len(b) and 100 * (n - drop) >= 80 * (n + len(b) - (n - drop)):
                keys = np.concatenate((np.sort(a), np.sort(b)))
                of = np.repeat([0, 1], [len(a), len(b)])
                for held in (lambda x: 0, lambda x: x % 3, lambda x: -x):
                    left, right = prefixes(keys, of, held)
                    assert left & right


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (60, 61), (61, 62), (62, 60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {60: 60, 61: 60, 62: 60}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (4, None), (8, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scores = [s for s, _, _ in model.score([None, b"", b"one", LONG.encode()])]
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    kept = toxicity.keep_harmless(docs, labels).collect()
    assert toxicity.keep_harmless(docs, labels).columns == docs.columns and {r["doc_id"] for r in kept} >= {1, 2, 3, 8, 9}
    assert {(r["n"], r["h"], r["score"]) for r in kept} == {(1, "h", 0.5)}
    assert toxicity.keep_harmless(none, labels.where("false")).count() == 0


def test_toxicity_nearest_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, int(rng.integers(1, 9)), False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.Index(vectors, [0] * len(vectors), list(range(len(vectors))), 40)
    dense = np.zeros((len(vectors), 40))
    for g, (t, w) in enumerate(vectors):
        dense[index.of[g], t] = w
    for t, w in vectors[:60]:
        q = np.zeros(40)
        q[t] = w
        assert index.nearest(t, w, 16)[1] == pytest.approx(np.sort(dense[: len(index.n)] @ q)[::-1][:16])


def test_quality(spark, docs, none):
    rows = quality.with_stats(docs).collect()
    assert len(rows) == len(ROWS) and {r["doc_id"]: r["n_words"] for r in rows}[6] == 30_000
    assert [r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(none).count() == 0
    loop = spark.createDataFrame([(1, "a b c d e " * 4000)], "doc_id long, text string")
    assert quality.with_stats(loop).first()["n_repeat_words"] == 20_000
    stats = quality.with_stats(docs.select("doc_id", "text"))
    judged = quality.judge(stats.withColumn("kept", F.lit("clash")), quality.fit(stats))
    kept = sorted(r["doc_id"] or 0 for r in judged.collect() if r["kept"])
    assert sorted(r["doc_id"] or 0 for r in quality.keep_good(docs).collect()) == kept and 6 in kept


def test_repeats_of_a_very_long_text_are_exact(spark):
    """The only repeat is that of the first five words at the end."""
    long = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("concat(array_join(transform(sequence(1, 3000000), x -> concat('w', x)), ' '), ' w1 w2 w3 w4 w5')").alias("text"))
    r = quality.with_stats(long).first()
    assert (r["n_words"], r["n_repeat_words"]) == (3_000_005, 10)


def test_expectation_maximisation_against_arrays():
    """The loop over vote patterns gives what the same steps over one row a document give, and finds rates that votes were drawn with."""
    rng = np.random.default_rng(5)
    names = [k for own in quality.FAMILIES.values() for k in own]
    kind = rng.choice(4, 4000, p=[0.8, 0.1, 0.06, 0.04])
    true = np.full((4, len(names)), 0.03)
    for c, own in enumerate(quality.FAMILIES.values(), 1):
        true[c, [names.index(k) for k in own]] = 0.85
    votes = np.where(rng.random((4000, len(names))) < true[kind], -1, 1) * (rng.random((4000, len(names))) < 0.9)
    found = sorted((list(p), n) for p, n in Counter(map(tuple, votes.tolist())).items())
    model = quality.expectation_maximisation(found, names, rounds=30)
    first = np.full((4, len(names)), quality.OTHER)
    first[0] = quality.FALSE
    first[true > 0.5] = quality.HIT
    guess = np.array([quality.GOOD] + [(1 - quality.GOOD) / 3] * 3)
    share, rate = guess, first
    for _ in range(30):
        like = share * np.exp((votes < 0) @ np.log(rate).T + (votes > 0) @ np.log(1 - rate).T)
        post = like / like.sum(axis=1, keepdims=True)
        share = (post.sum(axis=0) + quality.WEIGHT * guess) / (len(votes) + quality.WEIGHT)
        rate = (post.T @ (votes < 0) + quality.WEIGHT * first) / (post.T @ (votes != 0) + quality.WEIGHT)
    assert np.array(model["share"]) == pytest.approx(share) and np.array(model["rate"]) == pytest.approx(rate)
    assert np.abs(rate - true).max() < 0.12
    like = share * np.exp((votes < 0) @ np.log(rate).T + (votes > 0) @ np.log(1 - rate).T)
    good = like[:, 0] / like.sum(axis=1) >= 0.5
    assert np.mean(good == (kind == 0)) > 0.97
    alone = (votes < 0).sum(axis=1) == 1
    assert good[alone].mean() > 0.5  # one vote against a document seldom decides


def test_chat(spark):
    turns = [("a<%|\nb", "x<%%|im_end|>\n<|y<"), ("assistant", "<"), ("assistant", "%|<|nl|><|im_end|>\n"), (None, None), ("gpt", "")]
    rows = spark.createDataFrame([(1, turns), (None, []), (2, None)], "id long, messages array<struct<role:string,content:string>>")
    out = {r["id"]: r for r in chat.read(chat.render(chat.canonical(rows, "id"))).collect()}
    assert out[1]["turns_read"] == out[1]["turns"] and out[1]["loss_text"] == "<%|<|nl|><|im_end|>\n"
    assert out[2]["layout"] is None and out[2]["formatted"] is None
    assert [t["role"] for t in out[1]["turns_read"]][-1] == "gpt"
    mixed = spark.createDataFrame([(1, "do", "with", "done", None), (2, "do", None, "done", None), (3, None, None, "r", "p")], "id long, instruction string, input string, output string, prompt string")
    assert [r["layout"] for r in chat.canonical(mixed, "id").orderBy("id").collect()] == ["instruction+input", "instruction", None]
    clash = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (None, None, None, None, "x")], "conv_id long, turn long, role string, text string, layout string")
    assert {r["conv_id"]: len(r["messages"]) for r in chat.as_messages(clash).collect()} == {1: 2, None: 1}


def test_chat_layouts_with_further_columns(spark):
    """Columns and leaves that no layout names don't count, alone or in mixed tables; null ends and empty arrays keep their layout."""
    for x in chat.LAYOUTS:
        kind = f"{x.many[0]} array<struct<{x.many[1]}:string,{x.many[2]}:string,name:string>>" if x.many else ", ".join(f"{p} string" for p in x.paths)
        body = ([("user", "a", "n"), ("assistant", None, None)],) if x.many else tuple("abc"[: len(x.paths)])
        got = chat.canonical(spark.createDataFrame([(1, *body, "web", 0.5)], f"id long, {kind}, source string, score double"), "id").first()
        assert got["layout"] == x.name and len(got["turns"]) == (2 if x.many else len(x.one))
    rows = [(1, [("user", "a")], None, None, "s"), (2, None, "p", "q", "s"), (3, None, "p", None, "s"), (4, [], None, None, "s"), (5, [], "p", "q", "s"), (6, None, None, None, "s")]
    got = chat.canonical(spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>, prompt string, completion string, source string"), "id")
    said = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in got.collect()}
    pair = ("prompt/completion", [("user", "p"), ("assistant", "q")])
    assert said == {1: ("messages", [("user", "a")]), 2: pair, 3: (pair[0], [("user", "p"), ("assistant", "")]), 4: ("messages", []), 5: pair, 6: (None, None)}


def test_token_files(spark, docs, none):
    uri = shared.fresh_dir(spark, "t")
    manifest = token_files.write_shards(docs, uri)
    rows = token_files.read_shards(spark, uri, manifest).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ALL
    encoder = token_files.Encoder.open(token_files.tokenizer_path())
    reader = token_files.Reader(uri)
    for i, t in ROWS:
        if i is not None:
            assert reader.ids(i).tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert reader.ids(12345) is None
    assert token_files.read_shards(spark, uri, token_files.write_shards(none, shared.fresh_dir(spark, "t"))).count() == 0
    odd = ["á b c", "x y\tz", "don't  STOP", "Σας ΟΔΟΣ x", "<|endoftext|> a<|startoftext|>b", "　日本語", "e ́x", "\x1c a\x1f b", "\r\n\ra", "İstanbul ǅ ß"]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(odd)] == [encoder.tokenizer.encode(o, add_special_tokens=False).ids for o in odd]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(10**12), 10**12, n))
    index = token_files.build_index(keys)
    assert sorted(index[2].tolist()) == list(range(len(keys)))
    assert (token_files.find(keys, *index) == np.arange(len(keys))).all()


def test_simhash(spark, docs, none):
    rows = simhash.with_next(docs).select("doc_id", "text", "_part", "_halo").mapInArrow(simhash._compare, simhash._SCHEMA).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ALL
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[1] == prints[2] == prints[3] and prints[4] == prints[5] and len(prints[1]) == simhash.BITS // 4
    assert simhash.with_next(none).count() == 0


def test_simhash_radius(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (6, 16), np.uint8)
    prints = []
    for b in base:
        for flips in range(0, 7):
            bits = np.unpackbits(b)
            bits[rng.choice(128, flips, False)] ^= 1
            prints.append(np.packbits(bits).tobytes().hex())
    df = spark.createDataFrame([(p,) for p in prints + prints[:3]], "fingerprint string")
    got = {(r["query"], r["found"]): r["distance"] for r in simhash.within(df, df, 3).collect()}
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert got == {(a, b): far(a, b) for a in set(prints) for b in set(prints) if far(a, b) <= 3}


def test_packing(docs, none):
    assert ids(packing.pack(docs)) == ALL and packing.pack(none).count() == 0
    rng = np.random.default_rng(0)
    for _ in range(40):
        m, k = int(rng.integers(1, 8)), int(rng.integers(1, 4))
        size, count = np.sort(rng.choice(30, m, False)) + 1, rng.integers(1, 9, m)
        pad = lambda ends: sum(min(e for e in ends if e >= s) * c for s, c in zip(size, count, strict=True))  # noqa: B023, E731
        best = min(pad([*s, size[-1]]) for r in range(min(k, m)) for s in itertools.combinations(size[:-1], r))
        assert pad(packing.boundaries(size.astype(float), count, k)) == best


def test_html():
    take = lambda source: html_text.article(html_text.parse(source)[0])
    page = '<html><body><header>Site</header><div id="cookie-notice">We use cookies</div><nav><a>x</a></nav><main><h1>T&eacute;</h1><p>One <b>two</b>&nbsp;three<br>four<div class="advert">buy</div><p>five</p><form><input>go</form><section class="comments"><p>lol</p></section></main><aside>side</aside><footer>f</footer>'
    assert take(page) == "Té One two three four five"
    assert take('<div class="menu"><a>a</a></div><div><h2>Head</h2><p>This is the body of it all.</p></div><script>if (a<b) "</div>"</script><div class=footer>bye bye</div>') == "Head This is the body of it all."
    assert take("<body><article><p>x &lt; y & z<p>unclosed<ul><li>one<li>two</ul></article><!-- c <p>no</p> --><p>after") == "x < y & z unclosed one two"
    assert take("") == "" and take("<p>cut <b") == "cut" and take("<article>" + "<b>" * 3000 + "deep") == "deep"


def test_html_names_inside_articles():
    """Ids, headings and inline elements of an article are no menus or notices; a form around the page isn't one either."""
    take = lambda source: html_text.article(html_text.parse(source)[0])
    parts = '<h2 id="search-history">Search</h2><section id="discussion"><p>We <span class="notice">note</span> that</p></section><h3 class="related">Work</h3>'
    gone = '<div id="comments"><p>lol</p></div><section class="comments"><p>lol</p></section><p class="advert">buy</p><form>go</form><p hidden>no</p>'
    assert take(f"<body><nav>x</nav><article>{parts}{gone}</article></body>") == "Search We note that Work"
    assert take(f'<body><form id="aspnetForm"><nav>x</nav><main>{parts}<form>go</form></main><footer>f</footer></form></body>') == "Search We note that Work"
    assert take('<body><form id="aspnetForm"><div class="menu">x</div><div><p>The whole body of this page.</p></div></form></body>') == "The whole body of this page."
    assert take("<body><p>Some words to be read here.</p><form><p>Your name</p></form></body>") == "Some words to be read here."


def test_html_templates(spark):
    """On a host without article elements, what all pages say is the template's and goes."""
    body = '<div id="top"><p>Welcome to this very fine site of ours</p></div><div class="text"><p>{}</p><p>{}</p></div>'
    said = [(f"page {i} tells a story of its own kind", f"and goes on for {i} more long lines") for i in range(6)]
    rows = [(i, "http://h.example/x", body.format(*s), "c") for i, s in enumerate(said)] + [(8, None, None, "c"), (0, "http://h.example/x", body.format(*said[0]), "c")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter([(i, " ".join(s)) for i, s in enumerate(said)] + [(8, ""), (0, " ".join(said[0]))])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _texts(spark, sources, url="http://h.example/x"):
    rows = [(i, url, s) for i, s in enumerate(sources)]
    return [r["text"] for r in sorted(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_html_templates_inside_articles(spark):
    """Inside an article, what the pages of a template repeat goes, by cluster of the host; copies of an article stay whole."""
    said = [f"story {i} is told here at length in so many words, and {i} times over" for i in range(12)]
    page = "<nav><a>x</a></nav><article><h1>Head {0}</h1><p>{1}</p><ul><li>{0}</li></ul><div><a>see {0}</a></div><p>Read our paper every day</p></article>"
    other = "<main><p>{1}</p><div>Printed in town</div></main>"
    sources = [page.format(i, said[i]) for i in range(9)] + [other.format(i, said[i]) for i in range(9, 12)]
    assert _texts(spark, sources) == [f"Head {i} {said[i]} {i}" for i in range(9)] + said[9:]
    copies = [f"<nav>{i}</nav><article><h1>Same</h1><p>{said[0]}</p><p>{said[1]}</p></article>" for i in range(4)]
    assert _texts(spark, copies) == [f"Same {said[0]} {said[1]}"] * 4


def test_deep_and_open_elements_lose_no_text():
    """Blocks nest as deep as they like, many inline elements stay open, and a paragraph ends whatever is open in it."""
    words = "last words of it that are long enough"
    for deep in (50, 450, 1500):
        page = "<body><article>" + "<div>" * deep + f"<p>first words here</p><p>{words}</p>" + "</div>" * deep + f"<p>after {deep}</p></article>"
        pieces, _ = html_text.parse(page)
        assert html_text.article(pieces) == f"first words here {words} after {deep}"
    page = "<body><article><p>" + "<b><i><u><s><em><q>" * 100 + f"one<p>{words}<p>three</article><footer>no</footer>"
    assert html_text.article(html_text.parse(page)[0]) == f"one {words} three"
    a, b = (html_text.parse(f'<body><div class="a b c {x}"><p>t</p></div>')[1] for x in "de")
    assert set(a) != set(b)


def test_warc(spark):
    rows = [(1, "http://a/%0A\n", "same", 0), (2, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (None, "u", "lone", 0), (5, "u", "WARC/1.1 \r\n\r\n <|" * 9000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long")
    uri = shared.fresh_dir(spark, "w")
    files = warc.write_archives(df, uri)
    for size in (97, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_archives(files, uri, size).collect()}
        assert len(got) == 6 and got[1]["url"] == rows[0][1] and got[2]["url"] is None
        assert {k: v["refers_to"] for k, v in got.items()} == {1: None, 2: 1, 3: None, 4: 3, None: None, 5: None}
        assert bytes(got[5]["payload"]) == rows[5][2].encode()
    whole = warc.write_archives(df, shared.fresh_dir(spark, "w"), min_bytes=1)
    assert whole.agg(F.sum("records")).first()[0] == 6
    assert warc.read_archives(warc.write_archives(df.where("false"), shared.fresh_dir(spark, "w")), uri).count() == 0


def test_sampling_is_without_replacement():
    pieces = sampling.Pieces.open(sampling.model_path(), 1.0)
    n = 20_000
    drawn = sampling.Batch(pieces, ["the cat"] * n, np.arange(n)).samples(2)
    first, both = Counter(), Counter()
    p = {}
    for mine in drawn:
        a, b = (tuple(x[0].tolist()) for x in mine)
        assert a != b
        first[a] += 1
        both[a, b] += 1
        p |= {tuple(x[0].tolist()): np.exp(x[1]) for x in mine}
    for a, b in itertools.permutations(sorted(p, key=p.get)[-3:], 2):
        assert both[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.012)
        assert first[a] / n == pytest.approx(p[a], abs=0.012)


def test_inclusion_scores():
    """Over many draws each segmentation counts with its probability when weighed by probability over inclusion."""
    pieces = sampling.Pieces.open(sampling.model_path(), 1.0)
    n = 20_000
    for k in (1, 2, 4):
        weighed, p = Counter(), {}
        for mine in sampling.Batch(pieces, ["the cat"] * n, np.arange(n) + 7).samples(k):
            for x in mine:
                s = tuple(x[0].tolist())
                p[s] = float(np.exp(x[1]))
                weighed[s] += p[s] / x[3]
        assert sum(weighed.values()) / n == pytest.approx(1, abs=0.02)
        for s in sorted(p, key=p.get)[-3:]:
            assert weighed[s] / n == pytest.approx(p[s], abs=0.02)


def test_all_segmentations_of_a_short_text():
    """With enough samples each path comes once, as brute force over the vocabulary finds them, with inclusion 1."""
    pieces = sampling.Pieces.open(sampling.model_path(), 1.0)
    said = sampling.BLANK + "ab" + sampling.BLANK + "cd"

    def paths(rest):
        if not rest:
            return [()]
        return [(pieces.ids[rest[:n]], *t) for n in range(1, len(rest) + 1) if rest[:n] in pieces.ids and (n == 1 or sampling.BLANK not in rest[1:n]) for t in paths(rest[n:])]

    want = paths(said)
    got = sampling.Batch(pieces, ["ab cd"], np.array([1])).samples(len(want) + 5)[0]
    assert sorted(tuple(x[0].tolist()) for x in got) == sorted(want) and {x[3] for x in got} == {1.0}
    assert sum(np.exp(x[1]) for x in got) == pytest.approx(1)
    assert [x[2] for x in got] == sorted((x[2] for x in got), reverse=True)


def test_sampling_does_not_depend_on_batches():
    pieces = sampling.Pieces.open(sampling.model_path(), 1.0)
    texts = ["the cat sat", "", "x", "on the  mat\n"]
    together = sampling.Batch(pieces, texts, np.arange(4)).samples(3)
    for i, t in enumerate(texts):
        alone = sampling.Batch(pieces, [t], np.array([i])).samples(3)[0]
        assert [(x[0].tolist(), *x[1:]) for x in alone] == [(x[0].tolist(), *x[1:]) for x in together[i]]


def test_decoding_as_the_library():
    pieces = sampling.Pieces.open(sampling.model_path(), 1.0)
    for t in ["the cat", "naïve 日本語 😀", "a  b"]:
        own = pieces.model.encode(t)
        assert pieces.decode(own) == pieces.model.decode(own)


def test_sampling_edges(spark, docs, none):
    rows = sampling.decode(sampling.sample_segmentations(docs)).collect()
    by = Counter(r["doc_id"] for r in rows)
    assert by[1] == by[2] == 1 and by[5] == 4 and by[6] == by[7] == 2
    assert all(r["text"] == (dict(ROWS)[r["doc_id"]] or "") for r in rows)
    assert sampling.sample_segmentations(none).count() == 0
    pieces = sampling.Pieces.open(sampling.model_path(), 1.0)
    for t in ["", "a", "  two  blanks ", "naïve\n日本語 😀 x\t", "z" * 300, "▁ ▁x", "end "]:
        for x in sampling.Batch(pieces, [t], np.array([5])).samples(3)[0]:
            assert pieces.decode(x[0]) == t.replace(sampling.BLANK, " ")


def test_decode(spark, docs, none):
    """Samples carry their ids, and decoding them gives the texts back."""
    texts = {1: "", 2: "  two  blanks ", 3: "naïve\n日本語 😀 x\t", 4: None}
    made = sampling.sample_segmentations(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3)
    rows = sampling.decode(made).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len({(r["doc_id"], *r["ids"]) for r in rows}) == len(rows) > 6
    for r in rows:
        assert r["text"] == (texts[r["doc_id"]] or "") and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    pieces = sampling.Pieces.open(sampling.model_path(), 1.0)
    given = [([pieces.byte_id[0xFF], pieces.ids["a"]],), ([pieces.model.unk_id(), pieces.model.bos_id()],), ([],), (None,)]
    got = sampling.decode(spark.createDataFrame(given, "mine array<int>").coalesce(1), "mine").collect()
    assert [r["text"] for r in got] == ["\ufffda", "\u2047 ", "", None] and [r["mine"] for r in got] == [x for x, in given]
    assert sampling.decode(sampling.sample_segmentations(none)).count() == 0


def test_registered_names():
    from lexspan.llm import registry

    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", ["related work", "search results", "share-of-market", "social policy", "notice period", "discussion", "widget-physics", "menu"])
def test_html_class_words_of_prose_are_overruled(name):
    """Inside an article a block whose class has such a word stays if it is prose, and goes if it is links or labels."""
    prose = "A full paragraph of the article that goes on for some words and says what it has to say."
    pieces, _ = html_text.parse(f'<article><p>First words of the text.</p><div class="{name}"><p>{prose}</p></div></article>')
    assert html_text.article(pieces) == f"First words of the text. {prose}"
    links = " ".join(f'<a href="/{k}">some other page {k}</a>' for k in range(9))
    for inner in (links, "<span>Share</span>"):
        pieces, _ = html_text.parse(f'<article><p>First words of the text.</p><div class="{name}">{inner}</div></article>')
        assert html_text.article(pieces) == "First words of the text."
    pieces, _ = html_text.parse(f'<article><p>First words of the text.</p><div class="comments"><p>{prose}</p></div><div class="ad"><p>{prose}</p></div></article>')
    assert html_text.article(pieces) == "First words of the text."


def test_html_parents_of_deep_paths():
    """The parent of a path that is told by a hash is the path that was hashed."""
    deep = "".join(f'<div class="{"x" * 300}{chr(97 + k)}">' for k in range(9))
    _, tags = html_text.parse(deep + "text")
    keys = {html_text.key(p) for p in tags}
    assert any(p.startswith("#") for p in tags) and all(html_text.parent(p) in keys | {html_text.key("")} for p in tags)

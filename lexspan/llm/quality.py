"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

DataFrame functions only. The one thing that reaches the driver is the histogram of vote patterns, whose size is
bounded by 3 ** 11, for the eleven rules, whatever the input.

A document is good or has one family of faults: noise, repetition or style. Several rules look at each family in different ways, so
their agreement tells how far each can be trusted: what all rules of a family say of a document counts, and a lone vote that the others
of its family contradict seldom decides. Rates are learnt freely, from a weak first guess.

Defined results: a null text counts as empty; documents without words fail the base rule; null ids are kept as null;
repeated rows are judged alike, each on its own; an empty table gives an empty result; extra columns pass through
`judge`, and a clash with a column that `judge` adds is resolved in favour of the added one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, empty_text, fresh_dir, table

WHITE = " \t\n\x0b\f\r"
SPLIT = "[ \t-\r]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Columns of the steps in between; an input's columns of these names, as those of the counts, give way.
_BETWEEN = ["_w", "_lines", "_win", "_room", "_s", "_again"]
_OWN = [*BASE, "n_lines", "n_upper", "n_ends", "n_bangs", "n_letters", "n_distinct", "n_windows_again"]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of _OWN as longs, from the whole text.

    Windows of five words are compared by 64-bit hashes. The windows of a text that has a repeat are sorted by the hash's upper bits with
    their place in the low bits; those beside an equal are sorted once more by the whole hash, and a repeated window then stands beside its equal.
    """
    t = empty_text(text)
    trimmed = F.btrim(t, F.lit(WHITE))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    a = docs.select(
        *[c for c in docs.columns if c not in (*_OWN, *_BETWEEN)],
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT)).alias("_w"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(t, SPLIT, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[.?!:;。](?=[\\x20\\x09-\\x0D]|$)")).cast("long").alias("n_ends"),
        F.regexp_count(t, F.lit("!!")).cast("long").alias("n_bangs"),
        F.regexp_count(t, F.lit("\\p{L}")).cast("long").alias("n_letters"),
    )
    window = F.transform("_w", lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, 5)]))
    b = a.select(
        *[c for c in a.columns if c not in ("_w", "_lines")],
        F.size("_w").cast("long").alias("n_words"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.when(F.size("_w") < 5, F.array().cast("array<bigint>")).otherwise(F.slice(window, 1, F.greatest(F.lit(1), F.size("_w") - 4))).alias("_win"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    #: A power of two above any place in the text.
    room = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(2), F.size("_win")).cast("double"))) + 1).cast("long")
    c = b.select("*", (F.size("_win") - F.size(F.array_distinct("_win"))).cast("long").alias("n_windows_again"), room.alias("_room"))
    packed = F.sort_array(F.transform("_win", lambda h, i: h.bitwiseAND(-F.col("_room")).bitwiseOR(i.cast("long"))))
    d = c.select("*", F.when(F.col("n_windows_again") > 0, packed).alias("_s"))
    head = lambda x: x.bitwiseAND(-F.col("_room"))
    beside = lambda x, i, k: F.coalesce(head(F.get("_s", i + k)) == head(x), F.lit(False))
    maybe = F.filter("_s", lambda x, i: beside(x, i, -1) | beside(x, i, 1))
    whole = F.transform(maybe, lambda x: F.struct(F.get("_win", x.bitwiseAND(F.col("_room") - 1).cast("int")).alias("h"), x.bitwiseAND(F.col("_room") - 1).alias("i")))
    e = d.select(*[x for x in d.columns if x not in ("_s", "_win", "_room")], F.sort_array(whole).alias("_again"))
    equal = lambda x, i, k: F.coalesce(F.get("_again", i + k)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_again", lambda x, i: equal(x, i, -1) | equal(x, i, 1)), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).cast("long").alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5).cast("long"), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return e.select(*[x for x in e.columns if x != "_again"], F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    """-1 against a document, 1 for it, 0 abstains."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    w, n, chars = "n_words", F.col("n_words"), "word_chars"
    windows = F.greatest(n - 4, F.lit(1))
    return {
        "symbols": _vote(_ratio("n_symbols", w) > 0.25, _ratio("n_symbols", w) < 0.05),
        "symbol_share": _vote(_ratio("n_symbols", chars) > 0.05, _ratio("n_symbols", chars) < 0.01),
        "letters": _vote(_ratio("n_letters", chars) < 0.8, _ratio("n_letters", chars) > 0.9),
        "word_length": _vote((_ratio(chars, w) < 2) | (_ratio(chars, w) > 15), _ratio(chars, w).between(3, 10)),
        "duplicate_lines": _vote((F.col("n_lines") >= 3) & (_ratio("n_dup_lines", "n_lines") > 0.3), (F.col("n_lines") >= 3) & (_ratio("n_dup_lines", "n_lines") < 0.1)),
        "repeated_words": _vote(_ratio("n_repeat_words", w) > 0.2, (n >= 20) & (_ratio("n_repeat_words", w) < 0.1)),
        "repeated_windows": _vote((n >= 10) & (F.col("n_windows_again") / windows > 0.1), (n >= 20) & (F.col("n_windows_again") / windows < 0.02)),
        "few_words": _vote((n >= 20) & (F.col("n_distinct") * F.sqrt(F.least(n, F.lit(400))) < 4 * n), (n >= 20) & (F.col("n_distinct") * F.sqrt(F.least(n, F.lit(400))) > 6 * n)),
        "capitals": _vote(_ratio("n_upper", chars) > 0.3, _ratio("n_upper", chars) < 0.1),
        "shouting": _vote(_ratio("n_bangs", w) > 0.1, F.col("n_bangs") == 0),
        "sentences": _vote((n >= 40) & ((_ratio("n_ends", w) > 0.6) | (F.col("n_ends") == 0)), (n >= 10) & _ratio("n_ends", w).between(0.01, 0.4)),
    }


#: The rules that look at each family of faults.
FAMILIES = {
    "noise": ("symbols", "symbol_share", "letters", "word_length"),
    "repetition": ("duplicate_lines", "repeated_words", "repeated_windows", "few_words"),
    "style": ("capitals", "shouting", "sentences"),
}
#: First guesses: the share of good documents; the rates of votes against good documents, against those of the rule's family, and of another one.
GOOD, FALSE, HIT, OTHER = 0.85, 0.02, 0.7, 0.1
#: What a first guess weighs, in documents.
WEIGHT = 10.0


def expectation_maximisation(found: list[tuple[list[int], int]], names: list[str], rounds: int = 200) -> dict:
    """Shares of the kinds (good, then the families) and by kind and rule the rate of votes against, of (votes, documents) patterns. An abstention says nothing."""
    kinds = range(len(FAMILIES) + 1)
    first = [[FALSE] * len(names)] + [[HIT if k in own else OTHER for k in names] for own in FAMILIES.values()]
    guess = [GOOD] + [(1 - GOOD) / len(FAMILIES)] * len(FAMILIES)
    share, rate = guess, first
    for _ in range(rounds):
        total = [WEIGHT * g for g in guess]
        bad, votes = [[WEIGHT * r for r in row] for row in first], [[WEIGHT] * len(names) for _ in kinds]
        for p, n in found:
            like = [share[c] * math.prod(rate[c][j] if v < 0 else 1 - rate[c][j] for j, v in enumerate(p) if v) for c in kinds]
            for c in kinds:
                q = n * like[c] / sum(like)
                total[c] += q
                for j, v in enumerate(p):
                    if v:
                        votes[c][j] += q
                        bad[c][j] += q * (v < 0)
        before, share = share, [t / sum(total) for t in total]
        rate = [[b / v for b, v in zip(*both, strict=True)] for both in zip(bad, votes, strict=True)]
        if max(abs(x - y) for x, y in zip(before, share, strict=True)) < 1e-9:
            break
    return {"share": share, "rate": rate, "rules": names}


def fit(stats: DataFrame) -> dict:
    """What expectation-maximisation finds over all rows of stats; with no rows the first guess stays."""
    names = list(rules())
    votes = stats.select(*[v.cast("int").alias(k) for k, v in rules().items()])
    found = [([r[k] for k in names], r["n"]) for r in votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]  # 3 ** 11 rows at most
    return expectation_maximisation(sorted(found), names)


def posterior(model: dict) -> Column:
    """The probability that a document with these votes is good."""
    votes = rules()

    def like(c: int) -> Column:
        out = F.lit(math.log(model["share"][c]))
        for j, k in enumerate(model["rules"]):
            r = model["rate"][c][j]
            out = out + F.when(votes[k] == -1, math.log(r)).when(votes[k] == 1, math.log(1 - r)).otherwise(0.0)
        return out

    good = like(0)
    bad = [F.exp(like(c) - good) for c in range(1, len(model["share"]))]
    return 1 / (1 + sum(bad[1:], bad[0]))


def judge(stats: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    out = stats.withColumns({"base_failed": base_failed(), "quality_probability": posterior(model)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpoint(with_stats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return judge(stats, fit(stats)).select("doc_id", *BASE, "base_failed", "kept", F.round("quality_probability", 6).alias("quality_probability"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the base rule and the posterior keep, with the columns they came with. The counts are made once, and wait beside their rows
    in a table of the shared folder until the model is known."""
    path = fresh_dir(docs.sparkSession, "counted")
    with_stats(docs.select(F.struct(*docs.columns).alias("_row"), "text")).drop("text").write.parquet(path)
    stats = docs.sparkSession.read.parquet(path)
    judged = judge(stats, fit(stats), threshold)
    return judged.where("kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])

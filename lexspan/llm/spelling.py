"""Spelling variants: words at one edit of each other, by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the word has it an odd number of times. One inserted, deleted or replaced letter flips two bits
at most, so of three bands of the mask one stays as it is: words are posted under each band's bits, together with the shorter length of the
pair they look for, which is the length filter. A list of more than LIST words is split by halves: of two words at one edit, the shorter of
length m, either the first m // 2 letters are the same or the last m - m // 2. What meets in a list is compared by masks, then by edit distance.

A word's form is its near word of largest count (ties: the smaller in code-point order) if that count is RATIO times its own; forms are
followed to their last by pointer doubling, for counts grow along them.

Defined results: null texts have no words; a null doc_id counts as an empty one; repeated rows count each time; an empty table gives an empty
result; further columns of the input are ignored. Texts are read whole; memory follows the longest text and PARTIAL words a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, small_batches, swept, table, text_bytes

LETTERS, MOST_OFTEN, RATIO = 6, 5, 5
#: One letter in so many (by its word's checksum) is lost in the query's texts.
LOST = 199
#: Words of a list that are compared with each other before it is split.
LIST = 128
#: Distinct words that a task counts before it hands them on.
PARTIAL = 500_000
#: Bits of a mask, and what bits each band has: letters side by side go to different bands.
BITS, BANDS = 63, 3
_RUN = re.compile("[a-z\xc0-\xff]+")


def _counted(lost: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id as text, text) to (word, n): partial counts of its runs of letters, A-Z in lower case."""
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                found = Counter(_RUN.findall((text or b"").lower().decode()))  # bytes: only A-Z change
                before = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in found.items():
                    if len(word) < LETTERS:
                        continue
                    if lost:
                        h = zlib.crc32(word.encode(), before)
                        if h % lost == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1 :]
                            if len(word) < LETTERS:
                                continue
                    total[word] += n
                if len(total) > PARTIAL:
                    yield _counts(total)
                    total = Counter()
        if total:
            yield _counts(total)

    return count


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, lost: int | None = None, least: int = MOST_OFTEN) -> DataFrame:
    """(word, n): the words of at least LETTERS letters that docs (doc_id, text) have at least so often. lost: see LOST."""
    small_batches(docs.sparkSession)
    parts = docs.selectExpr("cast(doc_id as string) as doc_id", "text").mapInArrow(_counted(lost), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def parity_mask(word: str) -> Column:
    """A bit for each letter of the column, set if it is there an odd number of times."""
    bit = "shiftleft(1L, cast(ascii(c) % {0} as int))".format(BITS)
    return F.expr(f"aggregate(filter(split({word}, ''), c -> c != ''), 0L, (m, c) -> m ^ {bit})")


def band(mask: Column, k: int) -> Column:
    return mask.bitwiseAND(F.lit(sum(1 << b for b in range(BITS) if b % BANDS == k)))


def _posted(words: DataFrame) -> DataFrame:
    """words (word, n) under each band (k, bits) and each length m of the shorter word of a pair it may be in."""
    masked = words.select("word", "n", F.length("word").alias("size"), parity_mask("word").alias("mask"))
    keys = [F.struct(F.lit(k).alias("k"), band(F.col("mask"), k).alias("bits"), (F.col("size") - less).alias("m")) for k in range(BANDS) for less in (0, 1)]
    return masked.select("*", F.explode(F.array(*keys)).alias("key")).select("word", "n", "size", "mask", "key.*")


def _split(posted: DataFrame) -> DataFrame:
    """posted with a part: empty in short lists; in long ones each word is under its first m // 2 letters and its last m - m // 2."""
    long_ones = posted.groupBy("k", "bits", "m").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > LIST)
    half = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), half)), F.concat(F.lit(">"), F.expr("right(word, m - cast(floor(m / 2) as int))")))
    sized = posted.join(long_ones, ["k", "bits", "m"], "left")
    return sized.select(*posted.columns, F.explode(F.when(F.col("held").isNull(), F.array(F.lit(""))).otherwise(halves)).alias("part"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each two words of words (word, n) at one edit, once, with their counts."""
    rows = _split(_posted(words))
    key = ["k", "bits", "m", "part"]
    left = rows.where("size = m").select(*key, *(F.col(c).alias(f"a_{c}") for c in ("word", "n", "mask")))
    right = rows.select(*key, *(F.col(c).alias(f"b_{c}") for c in ("word", "n", "mask", "size")))
    sizes = (F.col("b_size") > F.col("m")) | (F.col("a_word") < F.col("b_word"))
    flips = F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2
    met = left.join(right, key).where(sizes & flips & (F.levenshtein("a_word", "b_word", 1) == 1))
    return met.select(F.col("a_word").alias("a"), F.col("a_n").alias("an"), F.col("b_word").alias("b"), F.col("b_n").alias("bn")).distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """forms (word, form) to (word, root): each form's last one, by doubling; counts grow along forms, so there are no rings."""
    state = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = checkpoint(state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def spelling_groups(words: DataFrame) -> DataFrame:
    """words (word, n), each once: with form, root, n_near and form_n."""
    with swept(words.sparkSession):
        words = checkpoint(words)
        pairs = checkpoint(near_pairs(words))
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("on")).union(pairs.select("b", "a", "an"))
        best = F.min(F.struct((-F.col("on")).alias("less"), F.col("other").alias("other")))
        near = checkpoint(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")))
        joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("on"))
        often = F.col("on") >= RATIO * F.col("n")
        formed = checkpoint(joined.select("word", "n", "n_near", F.when(often, F.col("other")).alias("form"), F.when(often, F.col("on")).alias("form_n")))
        roots = _followed(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(vocabulary(table(spark, sf_dir, "documents"), LOST))

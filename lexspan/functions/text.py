"""Column functions over clause text: headers, identifiers, references, names and dates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def any_of(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, cv: F.when(cv[0], cv[1]).otherwise(rest), reversed(pairs), default)


def header_id(line: Column) -> Column:
    """The normalised id of a header line, null on any other line."""
    t = F.trim(line)
    got = lambda p: F.regexp_extract(t, p, 1)
    found = any_of(
        [
            (got(P.SCHEDULE) != "", F.lower(got(P.SCHEDULE))),
            (got(P.ARTICLE) != "", F.lower(got(P.ARTICLE))),
            (got(P.SECTION) != "", got(P.SECTION)),
            (got(P.DOTTED) != "", got(P.DOTTED)),
            (got(P.BARE) != "", got(P.BARE)),
        ],
        F.lit(None).cast("string"),
    )
    return F.when(t.rlike(P.HEADER_START), found)


def header_title(line: Column) -> Column:
    """The title of a header line, empty without one."""
    t = F.trim(line)
    found = any_of([(F.regexp_extract(t, p, 1) != "", F.trim(F.regexp_extract(t, p, 2))) for p in (P.SCHEDULE, P.ARTICLE, P.SECTION, P.DOTTED, P.BARE)], F.lit(""))
    return F.when(t.rlike(P.HEADER_START), found).otherwise("")


def parent_id(section_id: Column) -> Column:
    """12.1.1 to 12.1, 4.2(b) to 4.2, schedules and bare numbers to null."""
    return (
        F.when(F.lower(section_id).rlike("^(?:schedule|appendix|exhibit|article)"), F.lit(None).cast("string"))
        .when(section_id.rlike("\\([a-zA-Z]+\\)$"), F.regexp_replace(section_id, "\\([a-zA-Z]+\\)$", ""))
        .when(section_id.contains("."), F.regexp_replace(section_id, "\\.[^.]*$", ""))
    )


def normalize_ref(ref: Column) -> Column:
    """`Clause 12.1` to 12.1, `Schedule 4` to `schedule 4`, final dots gone."""
    r = F.regexp_replace(F.trim(ref), "\\.+$", "")
    return F.when(r.rlike(P.SCHEDULE_LIKE), F.regexp_replace(F.lower(r), "\\s+", " ")).otherwise(F.regexp_replace(r, "^(?i:clause|section|paragraph)\\s+", ""))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f uses it; a plain column of a lambda is computed anew at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hinted_refs(content: Column) -> Column:
    """Distinct normalised references of a text in order, each with the document named within HINT_CHARS behind its first occurrence, null without one.

    Bare clause 0 and those beyond the last plausible one are page numbers. A match is empty: the reference and what stands behind it are one group inside a look-ahead, so that the text
    is searched once. No reference begins inside another.
    """
    pattern = F.lit(f"(?i)(?=[cspae])(?<![\\p{{L}}\\p{{N}}_])(?=((?:{P.REFERENCE})[\\s\\S]{{0,{P.HINT_CHARS}}}))")
    hint = lambda text: F.trim(F.regexp_extract(text, P.DOCUMENT_HINT, 1), F.lit(" \t\n\r"))
    named = lambda text: bound(hint(text), lambda h: F.when(h != "", h))
    split = lambda x: bound(F.regexp_extract(x, f"^(?i:{P.REFERENCE})", 0), lambda said: F.struct(normalize_ref(said).alias("ref"), named(F.substr(x, F.length(said) + 1)).alias("hint")))
    bare = lambda r: r.rlike("^[0-9]+$")
    real = F.filter(F.transform(F.regexp_extract_all(content, pattern, F.lit(1)), split), lambda x: ~bare(x["ref"]) | F.try_to_number(x["ref"], F.lit("999999999")).between(1, P.LAST_BARE_CLAUSE))
    return bound(real, lambda r: bound(F.transform(r, lambda y: y["ref"]), lambda ids: F.filter(r, lambda x, k: F.array_position(ids, x["ref"]) == k + 1)))


def refs(content: Column) -> Column:
    """The references of hinted_refs alone."""
    return F.transform(hinted_refs(content), lambda x: x["ref"])


def words(text: Column) -> Column:
    """Distinct words in lower case, of letters and digits of any alphabet."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+"), lambda w: w != ""))


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}_\\s]", ""), "\\s+", " "))


def alias_key(name: Column) -> Column:
    """A name without articles, punctuation and company words; its tokens of three letters or more, or all if none is left."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^\\p{L}\\p{N}_\\s]", ""), "\\s+", " "), " "), lambda w: (w != "") & ~w.isin("the", "a", "an"))
    strong = F.filter(words, lambda w: ~w.isin(P.LEGAL_SUFFIXES) & (F.length(w) >= 3))
    return F.when(F.size(strong) > 0, F.array_join(strong, " ")).otherwise(F.array_join(words, " "))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(both > 0, F.size(F.array_intersect(tokens(a), tokens(b))) / both).otherwise(F.lit(0.0))


def document_type(text: Column) -> Column:
    return any_of([(text.rlike(p), F.lit(n)) for n, _, p in P.DOCUMENT_TYPES], F.lit("agreement"))


def document_rank(text: Column) -> Column:
    return any_of([(text.rlike(p), F.lit(r)) for _, r, p in P.DOCUMENT_TYPES], F.lit(1))


def functional_role(text: Column) -> Column:
    return any_of([(text.rlike(p), F.lit(n)) for n, p in P.ROLES], F.lit("standalone"))


def role_rank(role: Column) -> Column:
    return any_of([(role == k, F.lit(v)) for k, v in P.ROLE_RANK.items()], F.lit(1))


def confidence(sections: Column, pages: Column) -> Column:
    """How plausible the number of sections a page is."""
    density = sections / F.greatest(pages, F.lit(1))
    return F.when(sections == 0, 0.0).when(density < 0.3, 0.3).when(density > 8.0, 0.4).otherwise(0.9)


def node_id(kind: str, *parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(kind), *parts)), 1, 16)


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.substring(F.md5(F.concat(source, F.lit("-"), kind, F.lit("-"), target)), 1, 16)


def point_id(file_id: Column, section_id: Column) -> Column:
    """UUID version 5 of `file:section` in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(F.concat_ws(":", file_id, section_id), "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4).substr(F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def iso_date(text: Column) -> Column:
    """The first date of a text as YYYY-MM-DD: ISO, D Month YYYY (with ordinal) or D/M/YYYY; the calendar isn't checked."""
    two = lambda x: F.lpad(x, 2, "0")
    iso = F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    long = "(?i)([0-9]{1,2})(?:st|nd|rd|th)?\\s+(" + "|".join(_MONTHS) + ")\\s+([0-9]{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.regexp_extract(text, long, 2)))
    short = "([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})"
    at = lambda p, k: F.regexp_extract(text, p, k)
    return (
        F.when(iso != "", iso)
        .when(at(long, 1) != "", F.concat_ws("-", at(long, 3), two(month.cast("string")), two(at(long, 1))))
        .when(at(short, 1) != "", F.concat_ws("-", at(short, 3), two(at(short, 2)), two(at(short, 1))))
    )

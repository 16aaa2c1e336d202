"""The frames of contract.py as DuckDB common table expressions, written apart from the Spark side."""

from __future__ import annotations

from . import fixed as S
from .fixed import MIN_CONTENT, SUFFIXES


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def cases(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


#: Written out here again, so that a slip in the lists of the Spark side shows.
_TYPES = ", ".join(map(lit, S.CLAUSE_TYPES))
_RANKS = {"master_agreement": 0, "standalone": 0, "modification": 1, "transaction": 2, "termination": 3}
_HEADERS = (S.SCHEDULE, S.ARTICLE, S.SECTION, S.DOTTED, S.BARE)
_got = lambda p, k: f"regexp_extract(trim(line), {lit(p)}, {k})"


def name_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''))"


def parent(x: str) -> str:
    return cases([(f"regexp_matches(lower({x}), '^(schedule|appendix|exhibit|article)')", "NULL"), (f"regexp_matches({x}, '\\([a-zA-Z]+\\)$')", f"regexp_replace({x}, '\\([a-zA-Z]+\\)$', '')"), (f"contains({x}, '.')", f"regexp_replace({x}, '\\.[^.]*$', '')")], "NULL")


def ref(x: str) -> str:
    r = f"regexp_replace(trim({x}), '\\.+$', '')"
    return f"CASE WHEN regexp_matches({r}, {lit(S.SCHEDULE_LIKE)}) THEN regexp_replace(lower({r}), '\\s+', ' ', 'g') ELSE regexp_replace({r}, '^(?i:clause|section|paragraph)\\s+', '') END"


def role_rank(x: str) -> str:
    return cases([(f"{x} = {lit(k)}", str(v)) for k, v in _RANKS.items()], "1")


_CTES = {
    "lines": f"""
        SELECT conv, 'f' || doc_id AS file_id, doc_id, lang, p, p // 12 + 1 AS page,
               CASE WHEN p % 20 = 19 THEN 'Schedule ' || (p // 20 + 1) || ' - Terms'
                    WHEN p % 3 = 0 AND doc_id % 9 = 4 THEN 'PART ' || (p // 3 + 1) || ': ' || left(x, 60) || tail
                    WHEN p % 3 = 0 THEN ((p // 9) % 12 + 1) || '.' || ((p // 3) % 3 + 1) || '  ' || x || tail ELSE x || tail END AS line
        FROM (SELECT *, {cases([(f"(doc_id * 31 + p * 7) % 23 = {k}", lit(s)) for k, s in SUFFIXES.items()], "''")} AS tail
              FROM (SELECT doc_id, lang, source AS conv, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents))""",
    "headed": f"""
        SELECT *, COUNT(section_id) OVER w AS pos, last_value(CASE WHEN regexp_matches(section_id, {lit(S.SCHEDULE_LIKE)}) THEN section_id END IGNORE NULLS) OVER w AS schedule
        FROM (SELECT *, {cases([(f"{_got(p, 1)} <> ''", f"lower({_got(p, 1)})" if i < 2 else _got(p, 1)) for i, p in enumerate(_HEADERS)], "NULL")} AS section_id,
                     {cases([(f"{_got(p, 1)} <> ''", f"trim({_got(p, 2)})") for p in _HEADERS], "''")} AS title FROM lines)
        WINDOW w AS (PARTITION BY file_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "raw_sections": f"""
        SELECT *, {parent("section_id")} AS parent_id FROM (
            SELECT conv, file_id, doc_id, pos, max(section_id) AS section_id, arg_min(title, p) AS title, min(page) AS page, first(schedule ORDER BY p) AS schedule,
                   trim(string_agg(trim(line), chr(10) ORDER BY p), chr(10) || ' ') AS content
            FROM headed WHERE pos > 0 GROUP BY ALL) WHERE length(content) >= {MIN_CONTENT}""",
    "sections": f"""
        SELECT * EXCLUDE (n), list_value({_TYPES})[(doc_id * 7 + pos * 3) % 20 + 1] AS clause_type, (doc_id + pos) % 5 + 1 AS risk, regexp_matches(content, {lit(S.QUALIFIER)}) AS qualifier
        FROM (SELECT *, row_number() OVER (PARTITION BY file_id, section_id ORDER BY length(content) DESC, pos) AS n, min(pos) OVER (PARTITION BY file_id, section_id) AS first_pos FROM raw_sections) WHERE n = 1""",
    "files": f"""
        SELECT source AS conv, 'f' || doc_id AS file_id, doc_id,
               ['Framework Agreement ', 'Work Order ', 'Addendum ', 'Termination Notice ', 'Policy '][doc_id // 20 % 5 + 1] || doc_id AS file_name,
               ['master_agreement', 'transaction', 'modification', 'termination', 'standalone'][doc_id // 20 % 5 + 1] AS role,
               {role_rank("['master_agreement', 'transaction', 'modification', 'termination', 'standalone'][doc_id // 20 % 5 + 1]")} AS role_rank,
               CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER), '%Y-%m-%d') END AS effective_date,
               'person ' || (doc_id % 40) AS person, 'The ' || upper(lang) || ' Holdings Ltd' AS org FROM documents""",
    "crossrefs": f"""
        SELECT conv, file_id, doc_id, section_id, ref, first(hint ORDER BY k) AS hint FROM (
            SELECT * EXCLUDE (behind), nullif(trim(regexp_extract(behind, {lit(S.DOCUMENT_HINT)}, 1), ' ' || chr(9) || chr(10) || chr(13)), '') AS hint FROM (
                SELECT conv, file_id, doc_id, section_id, k, {ref("said[k]")} AS ref, left(array_to_string(list_transform(range(k, len(whole) + 1), lambda j: parts[j + 1] || coalesce(whole[j + 1], '')), ''), 100) AS behind
                FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM (
                    SELECT *, regexp_extract_all(content, {lit(S.REFERENCE)}) AS whole, regexp_extract_all(content, {lit(S.REFERENCE)}, 1) AS said, string_split_regex(content, {lit(S.REFERENCE)}) AS parts FROM sections))))
        WHERE ref <> section_id AND (NOT regexp_matches(ref, '^[0-9]+$') OR TRY_CAST(ref AS BIGINT) BETWEEN 1 AND {S.LAST_BARE_CLAUSE}) GROUP BY conv, file_id, doc_id, section_id, ref""",
}


def oracle(query: str, **more: str) -> str:
    """query over the frames and further expressions."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in {**_CTES, **more}.items()) + " " + query

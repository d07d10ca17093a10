"""The mapping of names in DuckDB's SQL, from names to decisions; what the queries on mapping are held against."""

from __future__ import annotations

from collections.abc import Sequence

from .functions.names import STOP_TOKENS
from .operators import mapping as M


def clean_sql(n: str) -> str:
    return f"replace(lower(substr(trim({n}), 1, 1) || regexp_replace(substr(trim({n}), 2), '([A-Z])', '_\\1', 'g')), ' ', '_')"


def normalized_sql(n: str) -> str:
    return f"trim(regexp_replace({clean_sql(n)}, '[^a-z0-9]+', '_', 'g'), '_')"


def tokens_sql(n: str) -> str:
    stop = ", ".join(f"'{t}'" for t in STOP_TOKENS)
    return f"list_filter(string_split({normalized_sql(n)}, '_'), lambda t: t <> '' AND t NOT IN ({stop}))"


def values_sql(names: Sequence[str]) -> str:
    """(place, name) of names given as text."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + ") v(place, name)"


#: Longest common part of a and b, the first of several in a and then in b, as length, 999 - start in a, 999 - start in b.
_LONGEST = (
    "list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda j: "
    "len(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda l: substr(a, i, l) = substr(b, j, l))) * 1000000 + (999 - i) * 1000 + 999 - j))))"
)


def decisions_sql(sources: str, references: Sequence[str], synonyms: dict[str, list[str]], threshold: float, epsilon: float) -> str:
    """CTEs that end in ``decided`` (source, status, target, score, candidates) and ``scored`` (all pairs).

    ``sources`` is a query for (place, name, is_number, detected). The recursion takes the longest common part of two
    names and goes on left and right of it, as the sequence ratio does.
    """
    table = ", ".join(f"('{k}', {v!r})" for k, v in synonyms.items())
    return f"""
WITH RECURSIVE src AS (SELECT place, name AS source, is_number, detected, {normalized_sql('name')} AS src_n, {tokens_sql('name')} AS src_t FROM ({sources})),
syn(k, al) AS (VALUES {table}),
refs AS (SELECT v.place AS ref_place, v.name AS ref, {normalized_sql('v.name')} AS ref_n, {tokens_sql('v.name')} AS ref_t FROM ({values_sql(references)}) v),
known AS (SELECT r.*, COALESCE(d.al, n.al, []::VARCHAR[]) AS aliases FROM refs r LEFT JOIN syn d ON d.k = r.ref LEFT JOIN syn n ON n.k = r.ref_n),
pairs AS (SELECT *, list_transform(aliases, lambda n: {normalized_sql('n')}) AS alias_n, {normalized_sql('detected')} AS det_n FROM src, known),
parts(x, y, a, b) AS (
  SELECT DISTINCT src_n, ref_n, src_n, ref_n FROM pairs
  UNION ALL
  SELECT x, y, unnest([substr(a, 1, i - 1), substr(a, i + l)]), unnest([substr(b, 1, j - 1), substr(b, j + l)])
  FROM (SELECT *, m // 1000000 AS l, 999 - (m // 1000) % 1000 AS i, 999 - m % 1000 AS j FROM (SELECT *, {_LONGEST} AS m FROM parts WHERE a <> '' AND b <> '')) WHERE l > 0
),
common AS (SELECT x, y, sum(COALESCE({_LONGEST}, 0) // 1000000) AS hits FROM parts GROUP BY x, y),
rated AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * hits::DOUBLE / (length(x) + length(y)) END AS seq FROM common),
scored AS (
  SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, base + dtype_boost + pattern_boost + length_penalty)) AS final FROM (
    SELECT *, greatest(exact, norm_exact, synonym, jaccard, seq) AS base FROM (
      SELECT place, source, ref_place, ref, seq,
        (CASE WHEN source = ref THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact, (CASE WHEN src_n = ref_n THEN {M.NORM_EXACT} ELSE 0.0 END)::DOUBLE AS norm_exact,
        (CASE WHEN list_contains(aliases, source) OR list_contains(alias_n, src_n) OR list_has_any(src_t, alias_n) THEN {M.SYNONYM} ELSE 0.0 END)::DOUBLE AS synonym,
        COALESCE(len(list_intersect(src_t, ref_t))::DOUBLE / nullif(len(list_distinct(list_concat(src_t, ref_t))), 0), 0.0::DOUBLE) AS jaccard,
        (CASE WHEN len(src_t) = 1 AND length(src_t[1]) <= 2 AND src_n <> ref_n THEN {M.SHORT_PENALTY} ELSE 0.0 END)::DOUBLE AS length_penalty,
        (CASE WHEN is_number THEN {M.DTYPE_BOOST} ELSE 0.0 END)::DOUBLE AS dtype_boost,
        (CASE WHEN det_n = ref_n OR list_contains(alias_n, det_n) THEN {M.CONTENT_BOOST} ELSE 0.0 END)::DOUBLE AS pattern_boost
      FROM pairs JOIN rated ON x = src_n AND y = ref_n))),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(final) OVER w AS next, lead(ref) OVER w AS next_ref FROM scored WINDOW w AS (PARTITION BY source ORDER BY final DESC, ref_place)),
decided AS (
  SELECT source, status, CASE WHEN status = 'mapped' THEN ref END AS target, CASE WHEN status = 'mapped' THEN round(final, 6) END AS score, CASE WHEN status = 'ambiguous' THEN c END AS candidates FROM (
    SELECT *, CASE WHEN final < {threshold}::DOUBLE THEN 'unmapped' WHEN COALESCE(final - next <= {epsilon}::DOUBLE, false) AND lower(ref) <> lower(next_ref) THEN 'ambiguous' ELSE 'mapped' END AS status
    FROM ranked JOIN (SELECT source AS s, list(ref ORDER BY rank) AS c FROM ranked WHERE rank <= {M.MAX_CANDIDATES} GROUP BY source) ON s = source WHERE rank = 1))
"""

"""Pieces of oracle SQL that several checks share. Spark code does not use them."""
from __future__ import annotations

from ..functions import fixed_values as fv


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {sql_text(w)})" for w in words) + ")"


def hit_count(expr: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({expr}, {sql_text(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def in_list(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(sql_text(v) for v in values)})"


def pairs(table: dict) -> str:
    return ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in table.items())


def title_words(c: str) -> str:
    """Capital after every non-letter, for plain ASCII words."""
    parts = f"string_split(regexp_replace({c}, '([^A-Za-z])', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({parts}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def half_up(total: str, n: str, digits: int) -> str:
    """total / n rounded half up, in whole-number arithmetic (both non-negative)."""
    scale = 10 ** digits
    return (f"CASE WHEN {n} > 0 THEN cast((2 * {scale} * cast({total} AS hugeint) + {n}) // (2 * {n}) AS double)"
            f" / {scale} END")


_SEGMENT = "regexp_extract(lower(url_scraped), '^https://[^/]*/([^/]*)', 1)"
CASE_CITY = "coalesce(" + ", ".join(
    f"CASE WHEN {_SEGMENT} = {sql_text(s)} OR prefix({_SEGMENT}, {sql_text(s + '-')}) THEN {sql_text(c)} END"
    for s, c in fv.CITY_BY_SLUG.items()) + ")"


#: Longest common run of two texts, the first one in x, then in y; the empty list has no first element, so null.
_LONGEST = """list_sort(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2),
    lambda n: {'less': -n, 'i': i, 'j': strpos(y, substr(x, i::INT, n::INT))}))), lambda s: s.j > 0))[1]"""

#: Needs `pairs` (a, b) and a recursive WITH. Around the longest common run the texts left and right of it are compared likewise.
RATIO_SQL = f"""
segments AS (
  SELECT a, b, a AS x, b AS y FROM (SELECT DISTINCT a, b FROM pairs)
  UNION ALL
  SELECT a, b, part.x, part.y FROM (
    SELECT a, b, unnest([{{'x': left(x, (m.i - 1)::INT), 'y': left(y, (m.j - 1)::INT)}}, {{'x': substr(x, (m.i - m.less)::INT), 'y': substr(y, (m.j - m.less)::INT)}}]) AS part
    FROM (SELECT a, b, x, y, {_LONGEST} AS m FROM segments) WHERE m IS NOT NULL)
  WHERE part.x <> '' AND part.y <> ''),
ratios AS (SELECT a, b, CASE WHEN a = '' AND b = '' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(sum(-(m.less)), 0) / (length(a) + length(b)) END AS ratio
  FROM (SELECT a, b, {_LONGEST} AS m FROM segments) GROUP BY a, b)"""

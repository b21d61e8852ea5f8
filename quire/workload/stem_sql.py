"""The stemming algorithm as DuckDB SQL: one common table a step, from ``words`` (term) to ``stems`` (term, stem)."""

from __future__ import annotations

from quire.functions.stem import AFTER_PLURAL, DOUBLES, STEP2, STEP3, STEP4, WHOLE


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _ending(suffixes) -> str:
    """The longest of ``suffixes`` that ends ``w``."""
    tests = " ".join(f"WHEN ends_with(w, '{s}') THEN '{s}'" for s in sorted(suffixes, key=len, reverse=True))
    return f"CASE {tests} ELSE '' END"


def _short(word: str) -> str:
    return f"regexp_matches({word}, '(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"


_CUT = "left(w, length(w) - length(e))"

STEMS = f""",
marked AS (
  SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE {_map(WHOLE)}[term] END AS fixed,
    array_to_string(list_transform(range(1, length(term) + 1), lambda i: CASE WHEN term[i] = 'y'
      AND (i = 1 OR term[i - 1] IN ('a', 'e', 'i', 'o', 'u', 'y')) THEN 'Y' ELSE term[i] END), '') AS w
  FROM words),
region1 AS (SELECT *, coalesce(nullif(length(regexp_extract(w, '^(?:gener|commun|arsen|.*?[aeiouy][^aeiouy])')), 0), length(w)) AS r1 FROM marked),
region2 AS (SELECT *, coalesce(r1 + nullif(length(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]')), 0), length(w)) AS r2 FROM region1),
plural AS (
  SELECT * EXCLUDE (e) REPLACE (CASE e WHEN 'sses' THEN left(w, length(w) - 2)
    WHEN 'ied' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN 'ies' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN 's' THEN CASE WHEN regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN left(w, length(w) - 1) ELSE w END
    ELSE w END AS w)
  FROM (SELECT *, {_ending(("sses", "ied", "ies", "us", "ss", "s"))} AS e FROM region2 WHERE fixed IS NULL)),
kept AS (SELECT term, fixed AS stem FROM region2 WHERE fixed IS NOT NULL
  UNION ALL SELECT term, w FROM plural WHERE w IN ({_list(AFTER_PLURAL)})),
past AS (
  SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(w) - length(e) >= r1 THEN b || 'ee' ELSE w END
    WHEN e = '' OR NOT regexp_matches(b, '[aeiouy]') THEN w
    WHEN right(b, 2) IN ('at', 'bl', 'iz') THEN b || 'e'
    WHEN right(b, 2) IN ({_list(DOUBLES)}) THEN left(b, length(b) - 1)
    WHEN r1 >= length(b) AND {_short("b")} THEN b || 'e' ELSE b END AS w)
  FROM (SELECT *, {_CUT} AS b FROM (SELECT *, {_ending(("eed", "eedly", "ed", "edly", "ing", "ingly"))} AS e
    FROM plural WHERE w NOT IN ({_list(AFTER_PLURAL)})))),
last_y AS (
  SELECT * REPLACE (CASE WHEN right(w, 1) IN ('y', 'Y') AND length(w) > 2 AND w[length(w) - 1] NOT IN ('a', 'e', 'i', 'o', 'u', 'y')
    THEN left(w, length(w) - 1) || 'i' ELSE w END AS w) FROM past),
derived AS (
  SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN e = '' OR length(b) < r1 OR (e = 'ogi' AND NOT ends_with(b, 'l'))
      OR (e = 'li' AND NOT regexp_matches(b, '[cdeghkmnrt]$')) THEN w ELSE b || {_map(STEP2)}[e] END AS w)
  FROM (SELECT *, {_CUT} AS b FROM (SELECT *, {_ending(STEP2)} AS e FROM last_y))),
further AS (
  SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN e = '' OR length(b) < r1 OR (e = 'ative' AND length(b) < r2) THEN w ELSE b || {_map(STEP3)}[e] END AS w)
  FROM (SELECT *, {_CUT} AS b FROM (SELECT *, {_ending(STEP3)} AS e FROM derived))),
residual AS (
  SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN e = '' OR length(b) < r2 OR (e = 'ion' AND right(b, 1) NOT IN ('s', 't')) THEN w ELSE b END AS w)
  FROM (SELECT *, {_CUT} AS b FROM (SELECT *, {_ending(STEP4)} AS e FROM further))),
stems AS (
  SELECT term, replace(CASE
    WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {_short("left(w, length(w) - 1)")})) THEN left(w, length(w) - 1)
    WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END, 'Y', 'y') AS stem FROM residual
  UNION ALL SELECT term, stem FROM kept)"""

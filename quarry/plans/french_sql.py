"""The French stemmer as DuckDB statements: the word map of the stemmed search's oracle."""

from __future__ import annotations

from quarry.functions import french as F

_V = "".join(sorted(F.VOWELS))


def _any(words) -> str:
    return "(" + "|".join(words) + ")$"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _cut(expr: str, n: int) -> str:
    return f"left({expr}, length({expr}) - {n})"


def _ends(expr: str, tail: str, region: str) -> str:
    return f"({expr} LIKE '%{tail}' AND length({expr}) - {len(tail)} >= {region})"


def stem_ctes(vocabulary: str) -> str:
    """``stems (w, stem)`` of the words ``w`` of a table."""
    vowel = lambda c: f"({c} <> '' AND contains('{_V}', {c}))"
    at_word = "cut >= r2"
    iv = f"CASE WHEN {_ends(_cut('head', 2), 'at', 'r2')} THEN {_cut('head', 4)} ELSE {_cut('head', 2)} END"
    return f"""stem_marks AS (SELECT w, replace(replace(list_reduce(list_transform(range(1, length(w) + 1), lambda i: substr(w, CAST(i AS INT), 2)),
    lambda acc, x: acc || CASE WHEN left(x, 1) = 'u' AND right(acc, 1) = 'q' THEN 'U'
      WHEN left(x, 1) IN ('u', 'i') AND {vowel('right(acc, 1)')} AND {vowel('substr(x, 2, 1)')} THEN upper(left(x, 1))
      WHEN left(x, 1) = 'y' AND ({vowel('right(acc, 1)')} OR {vowel('substr(x, 2, 1)')}) THEN 'Y' ELSE left(x, 1) END, ''),
    'ë', 'He'), 'ï', 'Hi') AS m FROM {vocabulary}),
stem_r1 AS (SELECT *, length(m) AS n, CASE WHEN regexp_matches(m, '^[{_V}][{_V}]|^(par|col|tap)') THEN least(3, length(m))
      WHEN regexp_matches(m, '^.[^{_V}]*[{_V}]') THEN length(regexp_extract(m, '^.[^{_V}]*[{_V}]')) ELSE length(m) END AS rv,
    CASE WHEN regexp_matches(m, '^[^{_V}]*[{_V}]+[^{_V}]') THEN length(regexp_extract(m, '^[^{_V}]*[{_V}]+[^{_V}]')) ELSE length(m) END AS r1
  FROM stem_marks),
stem_r2 AS (SELECT *, CASE WHEN regexp_matches(substr(m, r1 + 1), '^[^{_V}]*[{_V}]+[^{_V}]')
      THEN r1 + length(regexp_extract(substr(m, r1 + 1), '^[^{_V}]*[{_V}]+[^{_V}]')) ELSE n END AS r2,
    regexp_extract(m, '{_any(F.STEP1)}') AS s FROM stem_r1),
stem_s AS (SELECT *, n - length(s) AS cut, left(m, n - length(s)) AS head FROM stem_r2),
stem_1 AS (SELECT *, CASE
    WHEN s = '' THEN NULL
    WHEN s IN {_in(F.STEP1_DELETE)} THEN CASE WHEN {at_word} THEN head END
    WHEN s IN {_in(F.STEP1_ATION)} THEN CASE WHEN {at_word} THEN
      CASE WHEN {_ends('head', 'ic', 'r2')} THEN {_cut('head', 2)} WHEN head LIKE '%ic' THEN {_cut('head', 2)} || 'iqU' ELSE head END END
    WHEN s IN {_in(F.STEP1_LOG)} THEN CASE WHEN {at_word} THEN head || 'log' END
    WHEN s IN {_in(F.STEP1_U)} THEN CASE WHEN {at_word} THEN head || 'u' END
    WHEN s IN {_in(F.STEP1_ENT)} THEN CASE WHEN {at_word} THEN head || 'ent' END
    WHEN s IN {_in(F.STEP1_EMENT)} THEN CASE WHEN cut >= rv THEN CASE
      WHEN head LIKE '%iv' THEN CASE WHEN {_ends('head', 'iv', 'r2')} THEN {iv} ELSE head END
      WHEN head LIKE '%eus' THEN CASE WHEN {_ends('head', 'eus', 'r2')} THEN {_cut('head', 3)}
        WHEN {_ends('head', 'eus', 'r1')} THEN {_cut('head', 1)} || 'x' ELSE head END
      WHEN head LIKE '%abl' OR head LIKE '%iqU' THEN CASE WHEN length(head) - 3 >= r2 THEN {_cut('head', 3)} ELSE head END
      WHEN head LIKE '%ièr' OR head LIKE '%Ièr' THEN CASE WHEN length(head) - 3 >= rv THEN {_cut('head', 3)} || 'i' ELSE head END
      ELSE head END END
    WHEN s IN {_in(F.STEP1_ITE)} THEN CASE WHEN {at_word} THEN CASE
      WHEN head LIKE '%abil' THEN CASE WHEN {_ends('head', 'abil', 'r2')} THEN {_cut('head', 4)} ELSE {_cut('head', 2)} || 'l' END
      WHEN head LIKE '%ic' THEN CASE WHEN {_ends('head', 'ic', 'r2')} THEN {_cut('head', 2)} ELSE {_cut('head', 2)} || 'iqU' END
      WHEN {_ends('head', 'iv', 'r2')} THEN {_cut('head', 2)} ELSE head END END
    WHEN s IN {_in(F.STEP1_IF)} THEN CASE WHEN {at_word} THEN CASE WHEN {_ends('head', 'at', 'r2')} THEN
        CASE WHEN {_ends(_cut('head', 2), 'ic', 'r2')} THEN {_cut('head', 4)}
             WHEN {_cut('head', 2)} LIKE '%ic' THEN {_cut('head', 4)} || 'iqU' ELSE {_cut('head', 2)} END ELSE head END END
    WHEN s = 'eaux' THEN head || 'eau'
    WHEN s = 'aux' THEN CASE WHEN cut >= r1 THEN head || 'al' END
    WHEN s IN {_in(F.STEP1_EUSE)} THEN CASE WHEN {at_word} THEN head WHEN cut >= r1 THEN head || 'eux' END
    WHEN s IN {_in(F.STEP1_ISSEMENT)} THEN CASE WHEN cut >= r1 AND head <> '' AND NOT {vowel('right(head, 1)')} THEN head END
    WHEN s = 'amment' THEN CASE WHEN cut >= rv THEN head || 'ant' END
    WHEN s = 'emment' THEN CASE WHEN cut >= rv THEN head || 'ent' END
    ELSE CASE WHEN {vowel('right(head, 1)')} AND length(head) - 1 >= rv THEN head END END AS one FROM stem_s),
stem_2 AS (SELECT *, coalesce(one, m) AS w1, one IS NULL OR s IN ('amment', 'emment', 'ment', 'ments') AS go_on FROM stem_1),
stem_2a AS (SELECT *, regexp_extract(substr(w1, rv + 1), '{_any(F.STEP2A)}') AS sa, regexp_extract(substr(w1, rv + 1), '{_any(F.STEP2B)}') AS sb
  FROM stem_2),
stem_2b AS (SELECT *, sa <> '' AND length(w1) - length(sa) - 1 >= rv
      AND NOT contains('{_V}H', substr(w1, CAST(length(w1) - length(sa) AS INT), 1)) AS by_a, length(w1) - length(sb) AS atb FROM stem_2a),
stem_3 AS (SELECT *, CASE WHEN NOT go_on THEN w1 WHEN by_a THEN left(w1, length(w1) - length(sa)) WHEN sb = '' THEN w1
    WHEN sb = 'ions' THEN CASE WHEN atb >= r2 THEN left(w1, atb) ELSE w1 END
    WHEN sb IN {_in(F.STEP2B_E)} AND atb - 1 >= rv AND substr(w1, CAST(atb AS INT), 1) = 'e' THEN left(w1, atb - 1) ELSE left(w1, atb) END AS w2 FROM stem_2b),
stem_4 AS (SELECT *, CASE WHEN w2 LIKE '%s' AND length(w2) > 1 AND (w2 LIKE '%His' OR NOT contains('aiouès', substr(w2, CAST(length(w2) - 1 AS INT), 1)))
    THEN {_cut('w2', 1)} ELSE w2 END AS w3 FROM stem_3),
stem_5 AS (SELECT *, regexp_extract(substr(w3, rv + 1), '{_any(F.STEP4)}') AS s4, length(w3) - length(regexp_extract(substr(w3, rv + 1), '{_any(F.STEP4)}')) AS at4
  FROM stem_4),
stem_6 AS (SELECT w, CASE WHEN w2 <> m THEN CASE WHEN w2 LIKE '%Y' THEN {_cut('w2', 1)} || 'i' WHEN w2 LIKE '%ç' THEN {_cut('w2', 1)} || 'c' ELSE w2 END
    WHEN s4 = '' THEN w3 WHEN s4 = 'ion' THEN CASE WHEN at4 >= r2 AND at4 - 1 >= rv AND substr(w3, CAST(at4 AS INT), 1) IN ('s', 't')
      THEN left(w3, at4) ELSE w3 END
    WHEN s4 = 'e' THEN left(w3, at4) ELSE left(w3, at4) || 'i' END AS x FROM stem_5),
stem_7 AS (SELECT w, CASE WHEN regexp_matches(x, '{_any(F.DOUBLES)}') THEN {_cut('x', 1)} ELSE x END AS x FROM stem_6),
stems AS (SELECT w, replace(replace(replace(replace(replace(replace(regexp_replace(x, '[éè]([^{_V}]+)$', 'e\\1'),
    'He', 'ë'), 'Hi', 'ï'), 'H', ''), 'I', 'i'), 'U', 'u'), 'Y', 'y') AS stem FROM stem_7)"""

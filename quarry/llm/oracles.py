"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

# word lists and statistics of every whole text
_STATS = r"""d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS v
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, i - coalesce(before, -8))) AS n FROM twice GROUP BY doc_id),
s AS (SELECT w.doc_id, text, words, len(words) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id))"""


def _count(pattern: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))"


_RULES = [
    "n_symbols / greatest(n_words, 1) > 0.1",
    f"{_count('!')} / greatest(n_words, 1) > 0.1",
    rf"{_count(r'\p{Lu}')} / greatest({_count(r'\p{L}')}, 1) > 0.3",
    "word_chars / greatest(n_words, 1) > 15",
    rf"{_count(r'\p{L}')} / greatest(word_chars, 1) < 0.5",
    "(len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1) > 0.4",
    "n_words >= 2 AND len(list_filter(range(2, n_words + 1), lambda i: words[i] = words[i - 1])) / n_words > 0.3",
]

_BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

SQL = {
    "op4_quality_cascade": f"""WITH {_STATS}
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
       ({_BASE}) AS base_failed, NOT ({_BASE} OR {' OR '.join(f'({r})' for r in _RULES)}) AS kept FROM s""",
    # every window that starts at a shared shingle (or ends with the text), its best exact similarity
    "op7_benchmark_leaks": f"""WITH it AS (SELECT item_id, words, least(5, len(words)) AS n
              FROM (SELECT item_id, {_TERMS} AS words FROM benchmark) WHERE len(words) > 0),
dw AS (SELECT doc_id, {_TERMS} AS words FROM documents),
ish AS (SELECT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS v
        FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM it)),
ic AS (SELECT item_id, n, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY item_id) AS m FROM ish GROUP BY 1, 2, 3),
dsh AS (SELECT doc_id, i, words, len(words) - n + 1 AS total, n, array_to_string(words[i:i + n - 1], ' ') AS v
        FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM it))),
hit AS (SELECT d.doc_id, ic.item_id, d.i, d.total, d.v, ic.c, ic.m FROM dsh d JOIN ic ON d.v = ic.v AND d.n = ic.n),
st AS (SELECT DISTINCT doc_id, item_id, m, total, least(i, greatest(total - m + 1, 1)) AS s FROM hit),
shared AS (SELECT st.doc_id, st.item_id, st.s, st.m, least(st.m, st.total) AS width, h.v, least(count(*), any_value(h.c)) AS n
           FROM st JOIN hit h ON h.doc_id = st.doc_id AND h.item_id = st.item_id AND h.i >= st.s AND h.i < st.s + st.m
           GROUP BY ALL),
sim AS (SELECT doc_id, item_id, s, sum(n) / (any_value(m) + any_value(width) - sum(n)) AS similarity
        FROM shared GROUP BY doc_id, item_id, s)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity FROM sim GROUP BY 1, 2 HAVING max(similarity) >= 0.8""",
    "op11_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS hex FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
             CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                  THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
             coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
             coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""",
    # eight groups of 20 bits of the digest, four base32 signs each
    "op12_warc_packages": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, html, sha1(html) AS hex FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM s)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
         (CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS INT), 1)),
         '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM r""",
}

"""Registered ingestion, maintenance and string-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean_text, content_sha256, normalize_index_name, normalize_table_prefix
from quarry.operators.chunking import (chunk_records, dedup_by_hash, fixed_window_chunks, html_to_markdown,
                                       markdown_sections, merge_by_heading, merge_by_heading_across,
                                       recursive_chunks, token_pack)
from quarry.operators.margins import blocks_from_lines, remove_repeated_margins, repeated_margins
from quarry.operators.routing import document_ordinals, route_files, skip_imported
from quarry.operators.store import delete_documents, upsert
from quarry.plans.common import RECORDS_CTE
from quarry.sources.tables import read_table, records


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def fixed_window_chunks_q(spark: SparkSession, sf: str) -> DataFrame:
    c = fixed_window_chunks(_docs(spark, sf))
    return c.select("doc_id", "partition_number", "start", F.length("text").alias("chunk_len"),
                    content_sha256("text").alias("content_sha256"))


def chunk_records_q(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk_records(fixed_window_chunks(_docs(spark, sf)))
    return c.select("id", "parent_id", "name", "size", "partition_number", "section_number",
                    "mime_type", "content_sha256")


def dedup_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_by_hash(chunk_records(fixed_window_chunks(_docs(spark, sf))))


def recursive_chunks_q(spark: SparkSession, sf: str) -> DataFrame:
    c = recursive_chunks(_docs(spark, sf))
    return c.select("doc_id", "partition_number", F.length("text").alias("chunk_len"),
                    content_sha256("text").alias("content_sha256"))


def _sections(spark, sf):
    pages = read_table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), html_to_markdown("html").alias("text"))
    return markdown_sections(pages)


def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    s = _sections(spark, sf)
    return s.select(F.col("doc_id").alias("page_id"), "section_no", "header_1", "header_2", "header_3",
                    F.length("content").alias("content_len"),
                    content_sha256("content").alias("content_sha256"))


def merge_by_heading_q(spark: SparkSession, sf: str) -> DataFrame:
    m = merge_by_heading(_sections(spark, sf))
    return m.select(F.col("doc_id").alias("page_id"), "group_no", "heading",
                    F.length("content").alias("content_len"),
                    content_sha256("content").alias("content_sha256"))


MERGED_PART = 20_000  # characters of a part


def merge_across_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of all pages under each heading, in parts."""
    m = merge_by_heading_across(_sections(spark, sf), part_chars=MERGED_PART)
    return m.select("heading_no", "heading", "part", F.length("content").alias("content_len"),
                    content_sha256("content").alias("content_sha256"))


def document_ordinals_q(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a listing of files, numbered by path."""
    path = F.concat(F.lit("/in/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return document_ordinals(_docs(spark, sf).select(path.alias("path"))).select("path", "document_id")


def token_pack_q(spark: SparkSession, sf: str) -> DataFrame:
    t = token_pack(_sections(spark, sf), max_tokens=100)
    return t.select(F.col("doc_id").alias("page_id"), "section_no", "chunk_no", "n_tokens",
                    content_sha256("text").alias("content_sha256"))


def _blocks(spark, sf):
    return blocks_from_lines(_docs(spark, sf))


def common_margins(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_margins(_blocks(spark, sf))


def page_text_without_margins(spark: SparkSession, sf: str) -> DataFrame:
    p = remove_repeated_margins(_blocks(spark, sf))
    return p.select("doc_id", "page_no", F.length("text").alias("text_len"),
                    content_sha256("text").alias("text_sha256"))


#: Endings given to the page addresses by their id, so that every loader occurs.
_ENDINGS = ["", "/a.PDF", "/b.docx", "/c.pptx", "/d.xlsx", "/e.md?raw=1", "/f.txt", "/g.html#top", "/h.tar.gz", "/.env"]
NAMES_SQL = "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDINGS)) + " END"


def mime_routing(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", F.expr(f"concat(url, {NAMES_SQL})").alias("path"))
    r = route_files(pages, web=True)
    return r.select("page_id", "name", "suffix", "mime_type", "supported", "loader")


def skip_imported_q(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs(spark, sf).select(F.col("doc_id").alias("document_id"), "n_chars")
    ready = read_table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return skip_imported(files, ready)


def _incoming(spark, sf):
    lab = read_table(spark, sf, "labels")
    d = _docs(spark, sf)
    return (lab.join(d, "doc_id")
            .select(F.col("doc_id").cast("string").alias("id"),
                    F.lit(None).cast("array<float>").alias("embedding"),
                    F.array(F.concat(F.lit("quality:"), F.col("quality").cast("string")),
                            F.concat(F.lit("toxic:"), F.col("toxic").cast("string")),
                            F.concat(F.lit("__document_id:"), F.col("doc_id").cast("string"))).alias("tags"),
                    F.col("text").alias("content"),
                    F.lit(None).cast("string").alias("payload")))


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = upsert(records(spark, sf), _incoming(spark, sf))
    return out.select("id", F.array_join("tags", "|").alias("tags"), "payload",
                      F.length("content").alias("content_len"),
                      F.col("embedding").isNull().alias("no_embedding"))


def delete_toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    toxic = read_table(spark, sf, "labels").where("toxic = 1").select(
        F.col("doc_id").cast("string").alias("document_id"))
    return delete_documents(records(spark, sf), toxic).select("id")


def index_name_norm(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", normalize_index_name("p_name").alias("index_name"),
                    normalize_table_prefix("p_brand").alias("table_prefix"))


def clean_text_q(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", clean_text("text").alias("cleaned"))


def content_sha256_q(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", content_sha256("text").alias("content_sha256"))


_WINDOWS = """w AS (
  SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) > 0
         THEN 1 + CAST(ceil(greatest(length(text) - 1000, 0) / 800.0) AS BIGINT) ELSE 0 END)) AS k
  FROM documents),
c AS (SELECT doc_id, k AS partition_number, k * 800 + 1 AS start,
             substring(text, k * 800 + 1, 1000) AS chunk FROM w)"""

_MD = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  html, '(?is)<head\b.*?</head>', '', 'g'), '(?is)<script\b.*?</script>', '', 'g'),
  '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
  '(?i)<h1\b[^>]*>', chr(10) || '# ', 'g'), '(?i)<h2\b[^>]*>', chr(10) || '## ', 'g'),
  '(?i)<h3\b[^>]*>', chr(10) || '### ', 'g'), '(?i)</h[1-6]>', chr(10), 'g'),
  '(?i)<(?:p|div|br|li|tr|article|section|nav|footer|header|ul|ol|table)\b[^>]*>', chr(10), 'g'),
  '<[^>]*>', '', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;', '"', 'g'), '&#39;', '''', 'g'),
  '&nbsp;', ' ', 'g'), '&middot;', '·', 'g'), '&copy;', '©', 'g'), '&amp;', '&', 'g')"""

_SECTIONS = f"""md AS (SELECT page_id, {_MD} AS text FROM pages),
lines AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw,
                 unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM md),
l2 AS (SELECT page_id, ln, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM lines),
l3 AS (SELECT *, CASE WHEN length(regexp_extract(s, '^(#{{1,3}})(?: |$)', 1)) > 0
                      THEN length(regexp_extract(s, '^(#{{1,3}})(?: |$)', 1)) END AS lvl FROM l2),
l4 AS (SELECT *, CASE WHEN lvl IS NOT NULL THEN regexp_replace(substring(s, lvl + 1), '^\\s+|\\s+$', '', 'g') END AS h
       FROM l3),
l5 AS (SELECT *,
  last_value(CASE WHEN lvl = 1 THEN ln END IGNORE NULLS) OVER w AS p1,
  last_value(CASE WHEN lvl = 1 THEN h END IGNORE NULLS) OVER w AS t1,
  last_value(CASE WHEN lvl = 2 THEN ln END IGNORE NULLS) OVER w AS p2,
  last_value(CASE WHEN lvl = 2 THEN h END IGNORE NULLS) OVER w AS t2,
  last_value(CASE WHEN lvl = 3 THEN ln END IGNORE NULLS) OVER w AS p3,
  last_value(CASE WHEN lvl = 3 THEN h END IGNORE NULLS) OVER w AS t3
  FROM l4 WINDOW w AS (PARTITION BY page_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
content AS (SELECT page_id, ln, s AS line, t1 AS header_1,
   CASE WHEN coalesce(p2, -1) > coalesce(p1, -1) THEN t2 END AS header_2,
   CASE WHEN coalesce(p3, -1) > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END AS header_3
   FROM l5 WHERE lvl IS NULL AND s <> ''),
c2 AS (SELECT *, lag(ln) OVER (PARTITION BY page_id ORDER BY ln) AS prev_ln,
   CASE WHEN lag(ln) OVER (PARTITION BY page_id ORDER BY ln) IS NULL
          OR lag(header_1) OVER (PARTITION BY page_id ORDER BY ln) IS DISTINCT FROM header_1
          OR lag(header_2) OVER (PARTITION BY page_id ORDER BY ln) IS DISTINCT FROM header_2
          OR lag(header_3) OVER (PARTITION BY page_id ORDER BY ln) IS DISTINCT FROM header_3
        THEN 1 ELSE 0 END AS new_sec FROM content),
c3 AS (SELECT *, CAST(sum(new_sec) OVER (PARTITION BY page_id ORDER BY ln) - 1 AS BIGINT) AS section_no FROM c2),
sections AS (SELECT page_id, section_no, any_value(header_1) AS header_1, any_value(header_2) AS header_2,
   any_value(header_3) AS header_3,
   string_agg(CASE WHEN new_sec = 1 THEN '' WHEN prev_ln = ln - 1 THEN chr(10) ELSE '  ' || chr(10) END || line, ''
              ORDER BY ln) AS content
   FROM c3 GROUP BY page_id, section_no)"""

_BLOCKS = """bl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
               unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
blocks AS (SELECT doc_id, CAST(line_no // 10 AS BIGINT) AS page_no, line_no % 10 AS block_no,
                  regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text,
                  100.0 - (line_no % 10) * 10.0 AS top, 100.0 - (line_no % 10 + 1) * 10.0 AS bottom FROM bl),
common AS (SELECT DISTINCT doc_id, text FROM (
   SELECT doc_id, text, CASE WHEN top > 85.0 THEN 'top' WHEN bottom < 15.0 THEN 'bottom' END AS band
   FROM blocks WHERE text <> '') WHERE band IS NOT NULL GROUP BY doc_id, band, text HAVING count(*) >= 3),
ptext AS (SELECT p.doc_id, p.page_no, coalesce(string_agg(b.text, '' ORDER BY b.block_no), '') AS text
   FROM (SELECT DISTINCT doc_id, page_no FROM blocks) p
   LEFT JOIN (SELECT * FROM blocks b WHERE b.text <> ''
              AND NOT EXISTS (SELECT 1 FROM common c WHERE c.doc_id = b.doc_id AND c.text = b.text)) b
   ON b.doc_id = p.doc_id AND b.page_no = p.page_no
   GROUP BY p.doc_id, p.page_no)"""

_CLEAN_SQL = r"""array_to_string(list_filter(list_transform(
    regexp_split_to_array(array_to_string(list_transform(
        string_split(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), chr(10)),
        lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n\n+'),
    lambda p: replace(regexp_replace(p, '^\n+|\n+$', '', 'g'), chr(10), ' ')), lambda p: p <> ''), chr(10))"""

def _mime_sql() -> str:
    from quarry.functions.mime import EXTENSION_TYPES, LOADER_BY_TYPE, SUPPORTED_TYPES
    ext_map = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in EXTENSION_TYPES.items()) + "}"
    load_map = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LOADER_BY_TYPE.items()) + "}"
    sup = "(" + ", ".join(f"'{t}'" for t in SUPPORTED_TYPES) + ")"
    return f"""WITH n AS (
  SELECT page_id, regexp_extract(regexp_replace(concat(url, {NAMES_SQL}), '[?#].*$', ''), '([^/\\\\]*)$', 1) AS name FROM pages),
s AS (SELECT page_id, name, lower(coalesce(regexp_extract(name, '^.+?(\\.[^.]+)$', 1), '')) AS suffix FROM n),
m AS (SELECT page_id, name, suffix, {ext_map}[suffix] AS mime_type FROM s)
SELECT page_id, name, suffix, mime_type, coalesce(mime_type IN {sup}, false) AS supported,
       CASE WHEN coalesce(mime_type IN {sup}, false) THEN {load_map}[mime_type] END AS loader FROM m"""


# elements of a section are its lines (long ones cut into 100-word windows); packing walks
# them one by one
_TOKEN_PACK = f"""WITH RECURSIVE {_SECTIONS},
ln AS (SELECT page_id, section_no, i, regexp_replace(raw, '\\s+$', '', 'g') AS line FROM (
  SELECT page_id, section_no, unnest(string_split(content, chr(10))) AS raw,
         unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM sections)),
wl AS (SELECT *, regexp_split_to_array(trim(line), '\\s+') AS words FROM ln WHERE trim(line) <> ''),
pieces AS (SELECT *, unnest(range(0, CAST(ceil(len(words) / 100.0) AS BIGINT))) AS j FROM wl),
e AS (SELECT page_id, section_no, row_number() OVER (PARTITION BY page_id, section_no ORDER BY i, j) AS k,
             CASE WHEN len(words) <= 100 THEN line
                  ELSE array_to_string(words[j * 100 + 1:j * 100 + 100], ' ') END AS text,
             least(len(words) - j * 100, 100) AS n FROM pieces),
walk AS (
  SELECT page_id, section_no, k, n AS total, 0 AS chunk_no FROM e WHERE k = 1
  UNION ALL
  SELECT e.page_id, e.section_no, e.k, CASE WHEN w.total + e.n <= 100 THEN w.total + e.n ELSE e.n END,
         CASE WHEN w.total + e.n <= 100 THEN w.chunk_no ELSE w.chunk_no + 1 END
  FROM walk w JOIN e ON e.page_id = w.page_id AND e.section_no = w.section_no AND e.k = w.k + 1)
SELECT page_id, section_no, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(sum(n) AS BIGINT) AS n_tokens,
       sha256(string_agg(text, chr(10) ORDER BY k)) AS content_sha256
FROM walk JOIN e USING (page_id, section_no, k) GROUP BY page_id, section_no, chunk_no"""

def _recursive_sql(size: int, overlap: int) -> str:
    """Pieces level by level; each run of short pieces is walked piece by piece."""
    from quarry.operators.chunking import BLANKS, SEPARATORS

    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    levels, shorts = [], []
    for k, sep in enumerate(SEPARATORS[:SEPARATORS.index("")]):
        s = " || ".join(f"chr({ord(c)})" for c in sep)
        levels.append(f"""p{k} AS (SELECT doc_id, path, i, CASE WHEN i = 1 THEN x ELSE {s} || x END AS piece FROM (
  SELECT doc_id, path, unnest(string_split(text, {s})) AS x, unnest(range(1, len(string_split(text, {s})) + 1)) AS i
  FROM open{k} WHERE contains(text, {s})) WHERE i > 1 OR x <> ''),
q{k} AS (SELECT *, sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, path ORDER BY i) AS run FROM p{k}),
open{k + 1} AS (SELECT doc_id, path, text FROM open{k} WHERE NOT contains(text, {s})
  UNION ALL SELECT doc_id, list_append(path, i), piece FROM q{k} WHERE length(piece) >= {size})""")
        shorts.append(f"SELECT doc_id, path, run, i, piece FROM q{k} WHERE length(piece) < {size}")
    return f"""WITH RECURSIVE open0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text FROM documents WHERE text <> ''),
{", ".join(levels)},
short AS (SELECT *, length(piece) AS n, row_number() OVER w AS k, min(i) OVER (PARTITION BY doc_id, path, run) AS first_i,
                 CAST(coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum
          FROM ({" UNION ALL ".join(shorts)}) WINDOW w AS (PARTITION BY doc_id, path, run ORDER BY i)),
sp AS (SELECT *, min(k) OVER (PARTITION BY doc_id, path, run ORDER BY cum RANGE BETWEEN least({overlap}, {size} - n) PRECEDING AND CURRENT ROW) AS jump
       FROM short),
walk AS (
  SELECT doc_id, path, run, k, 1 AS first, cum AS cum_first, CAST(NULL AS BIGINT) AS done FROM sp WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.path, p.run, p.k, CASE WHEN p.cum - w.cum_first + p.n > {size} THEN greatest(w.first, p.jump) ELSE w.first END,
         CASE WHEN p.cum - w.cum_first + p.n > {size} THEN greatest(w.cum_first, j.cum) ELSE w.cum_first END,
         CASE WHEN p.cum - w.cum_first + p.n > {size} THEN w.first END
  FROM walk w JOIN sp p ON p.doc_id = w.doc_id AND p.path = w.path AND p.run = w.run AND p.k = w.k + 1
  JOIN sp j ON j.doc_id = p.doc_id AND j.path = p.path AND j.run = p.run AND j.k = p.jump),
spans AS (SELECT doc_id, path, run, done AS first, k - 1 AS last FROM walk WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, path, run, arg_max(first, k), max(k) FROM walk GROUP BY 1, 2, 3),
packed AS (SELECT s.doc_id, list_append(s.path, any_value(p.first_i)) AS place, s.last AS seq, string_agg(p.piece, '' ORDER BY p.k) AS text
  FROM spans s JOIN sp p ON p.doc_id = s.doc_id AND p.path = s.path AND p.run = s.run AND p.k BETWEEN s.first AND s.last
  GROUP BY s.doc_id, s.path, s.run, s.first, s.last),
wins AS (SELECT doc_id, path AS place, k AS seq, substring(text, k * {size - overlap} + 1, {size}) AS text FROM (
  SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - {size}) / {size - overlap}.0) AS BIGINT)))) AS k FROM open{len(levels)})),
chunks AS (SELECT doc_id, place, seq, trim(text, {blanks}) AS text FROM (SELECT * FROM packed UNION ALL SELECT * FROM wins))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, seq) - 1 AS partition_number, length(text) AS chunk_len,
       sha256(text) AS content_sha256 FROM chunks WHERE text <> ''"""


SQL = {
    "recursive_chunks": _recursive_sql(1000, 200),
    "token_pack": _TOKEN_PACK,
    "fixed_window_chunks": f"""WITH {_WINDOWS}
SELECT doc_id, partition_number, start, length(chunk) AS chunk_len, sha256(chunk) AS content_sha256 FROM c""",
    "chunk_records": f"""WITH {_WINDOWS}
SELECT md5(CAST(doc_id AS VARCHAR) || '/' || CAST(partition_number AS VARCHAR)) AS id,
       CAST(doc_id AS VARCHAR) AS parent_id,
       CAST(doc_id AS VARCHAR) || '.partition.' || CAST(partition_number AS VARCHAR) || '.txt' AS name,
       length(chunk) AS size, partition_number, CAST(0 AS BIGINT) AS section_number, 'text/plain' AS mime_type,
       sha256(chunk) AS content_sha256 FROM c""",
    "dedup_chunks": f"""WITH {_WINDOWS}
SELECT sha256(chunk) AS content_sha256,
       min(md5(CAST(doc_id AS VARCHAR) || '/' || CAST(partition_number AS VARCHAR))) AS id,
       count(*) AS n_copies FROM c GROUP BY 1""",
    "heading_sections": f"""WITH {_SECTIONS}
SELECT page_id, section_no, header_1, header_2, header_3, length(content) AS content_len,
       sha256(content) AS content_sha256 FROM sections""",
    "merge_by_heading": f"""WITH {_SECTIONS},
g AS (SELECT page_id, coalesce(header_1, header_2, header_3, 'No_Heading') AS heading,
             min(section_no) AS first, string_agg(content, chr(10) ORDER BY section_no) AS content
      FROM sections GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS group_no, heading,
       length(content) AS content_len, sha256(content) AS content_sha256 FROM g""",
    "merge_across_documents": f"""WITH {_SECTIONS},
p AS (SELECT *, coalesce(header_1, header_2, header_3, 'No_Heading') AS heading, length(content) + 1 AS n FROM sections),
s AS (SELECT *, (sum(n) OVER (PARTITION BY heading ORDER BY page_id, section_no) - n) // {MERGED_PART} AS slot FROM p),
g AS (SELECT heading, slot, string_agg(content, chr(10) ORDER BY page_id, section_no) AS content FROM s GROUP BY 1, 2),
f AS (SELECT heading, row_number() OVER (ORDER BY page_id, section_no) - 1 AS heading_no FROM (
  SELECT heading, page_id, section_no, row_number() OVER (PARTITION BY heading ORDER BY page_id, section_no) AS i FROM p) WHERE i = 1)
SELECT heading_no, heading, row_number() OVER (PARTITION BY heading ORDER BY slot) - 1 AS part,
       length(content) AS content_len, sha256(content) AS content_sha256 FROM g JOIN f USING (heading)""",
    "document_ordinals": """WITH p AS (SELECT '/in/' || coalesce(source, '') || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents)
SELECT path, 'doc' || CAST(row_number() OVER (ORDER BY path) - 1 AS VARCHAR) AS document_id FROM p""",
    "common_margins": f"WITH {_BLOCKS}\nSELECT doc_id, text FROM common",
    "page_text_without_margins": f"""WITH {_BLOCKS}
SELECT doc_id, page_no, length(text) AS text_len, sha256(text) AS text_sha256 FROM ptext""",
    "mime_routing": _mime_sql(),
    "skip_imported": """SELECT doc_id AS document_id, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "upsert_merge": f"""WITH {RECORDS_CTE},
inc AS (SELECT CAST(l.doc_id AS VARCHAR) AS id,
               ['quality:' || CAST(l.quality AS VARCHAR), 'toxic:' || CAST(l.toxic AS VARCHAR),
                '__document_id:' || CAST(l.doc_id AS VARCHAR)] AS tags,
               '{{}}' AS payload, length(replace(d.text, chr(0), '')) AS content_len, true AS no_embedding
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT id, array_to_string(tags, '|') AS tags, payload, length(content) AS content_len,
       embedding IS NULL AS no_embedding FROM records
WHERE id NOT IN (SELECT id FROM inc)
UNION ALL SELECT id, array_to_string(tags, '|'), payload, content_len, no_embedding FROM inc""",
    "delete_toxic_documents": f"""WITH {RECORDS_CTE}
SELECT id FROM records WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
    "index_name_norm": r"""SELECT p_partkey,
  CASE WHEN length(trim(p_name)) > 0 THEN regexp_replace(lower(trim(p_name)), '[\s|\\/._:]', '-', 'g') END AS index_name,
  coalesce(CASE WHEN length(trim(p_brand)) > 0 THEN regexp_replace(lower(trim(p_brand)), '[\s|\\/._:]', '-', 'g') END, '') AS table_prefix
FROM part""",
    "clean_text": f"SELECT conv_id, turn, {_CLEAN_SQL} AS cleaned FROM conversations",
    "content_sha256": "SELECT doc_id, sha256(text) AS content_sha256 FROM documents",
}

QUERIES = {
    "fixed_window_chunks": fixed_window_chunks_q,
    "chunk_records": chunk_records_q,
    "recursive_chunks": recursive_chunks_q,
    "dedup_chunks": dedup_chunks,
    "heading_sections": heading_sections,
    "merge_by_heading": merge_by_heading_q,
    "merge_across_documents": merge_across_documents,
    "document_ordinals": document_ordinals_q,
    "token_pack": token_pack_q,
    "common_margins": common_margins,
    "page_text_without_margins": page_text_without_margins,
    "mime_routing": mime_routing,
    "skip_imported": skip_imported_q,
    "upsert_merge": upsert_merge,
    "delete_toxic_documents": delete_toxic_documents,
    "index_name_norm": index_name_norm,
    "clean_text": clean_text_q,
    "content_sha256": content_sha256_q,
}

"""Document -> chunk rows.

* ``fixed_window_chunks`` - overlapping character windows, pure Column math
  (``sequence`` + ``explode`` + ``substring``).
* ``recursive_chunks`` - separator-recursive packing with overlap (the plain
  text loader's splitter): one fold per separator over the texts that are still
  too long, inside the row.  ``split_recursive`` is the same for one string.
* ``markdown_sections`` - heading-aware sections computed with windows over
  the exploded lines of each document.
* ``merge_by_heading`` - sections of a document regrouped by first heading;
  ``merge_by_heading_across`` - those of all documents, in parts of bounded size.
* ``chunk_records`` - chunk rows described like generated partition files.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import content_sha256
from quarry.operators.ordering import row_numbers
from quarry.session import scratch_path

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
# Separator order of the plain-text splitter. "" (single
# characters) comes before " ", so " " is never reached.
SEPARATORS = ("\n\n", "\r", "\n", ".", "", " ")


def fixed_window_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                        key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, partition_number, start, text)``: windows of ``size`` characters
    starting every ``size - overlap``; the last window ends at the text end.
    An empty text has no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.length(text)
    n_chunks = F.when(n > 0, F.lit(1) + F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(step)))
    starts = F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks.cast("int") - 1))
    return (docs.select(key, text, F.posexplode(starts).alias("partition_number", "k"))
            .select(key, "partition_number", (F.col("k") * step + 1).alias("start"),
                    F.substring(F.col(text), F.col("k") * step + 1, size).alias("text")))


# --- recursive separator splitting (per-row helper) ---------------------------------

def _pieces(text: str, sep: str) -> list[str]:
    """Split keeping the separator at the start of the following piece."""
    if sep == "":
        return list(text)
    parts = text.split(sep)
    out = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in out if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy packing up to ``size`` characters, carrying at most ``overlap``
    characters of trailing pieces into the next chunk."""
    out, cur, total = [], deque(), 0
    for p in pieces:
        n = len(p)
        if total + n > size and cur:
            joined = "".join(cur).strip()
            if joined:
                out.append(joined)
            while total > overlap or (total + n > size and total > 0):
                total -= len(cur.popleft())
        cur.append(p)
        total += n
    joined = "".join(cur).strip()
    if joined:
        out.append(joined)
    return out


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators=SEPARATORS) -> list[str]:
    """Chunks of one text: use the first separator that occurs ("" always
    does), pack pieces shorter than ``size`` and split longer ones again with
    the remaining separators."""
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, list(separators[i + 1:])
            break
    if sep == "" and size > 1:  # single characters pack to plain windows
        last = max(0, -(-(len(text) - size) // (size - overlap)))
        windows = (text[k * (size - overlap):k * (size - overlap) + size].strip() for k in range(last + 1))
        return [w for w in windows if w]
    chunks, small = [], []
    for p in _pieces(text, sep):
        if len(p) < size:
            small.append(p)
            continue
        if small:
            chunks.extend(_pack(small, size, overlap))
            small = []
        chunks.extend(split_recursive(p, size, overlap, rest) if rest else [p])
    if small:
        chunks.extend(_pack(small, size, overlap))
    return chunks


#: What ``str.strip`` removes.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# The native splitter is written as SQL text: as Columns its lambdas take seconds to build.
_ITEMS = "array<struct<open:boolean,text:string>>"  # a finished chunk, or a text that further separators cut


def _chunk_sql(window: str) -> str:
    """The chunk of a window of pieces as items; none if it is blank."""
    return (f"transform(filter(array(btrim(array_join({window}, ''), '{BLANKS}')), t -> t != ''), "
            f"t -> named_struct('open', false, 'text', t))")


def _split_sql(text: str, sep: str, size: int, overlap: int) -> str:
    """Items of a text cut at ``sep``: one fold packs short pieces and passes long ones on.
    After a chunk, pieces leave the window from the left until the rest is an overlap to which
    the next piece can be added."""
    quoted = sep.replace("\n", "\\n").replace("\r", "\\r")
    pattern = "[.]" if sep == "." else quoted
    none, chunk = "cast(array() AS array<string>)", _chunk_sql("acc.window")
    return f"""aggregate(
  filter(transform(split({text}, '{pattern}', -1), (x, k) -> if(k = 0, x, concat('{quoted}', x))), x -> x != ''),
  named_struct('out', cast(array() AS {_ITEMS}), 'window', {none}, 'total', 0),
  (acc, x) -> CASE
    WHEN length(x) >= {size} THEN named_struct(
      'out', concat(acc.out, {chunk}, array(named_struct('open', true, 'text', x))), 'window', {none}, 'total', 0)
    WHEN acc.total + length(x) > {size} AND size(acc.window) > 0 THEN transform(array(aggregate(
        acc.window, named_struct('gone', 0, 'total', acc.total),
        (a, y) -> if(a.total > least({overlap}, {size} - length(x)), named_struct('gone', a.gone + 1, 'total', a.total - length(y)), a))),
      g -> named_struct('out', concat(acc.out, {chunk}),
                        'window', concat(slice(acc.window, g.gone + 1, size(acc.window)), array(x)), 'total', g.total + length(x)))[0]
    ELSE named_struct('out', acc.out, 'window', concat(acc.window, array(x)), 'total', acc.total + length(x)) END,
  acc -> concat(acc.out, {chunk}))"""


def recursive_pieces(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The chunks of the text in column ``text`` (an array of strings), as ``split_recursive``
    gives them, by JVM functions alone: one pass per separator over the texts that are still
    too long."""
    if not 0 <= overlap < size or size < 2:
        raise ValueError("need 0 <= overlap < size and size >= 2")
    name = "`" + text.replace("`", "``") + "`"
    items = f"array(named_struct('open', true, 'text', coalesce({name}, '')))"
    for sep in SEPARATORS[:SEPARATORS.index("")]:
        quoted = sep.replace("\n", "\\n").replace("\r", "\\r")
        items = (f"flatten(transform({items}, item -> if(item.open AND contains(item.text, '{quoted}'), "
                 f"{_split_sql('item.text', sep, size, overlap)}, array(item))))")
    step = size - overlap
    last = f"greatest(0, cast(ceil((length(item.text) - {size}) / {step}) AS int))"
    windows = (f"filter(transform(sequence(0, {last}), k -> btrim(substring(item.text, k * {step} + 1, {size}), '{BLANKS}')), "
               f"w -> w != '')")
    return F.expr(f"flatten(transform({items}, item -> if(item.open, {windows}, array(item.text))))")


def recursive_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, partition_number, text)`` from the recursive splitter."""
    return docs.select(key, F.posexplode(recursive_pieces(text, size, overlap)).alias("partition_number", "text"))


# --- records describing generated chunks -------------------------------------------

def chunk_records(chunks: DataFrame, parent: str = "doc_id", name: str | Column | None = None,
                  tags: str | Column | None = None) -> DataFrame:
    """One description row per chunk: deterministic id (md5 of parent and
    number, so reruns are idempotent), parent id, partition file name, size,
    MIME ``text/plain``, artifact type, numbers, inherited tags, SHA-256."""
    parent_id = F.col(parent).cast("string")
    file_name = (F.col(name) if isinstance(name, str) else name) if name is not None else parent_id
    tag_col = ((F.col(tags) if isinstance(tags, str) else tags) if tags is not None
               else F.array().cast("array<string>"))
    return chunks.select(
        F.md5(F.concat_ws("/", parent_id, F.col("partition_number").cast("string"))).alias("id"),
        parent_id.alias("parent_id"),
        F.concat(file_name, F.lit(".partition."), F.col("partition_number").cast("string"),
                 F.lit(".txt")).alias("name"),
        F.length("text").alias("size"),
        F.lit("text/plain").alias("mime_type"),
        F.lit("TextPartition").alias("artifact_type"),
        F.col("partition_number").cast("int").alias("partition_number"),
        F.lit(0).alias("section_number"),
        tag_col.alias("tags"),
        content_sha256("text").alias("content_sha256"),
        F.col("text"))


# --- heading-aware sections ----------------------------------------------------------

def html_to_markdown(c: str | Column) -> Column:
    """Light HTML -> Markdown text: drops head/script/style/comments, turns
    ``<h1..3>`` into ``#``-headings, block tags into line breaks, strips the
    remaining tags and decodes the common entities."""
    x = F.col(c) if isinstance(c, str) else c
    for pat, rep in [
        (r"(?is)<head\b.*?</head>", ""), (r"(?is)<script\b.*?</script>", ""),
        (r"(?is)<style\b.*?</style>", ""), (r"(?s)<!--.*?-->", ""),
        (r"(?i)<h1\b[^>]*>", "\n# "), (r"(?i)<h2\b[^>]*>", "\n## "), (r"(?i)<h3\b[^>]*>", "\n### "),
        (r"(?i)</h[1-6]>", "\n"),
        (r"(?i)<(?:p|div|br|li|tr|article|section|nav|footer|header|ul|ol|table)\b[^>]*>", "\n"),
        (r"<[^>]*>", ""),
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
        ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
    ]:
        x = F.regexp_replace(x, pat, rep)
    return x


def _fence_toggles(text: Column) -> Column:
    """Numbers of the lines that open or close a fenced code block, in order."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x, i: F.named_struct(
        F.lit("i"), i, F.lit("s"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    fences = F.filter(trimmed, lambda x: x["s"].startswith("```") | x["s"].startswith("~~~"))
    none = F.lit("")

    def step(acc, x):
        opens = F.when(x["s"].rlike(r"^```(?!.*```)"), F.lit("```")).when(x["s"].startswith("~~~"), F.lit("~~~"))
        toggles = F.when(acc["open"] == none, opens.isNotNull()).otherwise(x["s"].startswith(acc["open"]))
        return F.named_struct(
            F.lit("open"), F.when(~toggles, acc["open"]).when(acc["open"] == none, opens).otherwise(none),
            F.lit("at"), F.when(toggles, F.concat(acc["at"], F.array(x["i"]))).otherwise(acc["at"]))

    start = F.named_struct(F.lit("open"), none, F.lit("at"), F.array().cast("array<int>"))
    return F.aggregate(fences, start, step, lambda acc: acc["at"])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _heading_states(lines: Column, in_code) -> Column:
    """``(ln, h1, h2, h3)`` from each heading line on, and before the first one (-1)."""
    level = lambda s: F.length(F.regexp_extract(s, r"^(#{1,3})(?: |$)", 1))
    heads = F.filter(F.transform(lines, lambda s, i: F.named_struct(F.lit("ln"), i, F.lit("lvl"), level(s), F.lit("s"), s)),
                     lambda x: (x["lvl"] > 0) & ~in_code(x["ln"]))
    none = F.lit(None).cast("string")

    def state(ln, h1, h2, h3):
        return F.named_struct(F.lit("ln"), ln, F.lit("h1"), h1, F.lit("h2"), h2, F.lit("h3"), h3)

    def step(acc, x):
        text = F.regexp_replace(F.substr(x["s"], x["lvl"] + 1), r"(?U)^\s+|\s+$", "")
        last = acc[F.size(acc) - 1]
        return F.concat(acc, F.array(state(
            x["ln"], F.when(x["lvl"] == 1, text).otherwise(last["h1"]),
            F.when(x["lvl"] == 2, text).when(x["lvl"] > 2, last["h2"]), F.when(x["lvl"] == 3, text))))

    return F.aggregate(heads, F.array(state(F.lit(-1), none, none, none)), step)


def _segment_text(lines: Column, first: Column, count: Column, in_code) -> Column:
    """Content lines of ``count`` lines from number ``first`` on; NULL without any."""
    numbered = F.transform(F.slice(lines, first + 1, count), lambda s, k: F.named_struct(
        F.lit("ln"), first + k, F.lit("s"), s))
    kept = F.filter(numbered, lambda x: (x["s"] != "") | in_code(x["ln"]))

    def joined(rows):
        return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda x, k: F.concat(
            F.when(k == 0, F.lit("")).when(rows[F.greatest(k - 1, F.lit(0))]["ln"] == x["ln"] - 1, F.lit("\n"))
            .otherwise(F.lit("  \n")), x["s"])), ""))

    return _let(kept, joined)


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Split Markdown at ``#``/``##``/``###`` headings (headings removed).

    Returns ``(key, section_no, content, header_1, header_2, header_3)``.
    A shallower heading resets the deeper ones; consecutive content lines with
    the same headings form one section, lines joined by a newline and runs
    separated by blank lines or headings joined by two spaces and a newline.
    Inside a fenced code block (``` or ~~~) every line is content, blank ones and
    those that start with ``#`` included.

    All of it happens inside the document's row: folds run over its headings, not
    over its lines, and no line crosses an exchange.
    """
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    rows = docs.select(key, _fence_toggles(F.col(text)).alias("toggles"), lines.alias("lines"))
    in_code = lambda ln: F.size(F.filter("toggles", lambda t: t <= ln)) % 2 == 1
    rows = rows.withColumn("states", _heading_states(F.col("lines"), in_code))

    def segment(x, k):
        last = F.size("states") - 1
        end = F.when(k == last, F.size("lines")).otherwise(F.col("states")[F.least(k + 1, last)]["ln"])
        return F.named_struct(F.lit("content"), _segment_text(F.col("lines"), x["ln"] + 1, end - x["ln"] - 1, in_code),
                              F.lit("h1"), x["h1"], F.lit("h2"), x["h2"], F.lit("h3"), x["h3"])

    segments = rows.select(key, F.filter(F.transform("states", segment), lambda x: x["content"].isNotNull()).alias("segments"))

    def step(acc, x):  # neighbours under the same headings are one section
        last = acc[F.size(acc) - 1]
        same = (F.size(acc) > 0) & F.try_element_at(acc, F.lit(-1))["h1"].eqNullSafe(x["h1"]) & F.try_element_at(
            acc, F.lit(-1))["h2"].eqNullSafe(x["h2"]) & F.try_element_at(acc, F.lit(-1))["h3"].eqNullSafe(x["h3"])
        merged = F.named_struct(F.lit("content"), F.concat(last["content"], F.lit("  \n"), x["content"]),
                                F.lit("h1"), x["h1"], F.lit("h2"), x["h2"], F.lit("h3"), x["h3"])
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(
            F.concat(acc, F.array(x)))

    kind = "array<struct<content:string,h1:string,h2:string,h3:string>>"
    sections = F.aggregate("segments", F.array().cast(kind), step)
    return (segments.select(key, F.posexplode(sections).alias("section_no", "s"))
            .select(key, F.col("section_no").cast("long").alias("section_no"), F.col("s.content").alias("content"),
                    F.col("s.h1").alias("header_1"), F.col("s.h2").alias("header_2"), F.col("s.h3").alias("header_3")))


def merge_by_heading(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections of each document regrouped by their first heading
    (``No_Heading`` when none), bodies joined by newlines in section order;
    group numbers follow first appearance.  Grouping stays inside a document,
    so a group is bounded by the document size."""
    heading = F.coalesce("header_1", "header_2", "header_3", F.lit("No_Heading"))
    g = (sections.withColumn("heading", heading)
         .groupBy(key, "heading")
         .agg(F.min("section_no").alias("first"),
              F.array_sort(F.collect_list(F.struct("section_no", "content"))).alias("parts")))
    w = Window.partitionBy(key).orderBy("first")
    return g.select(key, (F.row_number().over(w) - 1).alias("group_no"), "heading",
                    F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content"))


def _word_count(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def token_pack(sections: DataFrame, max_tokens: int = 1000, key: str = "doc_id") -> DataFrame:
    """Structure-aware chunks of at most ``max_tokens`` tokens (whitespace
    words stand in for model tokens).

    The lines of a section are its elements; an element longer than the limit
    is cut into ``max_tokens``-word windows; consecutive elements under the
    same headings (peers) are merged greedily while the total stays within
    the limit.  The fold runs over one section's ordered elements (bounded by
    the document).  Returns ``(key, section_no, chunk_no, text, n_tokens,
    header_1, header_2, header_3)``."""
    if max_tokens <= 0:
        raise ValueError("max_tokens must be > 0")
    def pieces(line: Column) -> Column:
        n, words = _word_count(line), F.split(F.trim(line), r"\s+")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(n / F.lit(max_tokens)).cast("int") - 1), lambda i: F.named_struct(
            F.lit("text"), F.array_join(F.slice(words, i * max_tokens + 1, max_tokens), " "),
            F.lit("n"), F.least(F.lit(max_tokens), n - i * max_tokens)))
        return F.when(n <= max_tokens, F.array(F.named_struct(F.lit("text"), line, F.lit("n"), n))).otherwise(cut)

    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")),
                     lambda x: F.trim(x) != "")
    # the elements of a section are an array in its row: no exchange
    grouped = sections.select(key, "section_no", "header_1", "header_2", "header_3",
                              F.flatten(F.transform(lines, pieces)).alias("els"))
    empty = F.array().cast("array<struct<text:string,n:int>>")
    init = F.struct(empty.alias("done"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"))

    def step(acc, e):
        fits = acc["text"].isNotNull() & (acc["n"] + e["n"] <= max_tokens)
        flushed = F.when(acc["text"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["n"].alias("n")))))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(flushed).alias("done"),
            F.when(fits, F.concat(acc["text"], F.lit("\n"), e["text"])).otherwise(e["text"]).alias("text"),
            F.when(fits, acc["n"] + e["n"]).otherwise(e["n"]).alias("n"))

    def finish(acc):
        return F.when(acc["text"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["n"].alias("n")))))

    packed = grouped.select(key, "section_no", "header_1", "header_2", "header_3",
                            F.aggregate("els", init, step, finish).alias("chunks"))
    return packed.select(key, "section_no", F.posexplode("chunks").alias("chunk_no", "c"),
                         "header_1", "header_2", "header_3").select(
        key, "section_no", "chunk_no", F.col("c.text").alias("text"), F.col("c.n").alias("n_tokens"),
        "header_1", "header_2", "header_3")


def dedup_by_hash(chunk_rows: DataFrame) -> DataFrame:
    """One row per distinct chunk content: ``(content_sha256, id, n_copies)``
    keeping the smallest id.  A hash aggregation with partial combine, so a
    hash shared by a third of all chunks is pre-aggregated on every mapper
    and never collected in one task."""
    return (chunk_rows.groupBy("content_sha256")
            .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies")))


PART_CHARS = 1_000_000


def merge_by_heading_across(sections: DataFrame, key: str = "doc_id", part_chars: int = PART_CHARS) -> DataFrame:
    """Sections of all documents regrouped by their first heading (``No_Heading`` when none),
    bodies joined by newlines in the order of document and section.

    Returns ``(heading_no, heading, part, content)``: headings are numbered by first
    appearance, and the text of a heading comes in numbered parts.  A section belongs to the
    part in which it starts, counting ``part_chars`` characters to a part, so a part holds at
    most that and one section, and the parts in order, joined by newlines, are the whole text.

    A heading that every document has is many tasks: sections are dealt into sorted ranges,
    lengths are summed per heading and range, and a section's place is the sum before its
    range plus that inside it."""
    if part_chars <= 0:
        raise ValueError("part_chars must be > 0")
    heading = F.coalesce("header_1", "header_2", "header_3", F.lit("No_Heading"))
    rows = sections.select(heading.alias("heading"), F.col(key).alias("doc"), "section_no", "content")
    spark = sections.sparkSession
    path = scratch_path(spark, "headings")
    (rows.repartitionByRange("heading", "doc", "section_no").withColumn("range", F.spark_partition_id()).write.parquet(path))
    rows = spark.read.parquet(path).withColumn("size", F.length("content") + F.lit(1).cast("long"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("heading", "range").agg(F.sum("size").alias("n"), F.min(F.struct("doc", "section_no")).alias("first"))
    starts = sums.select("heading", "range", F.coalesce(F.sum("n").over(before("heading").orderBy("range")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("size").over(before("range", "heading").orderBy("doc", "section_no")), F.lit(0))
    placed = rows.withColumn("inside", inside).join(starts, ["heading", "range"])
    part = F.floor((F.col("start") + F.col("inside")) / F.lit(part_chars)).alias("n")
    parts = placed.groupBy("heading", part).agg(
        F.array_sort(F.collect_list(F.struct("doc", "section_no", "content"))).alias("bodies"))
    # parts that a long section leaves without a start are not there: number those that are
    numbered = parts.withColumn("part", F.row_number().over(Window.partitionBy("heading").orderBy("n")) - 1)
    order = row_numbers(sums.groupBy("heading").agg(F.min("first").alias("first")).select("first.*", "heading"),
                        ["doc", "section_no", "heading"], "heading_no").select("heading", "heading_no")
    return numbered.join(order, "heading").select(
        "heading_no", "heading", "part", F.array_join(F.transform("bodies", lambda b: b["content"]), "\n").alias("content"))

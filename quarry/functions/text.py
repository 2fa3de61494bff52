"""String Column builders (all JVM-side, codegen-friendly built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.stopwords import FRENCH

# Word boundary of the lexeme normaliser: anything that is not a letter or digit.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_index_name(c: str | Column) -> Column:
    """trim, lower-case, each of whitespace | \\ / . _ : becomes '-'; blank -> NULL."""
    trimmed = F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(F.lower(trimmed), r"(?U)[\s|\\/._:]", "-")
    return F.when(F.length(trimmed) > 0, s)


def normalize_table_prefix(c: str | Column) -> Column:
    """As the index name, but NULL or blank gives ''."""
    return F.coalesce(normalize_index_name(c), F.lit(""))


def strip_nul(c: str | Column) -> Column:
    """Remove U+0000 from text before it is stored."""
    return F.translate(_c(c), "\u0000", "")


def clean_text(c: str | Column) -> Column:
    """Trim every line; blank lines end a paragraph; lines of a paragraph are
    joined by one space and paragraphs by a newline. NULL/blank -> ''."""
    lines = F.split(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\r\n|\r", "\n"), "\n", -1)
    trimmed = F.transform(lines, lambda ln: F.regexp_replace(ln, r"(?U)^\s+|\s+$", ""))
    joined = F.array_join(trimmed, "\n")
    paragraphs = F.split(joined, r"\n(?:\n)+", -1)
    paragraphs = F.transform(
        paragraphs, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\n+|\n+$", ""), "\n", " "))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n")


def word_tokens(c: str | Column) -> Column:
    """Lower-cased word tokens; positions are array indexes (stop words included)."""
    return F.split(F.lower(_c(c)), TOKEN_SPLIT, -1)


def french_stem(c: str | Column) -> Column:
    """Minimal French stem (the published plural-and-ending rules for words of six letters
    and more): ``-aux`` becomes ``-al``, a last ``x`` goes, else last ``s``, ``r``, ``e``,
    ``é`` go in this order, and a doubled last letter becomes one.  Pass it as ``stemmer`` to
    the text search, which applies it to records and queries alike."""
    w = _c(c)
    plain = w
    for ending in ("s", "r", "e", "é"):
        plain = F.regexp_replace(plain, f"{ending}$", "")
    plain = F.regexp_replace(plain, r"(.)\1$", "$1")
    return (F.when(F.length(w) < 6, w).when(w.endswith("aux"), F.regexp_replace(w, "ux$", "l"))
            .when(w.endswith("x"), F.regexp_replace(w, "x$", "")).otherwise(plain))


def is_stop_word(c: str | Column) -> Column:
    return _c(c).isin(FRENCH)


def content_sha256(c: str | Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(_c(c), 256)


def format_fact(last_update: str | Column, source: str | Column, content: str | Column) -> Column:
    """One fact block: header with the update stamp, the source line, then the text."""
    return F.format_string("=== Last update:%s ===\nSource:%s\n%s\n",
                           _c(last_update), _c(source), _c(content))


def payload_field(field: str, payload: str | Column = "payload") -> Column:
    """A top-level field of the JSON payload as a string (NULL when absent)."""
    return F.get_json_object(_c(payload), f"$.{field}")

"""Recognised text: normalising and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIM = r"^[\p{Z}\s\x85]+|[\p{Z}\s\x85]+$"
U32 = 4294967295


def trimmed(text: Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(text, _TRIM, "")


def normalize_text(text: Column) -> Column:
    """One line: lines trimmed, blank ones dropped, curly quotes, dashes and hard spaces made plain."""
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), trimmed), lambda s: s != "")
    return trimmed(F.translate(F.array_join(lines, " "), "‘’–— ", "''-- "))


def u32(text: Column) -> Column:
    """A 32-bit unsigned number without anything around it, else null."""
    value = text.try_cast("long")
    return F.when(text.rlike(r"^\+?0*[0-9]{1,10}$") & (value <= F.lit(U32)), value)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def tsv_word(line: Column) -> Column:
    """The word of one TSV line (text, x, y, w, h), or null: 12 fields, a word, four numbers."""

    def parse(parts):
        seen = F.struct(trimmed(F.get(parts, 11)).alias("text"), F.transform(F.slice(parts, 7, 4), u32).alias("box"))
        word = lambda v: F.struct(v["text"].alias("text"), *(F.get(v["box"], i).alias(n) for i, n in enumerate("xywh")))
        return _once(seen, lambda v: F.when((F.size(parts) >= 12) & (v["text"] != "") & ~F.exists(v["box"], F.isnull), word(v)))

    return _once(F.split(line, "\t", -1), parse)


def tsv_words(tsv: Column) -> Column:
    """All words of a TSV document, its header line skipped."""
    lines = F.split(F.replace(tsv, F.lit("\r\n"), F.lit("\n")), "\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.filter(F.transform(body, tsv_word), lambda w: w.isNotNull())

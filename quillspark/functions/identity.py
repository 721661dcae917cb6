"""What a book's first pages say about it: title, author, publication, number, and the lines that say so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: The patterns of the imprint, and how many lines are looked at.
TITLE_AUTHOR = r"([^\n/]{2,100})/([\x{4e00}-\x{9fff}·]{2,12})\s*著"
TITLE_AUTHOR_END = r"/[\x{4e00}-\x{9fff}·]{2,12}\s*著"
TITLE_HEADING = r"(?m)^#\s*(.+?)\s+OCR\s*文本"
NO_TITLE = "ISBN|出版社|NEWSTAR|定价|上架建议"
AUTHOR_LINE = r"^([\x{4e00}-\x{9fff}·]{2,12})\s*[—\-－]*\s*著$"
IMPRINT = r"([\x{4e00}-\x{9fff}]{2,12})[：:]\s*([^，,\n]{2,40}出版社)[，,]\s*(\d{4}(?:\.\d+)?)"
PUBLISHER = r"([\x{4e00}-\x{9fff}]{2,30}出版社)"
ISBN = r"ISBN\s*([0-9\-]{10,20})"
OCR_TITLE, TITLE_MARKS, TITLE_LINES, AUTHOR_LINES, QUOTE_CHARS = "OCR 文本", " ：:，,。.", 20, 80, 120


def first_match(text: Column, pattern: str, needs: str, end: str | None = None) -> Column:
    """The first match, empty without one; needs: characters that every match holds, looked for first as that is cheap, and
    after them what every match ends in, where the pattern begins with what is anywhere."""
    there = F.contains(text, F.lit(needs))
    return F.when(there if end is None else there & text.rlike(end), F.regexp_extract(text, pattern, 0)).otherwise("")


def part_of(match: Column, pattern: str, group: int) -> Column:
    """A group of what first_match found, null without a match."""
    return F.when(match != "", F.regexp_extract(match, pattern, group))


def identity(text: Column, fallback: Column) -> Column:
    """A struct of title, author, publication_info, publisher, publication_date, isbn and evidence (field, quote).

    The first way that finds a value gives it: title and author together, then a heading, then the first line that can be a title,
    then the fallback; an imprint, then a publisher alone. A null text is an empty one. Each pattern meets the text once.
    """
    lines = T.let(T.lines(text), lambda ls: F.struct(F.slice(ls, 1, AUTHOR_LINES).alias("lines"), F.array_join(ls, "\n").alias("all")))
    matches = lambda x: F.struct(
        x["lines"].alias("lines"),
        first_match(x["all"], TITLE_AUTHOR, "著", TITLE_AUTHOR_END).alias("both"),
        first_match(T.or_empty(text), TITLE_HEADING, "OCR").alias("heading"),
        first_match(x["all"], IMPRINT, "出版社").alias("imprint"),
        first_match(x["all"], PUBLISHER, "出版社").alias("press"),
        first_match(x["all"], ISBN, "ISBN").alias("isbn"),
    )
    return T.let(lines, lambda x: T.let(matches(x), lambda m: _told(m, fallback)))


def _told(m: Column, fallback: Column) -> Column:
    clean = lambda s: T.squash(F.replace(s, F.lit(OCR_TITLE), F.lit("")))
    can_be_title = lambda c: F.length(c).between(2, 50) & ~c.rlike(NO_TITLE)
    cleaned = F.transform(F.slice(m["lines"], 1, TITLE_LINES), lambda s: F.struct(s.alias("line"), clean(s).alias("clean")))
    titled = F.get(F.filter(cleaned, lambda s: can_be_title(s["clean"])), F.lit(0))
    signed = F.get(F.filter(m["lines"], lambda s: F.contains(s, F.lit("著")) & T.squash(s).rlike(AUTHOR_LINE)), F.lit(0))
    ways = F.struct(
        F.nullif(T.squash(F.trim(part_of(m["both"], TITLE_AUTHOR, 1), F.lit(TITLE_MARKS))), F.lit("")).alias("joint"),
        F.when(m["heading"] != "", m["heading"]).alias("heading"),
        F.when(m["both"] == "", signed).alias("signed"),
    )
    lined = lambda w: F.struct(w.alias("w"), F.when(w["joint"].isNull() & w["heading"].isNull(), titled).alias("titled"))
    return T.let(ways, lambda w: T.let(lined(w), lambda x: _named(m, x["w"], x["titled"], fallback)))


def _named(m: Column, w: Column, titled: Column, fallback: Column) -> Column:
    """The struct of identity. w and titled are each worked out once before, as they are named several times here."""
    joint, line, author_line = w["joint"], titled["line"], w["signed"]
    heading = F.when(joint.isNull(), w["heading"])
    press = F.when((m["imprint"] == "") & (m["press"] != ""), m["press"])
    told = lambda field, quote: F.when(quote != "", F.struct(F.lit(field).alias("field"), F.substring(quote, 1, QUOTE_CHARS).alias("quote")))
    evidence = F.array(
        told("title_author", m["both"]), told("title", heading), told("title", line), told("author", author_line),
        told("publication_info", m["imprint"]), told("publisher", press), told("isbn", m["isbn"]),
    )
    return F.struct(
        F.coalesce(joint, T.squash(part_of(heading, TITLE_HEADING, 1)), titled["clean"], fallback).alias("title"),
        F.coalesce(T.squash(part_of(m["both"], TITLE_AUTHOR, 2)), F.regexp_extract(T.squash(author_line), AUTHOR_LINE, 1)).alias("author"),
        F.nullif(T.squash(m["imprint"]), F.lit("")).alias("publication_info"),
        F.coalesce(part_of(m["imprint"], IMPRINT, 2), press).alias("publisher"),
        part_of(m["imprint"], IMPRINT, 3).alias("publication_date"),
        part_of(m["isbn"], ISBN, 1).alias("isbn"),
        F.filter(evidence, lambda e: e.isNotNull()).alias("evidence"),
    )

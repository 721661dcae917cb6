"""Constraint suites: all rules on the rows of a table are judged in one scan of it, those on the table as a whole in one aggregate.

Every suite yields the findings of ``checks`` (rule_id, severity, path, message). A rule on null counts as not broken, unless the
rule is that a value be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import checks as C
from quillspark.operators import geo as G
from quillspark.operators.rules import Each, Row, Total, compiled

# What a segment's enumerations may hold, and what marks a text that stands for another.
SEGMENT_VALUES = {
    "movement_type": ("walked", "vehicle", "mixed", "inferred", "unclear"),
    "continuity_status": ("continuous", "gap_before", "gap_after", "isolated", "unclear"),
    "walkability_status": ("book_walkable", "partially_walkable", "not_walkable_as_written", "needs_review"),
    "modern_followability": ("likely_followable", "approximate_only", "not_enough_information", "needs_field_check"),
}
PRIORITIES = ("P0", "P1", "P2")
PLACEMENTS = ("core", "extra", "source")
BLANKS = ("review_result", "replacement_strategy", "review_notes", "reviewer", "reviewed_at")
P0_CATEGORIES = ("public_boundary", "schema_status", "web_mirror", "quote_policy", "book_overview")
CATEGORY_TARGETS = {"chapter_card": 25, "key_concept": 5, "reading_question": 26, "quote_structural_entry": 25}
READY = ("public_coordinate", "approximate_coordinate")

_FINDING = "array<struct<rule_id:string,severity:string,path:string,message:string>>"


def _finding(rule: str, severity: str, path: Column, message) -> Column:
    said = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), path.cast("string").alias("path"), said.alias("message"))


def _when(rule: str, severity: str, path: Column, message, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), _finding(rule, severity, path, message))


def _inlined(df: DataFrame, single: list[Column], lists: list[Column] = ()) -> DataFrame:
    every = F.concat(F.array_compact(F.array(*single)).cast(_FINDING), *[F.coalesce(x, F.array().cast(_FINDING)).cast(_FINDING) for x in lists])
    return df.select(F.inline(every))


def blank(c: str) -> Column:
    return T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def _missing(rule: str, path: Column, columns: list[str]) -> list[Column]:
    return [_when(rule, "error", path, f"missing {c}", blank(c)) for c in columns]


def _each(items: Column, f) -> Column:
    """The findings that f(item, place from 1) gives for the items, without the null ones."""
    return F.array_compact(F.flatten(F.transform(items, lambda x, i: F.array(*f(x, i + 1)))))


def _count_is(df: DataFrame, rule: str, path: str, n: Column, wanted: str, right: Column) -> DataFrame:
    return df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.inline(F.array_compact(F.array(_when(rule, "error", F.lit(path), F.concat(F.lit(f"expected {wanted}, got "), F.col("n").cast("string")), ~F.coalesce(right, F.lit(False)))))))


def route(segments: DataFrame, place: str = "place") -> DataFrame:
    """Segments of a route: id, place (from 1, in the file's order), order, title, start, end, via, refs (structs of page, quote, note),
    the four enumerations, gap_notes, do_not_connect, review_notes."""
    sid = F.coalesce(F.col("id").cast("string"), F.lit("<missing-id>"))
    points = F.filter(F.concat(F.array("start"), F.coalesce("via", F.array().cast("array<struct<name:string,lat:double,lng:double>>")), F.array("end")), lambda p: p.isNotNull())
    bad = lambda p: ~F.coalesce(G.valid_coordinates(p["lat"], p["lng"]), F.lit(False))
    refs = F.coalesce("refs", F.array().cast("array<struct<page:bigint,quote:string,note:string>>"))
    nothing = lambda c: F.coalesce(c, F.lit("")) == ""
    gap, noted = F.col("do_not_connect"), F.coalesce(F.size("gap_notes"), F.lit(0)) > 0
    single = [Row("C1.field", "error", sid, f"missing {c}", nothing(F.col(c).cast("string")) | (F.col(c).cast("string") == "0" if c == "order" else F.lit(False))) for c in ("id", "order", "title")]
    for role in ("start", "end"):
        named = ~nothing(F.col(role)["name"])
        single += [Row("C1.point", "error", sid, f"missing {role}.name", ~named), Row("C1.point", "error", sid, F.concat(F.lit(f"invalid coordinate for {role} "), F.col(role)["name"]), named & bad(F.col(role)))]
    unplaced = F.exists(points, lambda p: p["lat"].isNull() | p["lng"].isNull())
    single += [
        Row("C1.refs", "error", sid, "missing book_refs", F.size(refs) == 0),
        Row("C1.coordinates", "error", sid, "missing coordinates but no review_notes", unplaced & (F.coalesce(F.col("review_notes"), F.lit("")) == "")),
        Row("C1.gap", "error", sid, "missing gap_notes", F.col("gap_notes").isNull()),
        Row("C1.gap", "error", sid, "missing do_not_connect", gap.isNull()),
        Row("C1.gap", "error", sid, "do_not_connect requires gap_notes", gap & ~noted),
        Row("C1.info", "info", sid, F.concat(F.lit("movement_type="), F.col("movement_type")), (F.col("movement_type") != "walked") & (F.col("movement_type") != "")),
        Row("C1.info", "info", sid, "do_not_connect", gap),
    ]
    for c, values in SEGMENT_VALUES.items():
        single += [Row("C1.enum", "error", sid, f"missing {c}", F.col(c).isNull()), Row("C1.enum", "error", sid, f"invalid {c}", ~F.col(c).isin(*values))]
    number = lambda what, i, rest: F.concat(F.lit(what), i.cast("string"), F.lit(rest))
    lists = [
        Each(refs, lambda r, i: [Row("C1.refs", "error", sid, number("book_ref #", i, " must include page, quote, note"), r["page"].isNull() | nothing(r["quote"]) | nothing(r["note"])), Row("C1.quote", "warning", sid, number("book_ref #", i, " quote longer than 120 chars"), F.length(r["quote"]) > 120)]),
        Each(points, lambda p, i: [Row("C1.point", "error", sid, F.concat(F.lit("invalid coordinate for "), F.coalesce(p["name"], F.lit(""))), bad(p))]),
    ]
    order = Total("C1.order", "error", "route", "order must be consecutive", {"odd": F.bool_or(~F.col("order").eqNullSafe(F.col(place)))}, lambda v: v["odd"])
    return compiled(segments, [*single, *lists, order])


def letters(df: DataFrame, expected: tuple[str, ...], markers: tuple[str, ...] = (), forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Briefs of letters: place (from 1), letter_id, section_id, order, title, chunk_ids, brief, places, themes, notes (of the evidence).

    expected: the section of each letter in order. An id that stands before is found by a window over its own rows only.
    """
    path = F.concat(F.lit("letters["), (F.col("place") - 1).cast("string"), F.lit("]"))
    at = lambda c: F.concat(path, F.lit("." + c))
    again = F.row_number().over(Window.partitionBy("letter_id").orderBy("place"))
    rows = df.withColumn("_again", again)
    want = F.try_element_at(F.array(*map(F.lit, expected)), F.col("place").cast("int"))
    marked = lambda c: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(c, m)) if markers else F.lit(False)
    single = [
        *[_when("C2.list", "error", at(c), f"{c} must be a list", F.col(c).isNull()) for c in ("places", "themes")],
        *[_when("C2.list", "error", at(c), f"{c} must be a non-empty list", F.coalesce(F.size(c), F.lit(0)) < 1) for c in ("chunk_ids", "notes")],
        _when("C2.id", "error", at("letter_id"), "invalid letter_id", ~F.coalesce(F.col("letter_id").rlike(r"^letter-\d{3}$"), F.lit(False))),
        _when("C2.id", "error", at("letter_id"), "duplicate letter_id", F.col("_again") > 1),
        _when("C2.order", "error", at("order"), "out of order", ~F.col("order").eqNullSafe(F.col("place"))),
        _when("C2.section", "error", at("section_id"), "section out of order", ~F.col("section_id").eqNullSafe(want)),
        _when("C2.section", "error", at("section_id"), "forbidden section", F.col("section_id").isin(*forbidden) if forbidden else F.lit(False)),
        _when("C2.brief", "error", at("brief"), "brief must be a non-empty string", blank("brief")),
        _when("C2.marker", "error", path, "forbidden marker", marked(F.coalesce("brief", F.lit(""))) | marked(F.coalesce("title", F.lit("")))),
    ]
    note = lambda i: F.concat(at("evidence_refs["), (i - 1).cast("string"), F.lit("]"))
    notes = _each(F.col("notes"), lambda x, i: [_when("C2.note", "error", note(i), "evidence note too long", F.length(x) > 160), _when("C2.marker", "error", note(i), "forbidden marker", marked(x))])
    n = len(expected)
    return _count_is(df, "C2.count", "letters", F.count(F.lit(1)), str(n), F.col("n") == n).unionByName(_inlined(rows, single, [notes]))


def passages(chapters: DataFrame, items: DataFrame, sections: DataFrame, rule: str, least: dict[str, int], fields: tuple[str, ...], placeholders: tuple[str, ...] = (), shortest: int = 0, longest: int | None = None, chapter_count: int = 25) -> DataFrame:
    """Excerpts or reading blocks of chapters: enough of each kind, complete, of a fitting length, and found in their section.

    chapters: chapter, section_id; items: chapter, item, section_id, text, core, extra and the fields; sections: section_id, text,
    several rows a section (section and chunks). least: fewest items of kind "all", "core" and "extra" in a chapter.
    Texts are looked for only in their own section, as they are or with white space as one blank.
    """
    sized = items.groupBy("chapter").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.coalesce("core", F.lit(False))).alias("core"), F.count_if(F.coalesce("extra", F.lit(False))).alias("extra"))
    counts = chapters.select("chapter", F.col("section_id").alias("_section")).join(sized, "chapter", "left")
    where = F.concat(F.lit("chapters["), F.col("chapter").cast("string"), F.lit("]"))
    few = _inlined(counts, [_when(f"{rule}.few", "error", where, F.concat(F.lit(f"expected >={n} {kind}, got "), F.coalesce(kind, F.lit(0)).cast("string")), F.coalesce(kind, F.lit(0)) < n) for kind, n in least.items()])
    at = F.concat(where, F.lit("["), F.col("item").cast("string"), F.lit("]"))
    text = F.coalesce("text", F.lit(""))
    rows = items.join(chapters.select("chapter", F.col("section_id").alias("_section")), "chapter")
    single = [
        *_missing(f"{rule}.field", at, list(fields)),
        _when(f"{rule}.section", "error", at, "section mismatch", ~F.col("section_id").eqNullSafe(F.col("_section"))),
        _when(f"{rule}.length", "error", at, "too short", F.length(text) < shortest),
        _when(f"{rule}.placeholder", "error", at, "placeholder marker found", F.exists(F.array(*map(F.lit, placeholders)), lambda m: F.contains(text, m)) if placeholders else F.lit(False)),
    ]
    if longest is not None:
        single.append(_when(f"{rule}.length", "warning", at, "near the long limit", F.length(text) > longest))
    flat = T.squash(text)
    asked = rows.select("chapter", "item", "_section", text.alias("_text"), flat.alias("_flat"))
    texts = sections.select(F.col("section_id").alias("_section"), F.coalesce("text", F.lit("")).alias("_whole"))
    inside = (F.col("_flat") != "") & (F.contains("_whole", "_text") | F.contains(T.squash(F.col("_whole")), F.col("_flat")))
    found = asked.join(texts, "_section").where(inside).select("chapter", "item").distinct()
    lost = rows.join(found, ["chapter", "item"], "left_anti")
    count = _count_is(chapters, f"{rule}.chapters", "chapters", F.count(F.lit(1)), str(chapter_count), F.col("n") == chapter_count)
    return C.union([count, few, _inlined(rows, single), C.rows_where(lost, f"{rule}.source", "error", at, "text not found in its section", F.lit(True))])


def longer_blocks(blocks: DataFrame, excerpts: DataFrame, text: str = "text") -> DataFrame:
    """C7: blocks are clearly longer on average than excerpts: at least 90, and at least 35 above them. Averages have one decimal."""
    there = F.when(F.col(text) != "", F.length(text))
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 1), F.lit(0.0))
    both = blocks.agg(mean(F.length(F.coalesce(text, F.lit("")))).alias("b")).crossJoin(F.broadcast(excerpts.agg(mean(there).alias("e"))))  # one row each
    said = F.concat(F.lit("average block length is not clearly above excerpt average"))
    return _inlined(both, [_when("C7.average", "error", F.lit("average_length"), said, F.col("b") < F.greatest(F.lit(90.0), F.col("e") + 35))])


def workbench(tasks: DataFrame, key: str, required: list[str], count: int, letter_count: int = 25, per_letter: int = 5, length: tuple[str, str] | None = ("block_length", "block_text")) -> DataFrame:
    """C8, C9: review tasks before any review: counts, unique ids, enough for each letter, complete rows, nothing decided."""
    path = F.coalesce(F.col(key).cast("string"), F.lit(""))
    single = [
        *_missing("C8.field", path, required),
        *[_when("C8.blank", "error", path, f"{c} must be blank", ~blank(c)) for c in BLANKS if c in tasks.columns],
        _when("C8.enum", "error", path, "invalid current_placement", ~F.coalesce(F.col("current_placement").isin(*PLACEMENTS), F.lit(False))),
        _when("C8.enum", "error", path, "invalid review_priority", ~F.coalesce(F.col("review_priority").isin(*PRIORITIES), F.lit(False))),
    ]
    if length:
        stated = F.col(length[0]).cast("string").try_cast("long")
        single.append(_when("C8.length", "error", path, "length does not match the text", ~stated.eqNullSafe(F.length(F.coalesce(length[1], F.lit(""))).cast("long"))))
    lettered = tasks.groupBy("letter_id").agg(F.count(F.lit(1)).alias("n"))
    few = C.rows_where(lettered, "C8.letter", "error", F.coalesce(F.col("letter_id").cast("string"), F.lit("")), f"fewer than {per_letter} tasks", F.col("n") < per_letter)
    covered = F.count_if(~blank("letter_id"))
    return C.union([
        _count_is(tasks, "C8.count", "tasks", F.count(F.lit(1)), str(count), F.col("n") == count),
        _count_is(lettered, "C8.letters", "tasks", covered, str(letter_count), F.col("n") == letter_count),
        _count_is(tasks, "C8.p0", "tasks", F.count_if(F.col("review_priority") == "P0"), f"at least {letter_count}", F.col("n") >= letter_count),
        C.unique(tasks, "C8.unique", key), few, _inlined(tasks, single),
    ])


def manual_tasks(tasks: DataFrame, summary: DataFrame, order: str = "place", samples: int = 5) -> DataFrame:
    """C12: tasks (place, task_id, priority, category, target_id, review_question, manual_result) and their summary, rows of
    (kind: "total", "priority" or "category"; name; n), which must equal a recount."""
    turn = F.row_number().over(Window.partitionBy("task_id").orderBy(order))
    path = F.col(order).cast("string")
    empty = blank("task_id")
    single = [
        _when("C12.id", "error", path, "task_id is required", empty), _when("C12.id", "error", path, "duplicate task_id", ~empty & (F.col("_turn") > 1)),
        _when("C12.enum", "error", path, "invalid priority", ~F.coalesce(F.col("priority").isin(*PRIORITIES), F.lit(False))),
        *_missing("C12.field", path, ["category", "target_id", "review_question"]), _when("C12.blank", "error", path, "manual_result must be blank", ~blank("manual_result")),
    ]
    counted = lambda kind: tasks.groupBy(F.coalesce(kind, F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("_n")).select(F.lit(kind).alias("kind"), "name", "_n")
    recount = tasks.agg(F.count(F.lit(1)).alias("_n")).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "_n").unionByName(counted("priority")).unionByName(counted("category"))
    stated = recount.join(summary.select("kind", "name", "n"), ["kind", "name"], "left")
    differ = C.rows_where(stated, "C12.summary", "error", F.concat_ws(".", "kind", "name"), "does not match the recount", ~F.col("n").eqNullSafe(F.col("_n")))
    whole = summary.where(F.col("kind").isin("priority", "category")).groupBy("kind").agg(F.sum("n").alias("s")).crossJoin(F.broadcast(tasks.agg(F.count(F.lit(1)).alias("t"))))  # one row
    sums = C.rows_where(whole, "C12.summary", "error", F.col("kind"), "counts do not sum to the total", ~F.col("s").eqNullSafe(F.col("t")))
    p0 = F.col("priority") == "P0"
    targets = tasks.groupBy(F.col("category")).agg(F.count_distinct(F.coalesce("target_id", F.lit(""))).alias("targets"), F.count_if(p0).alias("p0"))
    of = lambda c, v: F.coalesce(F.max(F.when(F.col("category") == c, F.col(v))), F.lit(0)).cast("long")
    named = {c: i for i, c in enumerate((*P0_CATEGORIES, "chapter_card_sample", *CATEGORY_TARGETS))}
    one = targets.agg(*[of(c, "targets" if c in CATEGORY_TARGETS else "p0").alias(f"c{i}") for c, i in named.items()])
    cover = [
        *[_when("C12.coverage", "error", F.lit(c), "no P0 task", F.col(f"c{named[c]}") == 0) for c in P0_CATEGORIES],
        *[_when("C12.coverage", "error", F.lit(c), F.concat(F.lit(f"expected {n}, got "), F.col(f"c{named[c]}").cast("string")), F.col(f"c{named[c]}") != n) for c, n in CATEGORY_TARGETS.items()],
        _when("C12.coverage", "error", F.lit("chapter_card_sample"), f"fewer than {samples} P0 tasks", F.col(f"c{named['chapter_card_sample']}") < samples),
    ]
    return C.union([_inlined(tasks.withColumn("_turn", turn), single), differ, sums, _inlined(one, cover)])


def coordinates(places: DataFrame, count: int = 66, ready: int = 35) -> DataFrame:
    """C19: place, coordinate_status, lat, lng, coordinate_review_note: known statuses, a valid point where one is claimed, a note else."""
    at = F.concat(F.lit("places["), F.col("place").cast("string"), F.lit("]"))
    status, known = F.col("coordinate_status"), F.coalesce(F.col("coordinate_status"), F.lit("")) != ""
    point = F.coalesce(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180), F.lit(False))
    single = [
        _when("C19.status", "error", at, "missing coordinate_status", ~known), _when("C19.status", "error", at, "unexpected coordinate_status", known & ~status.isin(*READY, "needs_coordinate_review")),
        _when("C19.point", "error", at, "missing or invalid lat/lng", status.isin(*READY) & ~point), _when("C19.note", "error", at, "missing review note", (status == "needs_coordinate_review") & (F.coalesce(F.col("coordinate_review_note"), F.lit("")) == "")),
    ]
    low = C.rows_where(places.agg(F.count_if(status.isin(*READY)).alias("n")), "C19.coverage", "warning", F.lit("places"), f"fewer than {ready} places with a coordinate", F.col("n") < ready)
    return C.union([_count_is(places, "C19.count", "places", F.count(F.lit(1)), str(count), F.col("n") == count), low, _inlined(places, single)])


def place_sources(places: DataFrame, stated: int, baseline: int = 11, wished: int = 20) -> DataFrame:
    """C18: place, source_status, source_name, source_url, source_type, source_review_note, updated_in: a public source is complete, a
    pending one has a note, and the number stated is that of the rows."""
    at = F.concat(F.lit("places["), F.col("place").cast("string"), F.lit("]"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    status = F.coalesce("source_status", F.lit(""))
    single = [
        *[_when("C18.field", "error", at, f"missing {c}", (status == "public_source") & empty(c)) for c in ("source_name", "source_url", "source_type", "source_review_note", "updated_in")],
        _when("C18.note", "error", at, "missing review note", (status == "needs_source_review") & empty("source_review_note")), _when("C18.status", "error", at, "unexpected source_status", ~status.isin("public_source", "needs_source_review")),
    ]
    n = F.col("n")
    whole = places.agg(F.count_if(status == "public_source").alias("n"))
    all_of = [_when("C18.count", "error", F.lit("places"), f"not above {baseline} public sources", n <= baseline), _when("C18.count", "warning", F.lit("places"), f"below {wished} public sources", n < wished), _when("C18.stats", "error", F.lit("stats"), "does not match the recount", n != stated)]
    return _inlined(whole, all_of).unionByName(_inlined(places, single))

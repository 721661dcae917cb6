"""Evidence resolution: a table of rules, and one of cleanups, worked off segment by segment as a fold in the plan.

References of titles are parted from those of facts. Each rule says what becomes of a field that the evidence does not carry,
and may bring references; those count only if their quote stands on their page, which one join finds out for all rules.
Then a segment's rules are folded over it in order: references are added, the field takes its value, notes and the row of
the log are written. Keys of quotes are made before, so the fold needs no Python; it holds one segment at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let, plain_key, short_text
from quillspark.functions.udf import match_key, nfkc

# Actions, what stands for an unknown value, the fields it is for, and the wording of notes.
SUPPORTED, REWRITTEN, CLEARED = "supported_with_new_book_ref", "rewritten_without_unsupported_part", "cleared_to_unspecified"
UNSPECIFIED, FACT_FIELDS, UNCONFIGURED = "书中未明示", ("resupply", "lodging", "risks_or_notes", "roads_or_paths"), "未配置补充证据，按保守规则降级。"
CHAPTER_WORDS, CHAPTER_NOTE, MOVED_NOTE = ("标题", "章节"), "章节或段落标题来源", ("已将 ", " 条章节/路线标题引用移入 chapter_refs，book_refs 仅保留路线事实证据。")
REWRITTEN_NOTE, CLEARED_NOTE, TIDIED = ("证据不足，待人工复核：", " 原内容含无法由本段 book_refs 支撑的信息；原内容："), ("证据不足，待人工复核：", " 原内容："), "已按书中证据清理。"
UNVALIDATED, NO_QUOTES, TIGHTENED, NO_REFS = ": 补充引文未全部通过页内校验，已保守处理。", "无新增引文", ": 标题引用移出后补充正文证据并收紧表达。", "该段只有 chapter_refs 或缺少路线事实 book_refs。"
FOUND, LOST, NO_PAGE = "found", "quote not found in OCR page", "invalid page"
BEFORE_IN_NOTE, BEFORE_IN_LOG = 180, 220

REF = "struct<page:string,quote:string,note:string>"
_KEYED = "struct<page:string,quote:string,note:string,key:string>"
_LOG = "struct<field:string,claim:string,action:string,before:string,after:string,added_refs:string,moved_to_review_notes:string,quote_validation:string,notes:string>"
_STATE = f"struct<refs:array<{_KEYED}>,fields:map<string,string>,review:array<string>,evidence:array<string>,log:array<{_LOG}>>"
_APART = "\x01"


def _empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _keys(quotes: Column) -> Column:
    """The match keys of a list of texts, by one call for the list."""
    joined = F.array_join(F.transform(quotes, lambda q: F.replace(F.coalesce(q, F.lit("")), F.lit(_APART), F.lit(""))), _APART)
    return F.transform(F.split(nfkc(joined), _APART), plain_key)


def _keyed(refs: Column, keys: Column) -> Column:
    at = F.transform(refs, lambda r, i: F.struct(r["page"].alias("page"), r["quote"].alias("quote"), r["note"].alias("note"), F.get(keys, i).alias("key")))
    return at.cast(f"array<{_KEYED}>")


def _noted(notes: Column, note: Column) -> Column:
    return F.when(note.isNull() | F.array_contains(notes, note), notes).otherwise(F.array_append(notes, note))


def _added(refs: Column, new: Column) -> Column:
    """refs and those new ones that are valid and whose page and key are not there yet; of equal new ones the first."""
    plain = lambda r: F.struct(r["page"].alias("page"), r["quote"].alias("quote"), r["note"].alias("note"), r["key"].alias("key"))
    same = lambda a, b: a["page"].eqNullSafe(b["page"]) & (a["key"] == b["key"])
    return F.aggregate(F.filter(new, lambda r: r["said"] == FOUND), refs, lambda acc, r: F.when(F.exists(acc, lambda x: same(x, r)), acc).otherwise(F.array_append(acc, plain(r))))


def _named(refs: Column) -> Column:
    return F.transform(refs, lambda r: F.concat(F.lit("p"), F.coalesce(r["page"], F.lit("")), F.lit(" "), F.coalesce(r["quote"], F.lit(""))))


def _validated(owners: DataFrame, keys: list[str], pages: DataFrame) -> DataFrame:
    """owners with refs as structs of the reference, its key, and what its page says of it (said)."""
    each = owners.select(*keys, F.posexplode("refs").alias("_i", "_r")).withColumns({"_page": F.col("_r.page").try_cast("long"), "_key": match_key(F.col("_r.quote"))})
    cited = pages.select(F.col("page").alias("_page"), "text").join(each.select("_page").distinct(), "_page", "left_semi").select("_page", match_key(F.col("text")).alias("_text"))
    joined = each.join(cited, "_page", "left")
    said = F.when(F.col("_page").isNull(), NO_PAGE).when((F.col("_key") != "") & F.contains(F.coalesce("_text", F.lit("")), F.col("_key")), FOUND).otherwise(LOST)
    row = F.struct("_i", F.col("_r.page").alias("page"), F.col("_r.quote").alias("quote"), F.col("_r.note").alias("note"), F.col("_key").alias("key"), said.alias("said"))
    found = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_refs"))
    return owners.drop("refs").join(found, keys, "left").withColumn("refs", _empty(F.col("_refs"), "struct<_i:int,page:string,quote:string,note:string,key:string,said:string>")).drop("_refs")


def _checked(refs: Column) -> Column:
    return F.array_join(F.transform(refs, lambda r: F.concat(F.lit("p"), F.coalesce(r["page"], F.lit("")), F.lit(":"), r["said"])), " | ")


def _changed(fields: Column, name: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.map_from_arrays(F.array(name), F.array(value)))


def _step(state: Column, r: Column) -> Column:
    """One rule over a segment's state."""
    before, known = state["fields"][r["field"]], r["action"].isNotNull()
    action = F.coalesce(r["action"], F.lit(CLEARED))
    note = F.when(known, F.coalesce(r["note"], F.lit(""))).otherwise(UNCONFIGURED)
    value = F.when(known, r["new_value"]).when(r["field"].isin(*FACT_FIELDS), F.lit(UNSPECIFIED)).otherwise(before)
    valid = F.forall(r["refs"], lambda x: x["said"] == FOUND)
    refs = _added(state["refs"], r["refs"])
    new = F.slice(refs, F.size(state["refs"]) + 1, F.size(refs))
    kept = (action == SUPPORTED) & valid
    said = lambda parts: F.concat(F.lit(parts[0]), r["field"], F.lit(parts[1]), short_text(before, BEFORE_IN_NOTE))
    review = F.when(~kept, F.when(action == REWRITTEN, said(REWRITTEN_NOTE)).otherwise(said(CLEARED_NOTE)))
    evidence = _noted(state["evidence"], F.concat(r["field"], F.lit(": "), action, F.lit("; "), F.when(note == "", TIDIED).otherwise(note)))
    evidence = _noted(evidence, F.when(~valid, F.concat(r["field"], F.lit(UNVALIDATED))))
    row = F.struct(
        r["field"].alias("field"), r["claim"].alias("claim"), action.alias("action"), short_text(before, BEFORE_IN_LOG).alias("before"), short_text(value, BEFORE_IN_LOG).alias("after"), F.array_join(_named(new), " | ").alias("added_refs"),
        F.when(kept, "no").otherwise("yes").alias("moved_to_review_notes"), F.when(F.size(r["refs"]) == 0, NO_QUOTES).otherwise(_checked(r["refs"])).alias("quote_validation"), note.alias("notes"),
    )
    return F.struct(refs.alias("refs"), _changed(state["fields"], r["field"], value).alias("fields"), _noted(state["review"], review).alias("review"), evidence.alias("evidence"), F.array_append(state["log"], row.cast(_LOG)).alias("log")).cast(_STATE)


def resolved(segments: DataFrame, rules: DataFrame, cleanups: DataFrame, pages: DataFrame) -> DataFrame:
    """segments after all rules and cleanups: id, fields, book_refs, chapter_refs, review_notes, evidence_notes, evidence_status, moved (chapter
    references), log (a row for each rule) and cleanup (what the cleanup did, or null).

    segments: id, title, fields (map of text), book_refs, chapter_refs (arrays of page, quote, note), review_notes, evidence_notes,
    evidence_status. rules: id, ord, field, claim, action (null where nothing is set down for the claim), new_value, note, refs. cleanups: id
    (once), fields (map, noted in order of name), refs, updates (array of page, old_quote, new_quote), review_note. pages: page, text (a page once).
    Rules and cleanups of unknown segments do nothing.
    """
    keyed = segments.withColumns({"_title": match_key(F.col("title")), "book_refs": _empty(F.col("book_refs"), REF), "chapter_refs": _empty(F.col("chapter_refs"), REF)})
    keyed = keyed.withColumn("_keys", _keys(F.transform("book_refs", lambda r: r["quote"]))).withColumn("_refs", _keyed(F.col("book_refs"), F.col("_keys")))
    worded = lambda r: F.exists(F.array(*map(F.lit, CHAPTER_WORDS)), lambda w: F.contains(F.coalesce(r["note"], F.lit("")), w))
    chapter = lambda r: worded(r) | ((F.trim(F.coalesce("title", F.lit(""))) != "") & (r["key"] == F.col("_title")))
    titled = F.filter("_refs", chapter)
    moved = F.transform(titled, lambda r: F.struct(r["page"].alias("page"), r["quote"].alias("quote"), F.lit(CHAPTER_NOTE).alias("note")).cast(REF))
    chapters = F.aggregate(moved, F.col("chapter_refs").cast(f"array<{REF}>"), lambda acc, r: F.when(F.exists(acc, lambda x: x.eqNullSafe(r)), acc).otherwise(F.array_append(acc, r)))
    n = F.size(titled)
    told = F.when(n > 0, F.concat(F.lit(MOVED_NOTE[0]), n.cast("string"), F.lit(MOVED_NOTE[1])))
    split = keyed.select(
        "id", "fields", F.filter("_refs", lambda r: ~chapter(r)).alias("refs"), chapters.alias("chapter_refs"), _empty(F.col("review_notes"), "string").alias("review"), _noted(_empty(F.col("evidence_notes"), "string"), told).alias("evidence"), "evidence_status", n.cast("long").alias("moved")
    )
    ready = _validated(rules.withColumn("refs", _empty(F.col("refs"), REF)), ["id", "ord"], pages)
    listed = ready.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "field", "claim", "action", "new_value", "note", "refs"))).alias("rules"))
    start = F.struct("refs", "fields", "review", "evidence", F.array().cast(f"array<{_LOG}>").alias("log")).cast(_STATE)
    folded = split.join(listed, "id", "left").select("id", "chapter_refs", "evidence_status", "moved", F.coalesce(F.size("rules"), F.lit(0)).alias("_rules"), F.when(F.col("rules").isNull(), start).otherwise(F.aggregate("rules", start, _step)).alias("s"))
    return _cleaned(folded, cleanups, pages)


def _cleaned(folded: DataFrame, cleanups: DataFrame, pages: DataFrame) -> DataFrame:
    given = _validated(cleanups.withColumn("refs", _empty(F.col("refs"), REF)), ["id"], pages).withColumn("updates", _empty(F.col("updates"), "struct<page:string,old_quote:string,new_quote:string>"))
    old, new = _keys(F.transform("updates", lambda u: u["old_quote"])), _keys(F.transform("updates", lambda u: u["new_quote"]))
    given = given.withColumns({"_old": old, "_new": new})
    updates = F.transform("updates", lambda u, i: F.struct(u["page"].alias("page"), u["new_quote"].alias("quote"), F.get("_old", i).alias("old"), F.get("_new", i).alias("new")))
    given = given.select("id", F.col("fields").alias("c_fields"), F.col("refs").alias("c_refs"), updates.alias("c_updates"), F.col("review_note").alias("c_note"), F.lit(True).alias("c"))
    joined = folded.join(given, "id", "left")
    fields = F.coalesce("c_fields", F.create_map().cast("map<string,string>"))
    more = _empty(F.col("c_refs"), "struct<_i:int,page:string,quote:string,note:string,key:string,said:string>")
    grown = joined.withColumn("_refs", _added(F.col("s.refs"), more)).withColumn("_news", F.slice("_refs", F.size("s.refs") + 1, F.size("_refs")))
    hit = lambda r, u: r["page"].eqNullSafe(u["page"]) & (u["old"] != "") & (r["key"] == u["old"])
    put = lambda r, u: F.when(hit(r, u), F.struct(r["page"].alias("page"), u["quote"].alias("quote"), r["note"].alias("note"), u["new"].alias("key")).cast(_KEYED)).otherwise(r)
    start = F.struct(F.col("_refs").alias("refs"), F.array().cast("array<string>").alias("told"))
    shape = f"struct<refs:array<{_KEYED}>,told:array<string>>"
    told = lambda s, u: F.concat(s["told"], F.array_repeat(F.concat(F.lit("p"), u["page"], F.lit(" quote updated")), F.size(F.filter(s["refs"], lambda r: hit(r, u)))))
    changed = F.aggregate(F.coalesce("c_updates", F.array().cast("array<struct<page:string,quote:string,old:string,new:string>>")), start.cast(shape), lambda s, u: F.struct(F.transform(s["refs"], lambda r: put(r, u)).alias("refs"), told(s, u).alias("told")).cast(shape))
    done = grown.withColumn("_u", changed)
    names = F.array_sort(F.map_keys(fields))
    told_all = F.concat(F.transform(names, lambda f: F.concat(f, F.lit(TIGHTENED))), F.col("_u.told"))
    evidence = F.aggregate(told_all, F.col("s.evidence"), _noted)
    review = F.when(F.coalesce("c_note", F.lit("")) != "", _noted(F.col("s.review"), F.col("c_note"))).otherwise(F.col("s.review"))
    acted = F.coalesce(F.col("c"), F.lit(False)) & ((F.size(names) > 0) | (F.size("_news") > 0) | (F.size("_u.told") > 0))
    row = F.struct(
        F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("book_refs").alias("fields"), F.array_join(F.concat(_named(F.col("_news")), F.col("_u.told")), " | ").alias("added_refs"),
        F.when(F.size(more) == 0, NO_QUOTES).otherwise(_checked(more)).alias("quote_validation"), F.coalesce("c_note", F.lit("")).alias("notes"),
    )
    none = F.size("_u.refs") == 0
    status = F.when(none, "fail").when(acted | (F.col("_rules") > 0), "warning").otherwise(F.coalesce("evidence_status", F.when(F.size("chapter_refs") > 0, "warning").otherwise("pass")))
    plain = F.transform("_u.refs", lambda r: F.struct(r["page"].alias("page"), r["quote"].alias("quote"), r["note"].alias("note")))
    merged = let(F.map_filter(F.coalesce("s.fields", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(fields), k)), lambda rest: F.map_concat(rest, fields))
    return done.select(
        "id", merged.alias("fields"), plain.alias("book_refs"), "chapter_refs", review.alias("review_notes"), F.when(none, _noted(evidence, F.lit(NO_REFS))).otherwise(evidence).alias("evidence_notes"), status.alias("evidence_status"), "moved", F.col("s.log").alias("log"), F.when(acted, row).alias("cleanup")
    )


def change_log(done: DataFrame) -> DataFrame:
    """A row for each rule that was applied, in order."""
    return done.select("id", F.posexplode("log").alias("place", "_l")).select("id", "place", "_l.*")

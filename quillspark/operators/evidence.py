"""Claims against the evidence that a segment cites, and what to do with those it does not carry."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import anchors as text_anchors
from quillspark.functions.text import claims as claim_texts
from quillspark.functions.text import plain_key
from quillspark.functions.udf import match_key, near_window_ratio, nfkc


def evidence_text(refs: DataFrame, pages: DataFrame, segment: str, page: str, text: str, quote: str | None = None, note: str | None = None, order: str | None = None) -> DataFrame:
    """segment, evidence: the texts of all cited pages, each once, in order of page. Where quotes, notes and an order are
    named, each reference gives its page's text, its quote and its note, in order; one whose page is no whole number gives none."""
    if order is None:
        joined = refs.select(segment, page).distinct().join(pages.select(page, text), page)
        return joined.groupBy(segment).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text]), " ").alias("evidence"))
    cited = refs.select(segment, order, F.col(page).try_cast("long").alias("_page"), F.col(quote).alias("_quote"), F.col(note).alias("_note")).where("_page IS NOT NULL")
    joined = cited.join(pages.select(F.col(page).alias("_page"), F.col(text).alias("_text")), "_page", "left")
    pieces = F.concat_ws("\n", "_text", F.coalesce("_quote", F.lit("")), F.coalesce("_note", F.lit("")))
    return joined.groupBy(segment).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, pieces.alias("_x")))), lambda x: x["_x"]), "\n").alias("evidence"))


#: The fields of a segment that are audited, in order.
AUDITED_FIELDS = ("route_summary", "walking_directions", "terrain", "roads_or_paths", "water_sources", "resupply", "lodging", "risks_or_notes")
#: Names and words of a route that count as anchors beside a segment's own places.
ROUTE_KEYWORDS = tuple(
    """
健德门 皂甲屯 小月河 清河 南沙河 南玉河 北玉河 甲屯路 沙阳路 旧县 龙虎台 南口 居庸关 关沟 水关 八达岭 岔道城 小泥河 大泥河 大榆树 白河堡 燕山天池 车坊
黑峪口 盘云岭 昌赤路 骆驼山 郑家窑 镇虏楼 长伸地 巡检司 红沙梁 龙门所 G112 京环线 塘子庙 东万口 白草镇 黑河 X404 三道川 黑龙山 山神庙 老掌沟 小厂镇 沙岭 前坝
五花草甸 葫芦河 石头城 牛群头 沽源 梳妆楼 闪电河 河东村 青年湖 察罕脑儿 小宏城子 水泉淖尔 转佛庙 马神庙 塞北管理区 方元酒店 402 滦河 内蒙古 明安驿 李陵台
黑城子 X502 正蓝旗 四郎城 上都镇 圣元街 四郎城路 上都音高勒 明德门 元上都 上都遗址 县道 国道 公路 土路 水泥路 大堤 桥 河 河谷 水库 村 镇 城 关 岭 山 草甸 草原
沙丘 铁丝网 住宿 宾馆 旅馆 餐馆 小店 买水 水泡 暑热 酷热 搭车 坐车 出租车
""".split()
)


def field_claims(segments: DataFrame, segment: str, fields: tuple[str, ...] = AUDITED_FIELDS, *more: str) -> DataFrame:
    """segment, more columns, field, place, claim: the claims of each field, in order. A list's entries are its lines."""
    kinds = dict(segments.dtypes)
    texts = [F.array_join(F.col(f), "\n") if kinds[f].startswith("array") else F.col(f).cast("string") for f in fields]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), t.alias("_text")) for f, t in zip(fields, texts)]))
    rows = segments.select(segment, *more, each.alias("_f")).select(segment, *more, "_f.*")
    return rows.select(segment, *more, "field", F.posexplode(claim_texts(F.col("_text"))).alias("place", "claim"))


def named_places(*names: Column) -> Column:
    """The distinct names of a segment's points, the longest first."""
    there = F.filter(F.array_distinct(F.concat(*names)), lambda n: n.isNotNull() & (n != ""))
    return F.transform(F.array_sort(F.transform(there, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])


#: The lengths of claims that one anchor, or none, is enough for, and the similarities that longer ones need.
SHORT_ANCHORED, SHORT_BARE, NEAR_ANCHORED, NEAR_BARE = 12, 10, 0.42, 0.45


def claims_by_anchors(claims: DataFrame, evidence: DataFrame, segment: str, anchors: Column, key, anchor_keys: Column | None = None) -> DataFrame:
    """Adds support, anchors and the keys of claim and evidence to claims (segment, claim).

    anchor_keys: what the anchors are looked for by, where it is not their plain_key.

    empty: nothing to carry; direct: the evidence holds the claim; anchor, anchors: its one anchor, or half of them, and it
    is short, or has several; short: a short claim without anchors; none; similar?: similarity decides.
    """
    keyed = claims.withColumns({"anchors": anchors, "claim_key": key(F.col("claim"))})
    joined = keyed.join(evidence.select(segment, key(F.col("evidence")).alias("evidence_key")), segment, "left").withColumn("evidence_key", F.coalesce("evidence_key", F.lit("")))
    joined = joined.withColumn("anchor_keys", F.transform("anchors", plain_key) if anchor_keys is None else anchor_keys)
    n, found = F.size("anchor_keys"), F.size(F.filter("anchor_keys", lambda a: F.contains(F.col("evidence_key"), a)))
    size = F.length("claim_key")
    support = (
        F.when(size == 0, "empty")
        .when(F.contains(F.col("evidence_key"), F.col("claim_key")), "direct")
        .when(n == 1, F.when(found == 0, "none").when(size <= SHORT_ANCHORED, "anchor").otherwise("similar?"))
        .when(n > 1, F.when(found >= F.floor((n + 1) / 2), "anchors").otherwise("none"))
        .when(size <= SHORT_BARE, "short")
        .otherwise("similar?")
    )
    return joined.withColumn("support", support)


def audited_claims(claims: DataFrame, evidence: DataFrame, segment: str, names: tuple[str, ...] | Column = (), keywords: tuple[str, ...] = ()) -> DataFrame:
    """claims (segment, claim and more) with support: claims_by_anchors by match_key, and what it leaves open by similarity
    (similar or none); with the anchors, those that the evidence lacks (by key), and the score where similarity decided.

    Names, given ones or an array of each row, are looked for in the claim's compatibility form; codes and numbers are those
    of the claim as it stands, so a mark like ⑫ is no number. Only claims that are left open reach the similarity function.
    """
    fold_all = lambda c: F.split(nfkc(F.array_join(c, "\n")), "\n")
    if isinstance(names, Column):
        claims = claims.withColumn("_names", fold_all(names))
    else:
        names = tuple(unicodedata.normalize("NFKC", n) for n in names)
    folded = claims.withColumn("_folded", nfkc(F.col("claim")))
    found = text_anchors(F.col("claim"), F.col("_names") if isinstance(names, Column) else names, keywords, named_in=F.col("_folded"))
    keys = F.filter(F.array_distinct(F.transform(fold_all(F.col("anchors")), plain_key)), lambda k: k != "")
    judged = claims_by_anchors(folded, evidence, segment, found, match_key, keys)
    enough = F.when(F.size("anchor_keys") == 1, F.lit(NEAR_ANCHORED)).otherwise(F.lit(NEAR_BARE))
    open_ = F.col("support") == "similar?"
    lacking = F.filter("anchor_keys", lambda a: ~F.contains(F.col("evidence_key"), a))
    pairs = judged.withColumns({"lacking": lacking, "_a": F.when(open_, F.col("claim_key")), "_b": F.when(open_, F.col("evidence_key")), "_floor": enough})
    # dealt out anew, in a number that stays: rows are short for the work that their windows make. A filter on what comes of the
    # function must not move it to where rows were before: it does not pass a function that may give another value
    tasks = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.drop("_names", "_folded", "claim_key", "evidence_key", "anchor_keys").repartition(tasks, segment, "claim")
    scored = dealt.withColumn("score", near_window_ratio.asNondeterministic()("_a", "_b", "_floor"))
    support = F.when(F.col("_a").isNull(), F.col("support")).when(F.col("score") >= F.col("_floor"), "similar").otherwise("none")
    return scored.withColumn("support", support).drop("_a", "_b", "_floor")


def unsupported_claims(segments: DataFrame, refs: DataFrame, pages: DataFrame, segment: str, order: str, names: Column, fields: tuple[str, ...] = AUDITED_FIELDS, keywords: tuple[str, ...] = ROUTE_KEYWORDS) -> DataFrame:
    """segment, field, place, claim, support, anchors, lacking, pages: each claim of the audited fields that the segment's
    evidence does not carry. segments: segment, the fields and what names are made of; refs: segment, page, quote, note and an
    order; pages: page, text (one row a page). pages of the result: the cited ones that are whole numbers, ascending."""
    evidence = evidence_text(refs, pages, segment, "page", "text", "quote", "note", order)
    cited = refs.select(segment, F.col("page").try_cast("long").alias("_p")).groupBy(segment).agg(F.array_join(F.transform(F.array_sort(F.collect_set("_p")), lambda p: p.cast("string")), ",").alias("pages"))
    claims = field_claims(segments.withColumn("_places", names), segment, fields, "_places")
    judged = audited_claims(claims, evidence, segment, F.col("_places"), keywords).where("support = 'none'")
    return judged.join(cited, segment, "left").select(segment, "field", "place", "claim", "support", "anchors", "lacking", F.coalesce("pages", F.lit("")).alias("pages"))


def partition_refs(refs: Column, is_chapter) -> tuple[Column, Column]:
    """(chapter references, factual references) of an array of structs, both in order."""
    return F.filter(refs, is_chapter), F.filter(refs, lambda r: ~is_chapter(r))


def add_refs(refs: Column, more: Column, key) -> Column:
    """refs, and those of more whose key none of refs has; the first of equal newcomers."""
    return F.aggregate(more, refs, lambda acc, r: F.when(F.exists(acc, lambda x: key(x) == key(r)), acc).otherwise(F.array_append(acc, r)))


def resolve(action: Column, before: Column, new_value: Column, refs_valid: Column, cleared: str) -> Column:
    """The value after a rule: kept where supported, replaced where rewritten, replaced too where new references fail."""
    supported = action == "supported_with_new_ref"
    return F.when(supported & refs_valid, before).when(supported | action.isin("rewrite"), new_value).when(action == "keep", before).otherwise(F.lit(cleared))


def replace_quote(refs: Column, page: Column, old: Column, new: Column, norm) -> Column:
    """Quotes equal to old by norm, on that page, become new."""
    return F.transform(refs, lambda r: F.when((r["page"] == page) & (norm(r["quote"]) == norm(old)), F.struct(r["page"].alias("page"), new.alias("quote"))).otherwise(F.struct(r["page"].alias("page"), r["quote"].alias("quote"))))

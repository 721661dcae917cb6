"""Excerpts and reading blocks of sections: roles, scores, and a choice that spreads over the roles. JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: The words that tell of movement, sights, feelings, turns and daily life, and of front matter.
EXCERPT_MOVEMENT = "下车|上车|车厢|火车|汽车|船|甲板|公路|铁路|路上|上路|赶路|走到|到达|抵达|经过|驶|航|乘|出发|进城|沿着|沿"
EXCERPT_SIGHTS = "看|见|山|水|树|风|雨|城|寺|庙|街|江|海|湖|岩|峰"
EXCERPT_SCENERY = "山|水|风|雨|城|寺|庙|街|江|海|湖|岩|峰|树|云"
EXCERPT_FEELINGS = "觉得|感到|想|心|喜欢|忧郁|寂寞|兴奋|可惜|难忘"
EXCERPT_FRONT = r"第\d+封|台鉴|阿晖|目录|版权|ISBN"
BLOCK_TURNS = "忽然|突然|可是|然而|但|却|转|改|终于|后来"
BLOCK_MOVEMENT = "下车|上车|车厢|火车|汽车|船|甲板|公路|铁路|路上|赶路|走到|到达|抵达|经过|驶|航|乘|出发|进城|沿着|沿"
BLOCK_FEELINGS = "觉得|感到|想|心|喜欢|忧郁|寂寞|兴奋|可惜|难忘|以为|看来"
BLOCK_DAILY = "饭|宿|住|店|人|朋友|先生|师傅|买|问|说|谈|睡|醒"
BLOCK_FRONT = r"目录|版权|ISBN|第\d+封"
SALUTATION = "台鉴"

#: Roles in the order in which they are tested (None: the text names a place) and in which they are wanted.
EXCERPT_RULES = (("place_description", None), ("route_movement", EXCERPT_MOVEMENT), ("travel_observation", EXCERPT_SIGHTS), ("reflection", EXCERPT_FEELINGS))
EXCERPT_ROLES = ("opening_scene", "route_movement", "place_description", "travel_observation", "reflection", "closing_moment")
BLOCK_RULES = (("turning_point", BLOCK_TURNS), ("place_observation", None), ("route_movement", BLOCK_MOVEMENT), ("reflection", BLOCK_FEELINGS), ("travel_detail", BLOCK_DAILY))
BLOCK_ROLES = ("opening_scene", "route_movement", "place_observation", "travel_detail", "reflection", "turning_point", "closing_moment")


def names_any(text: Column, places: Column) -> Column:
    """Whether the text holds one of the places; empty and null ones name nothing."""
    return F.coalesce(F.exists(places, lambda p: F.coalesce((p != "") & F.contains(text, p), F.lit(False))), F.lit(False))


def role_of(text: Column, placed: Column, i: Column, n: Column, rules=EXCERPT_RULES, last: int = 1) -> Column:
    """The role of candidate i (from 0) of n: by place first, the last ones closing, then by the first rule that fits."""
    role = F.when(i == 0, "opening_scene").when(i >= n - last, "closing_moment")
    for name, words in rules:
        role = role.when(placed if words is None else text.rlike(words), name)
    return role.otherwise("other")


def score_of(text: Column, longest: int, gains: tuple[tuple[Column, int], ...]) -> Column:
    """Characters up to the limit, and what each condition that holds adds."""
    return sum((F.when(holds, points).otherwise(0) for holds, points in gains), F.least(F.length(text), F.lit(longest)))


def excerpt_score(text: Column, placed: Column, markers: tuple[str, ...] = ()) -> Column:
    """markers: texts that stand in for missing excerpts."""
    stand_in = T.has_marker(text, markers) if markers else F.lit(False)
    return score_of(text, 120, ((placed, 45), (text.rlike(EXCERPT_MOVEMENT), 35), (text.rlike(EXCERPT_SCENERY), 30), (text.rlike(EXCERPT_FEELINGS), 25), (text.rlike(EXCERPT_FRONT), -200), (stand_in, -500)))


def block_score(text: Column, placed: Column, role: Column) -> Column:
    liked = role.isin("route_movement", "place_observation", "travel_detail", "reflection")
    return score_of(text, 240, ((F.length(text).between(100, 260), 50), (placed, 55), (liked, 35), (role == "other", -20), (text.rlike(BLOCK_FRONT), -200)))


def choose(df: DataFrame, part: list[str], text: str, role: str, score: str, order: str, roles: tuple[str, ...], k: int, by_order: bool = False) -> DataFrame:
    """part, place (from 1), text, role, score, order of up to k rows with different texts a part.

    Role by role the best row whose text is not taken yet, until k are taken; then the best of the rest. The best has the highest
    score, then the lowest order. Places follow the taking, or the order column. Only the 2k best different texts of a role can be
    taken, so no more meet in a part's array, however many rows it has. Null texts, scores and orders are left out.
    """
    whole = df.select(*part, F.col(text).alias("_text"), F.col(role).alias("_role"), F.col(score).alias("_score"), F.col(order).alias("_order")).dropna(subset=["_text", "_score", "_order"])
    best = [F.desc("_score"), F.asc("_order")]
    once = whole.withColumn("_n", F.row_number().over(Window.partitionBy(*part, "_role", "_text").orderBy(*best))).where("_n = 1")
    top = once.withColumn("_n", F.row_number().over(Window.partitionBy(*part, "_role").orderBy(*best))).where(F.col("_n") <= 2 * k)
    row = F.struct((-F.col("_score")).alias("loss"), F.col("_order").alias("order"), F.col("_role").alias("role"), F.col("_text").alias("text"))
    rows = top.groupBy(*part).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    turn = lambda xs, at: F.transform(xs, lambda x: F.struct(F.lit(at).alias("turn"), x.alias("row")))
    tries = F.concat(*[turn(F.filter("_rows", lambda x: x["role"] == r), i) for i, r in enumerate(roles)], turn(F.col("_rows"), len(roles)))
    start = F.struct(F.slice("_rows", 1, 0).alias("taken"), F.lit(-1).alias("turn"))

    def attempt(acc: Column, x: Column) -> Column:
        free = (x["turn"] == len(roles)) | (x["turn"] != acc["turn"])
        fits = (F.size(acc["taken"]) < k) & free & ~F.exists(acc["taken"], lambda y: y["text"] == x["row"]["text"])
        return F.when(fits, F.struct(F.array_append(acc["taken"], x["row"]).alias("taken"), x["turn"].alias("turn"))).otherwise(acc)

    taken = F.aggregate(tries, start, attempt, lambda acc: acc["taken"])
    if by_order:
        taken = F.array_sort(taken, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
    placed = rows.select(*part, F.posexplode(taken).alias("_i", "_row"))
    return placed.select(*part, (F.col("_i") + 1).cast("long").alias("place"), F.col("_row.text").alias(text), F.col("_row.role").alias(role), (-F.col("_row.loss")).alias(score), F.col("_row.order").alias(order))


def section_excerpts(sections: DataFrame, key: str, title: str, text: str, places: str, k: int = 4, markers: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """key, place, text, role, score, order: up to k excerpts a section, its paragraphs' heads where sentences are too few.

    places: an array column. The order of a head is its paragraph's, after all sentences.
    """
    kept = T.usable_paragraphs(F.col(text), F.coalesce(title, F.lit("")), drop=drop)
    pieces = F.flatten(F.transform(kept, lambda p: T.sentences(p, ends="。！？；")))
    cut = F.transform(pieces, lambda s: F.when(F.length(s).between(20, 160), s).when(F.length(s) > 160, T.clip(s, "。；，、")))
    parts = sections.select(key, F.col(places).alias("_places"), kept.alias("_kept"), F.filter(cut, lambda s: s.isNotNull()).alias("_cut"))
    each = parts.select(key, "_places", F.size("_cut").alias("_total"), F.posexplode("_cut").alias("order", "_piece"))
    clean = each.withColumn("text", T.squash(F.col("_piece"))).where(F.length("text") >= 20)
    first = clean.withColumn("_n", F.row_number().over(Window.partitionBy(key, "text").orderBy("order"))).where("_n = 1")
    placed = names_any(F.col("text"), F.col("_places"))
    scored = first.select(key, "text", role_of(F.col("text"), placed, F.col("order"), F.col("_total")).alias("role"), excerpt_score(F.col("text"), placed, markers).alias("score"), "order")
    heads = parts.select(key, F.size("_cut").alias("_total"), F.posexplode("_kept").alias("_i", "_p"))
    spare = heads.select(key, F.coalesce(T.clip(F.col("_p"), "。；，、"), T.strip(F.substring("_p", 1, 120))).alias("text"), F.lit(SPARE).alias("role"), F.lit(SPARE_SCORE).alias("score"), (F.col("_total") + F.col("_i")).alias("order")).where(F.length("text") >= 20)
    chosen = choose(scored.unionByName(spare), [key], "text", "role", "score", "order", EXCERPT_ROLES, k)
    told = chosen.join(parts.select(key, "_places", F.greatest(F.size("_cut"), F.lit(1)).alias("_total")), key)
    own = role_of(F.col("text"), names_any(F.col("text"), F.col("_places")), F.col("place") - 1, F.col("_total"))
    return told.select(key, "place", "text", F.when(F.col("role") == SPARE, own).otherwise(F.col("role")).alias("role"), "score", "order")


#: A paragraph's head, whose role follows from its place among the chosen; its score is below every one that a sentence can have.
SPARE, SPARE_SCORE = "spare", -10_000


def section_blocks(sections: DataFrame, key: str, title: str, text: str, places: str, k: int = 5, markers: tuple[str, ...] = ()) -> DataFrame:
    """key, place, text, role, score, order, scope: up to k reading blocks a section in the order of the source.

    Paragraphs that hold a marker go, so do short ones that hold the salutation.
    """
    salutes = lambda p: (F.length(p) <= 24) & F.contains(p, F.lit(SALUTATION))
    usable = T.usable_paragraphs(F.col(text), F.coalesce(title, F.lit("")), greeting_chars=24)
    kept = F.filter(usable, lambda p: ~salutes(p) & (~T.has_marker(p, markers) if markers else F.lit(True)))
    blocks = F.transform(kept, lambda p: F.struct(p.alias("whole"), T.strip(T.block_of(T.sentences(p, ends="。！？；"), p)).alias("text")))
    fit = F.filter(blocks, lambda b: F.length(b["text"]).between(70, 340))
    parts = sections.select(key, F.col(places).alias("_places"), kept.alias("_kept"), fit.alias("_fit"))
    each = parts.select(key, "_places", "_kept", F.size("_fit").alias("_total"), F.posexplode("_fit").alias("order", "_b")).withColumn("text", F.col("_b.text"))
    placed = names_any(F.col("text"), F.col("_places"))
    roles = each.withColumn("_placed", placed).withColumn("role", role_of(F.col("text"), F.col("_placed"), F.col("order"), F.col("_total"), BLOCK_RULES, last=2))
    scored = roles.select(key, "text", "role", block_score(F.col("text"), F.col("_placed"), F.col("role")).alias("score"), "order", F.array_contains("_kept", F.col("text")).alias("_alone"))
    chosen = choose(scored, [key], "text", "role", "score", "order", BLOCK_ROLES, k, by_order=True)
    alone = scored.select(key, "order", "_alone")
    return chosen.join(alone, [key, "order"]).select(key, "place", "text", "role", "score", "order", F.when(F.col("_alone"), "paragraph").otherwise("paragraph_group").alias("scope"))


def excerpts_around(text: Column, probes: Column, title: Column, before: int = 10, after: int = 16, longest: int = 42, most: int = 2, title_chars: int = 28) -> Column:
    """The stretches around the first place of each probe that occurs, in the order of probes, each once; else the title's head."""
    at = lambda p: F.position(p, text)
    cut = lambda p: F.substring(F.substring(text, F.greatest(at(p) - before, F.lit(1)), F.least(at(p) - 1, F.lit(before)) + F.length(p) + after), F.lit(1), F.lit(longest))
    found = F.transform(F.filter(probes, lambda p: F.coalesce((p != "") & F.contains(text, p), F.lit(False))), cut)
    distinct = F.slice(F.array_distinct(found), 1, most)
    return F.when(F.size(distinct) > 0, distinct).otherwise(F.array(F.substring(F.coalesce(title, F.lit("")), 1, title_chars)))

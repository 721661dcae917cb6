"""Lookup joins: exact, by containment either way, with fallbacks, and fuzzy for what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip
from quillspark.functions.udf import best_window_ratio, match_key, near_window_ratio
from quillspark.operators.qgrams import contained
from quillspark.operators.qgrams import sent as small
from quillspark.sources.kept import kept


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order: a keyed map."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c != key]), order).alias("_v")).select(key, "_v.*")


def lookup(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join on key; where nothing is found, columns of the dimension take their defaults."""
    joined = df.join(dim.withColumn("_hit", F.lit(True)), key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(c)).otherwise(v) for c, v in defaults.items()}).drop("_hit")


def unknown_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return df.join(dim.select(key).distinct(), key, "left_anti")


def gazetteer_match(names: DataFrame, gazetteer: DataFrame, name: str = "name", entry: str = "entry", order: str = "ord") -> DataFrame:
    """name, entry, how: the exact entry, else the first in order that contains the name or lies in it, else missing.

    Distinct names only are matched, and of those only the ones without an exact entry; an index over runs of characters
    tells which entries may contain them or lie in them, so both sides may be large. Empty names and entries match nothing.
    """
    first = gazetteer.groupBy(F.col(entry).alias("_entry")).agg(F.min(order).alias("_o"))
    distinct = names.select(name).distinct()
    exact = kept(distinct.join(first.withColumnRenamed("_entry", name), name, "left"))
    rest = exact.where("_o IS NULL").select(name)
    within = contained(rest.select(name, F.col(name).alias("_n")), name, "_n", first.select("_entry", F.col("_entry").alias("_e")), "_entry", "_e")
    around = contained(first.select("_entry", F.col("_entry").alias("_e")), "_entry", "_e", rest.select(name, F.col(name).alias("_n")), name, "_n")
    near = within.unionByName(around).join(first, "_entry").groupBy(name).agg(F.min_by("_entry", "_o").alias("_near"))
    out = exact.join(near, name, "left")
    return out.select(name, F.when(F.col("_o").isNotNull(), F.col(name)).otherwise(F.col("_near")).alias(entry), F.when(F.col("_o").isNotNull(), "exact").when(F.col("_near").isNotNull(), "substring").otherwise("missing").alias("how"))


def shingles(text: Column, n: int) -> Column:
    """A hash for each n words in a row. The word list is named once: in a lambda it would be split anew for every word."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    grams = lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, n)]))
    return F.transform(F.array(words), lambda ws: F.slice(grams(ws), 1, F.greatest(F.size(ws) - n + 1, F.lit(0))))[0]


def containment(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str, gram: int = 5) -> DataFrame:
    """(quote_id, text_id) where the text contains the quote. Empty quotes lie in every text; those pairs are not listed.

    An equi join on one word n-gram of each quote finds the candidates (a quote's words all stand in a text that contains
    it, but for the first and last, which a text may hold as parts of longer words), then the strings are compared. Where
    the quotes' n-grams are of a size to be sent to every task, the text is at hand when one is met; else it is joined to
    the candidates. Quotes of fewer than gram + 2 words are found by an index over runs of characters.
    """
    q = quotes.select(quote_id, quote).withColumn("_g", shingles(F.regexp_replace(F.col(quote), r"^\S*\s+|\s+\S*$", ""), gram))
    q = kept(q.select(quote_id, quote, F.array_min("_g").alias("_k")))
    probe, t = q.where("_k IS NOT NULL"), texts.select(text_id, text)
    met = F.contains(F.col(text), F.col(quote))
    sent = small(probe)
    if sent is probe:
        grams = t.select(text_id, F.explode(F.array_distinct(shingles(F.col(text), gram))).alias("_k"))
        long = grams.join(probe, "_k").select(text_id, quote_id, quote).join(t, text_id).where(met)
    else:
        long = t.withColumn("_k", F.explode(F.array_distinct(shingles(F.col(text), gram)))).join(sent, "_k").where(met)
    short = contained(q.where("_k IS NULL"), quote_id, quote, t, text_id, text)
    return long.select(quote_id, text_id).unionByName(short).distinct()


def quote_status(
    refs: DataFrame, pages: DataFrame, page: str = "page", quote: str = "quote", key: Column | None = None, text: str = "text", short: int = 30, near_short: float = 0.78, near: float = 0.72, note: str | None = None, scores: bool = True
) -> DataFrame:
    """Adds status and score to references: the page is looked up, then the quote in it, exactly and at last by similarity.

    missing_ref_field: no page, or a blank quote (or note, where a column of notes is named); invalid_page: no whole number;
    missing_page; empty_quote: nothing but marks; found; approximate; citation_mismatch. Only cited pages are normalised, and
    only references that exact containment leaves over reach the similarity function with their texts; the others pass it as
    nulls. Without scores, the first window that is near decides; the score is then that one's, and null where none is near.
    """
    norm = key if key is not None else match_key
    number = F.col(page).try_cast("long")
    keyed = refs.withColumn("_page", number)
    cited = pages.withColumnRenamed("page", "_page").join(keyed.select("_page").distinct(), "_page", "left_semi")
    joined = keyed.withColumn("_quote", norm(F.col(quote))).join(cited.select("_page", norm(F.col(text)).alias("_text"), F.lit(True).alias("_there")), "_page", "left")
    blank = lambda c: F.coalesce(strip(F.col(c).cast("string")) == "", F.lit(True))
    exact = (
        F.when(F.coalesce(F.col(page).cast("string") == "", F.lit(True)) | blank(quote) | (blank(note) if note else F.lit(False)), "missing_ref_field")
        .when(F.col("_page").isNull(), "invalid_page")
        .when(F.col("_there").isNull(), "missing_page")
        .when(F.col("_quote") == "", "empty_quote")
        .when(F.contains("_text", F.col("_quote")), "found")
    )
    left = F.col("_exact").isNull()
    enough = F.when(F.length("_quote") < short, F.lit(near_short)).otherwise(F.lit(near))
    pair = F.when(left, F.col("_quote")), F.when(left, F.col("_text"))
    staged = joined.withColumn("_exact", exact).withColumn("_score", best_window_ratio(*pair) if scores else near_window_ratio(*pair, enough))
    status = F.coalesce("_exact", F.when(F.col("_score") >= enough, "approximate").otherwise("citation_mismatch"))
    score = F.when(left, F.col("_score")).when(F.col("_exact") == "found", 1.0).otherwise(0.0)
    return staged.withColumns({"status": status, "score": score}).drop("_page", "_quote", "_text", "_there", "_exact", "_score")


def by_array_key(df: DataFrame, key: str, groups: DataFrame, members: str, order: str) -> DataFrame:
    """df with the group whose members hold the key; of several the last in order, of none nulls. members is dropped."""
    each = groups.withColumn(key, F.explode(members)).drop(members)
    return df.join(last_wins(each, key, order), key, "left")


def memberships(items: DataFrame, item: str, groups: DataFrame, lists: list[str]) -> DataFrame:
    """Each group's row, without its lists, for each item that is in one of them; once, however often it is listed."""
    empty = F.array().cast(f"array<{dict(items.dtypes)[item]}>")
    members = F.array_distinct(F.concat(*[F.coalesce(F.col(c), empty) for c in lists]))
    return groups.withColumn(item, F.explode(members)).drop(*lists).join(items.select(item).distinct(), item)


def by_rule(df: DataFrame, rules: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """df with the columns of the rule for its keys, or their defaults where no rule is. A null in a rule stays null."""
    joined = df.join(small(rules.withColumn("_hit", F.lit(True))), keys, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(c)).otherwise(v) for c, v in defaults.items()}).drop("_hit")


def question_of(chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """chapter_id, question_id: the first question, in the order of ord, that is on the chapter's letter or links it with the
    scope letter; else the first whose id ends in the chapter's number, of three digits at least; else null.

    chapters: chapter_id, letter_id, number. questions: question_id, letter_id, linked (array), scope, ord. Two null letters agree.
    """
    own = questions.select("letter_id", "question_id", "ord")
    linked = questions.where("scope = 'letter'").select(F.explode("linked").alias("letter_id"), "question_id", "ord").where("letter_id <> ''")
    first = own.unionByName(linked).groupBy("letter_id").agg(F.min_by("question_id", "ord").alias("_own"))
    ending = F.expr("lpad(cast(coalesce(number, 0) as string), greatest(3, length(cast(coalesce(number, 0) as string))), '0')")
    numbered = chapters.select("chapter_id", "letter_id", ending.alias("_end"))
    # a question's ends, of the few lengths that numbers have, meet the numbers by equality
    lengths = numbered.agg(F.collect_set(F.length("_end")).alias("_lengths"))
    ends = questions.crossJoin(F.broadcast(lengths)).select("question_id", "ord", F.explode(F.filter("_lengths", lambda n: n <= F.length("question_id"))).alias("_n"))
    by_end = ends.groupBy(F.right("question_id", F.col("_n")).alias("_end")).agg(F.min_by("question_id", "ord").alias("_numbered"))
    found = numbered.alias("c").join(first.alias("f"), F.col("c.letter_id").eqNullSafe(F.col("f.letter_id")), "left").select("chapter_id", "_end", "_own")
    return found.join(by_end, "_end", "left").select("chapter_id", F.coalesce("_own", "_numbered").alias("question_id"))


def navigation_of(questions: DataFrame, chapters: DataFrame, fields: list[str], position: str, whole: str) -> DataFrame:
    """questions with the chapter's letter_id and fields, by the question's letter or else the first that it links; nulls and
    whole as the position where no chapter has it. chapters: letter_id, ord and the fields; of several the last counts."""
    known = last_wins(chapters.select("letter_id", "ord", *fields), "letter_id", "ord").drop("ord")
    asked = questions.withColumn("_letter", F.coalesce(F.when(F.col("letter_id") != "", F.col("letter_id")), F.get("linked", F.lit(0)))).drop("letter_id")
    joined = asked.join(known.withColumn("_hit", F.lit(True)), F.col("_letter") == F.col("letter_id"), "left")
    return joined.withColumn(position, F.when(F.col("_hit"), F.col(position)).otherwise(F.lit(whole))).drop("_letter", "_hit")

r"""Scalar text functions as Column expressions: all of them JVM-side, none a UDF.

White space is the Unicode class in WS wherever the engine trims or collapses; Spark's own \s and trim know ASCII only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]"
#: Ends of sentences, clause separators: full-width and ASCII.
SENTENCE_ENDS = "。！？!?."
CLAUSE_MARKS = "。；，、;,"


def or_empty(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    """Whether strip leaves nothing; the first character that stays decides."""
    return c.rlike(f"\\A{WS}*\\z")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def squash(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def first_truthy(*cols: Column) -> Column:
    """The first value that is neither null nor empty; white space is a value."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


#: What a line must be to be dropped, the marks that take no white space beside them, the limits of a large cleanup.
_PAGE_NUMBER = r"^\s*[-—–]?\s*\d{1,4}\s*[-—–]?\s*$"
_ORNAMENTS = ("|", "||", "_", "__", "·", "•")
_CJK_MARKS = "，。；：、！？"
_LARGE_CHARS, _LARGE_SHARE = 200, 0.5
#: The names of notes.
_NUMBER_NOTE, _ORNAMENT_NOTE, _LARGE_NOTE = "removed isolated page number", "removed ornamental noise", "large cleanup delta"


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once: a one-element array names it."""
    return F.transform(F.array(value), then)[0]


#: What ends a line (form feeds stand between the pages of a PDF's text), what becomes a blank, what goes.
_LINE_ENDS, _BLANK, _ZERO_WIDTH = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "\xa0", "\u200b"


def _clean_lines(text: Column) -> Column:
    unified = F.translate(F.replace(or_empty(text), F.lit("\r\n"), F.lit("\n")), _LINE_ENDS + _BLANK + _ZERO_WIDTH, "\n" * len(_LINE_ENDS) + " ")
    return F.transform(F.split(unified, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t\x{3000}]+", " ")))


def _cleaned(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: ~x.rlike(_PAGE_NUMBER) & ~x.isin(*_ORNAMENTS))
    after = F.regexp_replace(F.array_join(kept, "\n"), f"([{_CJK_MARKS}]){WS}+", "$1")
    return strip(F.regexp_replace(F.regexp_replace(after, f"{WS}+([{_CJK_MARKS}])", "$1"), r"\n{3,}", "\n\n"))


def clean_ocr_text(text: Column) -> Column:
    """Lines tidied, page numbers and ornaments dropped, no white space beside CJK marks, at most one empty line."""
    return let(_clean_lines(text), _cleaned)


def cleaned_with_notes(text: Column) -> Column:
    """struct<cleaned, notes>: clean_ocr_text, and what it did, sorted and distinct. The lines are worked out once."""
    before = F.length(or_empty(text))

    def noted(lines: Column, cleaned: Column) -> Column:
        notes = F.array(
            F.when((before > _LARGE_CHARS) & (F.length(cleaned) < before * _LARGE_SHARE), _LARGE_NOTE),
            F.when(F.exists(lines, lambda x: x.rlike(_PAGE_NUMBER)), _NUMBER_NOTE),
            F.when(F.exists(lines, lambda x: x.isin(*_ORNAMENTS)), _ORNAMENT_NOTE),
        )
        return F.struct(cleaned.alias("cleaned"), F.array_compact(notes).alias("notes"))

    return let(_clean_lines(text), lambda lines: let(_cleaned(lines), lambda cleaned: noted(lines, cleaned)))


def cleaning_notes(text: Column) -> Column:
    return cleaned_with_notes(text)["notes"]


def count_of(c: Column, char_class: str) -> Column:
    return F.regexp_count(c, F.lit(char_class))


CJK, LATIN = r"[\x{4e00}-\x{9fff}]", "[A-Za-z]"


def is_suspect(text: Column) -> Column:
    """Too short, too many replacement glyphs, or Latin noise in what should be CJK."""
    t = or_empty(text)
    latin, cjk = count_of(t, LATIN), count_of(t, CJK)
    return (F.length(strip(t)) < 80) | (count_of(t, "[�□■◆◇]") > 5) | ((latin > cjk * 1.2) & (cjk < 50))


def needs_review(text: Column, score: Column | None = None, least_score: float = 0.55) -> Column:
    t = strip(or_empty(text))
    noise = count_of(t, r"[|~`^_]")
    out = (F.length(t) < 80) | (count_of(t, "[�□■◆◇]") > 5) | (noise > F.length(t) * 0.04)
    return out if score is None else out | F.coalesce(score < least_score, F.lit(False))


def short_text(text: Column, limit: int) -> Column:
    """Squashed, and cut to limit characters with an ellipsis as the last."""
    t = squash(or_empty(text))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def first_sentence(text: Column, limit: int, ends: str = SENTENCE_ENDS) -> Column:
    t = squash(or_empty(text))
    head = F.regexp_extract(t, f"^[^{ends}]*[{ends}]", 0)
    return F.substring(F.when(head != "", head).otherwise(t), 1, limit)


def first_sentence_by_mark(text: Column, marks: str = "。！？；") -> Column:
    """Up to the first of the marks that occurs at all, in the order of marks rather than of places."""
    t = squash(or_empty(text))
    return F.coalesce(*[F.when(F.locate(m, t) > 0, F.substring(t, F.lit(1), F.locate(m, t))) for m in marks], t)


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(or_empty(text), r"[\r\n]+"), strip), lambda x: x != "")


def paragraphs(text: Column, at: str = r"\n\s*\n+") -> Column:
    """Non-blank parts; the whole text where nothing splits it."""
    return F.filter(F.transform(F.split(or_empty(text), at), strip), lambda x: x != "")


#: Fixed value: the number that opens a letter's heading.
_LETTER_HEADING = r"^第\d+封\s"


def usable_paragraphs(text: Column, title: Column, greeting_chars: int = 18, drop: tuple[str, ...] = ()) -> Column:
    """Paragraphs, squashed, without the title (or what begins with it), headings of letters, and short greetings that end in
    a colon. An empty title drops all."""
    greeting = lambda p: (F.length(p) <= greeting_chars) & p.rlike("[：:]$")
    keep = lambda p: ~F.startswith(p, title) & ~p.rlike(_LETTER_HEADING) & ~greeting(p) & (~p.isin(*drop) if drop else F.lit(True))
    return F.filter(F.transform(paragraphs(text, r"\n+"), squash), keep)


def sentences(text: Column, ends: str = "。！？；.!?", least: int = 1) -> Column:
    found = F.regexp_extract_all(or_empty(text), F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: F.length(s) >= least)


def clip(piece: Column, marks: str = CLAUSE_MARKS, low: int = 48, high: int = 150, least: int = 80, most: int = 120) -> Column:
    """Up to the first mark, in the order of marks, whose first place from low on is not past high; else a prefix; else null."""
    places = [F.locate(m, piece, low + 1) for m in marks]
    cut = F.coalesce(*[F.when((p > low) & (p <= high + 1), p) for p in places])
    return F.when(cut.isNotNull(), F.substring(piece, F.lit(1), cut)).when(F.length(piece) >= least, F.substring(piece, 1, most))


def block_of(parts: Column, whole: Column, low: int = 80, high: int = 320, enough: int = 160, prefix: int = 260) -> Column:
    """A paragraph of fitting length as it is; else its sentences, joined until enough; else a prefix."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def add(acc: Column, s: Column) -> Column:
        fits = ~acc["done"] & (F.length(acc["text"]) + F.length(s) <= high)
        grown = F.when(fits, F.concat(acc["text"], s)).otherwise(acc["text"])
        return F.struct(grown.alias("text"), (acc["done"] | ~fits | (F.length(grown) >= enough)).alias("done"))

    joined = F.aggregate(parts, start, add, lambda acc: acc["text"])
    n = F.length(whole)
    return F.when((n >= low) & (n <= high), whole).when(F.length(joined) >= low, joined).otherwise(F.substring(whole, 1, prefix))


#: What splits claims, what is trimmed from their ends, claims that say nothing, road codes, numbers.
CLAIM_HARD, CLAIM_SOFT, CLAIM_ENDS = r"[。！？；;：:\n\r]+", r"[，,、（）()\[\]【】]+", " ，,。；;：:"
CLAIM_STOP = ("null", "none", "书中未明示", "未明示", "无", "不详")
ROAD_CODES, NUMBERS = r"(?iU)\b(?:G|S|X)\s*\d{2,4}\b|\b\d{3}\b", r"(?U)\d+(?:\.\d+)?"
#: The characters that a match key leaves out.
KEY_PUNCTUATION = r"""[`~!@#$%^&*_+=|\\/<>{}\[\]（）()【】《》“”"'‘’：:；;，,。.!！?？、-]"""


def plain_key(c: Column) -> Column:
    """What texts are compared by: lower case, without white space and punctuation. udf.match_key folds compatibility forms before."""
    return F.regexp_replace(without_space(F.lower(c)), KEY_PUNCTUATION, "")


def claims(text: Column, hard: str = CLAIM_HARD, soft: str = CLAIM_SOFT, longest: int = 42, stop: tuple[str, ...] = CLAIM_STOP) -> Column:
    """Hard splits; parts over the limit are split softly too; separators at the ends go, so do empty and stop values."""
    whole = F.filter(F.transform(F.split(or_empty(text), hard), strip), lambda p: p != "")
    pieces = lambda p: let(F.filter(F.transform(F.split(p, soft), strip), lambda x: x != ""), lambda xs: F.when(F.size(xs) > 0, xs).otherwise(F.array(p)))
    parts = F.flatten(F.transform(whole, lambda p: F.when(F.length(p) <= longest, F.array(p)).otherwise(pieces(p))))
    tidy = F.transform(parts, lambda p: F.regexp_replace(p, f"^[{CLAIM_ENDS}]+|[{CLAIM_ENDS}]+$", ""))
    return F.filter(tidy, lambda p: (p != "") & ~plain_key(p).isin(*stop))


def anchors(text: Column, names: tuple[str, ...] | Column, keywords: tuple[str, ...] = (), codes: str = ROAD_CODES, plain: tuple[str, ...] = ("1", "2", "3"), named_in: Column | None = None) -> Column:
    """Names and keywords that the text holds by plain_key, road codes in capitals without blanks, numbers but the commonest.

    Anchors of one key are one, the first; those without a key are none. names: given ones, or an array. named_in: the form of
    the text that names are looked for in, where it is another; codes and numbers are those of the text as it stands.
    """
    t = or_empty(text)
    pair = lambda x: F.struct(plain_key(x).alias("key"), x.alias("x"))
    # of given names and keywords the key is worked out once, not for each text
    fixed = lambda ns: F.array(*[pair(F.lit(n)) for n in ns]).cast("array<struct<key: string, x: string>>")
    listed = F.concat(F.transform(names, pair) if isinstance(names, Column) else fixed(names), fixed(keywords))
    held = let(plain_key(t if named_in is None else or_empty(named_in)), lambda key: F.filter(listed, lambda n: (n["x"] != "") & F.contains(key, n["key"])))
    found = F.concat(
        F.transform(F.regexp_extract_all(t, F.lit(codes), F.lit(0)), lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))),
        F.filter(F.regexp_extract_all(t, F.lit(NUMBERS), F.lit(0)), lambda n: ~n.isin(*plain)),
    )
    keyed = F.concat(held, F.transform(found, pair))
    first = lambda ks: F.filter(ks, lambda p, i: (p["key"] != "") & (F.array_position(F.transform(ks, lambda q: q["key"]), p["key"]) == i + 1))
    return F.transform(let(keyed, first), lambda p: p["x"])


def page_numbers(text: Column) -> Column:
    """Numbers before 页 and after p, sorted and distinct."""
    t = or_empty(text)
    both = F.concat(F.regexp_extract_all(t, F.lit(r"(\d{1,3})\s*页"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"p(\d{1,3})"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(both, lambda x: x.cast("int"))))


def name_parts(title: Column, separators: str = r"[，,、/／—\-→：:\s]+", lead: str = "^第[^封]*封", dates: str = r"\d{1,2}月\d{1,2}日|[~～]", least: int = 2, most: int = 6, stop: tuple[str, ...] = ()) -> Column:
    """Names in a title: lead and dates go, separators split, short and stop names go, first occurrences stay."""
    bare = F.regexp_replace(F.regexp_replace(or_empty(title), lead, ""), dates, "")
    kept = F.filter(F.split(bare, separators), lambda x: (F.length(x) >= least) & (~x.isin(*stop) if stop else F.lit(True)))
    return F.slice(F.array_distinct(kept), 1, most)


def labels_by_keywords(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The labels of which any keyword occurs, in the order of groups."""
    t = or_empty(text)
    hit = lambda words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    return F.filter(F.array(*[F.when(hit(words), F.lit(label)) for label, words in groups.items()]), lambda x: x.isNotNull())


def category_by_token(name: Column, ordered: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first category of which any token occurs."""
    t, out = or_empty(name), F.lit(default)
    for label, tokens in reversed(list(ordered.items())):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in tokens]), F.lit(label)).otherwise(out)
    return out


def script_language(text: Column, look_at: int = 200_000) -> Column:
    """The dominant script of the beginning; the limit is part of the rule."""
    t = F.substring(or_empty(text), 1, look_at)

    def told(n: Column) -> Column:
        total = n["cjk"] + n["latin"]
        return F.when(total == 0, "unknown").when(n["cjk"] > total * 0.7, "zh-Hans").when(n["latin"] > total * 0.7, "en").otherwise("mixed")

    return let(F.struct(count_of(t, CJK).alias("cjk"), count_of(t, LATIN).alias("latin")), told)


def toc_score(text: Column, heading: str, features: tuple[tuple[str, int], ...]) -> Column:
    """5 for a heading, and each feature's count up to its limit."""
    t = or_empty(text)
    return F.when(t.rlike(heading), 5).otherwise(0) + reduce(lambda a, b: a + b, [F.least(F.regexp_count(t, F.lit(p)), F.lit(n)) for p, n in features])


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")


def reading_hint(chunks: Column, chars: Column) -> Column:
    c, n = F.coalesce(chunks, F.lit(0)), F.coalesce(chars, F.lit(0))
    return F.when((c >= 6) | (n >= 4500), "long").when((n > 0) & (n <= 2200), "short").otherwise("medium")


def value_text(value: Column, sentinel: str) -> Column:
    return F.coalesce(F.when(strip(value) != "", value), F.lit(sentinel))


def list_text(values: Column, sentinel: str, joiner: str = "；") -> Column:
    joined = F.array_join(F.filter(values, lambda x: strip(or_empty(x)) != ""), joiner)
    return F.when(F.coalesce(F.length(joined), F.lit(0)) > 0, joined).otherwise(F.lit(sentinel))


def resolve_href(base: Column, href: Column) -> Column:
    """href against the folder of base, with . and .. folded."""
    parts = F.concat(F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1), F.split(href, "/"))
    fold = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


def numbered(prefix: str, n: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0")))


def xml_escape(c: Column) -> Column:
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def place_name(name: Column) -> Column:
    """Without what stands in brackets behind it."""
    return strip(F.substring_index(F.replace(or_empty(name), F.lit("（"), F.lit("(")), "(", 1))


def has_marker(text: Column, markers: tuple[str, ...]) -> Column:
    t = F.lower(or_empty(text))
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(m.lower())) for m in markers])


def long_marked_line(text: Column, markers: tuple[str, ...], longest: int = 180) -> Column:
    """Is there a line over the limit that holds a marker?"""
    return F.exists(F.split(or_empty(text), "\n"), lambda x: (F.length(x) > longest) & has_marker(x, markers))


def snippet(text: Column, quote: Column, before: int = 120, after: int = 180, default: int = 420) -> Column:
    """The surroundings of the first occurrence, or the beginning."""
    t, q = squash(or_empty(text)), squash(or_empty(quote))
    at = F.position(q, t)
    start = F.greatest(at - before, F.lit(1))
    return F.when((q != "") & (at > 0), F.substr(t, start, at - start + F.length(q) + after)).otherwise(F.substring(t, 1, default))


def filled(items: Column, spare: Column, same, most: int) -> Column:
    """Up to most items: all that there are, then the spare ones, in order, that are like none before. same: item -> what is compared."""
    add = lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda y: same(y).eqNullSafe(same(x))), F.array_append(acc, x)).otherwise(acc)
    return F.slice(F.aggregate(spare, items, add), 1, most)


def appended(items: Column, item: Column) -> Column:
    """The array with the item at its end, unless it holds an equal one; repeats that are there stay."""
    return F.when(F.exists(items, lambda x: x.eqNullSafe(item)), items).otherwise(F.array_append(items, item))

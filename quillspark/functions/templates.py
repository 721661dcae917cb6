"""Texts from templates, as Column expressions: slots, fallback chains, texts chosen by a key, previews, padded lists."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(pattern: str, **slots: Column) -> Column:
    """The pattern with each {name} as the slot's text; a null slot prints nothing. Doubled braces are braces."""
    parts = []
    for text, name, spec, convert in Formatter().parse(pattern):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if spec or convert or name not in slots:
                raise ValueError(f"no slot {name!r} for {pattern!r}")
            parts.append(F.coalesce(slots[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def first_of(*values: Column | str) -> Column:
    """The first value that is neither null nor empty, else null; white space is a value. A str is a text."""
    cols = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def by_key(key: Column, texts: dict[str, str], default: str) -> Column:
    """The text of the key; the default for others and for null."""
    out = F.lit(default)
    for name, text in texts.items():
        out = F.when(key == name, F.lit(text)).otherwise(out)
    return out


def preview(text: Column, most: int, mark: str = "...") -> Column:
    """The first characters, and the mark where there are more; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(F.substring(t, 1, most), F.when(F.length(t) > most, mark).otherwise(""))


def some(items: Column) -> Column:
    """The items that are neither null nor empty; of a null array none."""
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False)))


def listed(items: Column, fallback: str | None = None, joiner: str = "、") -> Column:
    """The items that say something, joined; the fallback, or null, where there is none."""
    return F.coalesce(first_of(F.array_join(some(items), joiner)), F.lit(fallback))


def named_in(text: Column, names: Column, most: int = 3) -> Column:
    """The first names that occur in the text, joined; null where none does."""
    return listed(F.slice(F.filter(some(names), lambda p: F.contains(F.coalesce(text, F.lit("")), p)), 1, most))


def padded(items: Column, least: int, filler: str, most: int) -> Column:
    """The distinct items in order, with fillers up to the least number, and no more than most."""
    one = F.array_distinct(items)
    return F.slice(F.concat(one, F.array_repeat(F.lit(filler), F.greatest(F.lit(least) - F.size(one), F.lit(0)))), 1, most)

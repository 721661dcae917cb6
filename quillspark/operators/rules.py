"""A compiler from rule tables to findings: all rules on rows in one scan, all counts of a table in one aggregate.

A rule table is a list. Row says what is wrong with a row; Each gives the rules of every item of a row's list; Total says
what is wrong with the table's counts; Once asks that a key stand once; Mirror compares the table with another one by key.
compiled() lays them together: Row and Each become one expression, the counts of every Total one aggregate, each Once and
Mirror one grouping. A table that more than one of these reads is written once and read from there.

Every rule yields findings (rule_id, severity, path, message). What is broken when null counts as not broken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import checks as C
from quillspark.sources.kept import kept

FINDING = "struct<rule_id:string,severity:string,path:string,message:string>"


@dataclass(frozen=True)
class Row:
    rule: str
    severity: str
    path: Column
    message: str | Column
    broken: Column

    def found(self) -> Column:
        said = self.message if isinstance(self.message, Column) else F.lit(self.message)
        finding = F.struct(F.lit(self.rule).alias("rule_id"), F.lit(self.severity).alias("severity"), self.path.cast("string").alias("path"), said.alias("message"))
        return F.when(F.coalesce(self.broken, F.lit(False)), finding.cast(FINDING))


@dataclass(frozen=True)
class Each:
    """of(item, place from 1): the rules of one item of the list."""

    items: Column
    of: Callable[[Column, Column], list[Row]]

    def found(self) -> Column:
        every = F.array_compact(F.flatten(F.transform(self.items, lambda x, i: F.array(*[r.found() for r in self.of(x, i + 1)]))))
        return F.coalesce(every, F.array().cast(f"array<{FINDING}>"))


@dataclass(frozen=True)
class Total:
    """counts: aggregates by name; broken and, where it is no text, message are made of their values."""

    rule: str
    severity: str
    path: str
    message: str | Callable[[dict[str, Column]], Column]
    counts: dict[str, Column]
    broken: Callable[[dict[str, Column]], Column]

    def row(self, prefix: str) -> Row:
        values = {n: F.col(f"{prefix}{n}") for n in self.counts}
        return Row(self.rule, self.severity, F.lit(self.path), self.message if isinstance(self.message, str) else self.message(values), self.broken(values))


@dataclass(frozen=True)
class Once:
    """A finding for each key that stands more than once; path is made of the key's columns."""

    rule: str
    path: Column
    message: str
    keys: tuple[str, ...]
    severity: str = "error"


@dataclass(frozen=True)
class Mirror:
    """A finding for each key whose rows are not the same here and in the other table, repeats counted."""

    rule: str
    path: Column
    message: str
    keys: tuple[str, ...]
    values: tuple[str, ...]
    other: DataFrame = field(repr=False)
    severity: str = "error"

    def found(self, df: DataFrame) -> DataFrame:
        side = lambda d, n: d.select(*self.keys, F.to_json(F.struct(*self.values), {"ignoreNullFields": "false"}).alias("_v"), F.lit(n).alias("_n"))
        uneven = side(df, 1).unionByName(side(self.other, -1)).groupBy(*self.keys, "_v").agg(F.sum("_n").alias("_n")).where("_n <> 0")
        return _given(uneven.select(*self.keys).distinct(), self.rule, self.severity, self.path, self.message)


def _given(df: DataFrame, rule: str, severity: str, path: Column, message: str) -> DataFrame:
    return C.rows_where(df, rule, severity, path, message, F.lit(True))


def required(rule: str, path: Column, columns: list[str], message: Callable[[str], str] = "missing {}".format) -> list[Row]:
    """Columns that must be there and not blank."""
    return [Row(rule, "error", path, message(c), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "") for c in columns]


def marked(rule: str, path: Column, message: str, text: Column, markers: tuple[str, ...], severity: str = "error") -> Row:
    """Texts that hold one of the markers, without regard to case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return Row(rule, severity, path, message, F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(low, m)))


def counted(rule: str, path: str, wanted: int, what: str = "rows", n: Column | None = None) -> Total:
    """A number of rows, or another count, that is given."""
    return Total(rule, "error", path, lambda v: F.concat(F.lit(f"expected {wanted} {what}, got "), F.coalesce(v["n"], F.lit(0)).cast("string")), {"n": F.count(F.lit(1)) if n is None else n}, lambda v: F.coalesce(v["n"], F.lit(0)) != wanted)


def compiled(df: DataFrame, rules: list) -> DataFrame:
    """The findings of all rules on the table."""
    rows = [r for r in rules if isinstance(r, (Row, Each))]
    totals = [r for r in rules if isinstance(r, Total)]
    grouped = [r for r in rules if isinstance(r, (Once, Mirror))]
    if len(rows + totals + grouped) != len(rules):
        raise TypeError("a rule table holds Row, Each, Total, Once and Mirror")
    if bool(rows) + bool(totals) + len(grouped) > 1:
        df = kept(df)
    out = []
    if rows:
        single = F.array_compact(F.array(*[r.found() for r in rows if isinstance(r, Row)])).cast(f"array<{FINDING}>")
        out.append(df.select(F.inline(F.concat(single, *[r.found() for r in rows if isinstance(r, Each)]))))
    if totals:
        one = df.agg(*[v.alias(f"t{i}_{n}") for i, t in enumerate(totals) for n, v in t.counts.items()])
        out.append(one.select(F.inline(F.array_compact(F.array(*[t.row(f"t{i}_").found() for i, t in enumerate(totals)])))))
    for r in grouped:
        if isinstance(r, Mirror):
            out.append(r.found(df))
        else:
            repeated = df.groupBy(*r.keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            out.append(_given(repeated, r.rule, r.severity, r.path, r.message))
    return C.union(out)

"""Walks through JSON of any shape: every string with its path, every object that has given fields. In Arrow batches, as a
row's depth is not known to a plan."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def nodes(value) -> Iterator[tuple[str, object]]:
    """(path, node) of all nodes, parents first, in the order of the text. Paths are like $.a[0].b."""
    stack = [("$", value)]
    while stack:
        path, node = stack.pop()
        yield path, node
        if isinstance(node, dict):
            stack += [(f"{path}.{k}", v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node)))]


def _walk(df: DataFrame, key: str, column: str, names: list[str], rows_of) -> DataFrame:
    """key, place (from 1), path and the named strings of each row that rows_of makes; text that is no JSON gives one row of nulls."""
    kind = dict(df.dtypes)[key]
    heads = [key, "place", "path", *names]
    if len(set(heads)) < len(heads):
        raise ValueError(f"{key} is a name of the result")

    def rows(text: str | None) -> Iterator[tuple]:
        if text is None:
            return
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            yield (None, *[None] * len(names))
            return
        yield from rows_of(nodes(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, i, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, r in enumerate(rows(t), 1)]
            columns = list(zip(*found)) if found else [[]] * len(heads)
            kinds = [b.schema.field(0).type, pa.int64(), *[pa.string()] * (len(heads) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], heads)

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, place long, path string" + "".join(f", `{n}` string" for n in names))


def json_strings(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, place, path, value of every string in the JSON text of a column; keys are no strings. Null text gives no row."""
    return _walk(df, key, column, ["value"], lambda walk: ((path, node) for path, node in walk if isinstance(node, str)))


def json_objects(df: DataFrame, key: str, column: str, fields: tuple[str, ...]) -> DataFrame:
    """key, place, path and the fields, as text, of every object that has them all, also inside others. Null text gives no row."""
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return _walk(df, key, column, list(fields), lambda walk: ((path, *[text(node[f]) for f in fields]) for path, node in walk if isinstance(node, dict) and all(f in node for f in fields)))

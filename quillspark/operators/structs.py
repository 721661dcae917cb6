"""Structs that take over fields from others, at any depth, as expressions made from their schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def typed(kind: DataType, path: str) -> DataType | None:
    """The type at a dotted path into structs; None where there is no such field."""
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def _at(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value.getField(name)
    return value


def _put(value: Column, kind: DataType | None, path: list[str], new: Column) -> Column:
    """value with new at the path; structs on the way that are not there are made."""
    name, rest = path[0], path[1:]
    inner = kind[name].dataType if isinstance(kind, StructType) and name in kind.names else None
    if rest:
        new = _put(value.getField(name) if inner is not None else None, inner, rest, new)
    return new_struct({name: new}) if value is None else F.when(value.isNull(), new_struct({n: new if n == name else F.lit(None).cast(kind[n].dataType) for n in dict.fromkeys([*kind.names, name])})).otherwise(value.withField(name, new))


def new_struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def synced(df: DataFrame, target: str, source: str, keys: list[str], text: str = "string") -> DataFrame:
    """df with the fields of the struct source at the keys (dotted paths) put into the struct target, whatever was there.

    A key that the source does not have becomes null; so does every key where the source itself is null. Other fields of the
    target stay. A null target becomes a struct of the keys. A key that neither side has a type for is made a text.
    """
    into, kind = F.col(target), df.schema[target].dataType
    for key in keys:
        found = typed(df.schema[source].dataType, key)
        new = _at(F.col(source), key) if found is not None else F.lit(None).cast(typed(kind, key) or text)
        into = _put(into, kind, key.split("."), new)
        df = df.withColumn(target, into)
        into, kind = F.col(target), df.schema[target].dataType
    return df


def synced_items(df: DataFrame, key: str, items: str, name: str, others: DataFrame, fields: list[str], order: str = "_i") -> DataFrame:
    """df with the fields of others (one row a name) put into those items of a list of structs whose name is known there.

    Items of unknown names stay as they are, the list keeps its order; a null list stays null. A field that others lack becomes
    null. The items are joined, so the table of others may be of any size.
    """
    kind = df.schema[items].dataType
    assert isinstance(kind, ArrayType)
    each = df.select(key, F.posexplode(items).alias(order, "_item"))
    known = others.select(F.col(name).alias("_name"), F.struct(*[c for c in others.columns]).alias("_from"))
    joined = each.join(known, F.col("_item").getField(name) == F.col("_name"), "left").drop("_name")
    whole = synced(joined, "_item", "_from", fields)
    plain = [n for n in whole.schema["_item"].dataType.names]
    was = {n: joined.schema["_item"].dataType[n].dataType if n in joined.schema["_item"].dataType.names else None for n in plain}
    old = joined.withColumn("_old", F.struct(*[F.col("_item").getField(n).alias(n) if was[n] is not None else F.lit(None).cast(whole.schema["_item"].dataType[n].dataType).alias(n) for n in plain]))
    both = synced(old, "_item", "_from", fields)
    picked = both.select(key, order, F.when(F.col("_from").isNull(), F.col("_old")).otherwise(F.col("_item")).alias("_item"))
    lists = picked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "_item"))), lambda x: x["_item"]).alias("_list"))
    empty = F.when(F.col(items).isNotNull(), F.array().cast(lists.schema["_list"].dataType))
    return df.join(lists, key, "left").withColumn(items, F.coalesce("_list", empty)).drop("_list")

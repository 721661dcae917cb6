"""Documents of any size as ordered lines: JSON documents, GeoJSON collections, GPX files.

A document is lines with a place (part, a, b). It is written in ranges of places, so its files, put together by name, are the
document; no list of rows is ever gathered.
"""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import or_empty, xml_escape
from quillspark.operators import geo as G
from quillspark.sources.readers import numbered_lines


def lines_of(rows: DataFrame, line: Column, a: Column, b: Column | int = 0, between: str = "") -> DataFrame:
    """a, b (whole numbers, together unique) and line of each row; all but the last end in ``between``. Null lines are left out."""
    at = rows.select(a.cast("long").alias("a"), (F.lit(b) if isinstance(b, int) else b).cast("long").alias("b"), line.alias("line")).where("line IS NOT NULL")
    if not between:
        return at
    last = at.agg(F.max(F.struct("a", "b")).alias("_last"))  # one row
    return at.crossJoin(F.broadcast(last)).select("a", "b", F.concat("line", F.when(F.struct("a", "b") < F.col("_last"), between).otherwise("")).alias("line"))


def document(spark: SparkSession, pieces: list[str | DataFrame]) -> DataFrame:
    """part, a, b, line: fixed lines and rows of lines_of, in the order of the list."""
    out = None
    for part, piece in enumerate(pieces):
        rows = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(piece).alias("line")) if isinstance(piece, str) else piece
        rows = rows.select(F.lit(part).alias("part"), "a", "b", "line")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_document(lines: DataFrame, path: str, compression: str = "none") -> None:
    """The lines as text files, each a range of places; a reader that takes the files by name reads the document. Files of gzip
    put together are one too, and unpack to the document."""
    order = ["part", "a", "b"]
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("line").write.text(path, compression=compression)


def json_object(rows: DataFrame, payload: str, a: Column, b: Column | int = 0, **constants) -> DataFrame:
    """The constants, and the rows under payload, a row a line; nulls are written. a, b: the rows' order."""
    head = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}, " for k, v in constants.items()) + json.dumps(payload) + ": ["
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    return document(rows.sparkSession, [head, lines_of(rows, line, a, b, ","), "]}"])


def feature_collection(features: DataFrame, feature: str, a: Column, b: Column | int = 0) -> DataFrame:
    """A GeoJSON collection of features given as JSON."""
    return document(features.sparkSession, ['{"type": "FeatureCollection", "features": [', lines_of(features, F.col(feature), a, b, ","), "]}"])


def gpx(segments: DataFrame, name: str, track: str, creator: str, time: str) -> DataFrame:
    """A GPX 1.1 document: metadata, a waypoint for each point that has coordinates, and a track with a segment for each chain that may
    be connected and has two such points.

    segments: number (whole, unique), title, summary, gap, points (structs of name, lat, lng; the first is the start, the last the end).
    """
    points = segments.select("number", "title", "summary", F.size("points").alias("n"), F.posexplode("points").alias("place", "p"))
    known = points.where(G.has_coordinates(F.col("p")))
    at = F.concat(F.lit('<wpt lat="'), F.col("p.lat").cast("string"), F.lit('" lon="'), F.col("p.lng").cast("string"), F.lit('">'))
    about = F.concat(or_empty("title"), F.lit(" | "), or_empty("summary"))
    label = G.point_label(F.col("number"), F.col("place"), F.col("n"), F.col("p.name"))
    way = F.concat(F.lit("  "), at, F.lit("<name>"), xml_escape(label), F.lit("</name><desc>"), xml_escape(about), F.lit("</desc></wpt>"))
    tracks = segments.select("number", G.labelled_track(F.col("number"), F.col("points"), F.col("gap")).alias("t"))
    return document(segments.sparkSession, [
        '<?xml version="1.0" encoding="UTF-8"?>', f'<gpx version="1.1" creator="{escape(creator)}" xmlns="http://www.topografix.com/GPX/1/1">', "  <metadata>", f"    <name>{escape(name)}</name>", f"    <time>{escape(time)}</time>", "  </metadata>",
        lines_of(known, way, F.col("number"), F.col("place")), "  <trk>", f"    <name>{escape(track)}</name>", lines_of(tracks, F.col("t"), F.col("number")), "  </trk>", "</gpx>",
    ])


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """place (from 1) and line of a written document. Only the files' line counts, a row each, meet in one task."""
    lines = numbered_lines(spark, path)
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", before.alias("before"))
    return lines.join(F.broadcast(files), "file").select((F.col("before") + F.col("line")).cast("long").alias("place"), F.col("text").alias("line"))

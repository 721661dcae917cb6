"""Point chains: distances, coordinate states, features and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import numbered, xml_escape
from quillspark.operators.windows import NUMBERED_TOGETHER, numbered_rows

EARTH_KM = 6371.0088


def chain(start: Column, via: Column, end: Column) -> Column:
    return F.concat(F.array(start), F.coalesce(via, F.slice(F.array(start), 1, 0)), F.array(end))


def has_coordinates(p: Column) -> Column:
    return p["lat"].isNotNull() & p["lng"].isNotNull()


def valid_coordinates(lat: Column, lng: Column) -> Column:
    """Both missing, or both in range."""
    return (lat.isNull() & lng.isNull()) | F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def haversine_km(a: Column, b: Column) -> Column:
    lat1, lat2 = F.radians(a["lat"]), F.radians(b["lat"])
    dlat, dlng = lat2 - lat1, F.radians(b["lng"]) - F.radians(a["lng"])
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlng / 2), F.lit(2.0))
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_KM)


def path_km(points: Column) -> Column:
    """The sum over consecutive points, to two places; null where a point has no coordinates or there are fewer than two."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), haversine_km)
    total = F.round(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x), 2)
    return F.when((n >= 2) & F.forall(points, has_coordinates), total)


def coordinate_state(points: Column) -> Column:
    """missing if any point's confidence is, else approximate if any is, else verified."""
    kinds = F.transform(points, lambda p: F.coalesce(p["confidence"], F.lit("missing")))
    return F.when(F.array_contains(kinds, "missing"), "missing").when(F.array_contains(kinds, "approximate"), "approximate").otherwise("verified")


def bounding_box(points: Column) -> Column:
    lat, lng = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lng"])
    return F.struct(F.array_min(lat).alias("south"), F.array_max(lat).alias("north"), F.array_min(lng).alias("west"), F.array_max(lng).alias("east"))


def line_feature(key: Column, points: Column, gap: Column) -> Column:
    """A GeoJSON feature; geometry null where the segment must not be drawn or any point is missing."""
    drawable = ~F.coalesce(gap, F.lit(False)) & (F.size(points) >= 2) & F.forall(points, has_coordinates)
    line = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lng"], p["lat"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(key.alias("id")).alias("properties"), F.when(drawable, line).alias("geometry")), {"ignoreNullFields": "false"})


def route_feature(key: Column, points: Column, gap: Column, properties: list[Column]) -> Column:
    """A GeoJSON feature of a segment: as line_feature, with the names of its ends, the state of its coordinates, whether its geometry
    is missing and why, and the given properties."""
    closed = F.coalesce(gap, F.lit(False))
    drawable = ~closed & (F.size(points) >= 2) & F.forall(points, has_coordinates)
    line = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lng"], p["lat"])).alias("coordinates"))
    about = F.struct(
        key.alias("segment_id"), F.get(points, F.lit(0))["name"].alias("start_name"), F.try_element_at(points, F.lit(-1))["name"].alias("end_name"), coordinate_state(points).alias("coordinate_confidence"),
        (~drawable).alias("missing_geometry"), closed.alias("route_gap"), *properties,
    )
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.when(drawable, line).alias("geometry"), about.alias("properties")), {"ignoreNullFields": "false"})


def place_features(segments: DataFrame, key: str, points: str, pages: str, properties: list[Column]) -> DataFrame:
    """key, turn and feature: a GeoJSON point for each point with coordinates, on the segment's first page; its turn is 0 for the
    start, 1 for the end, and from 2 on for those between."""
    p = segments.select(key, F.array_min(pages).alias("_page"), F.struct(*properties).alias("_about"), F.size(points).alias("_n"), F.posexplode(points).alias("_i", "p")).where(has_coordinates(F.col("p")))
    i, last = F.col("_i"), F.col("_i") == F.col("_n") - 1
    role = F.when(i == 0, "start").when(last, "end").otherwise("via")
    shape = F.struct(F.lit("Point").alias("type"), F.array("p.lng", "p.lat").alias("coordinates"))
    about = F.struct(F.col("p.name").alias("name"), F.col(key).alias("segment_id"), role.alias("role"), F.col("_page").alias("page"), F.col("p.confidence").alias("coordinate_confidence"), "_about.*")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), about.alias("properties")), {"ignoreNullFields": "false"})
    return p.select(key, F.when(i == 0, 0).when(last, 1).otherwise(i + 1).cast("long").alias("turn"), feature.alias("feature"))


#: The labels of a chain's points.
POINT_LABELS = ("起点", "终点", "途经")


def point_label(number: Column, place: Column, n: Column, name: Column) -> Column:
    """The segment's number in two digits, the point's label, its name."""
    label = F.when(place == 0, POINT_LABELS[0]).when(place == n - 1, POINT_LABELS[1]).otherwise(F.concat(F.lit(POINT_LABELS[2]), place.cast("string")))
    return F.concat_ws(" ", numbered("", number, 2), label, F.coalesce(name, F.lit("")))


def labelled_track(number: Column, points: Column, gap: Column) -> Column:
    """A track segment, a point a line, named by label; null where fewer than two points have coordinates or not to be connected."""
    n = F.size(points)
    rows = F.transform(points, lambda p, i: F.when(has_coordinates(p), F.concat(F.lit('      <trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lng"].cast("string"), F.lit('"><name>'), xml_escape(point_label(number, i, n, p["name"])), F.lit("</name></trkpt>"))))
    known = F.filter(rows, lambda r: r.isNotNull())
    return F.when(~F.coalesce(gap, F.lit(False)) & (F.size(known) >= 2), F.concat(F.lit("    <trkseg>\n"), F.array_join(known, "\n"), F.lit("\n    </trkseg>")))


def waypoints(segments: DataFrame, key: str, points: str) -> DataFrame:
    """key, place in the chain, role, and the coordinates of every point that has them."""
    p = segments.select(key, F.size(points).alias("_n"), F.posexplode(points).alias("place", "p")).where(has_coordinates(F.col("p")))
    role = F.when(F.col("place") == 0, "start").when(F.col("place") == F.col("_n") - 1, "end").otherwise("via")
    return p.select(key, F.col("place").cast("long").alias("place"), role.alias("role"), F.col("p.name").alias("name"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))


def gpx_track(points: Column, gap: Column) -> Column:
    """A track segment of the points that have coordinates; null where fewer than two or not to be connected."""
    known = F.filter(points, has_coordinates)
    rows = F.transform(known, lambda p: F.concat(F.lit('<trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lng"].cast("string"), F.lit('"><name>'), xml_escape(p["name"]), F.lit("</name></trkpt>")))
    return F.when(~F.coalesce(gap, F.lit(False)) & (F.size(known) >= 2), F.concat(F.lit("<trkseg>"), F.array_join(rows, ""), F.lit("</trkseg>")))


def walkable_blocks(segments: DataFrame, key: str, order: str, gap: str, walked: Column, noted: Column, review: Column) -> DataFrame:
    """A block for each segment that may be connected, numbered in order, a number; review beats partial beats continuous."""
    kept = segments.where(~F.coalesce(F.col(gap), F.lit(False)))
    status = F.when(review, "needs_review").when(~walked | noted, "partial").otherwise("continuous")
    placed = numbered_rows(kept.select(key, order, status.alias("status")), "_n", [order], [F.floor(F.col(order) / NUMBERED_TOGETHER)])
    return placed.select(numbered("walk-block-", F.col("_n"), 3).alias("block_id"), key, "status")


def risk_score(blocked: Column, mixed: Column, unchecked: Column, approximate: Column, notes: Column) -> Column:
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return (flag(blocked, 3) + flag(mixed, 2) + flag(unchecked, 2) + approximate + F.floor(notes / 3)).cast("long")

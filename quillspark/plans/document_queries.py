"""Documents as ordered lines: each is written to the shared folder and read again, beside the SQL that checks every line."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import geo as G
from quillspark.plans.domain_queries import SEG, segments
from quillspark.plans.registry import query, table
from quillspark.sources import documents as D
from quillspark.sources.kept import shared_folder


def _lines(spark, lines):
    path = f"{shared_folder(spark)}/document-{uuid.uuid4().hex[:12]}"
    D.write_document(lines, path, "gzip")
    return D.read_document(spark, path)


def _document_sql(*pieces: str) -> str:
    """place and line of fixed lines ('text') and selects of a, b, j, sep."""
    parts = [f"SELECT {i} AS part, 0 AS a, 0 AS b, {p} AS line" if p.startswith("'") else f"SELECT {i}, a, b, j || CASE WHEN row_number() OVER (ORDER BY a DESC, b DESC) > 1 THEN sep ELSE '' END FROM ({p})" for i, p in enumerate(pieces)]
    return "l AS (" + " UNION ALL ".join(parts) + ") SELECT row_number() OVER (ORDER BY part, a, b) AS place, line FROM l"


@query("k2_json_document", "WITH " + _document_sql("'{\"project\": \"orders\", \"draft\": true, \"rows\": ['", """SELECT o_orderkey AS a, 0 AS b, '{"o_orderkey":' || o_orderkey || ',"note":null,"o_orderstatus":"' || o_orderstatus || '"}' AS j, ',' AS sep FROM orders""", "']}'"))
def k2(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(None).cast("string").alias("note"), "o_orderstatus")
    return _lines(spark, D.json_object(rows, "rows", F.col("o_orderkey"), project="orders", draft=True))


_STATE = "CASE WHEN len(list_filter(ps, lambda p: p.confidence = 'missing')) > 0 THEN 'missing' WHEN len(list_filter(ps, lambda p: p.confidence = 'approximate')) > 0 THEN 'approximate' ELSE 'verified' END"
_DRAWN = "(NOT gap AND n >= 2 AND len(list_filter(ps, lambda p: p.lat IS NULL)) = 0)"
_HEAD = "'{\"type\": \"FeatureCollection\", \"features\": ['"
_ROUTE = f"""SELECT id AS a, 0 AS b, '{{"type":"Feature","geometry":' || CASE WHEN {_DRAWN} THEN '{{"type":"LineString","coordinates":[' || array_to_string(list_transform(ps, lambda p: '[' || p.lng || ',' || p.lat || ']'), ',') || ']}}' ELSE 'null' END
    || ',"properties":{{"segment_id":' || id || ',"start_name":"' || ps[1].name || '","end_name":"' || ps[n].name || '","coordinate_confidence":"' || {_STATE} || '","missing_geometry":' || (NOT {_DRAWN}) || ',"route_gap":' || gap || ',"movement_type":"' || status || '"}}}}' AS j, ',' AS sep FROM s"""
_POINTS = "u AS (SELECT id, n, gap, status, prio, unnest(ps) AS p, unnest(range(n)) AS i FROM s), k AS (SELECT * FROM u WHERE p.lat IS NOT NULL)"
_PLACES = """SELECT id AS a, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 1 ELSE i + 1 END AS b, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || p.lng || ',' || p.lat || ']},"properties":{"name":"' || p.name || '","segment_id":' || id || ',"role":"'
    || CASE WHEN i = 0 THEN 'start' WHEN i = n - 1 THEN 'end' ELSE 'via' END || '","page":' || (id % 7) || ',"coordinate_confidence":"' || p.confidence || '","movement_type":"' || status || '"}}' AS j, ',' AS sep FROM k"""


@query("k4_route_geojson", f"WITH {SEG}, " + _document_sql(_HEAD, _ROUTE, "']}'"))
def k4_routes(spark, d):
    routes = segments(spark, d).select("id", G.route_feature(F.col("id"), F.col("ps"), F.col("gap"), [F.col("status").alias("movement_type")]).alias("f"))
    return _lines(spark, D.feature_collection(routes, "f", F.col("id")))


@query("k4_place_geojson", f"WITH {SEG}, {_POINTS}, " + _document_sql(_HEAD, _PLACES, "']}'"))
def k4_places(spark, d):
    paged = segments(spark, d).withColumn("pages", F.array(F.col("id") % 7 + 3, F.col("id") % 7, F.lit(None).cast("long")))
    places = G.place_features(paged, "id", "ps", "pages", [F.col("status").alias("movement_type")])
    return _lines(spark, D.feature_collection(places, "feature", F.col("id"), F.col("turn")))


_NUMBER = "CASE WHEN id < 10 THEN '0' || id ELSE '' || id END"
_POINT_LABEL = f"{_NUMBER} || ' ' || CASE WHEN i = 0 THEN '起点' WHEN i = n - 1 THEN '终点' ELSE '途经' || i END || ' ' || p.name"
_WAY = f"""SELECT id AS a, i AS b, '  <wpt lat="' || p.lat || '" lon="' || p.lng || '"><name>' || {_POINT_LABEL} || '</name><desc>' || prio || ' &amp; &lt;' || status || '&gt; | </desc></wpt>' AS j, '' AS sep FROM k"""
_TRACK = f"""SELECT id AS a, row_number() OVER (PARTITION BY id ORDER BY i) AS b, CASE WHEN i = f THEN '    <trkseg>' || chr(10) ELSE '' END || '      <trkpt lat="' || p.lat || '" lon="' || p.lng || '"><name>' || {_POINT_LABEL} || '</name></trkpt>' || CASE WHEN i = z THEN chr(10) || '    </trkseg>' ELSE '' END AS j, '' AS sep
    FROM (SELECT *, min(i) OVER (PARTITION BY id) AS f, max(i) OVER (PARTITION BY id) AS z FROM k WHERE NOT gap) WHERE f < z"""
_GPX = _document_sql("'<?xml version=\"1.0\" encoding=\"UTF-8\"?>'", "'<gpx version=\"1.1\" creator=\"a &amp; b\" xmlns=\"http://www.topografix.com/GPX/1/1\">'", "'  <metadata>'", "'    <name>way</name>'", "'    <time>2000-01-01T00:00:00Z</time>'", "'  </metadata>'", _WAY, "'  <trk>'", "'    <name>track</name>'", _TRACK, "'  </trk>'", "'</gpx>'")


@query("k5_gpx_document", f"WITH {SEG}, {_POINTS}, " + _GPX.replace("SELECT row_number() OVER (ORDER BY part, a, b) AS place, line FROM l", "SELECT row_number() OVER (ORDER BY part, a, b, e) AS place, line FROM (SELECT part, a, b, unnest(string_split(line, chr(10))) AS line, unnest(range(len(string_split(line, chr(10))))) AS e FROM l)"))
def k5(spark, d):
    title = F.concat_ws("", "prio", F.lit(" & <"), "status", F.lit(">"))
    chains = segments(spark, d).select(F.col("id").alias("number"), title.alias("title"), F.lit(None).cast("string").alias("summary"), "gap", F.col("ps").alias("points"))
    return _lines(spark, D.gpx(chains, "way", "track", "a & b", "2000-01-01T00:00:00Z"))

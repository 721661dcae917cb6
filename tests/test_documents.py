"""Documents written as ordered lines: what the files say when they are put together by name."""

import glob
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quillspark.operators import geo as G
from quillspark.sources import documents as D

POINT = "struct<name:string,lat:double,lng:double,confidence:string>"


@pytest.fixture
def written(spark, tmp_path):
    """A function that writes a document and gives its text and the number of files that say anything."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    def write(lines):
        path = str(tmp_path / "doc")
        D.write_document(lines, path)
        texts = [open(f, encoding="utf-8").read() for f in sorted(glob.glob(path + "/part-*"))]
        back = [r.line for r in D.read_document(spark, path).orderBy("place").collect()]
        assert back == "".join(texts).splitlines()
        return "".join(texts), sum(map(bool, texts))

    yield write
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_json_of_many_files_parses(spark, written):
    rows = spark.range(500).select((F.lit(1000) - F.col("id")).alias("k"), F.when(F.col("id") % 2 == 0, F.concat(F.lit('say "x"\n中'), F.col("id").cast("string"))).alias("t"), F.array("id").alias("xs"))
    text, files = written(D.json_object(rows.repartition(7), "rows", F.col("k"), name='a"b', draft=None))
    got = json.loads(text)
    assert files > 1 and list(got) == ["name", "draft", "rows"] and got["name"] == 'a"b' and got["draft"] is None
    assert [r["k"] for r in got["rows"]] == list(range(501, 1001)) and got["rows"][-1] == {"k": 1000, "t": 'say "x"\n中0', "xs": [0]} and got["rows"][0]["t"] is None


def test_json_of_one_row_and_of_none(spark, tmp_path, written):
    rows = spark.createDataFrame([(1, None)], "k int, t string")
    assert json.loads(written(D.json_object(rows, "rows", F.col("k")))[0]) == {"rows": [{"k": 1, "t": None}]}


def test_empty_json(spark, written):
    assert json.loads(written(D.json_object(spark.createDataFrame([], "k int, rows string"), "rows", F.col("k"), v="1"))[0]) == {"v": "1", "rows": []}


def segments(spark):
    a, b, c, none = ("A", 1.0, 2.0, "verified"), ("B", 3.5, -4.0, "approximate"), ("C <&", 5.0, 6.0, None), ("D", None, 7.0, "missing")
    rows = [(1, [a, b, c], False, [5, 2]), (2, [a, none], False, []), (12, [a, c], True, None), (3, [a, none, c], None, [9]), (4, [], False, [1]), (5, [a], False, [1])]
    return spark.createDataFrame(rows, f"id long, points array<{POINT}>, gap boolean, pages array<int>")


def test_route_features(spark, written):
    f = segments(spark).select("id", G.route_feature(F.col("id"), F.col("points"), F.col("gap"), [F.lit(None).cast("string").alias("title")]).alias("f"))
    got = {x["properties"]["segment_id"]: x for x in json.loads(written(D.feature_collection(f, "f", F.col("id")))[0])["features"]}
    assert list(got) == [1, 2, 3, 4, 5, 12]
    assert got[1]["geometry"] == {"type": "LineString", "coordinates": [[2.0, 1.0], [-4.0, 3.5], [6.0, 5.0]]}
    assert all(got[k]["geometry"] is None and got[k]["properties"]["missing_geometry"] for k in (2, 3, 4, 5, 12))
    assert got[1]["properties"] == {"segment_id": 1, "start_name": "A", "end_name": "C <&", "coordinate_confidence": "missing", "missing_geometry": False, "route_gap": False, "title": None}
    assert got[12]["properties"]["route_gap"] and not got[3]["properties"]["route_gap"] and got[4]["properties"]["start_name"] is None


def test_place_features_put_the_ends_first(spark, written):
    p = G.place_features(segments(spark), "id", "points", "pages", [])
    got = json.loads(written(D.feature_collection(p, "feature", F.col("id"), F.col("turn")))[0])["features"]
    said = [(x["properties"]["segment_id"], x["properties"]["name"], x["properties"]["role"], x["properties"]["page"]) for x in got]
    assert said == [(1, "A", "start", 2), (1, "C <&", "end", 2), (1, "B", "via", 2), (2, "A", "start", None), (3, "A", "start", 9), (3, "C <&", "end", 9), (5, "A", "start", 1), (12, "A", "start", None), (12, "C <&", "end", None)]
    assert got[2]["geometry"] == {"type": "Point", "coordinates": [-4.0, 3.5]}


def test_gpx_parses_and_skips_gaps(spark, written):
    s = segments(spark).select(F.col("id").alias("number"), F.lit("t<1>").alias("title"), F.lit(None).cast("string").alias("summary"), "gap", "points")
    root = ET.fromstring(written(D.gpx(s, "n & m", "tr", "c'r", "2000-01-01T00:00:00Z"))[0])
    ns = "{http://www.topografix.com/GPX/1/1}"
    assert root.get("creator") == "c'r" and root.find(f"{ns}metadata/{ns}name").text == "n & m"
    assert [w.find(f"{ns}name").text for w in root.iter(f"{ns}wpt")] == ["01 起点 A", "01 途经1 B", "01 终点 C <&", "02 起点 A", "03 起点 A", "03 终点 C <&", "05 起点 A", "12 起点 A", "12 终点 C <&"]
    assert next(root.iter(f"{ns}desc")).text == "t<1> | "
    tracks = [[p.find(f"{ns}name").text for p in t] for t in root.iter(f"{ns}trkseg")]
    assert tracks == [["01 起点 A", "01 途经1 B", "01 终点 C <&"], ["03 起点 A", "03 终点 C <&"]]


def test_a_packed_document_is_read_as_it_is(spark, tmp_path):
    import gzip

    rows = spark.range(2000).select(F.concat(F.lit("line number "), F.col("id").cast("string")).alias("line"), "id")
    path = str(tmp_path / "packed")
    D.write_document(D.document(spark, ["head", D.lines_of(rows, F.col("line"), F.col("id")), "tail"]), path, "gzip")
    packed = b"".join(open(f, "rb").read() for f in sorted(glob.glob(path + "/part-*")))
    want = ["head", *(f"line number {i}" for i in range(2000)), "tail"]
    assert gzip.decompress(packed).decode().splitlines() == want and len(packed) < 12000
    assert [r.line for r in D.read_document(spark, path).orderBy("place").collect()] == want

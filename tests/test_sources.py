from __future__ import annotations

import datetime

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartotek.sources import json_lines, tables, xml

BOOKS = """<?xml version="1.0"?>
<catalog>
  <book id="b1"><author>A, B</author><title>One</title><genre>G</genre><price>4.5</price>
    <publish_date>2000-10-01</publish_date><description>line
    two &amp; more</description></book><book id="b2">
    <title>Two</title></book>
</catalog>
"""

REPORT = """<?xml version="1.0"?>
<xbrl xmlns="urn:x" xmlns:f="urn:f" xmlns:g="urn:g"><schemaRef href="s"/>
<context id="D"><entity><identifier scheme="cvr">{n}</identifier></entity>
  <period><startDate>2014-01-01</startDate><endDate>2014-12-31</endDate></period></context>
<context id="I"><entity><identifier scheme="cvr">{n}</identifier></entity>
  <period><instant>2014-12-31</instant></period></context>
<unit id="kr"><measure>iso4217:DKK</measure></unit>
<f:Profit contextRef="D" precision="INF" unitRef="kr">-5</f:Profit>
<f:Profit contextRef="I" precision="INF" unitRef="kr">7</f:Profit>
<f:Assets contextRef="I" precision="INF" unitRef="kr">100</f:Assets>
<g:Meeting contextRef="D">2015-04-17</g:Meeting></xbrl>
"""


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "j")
    frame = spark.createDataFrame([(1, ("a", [1, 2])), (2, None)], "id long, s struct<t:string,a:array<long>>")
    json_lines.write_json(frame, path)
    json_lines.write_json(frame, path)
    assert sorted(rows(json_lines.read_json(spark, path, frame.schema))) == sorted(rows(frame))
    wider = json_lines.read_json(spark, path, "id long, gone string")
    assert sorted(rows(wider)) == [(1, None), (2, None)]
    assert set(json_lines.read_json(spark, path).columns) == {"id", "s"}


def test_json_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    frame = spark.createDataFrame(
        [(0, Vectors.sparse(4, {1: -2.0, 3: 1.5})), (1, Vectors.dense([0.0, 1.0])), (2, Vectors.sparse(3, {}))],
        ["Index", "scaledfeatures"],
    )
    json_lines.write_json(frame, path)
    schema = T.StructType([T.StructField("Index", T.LongType()), T.StructField("scaledfeatures", VectorUDT())])
    assert sorted(rows(json_lines.read_json(spark, path, schema)), key=lambda r: r[0]) == rows(frame)


def test_store(spark, tmp_path):
    path = str(tmp_path / "p")
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string")
    tables.write_store(frame, path, ["kind"])
    tables.write_store(frame, path, ["kind"])
    read = tables.read_store(spark, path).filter("kind = 'a'")
    assert rows(read) == [(1, "a")]
    assert "kind" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


@pytest.mark.parametrize("per_cluster", [False, True])
def test_distance_report(spark, tmp_path, per_cluster):
    path = str(tmp_path / "r")
    frame = spark.createDataFrame([(10, 1.5, 0), (11, 2.5, 1), (12, 0.25, 0)], "cvr long, d double, c int")
    tables.write_distance_report(frame, path, "cvr", "d", "c", per_cluster)
    if per_cluster:
        assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["cluster=0", "cluster=1"]
        lines = [p.read_text() for p in (tmp_path / "r" / "cluster=0").glob("*.csv")]
        assert lines == ["cvr;afstand\n10;1.5\n12;0.25\n"]
    else:
        assert sorted(rows(tables.read_distance_report(spark, path))) == sorted(rows(frame))


def test_xml_books(spark, tmp_path):
    (tmp_path / "books.xml").write_text(BOOKS)
    got = sorted(rows(xml.read_xml(spark, str(tmp_path), "book", xml.BOOK_SCHEMA)))
    assert got[0][:6] == ("b1", "A, B", "One", "G", 4.5, datetime.date(2000, 10, 1)) and "two & more" in got[0][6]
    assert got[1] == ("b2", None, "Two", None, None, None, None)


def test_xml_writing(spark, tmp_path):
    frame = spark.createDataFrame([("b1", "T <&>", 1.0)], "_id string, title string, price double")
    xml.write_xml(frame, str(tmp_path / "x"), "book", "catalog")
    assert rows(xml.read_xml(spark, str(tmp_path / "x"), "book", frame.schema)) == rows(frame)


def test_written_xml_is_cut_into_files(spark, tmp_path):
    """One partition gives several documents of bounded size, and no row is lost."""
    frame = spark.range(120).selectExpr("concat('b', id) AS _id", "concat('T ', id) AS title").coalesce(1)
    xml.write_xml(frame, str(tmp_path / "x"), "book", "catalog", rows_per_file=50)
    counts = sorted(f.read_text().count("</book>") for f in (tmp_path / "x").glob("part-*"))
    assert counts == [20, 50, 50]
    assert sorted(rows(xml.read_xml(spark, str(tmp_path / "x"), "book", frame.schema))) == sorted(rows(frame))


def expected(n):
    day = datetime.date
    period = (str(n), day(2014, 1, 1), day(2014, 12, 31), None)
    moment = (str(n), None, None, day(2014, 12, 31))
    money = ("kr", "iso4217:DKK", "INF", None)
    return [
        ("f:Assets", "I", *moment, *money, "100", 100.0),
        ("f:Profit", "D", *period, *money, "-5", -5.0),
        ("f:Profit", "I", *moment, *money, "7", 7.0),
        ("g:Meeting", "D", *period, None, None, None, None, "2015-04-17", None),
    ]


def test_xbrl_inferred(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.xml").write_text(REPORT.format(n=n))
    got = rows(xml.xbrl_facts(xml.read_xbrl(spark, str(tmp_path))))
    assert sorted(got, key=str) == sorted(expected(1) + expected(2), key=str)


def test_xbrl_with_prefixes_at_every_level(spark, tmp_path):
    text = REPORT.format(n=1).replace('xmlns="urn:x"', 'xmlns="urn:y" xmlns:x="urn:x"')
    for tag in ("context", "entity", "identifier", "period", "startDate", "endDate", "instant", "unit", "measure"):
        text = text.replace(f"<{tag}", f"<x:{tag}").replace(f"</{tag}>", f"</x:{tag}>")
    (tmp_path / "1.xml").write_text(text.replace('precision="INF"', 'decimals="0"'))
    got = rows(xml.xbrl_facts(xml.read_xbrl(spark, str(tmp_path))))
    swapped = [(*r[:8], None, "0" if r[8] else None, *r[10:]) for r in expected(1)]
    assert sorted(got, key=str) == sorted(swapped, key=str)


def test_xbrl_one_per_line(spark, tmp_path):
    lines = [REPORT.format(n=n).split("?>")[1].replace("\n", " ").strip() for n in (1, 2, 3)]
    (tmp_path / "all.xml").write_text("\n".join(lines))
    reports = xml.read_xbrl(spark, str(tmp_path), one_per_line=True)
    got = rows(xml.xbrl_facts(reports))
    assert sorted(got, key=str) == sorted(expected(1) + expected(2) + expected(3), key=str)
    numbered = reports.withColumn("file", F.lit("f"))
    assert xml.xbrl_facts(numbered, keep=["file"]).columns[0] == "file"


def test_xbrl_without_facts(spark):
    with pytest.raises(ValueError):
        xml.xbrl_facts(spark.createDataFrame([(1,)], "context int"))

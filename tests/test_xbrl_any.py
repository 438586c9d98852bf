from __future__ import annotations

import datetime

from kartotek.sources.xbrl_any import read_facts

HEAD = '<?xml version="1.0" encoding="UTF-8"?><!--made--><xbrl xmlns="urn:i" xmlns:a="urn:one" xmlns:b="urn:two" xmlns:d="urn:d">'
CONTEXTS = (
    '<context id="C0"><entity><identifier scheme="urn:cvr">{0}</identifier></entity>'
    "<period><startDate>2014-01-01</startDate><endDate>2014-12-31</endDate></period></context>"
    '<context id="C1"><entity><identifier scheme="urn:cvr">{0}</identifier><segment>'
    '<d:explicitMember dimension="d:Part">d:North</d:explicitMember></segment></entity>'
    "<period><instant>2013-12-31</instant></period></context>"
    '<unit id="U"><measure>iso4217:DKK</measure></unit>'
    '<unit id="V"><divide><unitNumerator><measure>m</measure></unitNumerator>'
    "<unitDenominator><measure>s</measure><measure>t</measure></unitDenominator></divide></unit>"
)


def report(identifier, facts):
    return HEAD + CONTEXTS.format(identifier) + facts + "</xbrl>"


def many(n):
    """Facts of n different tags."""
    return "".join(f'<{"ab"[i % 2]}:Tag{i} contextRef="C{i % 2}" unitRef="U" decimals="0"> {i} </{"ab"[i % 2]}:Tag{i}>' for i in range(n))


def test_facts_of_any_tag(spark, tmp_path):
    (tmp_path / "one.xml").write_text(report(7, many(59) + '<a:T contextRef="C0">Æ &amp; <b>x</b></a:T><a:S><b:In contextRef="C1" unitRef="V">x</b:In></a:S>'))
    rows = {r["name"]: r for r in read_facts(spark, str(tmp_path)).collect()}
    assert len(rows) == 61
    r = rows["b:Tag5"]
    assert (r["namespace"], r["identifier"], r["instant"], r["start_date"]) == ("urn:two", "7", datetime.date(2013, 12, 31), None)
    assert (r["dimensions"], r["measure"], r["decimals"], r["value"], r["number"]) == ({"d:Part": "d:North"}, "iso4217:DKK", "0", " 5 ", 5.0)
    assert (rows["a:T"]["value"], rows["a:T"]["number"], rows["a:T"]["end_date"]) == ("Æ & x", None, datetime.date(2014, 12, 31))
    assert (rows["b:In"]["measure"], rows["b:In"]["number"]) == ("m / s * t", None)


def test_many_reports_in_one_file(spark, tmp_path):
    parts = [report(i, many(3)) for i in range(400)]
    parts[7] = HEAD + "<broken></xbrl>"
    parts[9] = report(9, "")
    (tmp_path / "all.xml").write_text("\n".join(parts) + "\n<!-- end -->\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        facts = read_facts(spark, str(tmp_path))
        assert facts.rdd.getNumPartitions() > 5
        got = facts.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good = [r for r in got if r["problem"] is None]
    assert len(good) == 398 * 3 and {r["identifier"] for r in good} == {str(i) for i in range(400) if i not in (7, 9)}
    assert [r["name"] for r in got if r["problem"] is not None] == [None]


def test_prefixed_root_and_missing_parts(spark, tmp_path):
    text = '<x:xbrl xmlns:x="urn:i"><Alone contextRef="none" unitRef="U">5</Alone></x:xbrl>\n'
    (tmp_path / "p.xml").write_text(text)
    (tmp_path / "empty.xml").write_text("")
    [r] = read_facts(spark, str(tmp_path)).collect()
    assert (r["name"], r["namespace"], r["identifier"], r["measure"], r["number"], r["problem"]) == ("Alone", None, None, None, 5.0, None)


def test_facts_of_many_reports_are_handed_on_together():
    """Rows of different reports share a batch, a bounded number of them, in their order and each with its own report."""
    import pyarrow as pa

    from kartotek.sources import xbrl_any

    texts = [report(i, many(i % 3)) for i in range(9_000)] + ["<broken>"]
    names = [f"r{i}" for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(texts)), pa.array(names), pa.array(texts)], names=["file", "report", "text"])
    given = list(xbrl_any._parsed([batch]))
    assert 2 <= len(given) <= 4
    rows = [r for b in given for r in b.to_pylist()]
    assert [(r["report"], r["name"]) for r in rows] == [
        (f"r{i}", f'{"ab"[j % 2]}:Tag{j}') for i in range(9_000) for j in range(i % 3)
    ] + [("r9000", None)]
    assert {r["identifier"] for r in rows[:-1]} == {str(i) for i in range(9_000) if i % 3}
    assert rows[-1]["dimensions"] == [] and rows[-1]["problem"]

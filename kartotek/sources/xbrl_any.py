"""Facts of XBRL reports whose tags are not known beforehand.

Files are read as text cut at the end tag of a report, so a large file of many reports is split over tasks at report
borders, and every report is parsed where it is. Nothing is inferred and no schema is given.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = (
    "file string, report string, name string, namespace string, context_ref string, identifier string, start_date string, "
    "end_date string, instant string, dimensions map<string,string>, unit_ref string, measure string, precision string, "
    "decimals string, value string, problem string"
)
_TEXTS = (
    "name namespace context_ref identifier start_date end_date instant dimensions unit_ref measure precision decimals value problem"
).split()


_CONTEXT = ("identifier", "startDate", "endDate", "instant")
# So many facts, or characters of reports, are handed on together.
FACTS_TOGETHER = 1 << 13
CHARACTERS_TOGETHER = 1 << 23


@lru_cache(maxsize=1 << 16)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(element, name: str) -> list[str]:
    return [(e.text or "").strip() for e in element.iter() if _local(e.tag) == name]


def _context(element) -> tuple[dict[str, str], dict[str, str]]:
    """The first text of each part of a context, and its dimensions."""
    parts, members = {}, {}
    for e in element.iter():
        name = _local(e.tag)
        if name in _CONTEXT and name not in parts:
            parts[name] = (e.text or "").strip()
        if dimension := e.get("dimension"):
            members[dimension] = (e.text or "").strip()
    return parts, members


def _unit(element) -> str:
    below = []
    for part in element.iter():
        if _local(part.tag) == "unitDenominator":
            below = _texts(part, "measure")
    above = _texts(element, "measure")
    above = above[: len(above) - len(below)]
    return " * ".join(above) + (" / " + " * ".join(below) if below else "")


class _Tree:
    """Builds the tree of one report and keeps the first prefix that each namespace has in it."""

    def __init__(self):
        builder = ET.TreeBuilder()
        self.start, self.end, self.data, self.close = builder.start, builder.end, builder.data, builder.close
        self.prefixes: dict[str, str] = {}

    def start_ns(self, prefix: str | None, uri: str | None) -> None:
        self.prefixes.setdefault(uri or "", prefix or "")


def report_facts(text: str) -> list[tuple]:
    """The facts of one report in their order, also those inside tuples, as ``_TEXTS``.

    A report that cannot be read gives one row with ``problem``.
    """
    tree = _Tree()
    prefixes, parser = tree.prefixes, ET.XMLParser(target=tree)
    problem = None
    try:
        try:
            parser.feed(text)
        except ET.ParseError as error:
            problem = error
        root = parser.close()
    except ET.ParseError as error:
        problem = error
    if problem is not None:
        return [tuple([] if n == "dimensions" else str(problem) if n == "problem" else None for n in _TEXTS)]
    contexts, units, facts, found = {}, {}, [], []
    for element in root.iter():
        if element.get("contextRef") is not None:
            found.append(element)
            continue
        kind = _local(element.tag)
        if kind == "context" and element.get("id") not in contexts:
            contexts[element.get("id")] = _context(element)
        elif kind == "unit" and element.get("id") not in units:
            units[element.get("id")] = _unit(element)
    for element in found:
        tag, get = element.tag, element.get
        uri = tag[1:].split("}")[0] if tag.startswith("{") else ""
        prefix = prefixes.get(uri, "")
        context, members = contexts.get(get("contextRef"), ({}, {}))
        facts.append(
            (
                f"{prefix}:{_local(tag)}" if prefix else _local(tag), uri or None, get("contextRef"), context.get("identifier"),
                context.get("startDate"), context.get("endDate"), context.get("instant"), list(members.items()),
                get("unitRef"), units.get(get("unitRef")), get("precision"), get("decimals"), "".join(element.itertext()), None,
            )
        )
    return facts


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = pa.string()
    schema = pa.schema([(n, pa.map_(text, text) if n == "dimensions" else text) for n in ("file", "report", *_TEXTS)])

    def together(reports: list[tuple], facts: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*reports), *zip(*facts)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    reports, facts, characters = [], [], 0
    for batch in batches:
        for file, report, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found = report_facts(line)
            facts += found
            reports += [(file, report)] * len(found)
            characters += len(line)
            if len(facts) >= FACTS_TOGETHER or characters >= CHARACTERS_TOGETHER:
                if facts:
                    yield together(reports, facts)
                reports, facts, characters = [], [], 0
    if facts:
        yield together(reports, facts)


def read_facts(spark: SparkSession, path: str | list[str], end_tag: str = "</xbrl>") -> DataFrame:
    """One row per fact of every report below ``path``, of whatever tag: the columns of ``FACTS`` and ``number``.

    ``file`` and ``report`` (a digest of its text) tell reports apart. ``name`` has the prefix that the report itself uses, and
    ``namespace`` is what that stands for. The period, identifier and dimensions come from the fact's context, the first
    of equal ids; a unit is the product of its measures and, after a slash, of those it is divided by. ``number`` is the
    value of a fact with a unit, null where that is no number. A report that is not well formed gives one row
    with only ``file``, ``report`` and ``problem``; the others of its file are not touched by it. One without facts gives none.

    ``end_tag`` is what reports end with. A file whose reports end otherwise is one piece: right for a single report,
    while of several it is a problem. A report is parsed as a whole, so it must fit a task's memory; files are UTF-8.
    """
    pieces = spark.read.option("lineSep", end_tag).text(path)
    body = F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")
    ends = F.regexp_like("body", F.lit(r"</[\w.-]+:xbrl>\s*$"))
    whole = F.when(ends, F.col("body")).otherwise(F.concat("body", F.lit(end_tag)))
    reports = (
        pieces.select(F.col("_metadata.file_path").alias("file"), body.alias("body"))
        .filter(F.regexp_like("body", F.lit(r"<[^!?\s]")))
        .select("file", F.sha2("body", 256).alias("report"), whole.alias("text"))
    )
    facts = reports.mapInArrow(_parsed, FACTS)
    number = F.when(F.col("unit_ref").isNotNull(), F.trim("value").try_cast("double"))
    return facts.withColumns({**{c: F.col(c).try_cast("date") for c in ("start_date", "end_date", "instant")}, "number": number})

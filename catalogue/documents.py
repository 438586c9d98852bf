"""Documents of any shape: schemas found in the data, nested tables as flat ones, reports with unknown tags, reports per cluster."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.fits import TEXT_TERMS, labelled_texts
from catalogue.registry import ORACLE, Tables, query
from catalogue.rows import order_documents
from catalogue.vectors import LONG, TO_OWN_CENTRE, own_distances, spread
from kartotek.operators import regression, shred, vectors
from kartotek.sizing import pinned, scratch_path
from kartotek.sources import json_types, tables
from kartotek.sources.xbrl_any import read_facts


def mixed_lines(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events as JSON lines in two batches: a field that is a number or a text, one that is whole or not, and lines cut short."""
    number = F.get_json_object("props", "$.k")
    value = F.when(F.col("event_id") % 10 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(number)
    amount = F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    whole = F.format_string('{"event_id":%s,"v":%s,"of":{"w":%s}}', F.col("event_id").cast("string"), value, amount)
    line = F.when(F.col("event_id") % 10 == 0, F.format_string('{"event_id":%s,"v":', F.col("event_id").cast("string"))).otherwise(whole)
    batches = []
    for rest in (0, 1):
        path = scratch_path(t.spark, "lines")
        t.events.filter(F.col("event_id") % 3 % 2 == rest).select(line.alias("value")).write.text(path)
        batches.append(json_types.numbered_lines(t.spark, path))
    return batches[0], batches[1]


@query(
    """
SELECT event_id, CASE WHEN event_id % 10 = 1 THEN event_type ELSE json_extract_string(props, '$.k') END AS v,
       CASE WHEN event_id % 2 = 0 THEN floor(value) ELSE value END AS w
FROM events WHERE event_id % 10 <> 0
"""
)
def q_json_lattice(t: Tables) -> DataFrame:
    """Lines read by the schema found in both batches, the first one's kept in between."""
    one, two = mixed_lines(t)
    path = scratch_path(t.spark, "schema")
    json_types.save_schema(t.spark, json_types.found_schema(one), path)
    schema = json_types.found_schema(two, json_types.load_schema(t.spark, path))
    return json_types.records(one.unionByName(two), schema).select("event_id", "v", "of.w")


@query("SELECT concat('{\"event_id\":', CAST(event_id AS VARCHAR), ',\"v\":') AS line FROM events WHERE event_id % 10 = 0")
def q_json_bad_lines(t: Tables) -> DataFrame:
    """The lines cut short, each with its file."""
    one, two = mixed_lines(t)
    return json_types.bad_lines(one.unionByName(two)).filter(F.col("file").isNotNull()).select("line")


@query(
    """
SELECT o_orderkey, o_custkey AS kunde, o_totalprice AS pris,
       CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0 WHEN o_orderstatus <> 'P' THEN 2 END AS INTEGER) AS n
FROM orders
"""
)
def q_shred_top(t: Tables) -> DataFrame:
    """The top table of the nested orders: structs as columns, the history as its length, null where it is null."""
    top = shred.shred(order_documents(t.orders), ["o_orderkey"])[""]
    return top.select(
        "o_orderkey", F.col("`ordre.kunde`").alias("kunde"), F.col("`ordre.beloeb.pris`").alias("pris"), F.col("`ordre.historik#`").alias("n")
    )


HISTORY = """
WITH h AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'),
e AS (SELECT o_orderkey, CAST(0 AS INTEGER) AS place, o_orderpriority AS status, CAST(o_orderdate AS DATE) AS fra FROM h
      UNION ALL SELECT o_orderkey, 1, concat('Slut ', o_orderstatus), CAST(o_orderdate AS DATE) + 30 FROM h)
"""


@query(HISTORY + "SELECT o_orderkey, place, status, CAST(fra AS VARCHAR) AS fra FROM e")
def q_shred_history(t: Tables) -> DataFrame:
    """The history as a table of its own, linked by key and position."""
    rows = shred.shred(order_documents(t.orders), ["o_orderkey"])["ordre.historik[]"]
    return rows.select(
        F.col("`^o_orderkey`").alias("o_orderkey"), F.col("`@1`").alias("place"), "status", F.col("`periode.fra`").cast("string").alias("fra")
    )


@query(
    HISTORY
    + """, g AS (SELECT o_orderkey, string_agg(concat(status, ' ', CAST(fra AS VARCHAR)), '|' ORDER BY place) AS steps FROM e GROUP BY o_orderkey)
SELECT o.o_orderkey, o_custkey AS kunde, o_totalprice AS pris,
       CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE steps END AS steps
FROM orders o LEFT JOIN g ON g.o_orderkey = o.o_orderkey
"""
)
def q_shred_restore(t: Tables) -> DataFrame:
    """The flat tables written, read and put together again."""
    documents = order_documents(t.orders)
    flat = {name: pinned(table) for name, table in shred.shred(documents, ["o_orderkey"]).items()}
    back = shred.restore(flat, documents.schema, ["o_orderkey"])
    steps = F.transform("ordre.historik", lambda s: F.concat_ws(" ", s["status"], s["periode"]["fra"].cast("string")))
    return back.select("o_orderkey", "ordre.kunde", "ordre.beloeb.pris", F.array_join(steps, "|").alias("steps"))


@query(
    """
SELECT CAST(o_orderkey AS VARCHAR) AS identifier, concat('fsa:Status', o_orderstatus) AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS instant,
       'iso4217:DKK' AS measure, floor(o_totalprice) AS number
FROM orders
"""
)
def q_xbrl_any_tag(t: Tables) -> DataFrame:
    """Reports whose tags come from the data, many in a file; read without a schema or inference."""
    path = scratch_path(t.spark, "reports")
    report = (
        '<?xml version="1.0"?><xbrl xmlns="urn:x" xmlns:fsa="urn:fsa"><context id="C">'
        '<entity><identifier scheme="urn:cvr">%1$s</identifier></entity><period><instant>%2$s</instant></period></context>'
        '<unit id="U"><measure>iso4217:DKK</measure></unit>'
        '<fsa:Status%3$s contextRef="C" unitRef="U">%4$s</fsa:Status%3$s>\n</xbrl>'
    )
    text = F.format_string(
        report, F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("date").cast("string"), "o_orderstatus", F.floor("o_totalprice").cast("string")
    )
    t.orders.select(text.alias("value")).write.text(path)
    return read_facts(t.spark, path).select("identifier", "name", F.col("instant").cast("string").alias("instant"), "measure", "number")


@query(TO_OWN_CENTRE + "SELECT vec_id AS cvr, round(distance, 6) AS afstand, label AS cluster FROM d")
def q_csv_report_by_cluster(t: Tables) -> DataFrame:
    """The ranked distances in one folder per cluster, read back."""
    path = scratch_path(t.spark, "report")
    tables.write_distance_report(own_distances(t.embeddings), path, "vec_id", "distance", "label", per_cluster=True)
    return tables.read_distance_report(t.spark, path).withColumn("afstand", F.round("afstand", 6))


@query(LONG + "SELECT vec_id, dim, round(x, 6) AS x FROM e")
def q_old_vectors(t: Tables) -> DataFrame:
    """Vectors of the old kind as vectors of the new one."""
    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    old = MLUtils.convertVectorColumnsFromML(rows, "features")
    if vectors.vector_kind(old.schema, "features") != "mllib":
        raise TypeError("the vectors are of the new kind already")
    new = vectors.to_ml_vectors(old, "features")
    return spread(new.withColumn("a", vector_to_array("features")), "a", "vec_id")


@query(ORACLE["q_glm_moments"])
def q_glm_pipeline(t: Tables) -> DataFrame:
    """Assembler and GLM fitted as one pipeline; probability times feature sums to label times feature."""
    rows = labelled_texts(t)
    flat = rows.select("doc_id", "label", *[F.get(vector_to_array("features"), i).alias(n) for i, n in enumerate(TEXT_TERMS)])
    scored = regression.binomial_pipeline(TEXT_TERMS).fit(flat).transform(flat)
    terms = [F.struct(F.lit(n).alias("term"), (F.col("predictions") * x).alias("x")) for n, x in [*((n, F.col(n)) for n in TEXT_TERMS), ("Intercept", F.lit(1.0))]]
    return scored.select(F.inline(F.array(*terms))).groupBy("term").agg(F.round(F.sum("x"), 3).alias("total"))

"""Round trips through the readers and writers, in the session's shared folder."""

from __future__ import annotations

from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue.registry import Tables, query
from catalogue.vectors import LONG, TO_OWN_CENTRE, own_distances, spread
from kartotek.functions.vector import sparse_vector
from kartotek.operators import clusters, vectors
from kartotek.plans import clustering, company
from kartotek.sizing import scratch_path
from kartotek.sources import json_lines, models, tables, xml


@query(
    """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events
"""
)
def q_json_roundtrip(t: Tables) -> DataFrame:
    """Nested events written as JSON lines and read with a schema; an unknown field is null."""
    path = scratch_path(t.spark, "events-json")
    props = F.from_json("props", "k long")
    json_lines.write_json(t.events.select("event_id", F.struct("event_type", props.alias("props")).alias("doc")), path)
    schema = "event_id long, doc struct<event_type:string,props:struct<k:long>,missing:string>"
    back = json_lines.read_json(t.spark, path, schema)
    return back.select("event_id", "doc.event_type", "doc.props.k", "doc.missing")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_json_inferred(t: Tables) -> DataFrame:
    """JSON lines read back with an inferred schema."""
    path = scratch_path(t.spark, "nation-json")
    json_lines.write_json(t.nation, path)
    back = json_lines.read_json(t.spark, path)
    return back.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT event_id, user_id, value, event_type FROM events WHERE event_type = 'purchase'")
def q_parquet_store(t: Tables) -> DataFrame:
    """A store partitioned by type; the filter reads one partition only."""
    path = scratch_path(t.spark, "events-store")
    tables.write_store(t.events.select("event_id", "user_id", "value", "event_type"), path, ["event_type"])
    return tables.read_store(t.spark, path).filter(F.col("event_type") == "purchase")


@query(TO_OWN_CENTRE + "SELECT vec_id AS cvr, round(distance, 6) AS afstand, label AS cluster FROM d")
def q_csv_report(t: Tables) -> DataFrame:
    """The ranked distances as a semicolon file, read back."""
    path = scratch_path(t.spark, "report")
    tables.write_distance_report(own_distances(t.embeddings), path, "vec_id", "distance", "label")
    return tables.read_distance_report(t.spark, path).withColumn("afstand", F.round("afstand", 6))


@query(
    LONG
    + """SELECT vec_id, dim, round(x, 6) AS x, round(greatest(x, 0), 6) AS positive FROM e"""
)
def q_vector_json(t: Tables) -> DataFrame:
    """A dense vector and a sparse one of its positive part, through JSON lines."""
    path = scratch_path(t.spark, "vectors-json")
    x = F.col("embedding").cast("array<double>")
    positive = F.filter(x, lambda v: v > 0)
    at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) > 0)
    json_lines.write_json(
        t.embeddings.select(
            "vec_id", array_to_vector(x).alias("full"), sparse_vector(F.size(x), at, positive).alias("part")
        ),
        path,
    )
    schema = T.StructType(
        [T.StructField("vec_id", T.LongType()), T.StructField("full", VectorUDT()), T.StructField("part", VectorUDT())]
    )
    back = json_lines.read_json(t.spark, path, schema)
    both = F.arrays_zip(vector_to_array("full").alias("x"), vector_to_array("part").alias("positive"))
    rows = back.select("vec_id", F.posexplode(both).alias("dim", "v"))
    return rows.select(
        "vec_id", F.col("dim").cast("long").alias("dim"), *[F.round(f"v.{c}", 6).alias(c) for c in ("x", "positive")]
    )


@query(
    LONG
    + """, s AS (SELECT dim, stddev_samp(x) AS sd FROM e GROUP BY dim)
SELECT vec_id, e.dim, round(x / sd, 6) AS x FROM e JOIN s ON s.dim = e.dim"""
)
def q_model_reload(t: Tables) -> DataFrame:
    """A fitted scaler saved, loaded and applied."""
    path = scratch_path(t.spark, "scaler")
    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    _, model = vectors.scale(rows)
    models.save_model(model, path)
    scaled = models.load_model(StandardScalerModel, path).transform(rows)
    return spread(scaled.withColumn("a", vector_to_array("scaledfeatures")), "a", "vec_id")


@query(
    """
SELECT concat('bk', CAST(p_partkey AS VARCHAR)) AS id, p_brand AS author, p_name AS title, p_type AS genre,
       p_retailprice AS price, CAST(DATE '2000-01-01' + p_size AS VARCHAR) AS publish_date
FROM part
"""
)
def q_xml_books(t: Tables) -> DataFrame:
    """Parts written as book elements with an id attribute, and read as typed rows."""
    path = scratch_path(t.spark, "books")
    books = t.part.select(
        F.concat(F.lit("bk"), F.col("p_partkey").cast("string")).alias("_id"),
        F.col("p_brand").alias("author"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("genre"),
        F.col("p_retailprice").alias("price"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")).alias("publish_date"),
        F.concat(F.lit("About\n  "), "p_name").alias("description"),
    )
    xml.write_xml(books, path, "book", "catalog")
    back = xml.read_xml(t.spark, path, "book", xml.BOOK_SCHEMA)
    return back.select(
        F.col("_id").alias("id"), "author", "title", "genre", "price", F.col("publish_date").cast("string").alias("publish_date")
    )


XBRL_SCHEMA = (
    "context array<struct<_id:string,entity:struct<identifier:struct<_VALUE:string,_scheme:string>>,"
    "period:struct<endDate:string,instant:string,startDate:string>>>, "
    "unit struct<_id:string,measure:string>, "
    "`fsa:ProfitLoss` array<struct<_VALUE:string,_contextRef:string,_precision:string,_unitRef:string>>, "
    "`gsd:TypeOfReport` struct<_VALUE:string,_contextRef:string>"
)


@query(
    """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS identifier, CAST(o_orderdate AS DATE) AS d,
                  CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole, o_orderpriority FROM orders)
SELECT identifier, 'fsa:ProfitLoss' AS name, 'C1' AS context_ref, CAST(d - 30 AS VARCHAR) AS start_date,
       CAST(d AS VARCHAR) AS end_date, CAST(NULL AS VARCHAR) AS instant, 'iso4217:DKK' AS measure, whole AS value,
       CAST(whole AS DOUBLE) AS number FROM o
UNION ALL
SELECT identifier, 'fsa:ProfitLoss', 'C2', NULL, NULL, CAST(d AS VARCHAR), 'iso4217:DKK', concat('-', whole),
       -CAST(whole AS DOUBLE) FROM o
UNION ALL
SELECT identifier, 'gsd:TypeOfReport', 'C1', CAST(d - 30 AS VARCHAR), CAST(d AS VARCHAR), NULL, NULL, o_orderpriority, NULL
FROM o
"""
)
def q_xbrl_facts(t: Tables) -> DataFrame:
    """One report per order with two periods; its facts as rows with their context and unit."""
    path = scratch_path(t.spark, "xbrl")
    day = F.col("o_orderdate").cast("date")
    start, end = F.date_sub(day, 30).cast("string"), day.cast("string")
    key, whole = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("string")
    entity = '<entity><identifier scheme="urn:cvr">%1$s</identifier></entity>'
    amount = '<fsa:ProfitLoss contextRef="%s" precision="INF" unitRef="currency">%s</fsa:ProfitLoss>'
    report = (
        '<xbrl xmlns="urn:x" xmlns:fsa="urn:fsa" xmlns:gsd="urn:gsd">'
        f'<context id="C1">{entity}<period><startDate>%2$s</startDate><endDate>%3$s</endDate></period></context>'
        f'<context id="C2">{entity}<period><instant>%3$s</instant></period></context>'
        '<unit id="currency"><measure>iso4217:DKK</measure></unit>'
        + amount % ("C1", "%4$s")
        + amount % ("C2", "-%4$s")
        + '<gsd:TypeOfReport contextRef="C1">%5$s</gsd:TypeOfReport></xbrl>'
    )
    text = F.format_string(report, key, start, end, whole, "o_orderpriority")
    t.orders.select(text.alias("value")).write.text(path)
    facts = xml.xbrl_facts(xml.read_xbrl(t.spark, path, XBRL_SCHEMA, one_per_line=True))
    return facts.select(
        "identifier",
        "name",
        "context_ref",
        *[F.col(c).cast("string").alias(c) for c in ("start_date", "end_date", "instant")],
        "measure",
        "value",
        "number",
    )


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ FROM embeddings")
def q_saved_clustering(t: Tables) -> DataFrame:
    """Vectors stored, models saved, and all of it read again: rows whose cluster or distance is another then are none."""
    rows = t.embeddings.select(F.col("vec_id").alias("Index"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    scaled, scaler = vectors.scale(rows)
    model = clusters.fit_kmeans(scaled)
    paths = [scratch_path(t.spark, name) for name in ("scaler", "kmeans", "vectors")]
    models.save_model(scaler, paths[0])
    models.save_model(model, paths[1])
    tables.write_store(rows, paths[2])
    stored = clustering.saved_distances(paths[0], paths[1], tables.read_store(t.spark, paths[2]))
    own = clustering.distances(scaled, model).toDF("Index", "own", "away")
    differs = (F.col("own") != F.col("prediction")) | (F.abs(F.col("away") - F.col("distance")) > 1e-9)
    return stored.join(own, "Index").agg(F.count("*").alias("n"), F.count_if(differs).alias("differ"))


@query(
    """
SELECT 'virksomhed' AS kind, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'deltager', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT 'produktionsenhed', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey % 3 = 2
"""
)
def q_register_store(t: Tables) -> DataFrame:
    """A register dump of all three types stored by type and read type by type."""
    key = F.col("c_custkey")
    source = F.struct(
        F.when(key % 3 == 0, F.struct(key.alias("cvrNummer"))).alias("Vrvirksomhed"),
        F.when(key % 3 == 1, F.struct(key.alias("enhedsNummer"))).alias("Vrdeltagerperson"),
        F.when(key % 3 == 2, F.struct(key.alias("pNummer"))).alias("VrproduktionsEnhed"),
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in company.PAYLOADS]), (key % 3 + 1).cast("int"))
    path = scratch_path(t.spark, "register")
    company.store_register(t.customer.select(key.cast("string").alias("_id"), kind.alias("_type"), source.alias("_source")), path)
    fields = {"virksomhed": "cvrNummer", "deltager": "enhedsNummer", "produktionsenhed": "pNummer"}
    parts = [
        company.stored_type(t.spark, path, kind).agg(
            F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(f"{company.PAYLOADS[kind][1]}.{field}").alias("keys")
        )
        for kind, field in fields.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

"""Row-wise queries: projection, filters, typing, nested data, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import Tables, query
from kartotek.functions import text as X
from kartotek.operators import cleaning, nested, sampling
from kartotek.plans.durations import mean_durations


def line_histories(lineitem: DataFrame) -> DataFrame:
    """Two status intervals per line item in parallel arrays of text dates.

    From shipping for as many days as there are pieces; then open for status O, or
    back to a date before shipping.
    """
    ship = F.col("l_shipdate").cast("date")
    days = F.col("l_quantity").cast("int")
    turn = F.date_add(ship, days)
    end = F.when(F.col("l_linestatus") != "O", F.date_sub(ship, days).cast("string"))
    return lineitem.select(
        F.col("l_orderkey").alias("cvr"),
        F.array(ship.cast("string"), turn.cast("string")).alias("gyldigFra"),
        F.array(turn.cast("string"), end).alias("gyldigTil"),
        F.array("l_returnflag", "l_linestatus").alias("status"),
    )


LINE_INTERVALS = """
WITH h AS (
  SELECT l_orderkey AS cvr, lower(l_returnflag) AS s1, lower(l_linestatus) AS s2, l_linestatus,
         CAST(l_shipdate AS DATE) AS ship, CAST(l_quantity AS INTEGER) AS days
  FROM lineitem
), d AS (
  SELECT cvr, s1 AS status, greatest(days, 1) AS difference FROM h
  UNION ALL
  SELECT cvr, s2, CASE WHEN l_linestatus = 'O' THEN greatest(abs(DATE '2100-01-01' - (ship + days)), 1)
                       ELSE greatest(2 * days, 1) END
  FROM h
)
"""


@query(
    LINE_INTERVALS
    + "SELECT status, count(*) AS n, round(avg(difference), 6) AS avg_days FROM d GROUP BY status"
)
def q_status_duration(t: Tables) -> DataFrame:
    """Mean time in each status over all line items."""
    return mean_durations(line_histories(t.lineitem)).withColumn("avg_days", F.round("avg_days", 6))


@query(LINE_INTERVALS + "SELECT cvr, status, CAST(difference AS INTEGER) AS difference FROM d")
def q_status_intervals(t: Tables) -> DataFrame:
    """Every status interval of every line item."""
    from kartotek.plans.durations import durations

    return durations(line_histories(t.lineitem)).select("cvr", "status", "difference")


def event_envelopes(events: DataFrame) -> DataFrame:
    """Events as typed documents: the payload sits in a struct named after its type."""

    def payload(kind: str, *columns: str):
        return F.when(F.col("event_type") == kind, F.struct("event_id", *columns)).alias(kind.capitalize())

    return events.select(
        F.col("event_type").alias("_type"),
        F.struct(payload("purchase", "value", "user_id"), payload("view", "user_id"), payload("click", "value")).alias(
            "_source"
        ),
    )


@query(
    """
SELECT 'purchase' AS kind, event_id, value, user_id FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'view', event_id, NULL, user_id FROM events WHERE event_type = 'view'
UNION ALL SELECT 'click', event_id, value, NULL FROM events WHERE event_type = 'click'
"""
)
def q_split_by_type(t: Tables) -> DataFrame:
    """Documents split by type, each payload flattened; other types go."""
    kinds = {"purchase": ("Purchase", "doc"), "view": ("View", "doc"), "click": ("Click", "doc")}
    parts = nested.split_by_type(event_envelopes(t.events), kinds)
    return sampling.union_rows(*[part.select(F.lit(kind).alias("kind"), "doc.*") for kind, part in parts.items()])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def q_status_filter(t: Tables) -> DataFrame:
    return cleaning.keep_values(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


@query("SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND toxic IS NULL")
def q_null_filter(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return cleaning.where_all_null(joined, ["quality", "toxic"]).select("doc_id", "lang")


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def q_present_filter(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return cleaning.where_present(joined, ["quality"]).select("doc_id", "lang", "quality")


@query("SELECT p_partkey, p_name, p_size FROM part")
def q_drop_columns(t: Tables) -> DataFrame:
    """The complement of a list of columns, one of them absent."""
    return cleaning.without(t.part, ["p_brand", "p_type", "p_retailprice", "not_there"])


@query("SELECT n_nationkey, n_name AS \"nation:n_name\", n_regionkey AS \"nation:n_regionkey\" FROM nation")
def q_prefix_columns(t: Tables) -> DataFrame:
    return cleaning.prefixed(t.nation, "nation:", keep=["n_nationkey"])


@query(
    """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) - 2000 AS aar
FROM orders
"""
)
def q_derive(t: Tables) -> DataFrame:
    years = t.orders.select("o_orderkey", F.year("o_orderdate").alias("stiftelsesAar"))
    return cleaning.with_offset_year(years).drop("stiftelsesAar")


@query(
    """
SELECT o_orderkey, CAST(o_totalprice > 250000 AS INTEGER) AS dear, CAST(o_custkey AS BIGINT) AS customer,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, TRY_CAST(o_orderstatus AS INTEGER) AS status
FROM orders
"""
)
def q_cast(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        (F.col("o_totalprice") > 250000).alias("dear"),
        F.col("o_custkey").cast("int").alias("customer"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    return cleaning.cast_columns(rows, {"dear": "int", "customer": "long", "priority": "int", "status": "int"})


@query(
    """
SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'ukendt') AS quality_text,
       coalesce(nullif(lang, 'en'), 'ukendt') AS other_lang
FROM documents LEFT JOIN labels USING (doc_id)
"""
)
def q_fill_constant(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", F.nullif("lang", F.lit("en")).alias("other_lang")).join(
        t.labels.select("doc_id", F.col("quality").cast("string").alias("quality_text")), "doc_id", "left"
    )
    return cleaning.fill_text(joined, ["quality_text", "other_lang", "not_there"])


@query(
    """
SELECT doc_id, lang, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)
"""
)
def q_fill_zero(t: Tables) -> DataFrame:
    return cleaning.fill_zero(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"))


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def q_drop_nulls(t: Tables) -> DataFrame:
    return cleaning.drop_missing(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"))


@query(
    """
WITH j AS (SELECT doc_id, quality, toxic, CASE WHEN n_chars > 500 THEN n_chars END AS long_chars
           FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, round(coalesce(quality, (SELECT avg(quality) FROM j)), 6) AS quality,
       round(coalesce(toxic, (SELECT avg(toxic) FROM j)), 6) AS toxic,
       round(coalesce(long_chars, (SELECT avg(long_chars) FROM j)), 6) AS long_chars
FROM j
"""
)
def q_impute_mean(t: Tables) -> DataFrame:
    chars = F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("long_chars")
    joined = t.documents.select("doc_id", chars).join(t.labels, "doc_id", "left")
    columns = ["quality", "toxic", "long_chars"]
    filled = cleaning.impute_mean(joined, columns)
    return filled.select("doc_id", *[F.round(c, 6).alias(c) for c in columns])


@query(
    """
SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS INTEGER) AS brand_number,
       TRY_CAST(nullif(regexp_extract(p_type, '([0-9]+)', 1), '') AS INTEGER) AS type_number,
       TRY_CAST(nullif(regexp_extract(concat('ANTAL_', CAST(p_size AS VARCHAR), '_99'), '([0-9]+)', 1), '') AS INTEGER)
         AS interval_low
FROM part
"""
)
def q_extract_number(t: Tables) -> DataFrame:
    """Codes such as ANTAL_10_19 give their first number; text without digits gives null."""
    interval = F.concat(F.lit("ANTAL_"), F.col("p_size").cast("string"), F.lit("_99"))
    return t.part.select(
        "p_partkey",
        X.first_number(F.col("p_brand")).alias("brand_number"),
        X.first_number(F.col("p_type")).alias("type_number"),
        X.first_number(interval).alias("interval_low"),
    )


@query(
    """
SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'None') AS quality_text, coalesce(lang, 'None') AS lang_text
FROM documents LEFT JOIN labels USING (doc_id)
"""
)
def q_to_text(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select(
        "doc_id", X.as_text(F.col("quality")).alias("quality_text"), X.as_text(F.col("lang")).alias("lang_text")
    )


@query(
    """
SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '\\s+', '', 'g') AS priority,
       regexp_replace(lower(concat(' Opløst  efter ', nullif(o_orderstatus, 'P'))), '\\s+', '', 'g') AS status
FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders)
WHERE o_orderstatus <> 'P'
UNION ALL
SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '\\s+', '', 'g'), NULL FROM orders WHERE o_orderstatus = 'P'
"""
)
def q_norm_status(t: Tables) -> DataFrame:
    status = F.concat(F.lit(" Opløst  efter "), F.nullif("o_orderstatus", F.lit("P")))
    return t.orders.select(
        "o_orderkey",
        X.squeezed_lower(F.col("o_orderpriority")).alias("priority"),
        X.squeezed_lower(status).alias("status"),
    )


@query(
    """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS aar,
       TRY_CAST(substr(o_orderpriority, 1, 4) AS INTEGER) AS no_year
FROM orders
"""
)
def q_year(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        X.leading_year(F.col("o_orderdate").cast("date")).alias("aar"),
        X.leading_year(F.col("o_orderpriority")).alias("no_year"),
    )


@query(
    """
SELECT doc_id, CASE WHEN quality IS NULL THEN 100 ELSE quality END AS kode
FROM documents LEFT JOIN labels USING (doc_id)
"""
)
def q_make_integer(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", X.code_to_int(X.as_text(F.col("quality"))).alias("kode"))


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS label FROM orders
"""
)
def q_label(t: Tables) -> DataFrame:
    """F stands for the active status; P becomes null first, and null counts as not active."""
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.select("o_orderkey", X.status_label(status, active="F").alias("label"))


def order_documents(orders: DataFrame) -> DataFrame:
    """Orders as nested documents: a head struct and a status history as array of structs.

    Orders of status P have a null history and those of priority 5-LOW an empty one.
    """
    first = F.struct(
        F.col("o_orderpriority").alias("status"), F.struct(F.col("o_orderdate").cast("date").alias("fra")).alias("periode")
    )
    second = F.struct(
        F.concat(F.lit("Slut "), "o_orderstatus").alias("status"),
        F.struct(F.date_add(F.col("o_orderdate").cast("date"), 30).alias("fra")).alias("periode"),
    )
    history = F.array(first, second)
    low = F.filter(history, lambda _: F.lit(False))
    return orders.select(
        "o_orderkey",
        F.struct(
            F.col("o_custkey").alias("kunde"),
            F.struct(F.col("o_totalprice").alias("pris")).alias("beloeb"),
            F.when(F.col("o_orderpriority") == "5-LOW", low)
            .when(F.col("o_orderstatus") != "P", history)
            .alias("historik"),
        ).alias("ordre"),
    )


@query(
    """
SELECT o_orderkey, o_totalprice AS pris,
       CASE WHEN o_orderpriority = '5-LOW' THEN ''
            WHEN o_orderstatus <> 'P' THEN concat(o_orderpriority, '|Slut ', o_orderstatus) END AS statuser,
       CASE WHEN o_orderpriority = '5-LOW' THEN ''
            WHEN o_orderstatus <> 'P' THEN concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '|',
                 CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR)) END AS datoer
FROM orders
"""
)
def q_array_field(t: Tables) -> DataFrame:
    """Paths through an array of structs give the array of the field, in order."""
    flat = nested.project_paths(
        order_documents(t.orders),
        [
            ("o_orderkey", "o_orderkey"),
            ("ordre.beloeb.pris", "pris"),
            ("ordre.historik.status", "statuser"),
            ("ordre.historik.periode.fra", "datoer"),
        ],
    )
    texts = {c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("statuser", "datoer")}
    return flat.withColumns(texts)


@query(
    """
WITH h AS (SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW')
SELECT o_custkey AS kunde, o_orderpriority AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS fra FROM h
UNION ALL
SELECT o_custkey, concat('Slut ', o_orderstatus), CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) FROM h
"""
)
def q_next_layer(t: Tables) -> DataFrame:
    """One row per history entry, below the struct that holds it."""
    layer = nested.next_layer(order_documents(t.orders), ["kunde"], "historik", "ordre")
    return layer.select("kunde", "status", F.col("periode.fra").cast("string").alias("fra"))


@query(
    """
WITH h AS (SELECT *, o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS full_history FROM orders)
SELECT o_orderkey, CASE WHEN full_history THEN o_orderpriority END AS status FROM h
UNION ALL
SELECT o_orderkey, concat('Slut ', o_orderstatus) FROM h WHERE full_history
"""
)
def q_explode(t: Tables) -> DataFrame:
    """Array elements as rows, rows with an empty or missing array kept."""
    histories = order_documents(t.orders).select("o_orderkey", "ordre.historik")
    rows = nested.explode_rows(histories, "historik", "entry", keep_empty=True)
    return rows.select("o_orderkey", "entry.status")


@query(
    """
SELECT o_orderkey, o_custkey AS ordre_kunde, o_totalprice AS pris,
       CASE WHEN o_orderpriority = '5-LOW' THEN 0 WHEN o_orderstatus <> 'P' THEN 2 END AS antal
FROM orders
"""
)
def q_expand_struct(t: Tables) -> DataFrame:
    """Struct fields as columns; a second call opens the struct found inside."""
    wide = nested.expand_struct(order_documents(t.orders), "ordre", "not_there")
    wide = nested.expand_struct(wide, "ordre_beloeb")
    return wide.select(
        "o_orderkey",
        "ordre_kunde",
        F.col("ordre_beloeb_pris").alias("pris"),
        F.when(F.col("ordre_historik").isNotNull(), F.size("ordre_historik")).alias("antal"),
    )


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR o_orderstatus = 'P' THEN ''
                        ELSE concat('slut', lower(o_orderstatus)) END AS virksomhedsstatus
FROM orders
"""
)
def q_last_status(t: Tables) -> DataFrame:
    documents = order_documents(t.orders)
    return documents.select("o_orderkey", X.last_status(F.col("ordre.historik")).alias("virksomhedsstatus"))


@query(
    """
SELECT conv_id, turn, lower(replace(text, chr(10), '|')) AS lines FROM conversations
"""
)
def q_array_lower(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.conversations.select("conv_id", "turn", F.array_join(X.lower_elements(lines), "|").alias("lines"))


@query(
    """
SELECT o_orderkey, CAST(concat('0x', substr(md5(o_orderpriority), 1, 15)) AS BIGINT) AS h1,
       CAST(concat('0x', substr(md5(o_orderstatus), 1, 15)) AS BIGINT) AS h2
FROM orders
"""
)
def q_array_hash(t: Tables) -> DataFrame:
    hashed = X.hash_elements(F.array("o_orderpriority", "o_orderstatus"))
    return t.orders.select("o_orderkey", hashed.alias("h")).select("o_orderkey", F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2"))


@query(
    """
SELECT concat(CAST(c_custkey AS VARCHAR), '|', c_name, '|', CAST(c_nationkey AS VARCHAR), '|',
              coalesce(nullif(c_mktsegment, 'BUILDING'), 'null')) AS featlist
FROM customer
"""
)
def q_columns_to_list(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"))
    return nested.columns_to_list(rows).select(F.array_join("featlist", "|", "null").alias("featlist"))

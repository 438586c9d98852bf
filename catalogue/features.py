"""One-hot columns, indexes, dictionaries, words, and the company tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import Tables, query
from kartotek.functions.text import words
from kartotek.functions.vector import vector_entries
from kartotek.operators import indexing, onehot
from kartotek.operators import words as bags
from kartotek.operators.nested import elements
from kartotek.plans import company

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "SELECT user_id AS \"Index\", "
    + ", ".join(f"count(*) FILTER (event_type = '{v}') AS \"event_type:{v}\"" for v in EVENT_TYPES)
    + " FROM events GROUP BY user_id"
)
def q_pivot_onehot(t: Tables) -> DataFrame:
    """Events of each kind per user; the kinds are those found."""
    rows = t.events.select(F.col("user_id").alias("Index"), "event_type")
    return onehot.pivot_onehot(rows, "event_type")


@query(
    "SELECT e.user_id AS \"Index\", e.event_id, c.* EXCLUDE (user_id) FROM events e JOIN (SELECT user_id, "
    + ", ".join(f"count(*) FILTER (event_type = '{v}') AS \"event_type:{v}\"" for v in EVENT_TYPES)
    + " FROM events GROUP BY user_id) c ON c.user_id = e.user_id"
)
def q_onehot_joined(t: Tables) -> DataFrame:
    """An index with many rows: each event next to the counts of its user, joined back."""
    rows = t.events.select(F.col("user_id").alias("Index"), "event_id", "event_type")
    return onehot.onehot_all(rows, unique_index=False)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "SELECT o_orderkey AS \"Index\", o_totalprice, "
    "CAST(o_orderstatus = 'F' AS BIGINT) AS \"status:F\", CAST(o_orderstatus = 'O' AS BIGINT) AS \"status:O\", "
    "CAST(o_orderstatus = 'P' AS BIGINT) AS \"status:null\", "
    + ", ".join(f"CAST(o_orderpriority = '{v}' AS BIGINT) AS \"priority:{v}\"" for v in PRIORITIES)
    + " FROM orders"
)
def q_onehot_all(t: Tables) -> DataFrame:
    """All text columns of the orders as 0/1 columns; the values are found in the data."""
    rows = t.orders.select(
        F.col("o_orderkey").alias("Index"),
        "o_totalprice",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return onehot.onehot_all(rows)


@query(
    """
WITH p AS (SELECT o_orderkey, unnest([concat('status:', coalesce(nullif(o_orderstatus, 'P'), 'null')),
                                      concat('priority:', o_orderpriority)]) AS term FROM orders),
d AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS at FROM (SELECT DISTINCT term FROM p))
SELECT o_orderkey, CAST(d.at AS INTEGER) AS term_index FROM p JOIN d ON d.term = p.term
"""
)
def q_onehot_sparse(t: Tables) -> DataFrame:
    """The positions set in one sparse vector over all values of both columns."""
    rows = t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderpriority").alias("priority")
    )
    vectors, _ = onehot.onehot_sparse(rows, "o_orderkey")
    entries = vectors.select("o_orderkey", F.explode(vector_entries(F.col("onehot"))).alias("entry"))
    return entries.select("o_orderkey", F.col("entry.index").alias("term_index"))


@query(
    """
WITH s AS (SELECT c_mktsegment AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS DOUBLE) AS r
           FROM customer GROUP BY 1),
n AS (SELECT CAST(c_nationkey AS VARCHAR) AS v,
             CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(c_nationkey AS VARCHAR)) - 1 AS DOUBLE) AS r
      FROM customer GROUP BY 1)
SELECT c_custkey, s.r AS segment_index, n.r AS nation_index
FROM customer JOIN s ON s.v = c_mktsegment JOIN n ON n.v = CAST(c_nationkey AS VARCHAR)
"""
)
def q_string_index(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    indexed = indexing.string_index(rows, {"c_mktsegment": "segment_index", "nation": "nation_index"})
    return indexed.select("c_custkey", "segment_index", "nation_index")


@query('SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS "Index", o_orderkey FROM orders')
def q_row_index(t: Tables) -> DataFrame:
    """Orders numbered by priority and key; the five priorities hold a fifth of the rows each."""
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return indexing.row_index(rows, ["o_orderpriority", "o_orderkey"]).select("Index", "o_orderkey")


_TURN_WORDS = """
t AS (SELECT conv_id * 1000 + turn AS turn_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term
      FROM conversations),
w AS (SELECT * FROM t WHERE term <> ''),
d AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_index FROM (SELECT DISTINCT term FROM w))
"""


@query(f"WITH {_TURN_WORDS} SELECT term, term_index FROM d")
def q_term_dictionary(t: Tables) -> DataFrame:
    turns = t.conversations.select(words(F.col("text")).alias("tokens"))
    return indexing.term_dictionary(turns, "tokens").select("term", "term_index")


@query(
    f"""
WITH {_TURN_WORDS}
SELECT w.turn_id, d.term_index, count(*) AS n FROM w JOIN d ON d.term = w.term GROUP BY 1, 2
"""
)
def q_bag_of_words(t: Tables) -> DataFrame:
    """Term counts of every conversation turn against the dictionary of all turns."""
    turns = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), words(F.col("text")).alias("tokens")
    )
    return bags.bag_of_words(turns, "turn_id", "tokens", indexing.term_dictionary(turns, "tokens"))


@query(
    f"""
WITH {_TURN_WORDS},
c AS (SELECT turn_id, term, count(*) AS n FROM w GROUP BY 1, 2)
SELECT turn_id, CAST(count(*) AS INTEGER) AS terms, CAST(sum(n) AS DOUBLE) AS tokens, CAST(max(n) AS DOUBLE) AS most
FROM c GROUP BY turn_id
"""
)
def q_bag_of_words_vectors(t: Tables) -> DataFrame:
    """The same bags as sparse vectors: terms set, total and greatest count per turn."""
    turns = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), words(F.col("text")).alias("tokens")
    )
    vectors = bags.bag_of_words_vectors(turns, "turn_id", "tokens", indexing.term_dictionary(turns, "tokens"))
    entries = elements(vectors, vector_entries(F.col("features")), "entry", ["turn_id"])
    return entries.groupBy("turn_id").agg(
        F.count("*").cast("int").alias("terms"), F.sum("entry.value").alias("tokens"), F.max("entry.value").alias("most")
    )


@query(
    """
SELECT word, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents)
WHERE word <> '' GROUP BY word
"""
)
def q_word_count(t: Tables) -> DataFrame:
    return bags.word_count(t.documents, "text")


def company_documents(customer: DataFrame) -> DataFrame:
    """Customers in the nested form of the register's companies."""
    nation, key, segment = F.col("c_nationkey"), F.col("c_custkey"), F.col("c_mktsegment")
    code = nation.cast("string")

    def industry(condition):
        return F.when(condition, F.struct(code.alias("branchekode"), segment.alias("branchetekst")))

    status = F.when(nation < 12, F.lit("Aktiv")).otherwise(F.lit("Opløst efter  konkurs"))
    history = F.array(
        F.struct(F.lit("NORMAL").alias("status")), F.struct(F.concat(F.lit("Under "), segment).alias("status"))
    )
    metadata = F.struct(
        F.when(nation != 3, nation.cast("long") % 5).alias("antalPenheder"),
        F.struct(
            F.lit(2015).cast("long").alias("aar"),
            F.when(nation % 4 != 0, F.concat(F.lit("ANTAL_"), code, F.lit("_99"))).alias("intervalKodeAntalAnsatte"),
        ).alias("nyesteAarsbeskaeftigelse"),
        F.when(segment == "BUILDING", F.struct(F.lit(2016).cast("long").alias("aar"))).alias("nyesteKvartalsbeskaeftigelse"),
        F.struct(
            F.col("c_name").alias("bynavn"),
            key.alias("husnummerFra"),
            (key + 1).alias("husnummerTil"),
            F.struct(nation.cast("long").alias("kommuneKode"), F.lit("K").alias("kommuneNavn")).alias("kommune"),
            F.when(nation > 5, F.lit("DK")).alias("landekode"),
        ).alias("nyesteBeliggenhedsadresse"),
        industry(nation > 8).alias("nyesteBibranche1"),
        industry(nation > 16).alias("nyesteBibranche2"),
        industry(nation > 20).alias("nyesteBibranche3"),
        industry(nation >= 0).alias("nyesteHovedbranche"),
        F.when(nation % 3 == 0, F.array().cast("array<string>"))
        .when(nation % 3 == 1, F.array(F.col("c_name")))
        .otherwise(F.array(F.col("c_name"), segment))
        .alias("nyesteKontaktoplysninger"),
        F.struct(F.lit(1).cast("long").alias("kreditoplysningkode"), nation.cast("long").alias("statuskode")).alias(
            "nyesteStatus"
        ),
        F.struct(
            F.lit("E&S").alias("ansvarligDataleverandoer"),
            F.nullif(segment, F.lit("FURNITURE")).alias("kortBeskrivelse"),
            segment.alias("langBeskrivelse"),
            (nation.cast("long") + 80).alias("virksomhedsformkode"),
        ).alias("nyesteVirksomhedsform"),
        status.alias("sammensatStatus"),
        F.when(nation != 7, F.concat((nation + 1980).cast("string"), F.lit("-01-31"))).alias("stiftelsesDato"),
        F.lit("2016-01-01").alias("virkningsDato"),
    )
    return customer.select(
        F.struct(
            key.alias("cvrNummer"),
            F.when(nation % 2 == 0, nation).alias("brancheAnsvarskode"),
            (nation % 2 == 1).alias("reklamebeskyttet"),
            F.when(nation % 6 == 0, F.filter(history, lambda _: F.lit(False))).otherwise(history).alias("virksomhedsstatus"),
            metadata.alias("virksomhedMetadata"),
        ).alias("virksomhed")
    )


@query(
    """
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS "Index", c_custkey AS cvrnummer,
       CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey % 5 AS BIGINT) END AS "nPenheder",
       CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS "antalAnsatte",
       CASE WHEN c_nationkey > 8 THEN CAST(c_nationkey AS VARCHAR) ELSE 'None' END AS branchekode1,
       CASE WHEN c_nationkey > 16 THEN CAST(c_nationkey AS VARCHAR) ELSE 'None' END AS branchekode2,
       CASE WHEN c_nationkey > 20 THEN CAST(c_nationkey AS VARCHAR) ELSE 'None' END AS branchekode3,
       CAST(c_nationkey AS VARCHAR) AS hovedbranchekode, CAST(c_nationkey AS VARCHAR) AS statuskode,
       c_mktsegment AS "virksomhedsBeskrivelse",
       CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'None' END AS "brancheAnsvarskode",
       CASE WHEN c_nationkey < 12 THEN 'aktiv' ELSE 'opløstefterkonkurs' END AS "sammensatStatus",
       CAST(c_nationkey + 80 AS BIGINT) AS virksomhedsformkode,
       CASE WHEN c_nationkey <> 7 THEN concat(CAST(c_nationkey + 1980 AS VARCHAR), '-01-31') END AS "stiftelsesDato",
       CASE WHEN c_nationkey <> 7 THEN c_nationkey + 1980 END AS "stiftelsesAar",
       CASE WHEN c_nationkey % 6 = 0 THEN '' ELSE concat('under', lower(c_mktsegment)) END AS virksomhedsstatus,
       CAST(c_nationkey % 2 = 1 AS INTEGER) AS reklamebeskyttet
FROM customer
"""
)
def q_feature_table(t: Tables) -> DataFrame:
    """The numbered, typed feature table of 17 columns."""
    return company.feature_table(company_documents(t.customer))


_CONTACTS = """
  SELECT * FROM customer WHERE c_nationkey % 3 <> 0
  UNION ALL SELECT * FROM customer WHERE c_nationkey % 3 = 2
"""


@query(
    f"""
WITH k AS ({_CONTACTS}),
y AS (SELECT c_custkey AS "cvrNummer", c_custkey AS husnummerfra, c_custkey + 1 AS husnummertil,
             CAST(c_nationkey AS BIGINT) AS kommunekode,
             CASE WHEN c_nationkey > 5 THEN 'DK' ELSE 'ukendt' END AS landkode,
             CASE WHEN c_nationkey > 8 THEN CAST(c_nationkey AS VARCHAR) END AS branchekode1,
             CASE WHEN c_mktsegment = 'FURNITURE' THEN 'ukendt' ELSE c_mktsegment END AS "kortBeskrivelse",
             CASE WHEN c_nationkey < 12 THEN 'Aktiv' ELSE 'Opløst efter  konkurs' END AS "sammensatStatus"
      FROM k WHERE c_mktsegment <> 'BUILDING'),
b AS (SELECT "kortBeskrivelse" AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, "kortBeskrivelse") - 1 AS DOUBLE) AS r
      FROM y GROUP BY 1),
l AS (SELECT landkode AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, landkode) - 1 AS DOUBLE) AS r
      FROM y GROUP BY 1)
SELECT y.*, b.r AS "indexKortBeskrivelse", CAST(0 AS DOUBLE) AS "indexKortDataleverandoer", l.r AS "indexLandkode"
FROM y JOIN b ON b.v = y."kortBeskrivelse" JOIN l ON l.v = y.landkode
"""
)
def q_company_metadata(t: Tables) -> DataFrame:
    """The flat metadata, one row per contact detail: yearly reporters only, text filled and indexed."""
    flat = company.company_metadata(company_documents(t.customer))
    indexed = company.indexed_companies(company.yearly_companies(flat))
    return indexed.select(
        "cvrNummer",
        "husnummerfra",
        "husnummertil",
        "kommunekode",
        "landkode",
        "branchekode1",
        "kortBeskrivelse",
        "sammensatStatus",
        "indexKortBeskrivelse",
        "indexKortDataleverandoer",
        "indexLandkode",
    )

"""Counts, averages, statistics, histograms, ranking and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import Tables, query
from catalogue.rows import LINE_INTERVALS, line_histories
from kartotek.operators import confusion, histograms, ranking, sampling, statistics
from kartotek.plans import durations


@query("SELECT count(*) AS n FROM lineitem")
def q_count_rows(t: Tables) -> DataFrame:
    return statistics.row_count(t.lineitem)


@query("SELECT nullif(event_type, 'error') AS kind, count(*) AS n FROM events GROUP BY 1")
def q_group_count(t: Tables) -> DataFrame:
    """Null is a group of its own."""
    return statistics.group_count(t.events.select(F.nullif("event_type", F.lit("error")).alias("kind")), ["kind"])


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS average FROM lineitem GROUP BY 1, 2")
def q_group_average(t: Tables) -> DataFrame:
    means = statistics.group_average(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")
    return means.withColumn("average", F.round("average", 6))


@query("SELECT CAST(min(year(o_orderdate)) AS INTEGER) AS minimum FROM orders")
def q_global_min(t: Tables) -> DataFrame:
    return statistics.global_min(t.orders.select(F.year("o_orderdate").alias("aar")), "aar")


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def q_global_sum(t: Tables) -> DataFrame:
    return statistics.global_sum(t.lineitem, "l_linenumber")


@query("SELECT DISTINCT event_type, user_id FROM events")
def q_distinct(t: Tables) -> DataFrame:
    return statistics.distinct_rows(t.events, ["event_type", "user_id"])


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def q_distinct_count(t: Tables) -> DataFrame:
    return statistics.distinct_count(t.orders, ["o_custkey", "o_orderstatus"])


_DESCRIBED = """
SELECT event_type, '{c}' AS "column", count({e}) AS n, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS stddev,
       CAST(min({e}) AS DOUBLE) AS minimum, CAST(max({e}) AS DOUBLE) AS maximum
FROM events GROUP BY event_type
"""


@query(
    _DESCRIBED.format(c="value", e="value")
    + " UNION ALL "
    + _DESCRIBED.format(c="user_id", e="user_id")
    + " UNION ALL "
    + _DESCRIBED.format(c="big", e="CASE WHEN value > 20 THEN value END")
)
def q_describe(t: Tables) -> DataFrame:
    """Descriptive statistics of three columns per event type, nulls left out."""
    events = t.events.select(
        "event_type", "value", "user_id", F.when(F.col("value") > 20, F.col("value")).alias("big")
    )
    table = statistics.describe_columns(events, ["value", "user_id", "big"], ["event_type"])
    return table.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query(
    """
SELECT 'l_quantity' AS "column", count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean,
       round(stddev_samp(l_quantity), 6) AS stddev, min(l_quantity) AS minimum, max(l_quantity) AS maximum FROM lineitem
UNION ALL
SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6),
       min(l_discount), max(l_discount) FROM lineitem
"""
)
def q_describe_all(t: Tables) -> DataFrame:
    table = statistics.describe_columns(t.lineitem, ["l_quantity", "l_discount"])
    return table.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query(
    """
WITH b AS (SELECT event_type, min(value) AS lo, (max(value) - min(value)) / 50 AS w, count(value) AS total
           FROM events GROUP BY event_type),
g AS (SELECT event_type, lo, w, total, CAST(bin AS INTEGER) AS bin FROM b, range(50) r(bin)),
c AS (SELECT e.event_type, CAST(least(floor((e.value - b.lo) / b.w), 49) AS INTEGER) AS bin, count(*) AS n
      FROM events e JOIN b ON b.event_type = e.event_type WHERE e.value IS NOT NULL GROUP BY 1, 2)
SELECT g.event_type, g.bin, round(g.lo + g.bin * g.w, 6) AS bin_lo, round(g.lo + (g.bin + 1) * g.w, 6) AS bin_hi,
       coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (g.total * g.w), 9) AS density
FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.bin = g.bin
"""
)
def q_histogram(t: Tables) -> DataFrame:
    """Fifty equal bins of the event value for every event type."""
    table = histograms.histogram(t.events, "value", ["event_type"])
    return table.withColumns(
        {"bin_lo": F.round("bin_lo", 6), "bin_hi": F.round("bin_hi", 6), "density": F.round("density", 9)}
    )


@query(
    """
WITH p AS (SELECT o_totalprice AS x FROM orders),
b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM p),
c AS (SELECT CAST(least(floor((x - lo) / w), 49) AS INTEGER) AS bin, count(*) AS n FROM p, b GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n FROM range(50) r(bin) LEFT JOIN c ON c.bin = r.bin
"""
)
def q_histogram_all(t: Tables) -> DataFrame:
    return histograms.histogram(t.orders, "o_totalprice").select("bin", "n")


@query(
    """
WITH c AS (SELECT CAST(least(floor(log10(o_totalprice) * 99 / 8), 98) AS INTEGER) AS bin, count(*) AS n
           FROM orders WHERE o_totalprice BETWEEN 1 AND 1e8 GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round(pow(10.0, r.bin * (8 / 99.0)), 4) AS bin_lo, coalesce(c.n, 0) AS n
FROM range(99) r(bin) LEFT JOIN c ON c.bin = r.bin
"""
)
def q_log_histogram(t: Tables) -> DataFrame:
    table = histograms.log_histogram(t.orders, "o_totalprice")
    return table.select("bin", F.round("bin_lo", 4).alias("bin_lo"), "n")


@query(
    """
SELECT event_type, CAST(least(floor(log10(value) * 99 / 8), 98) AS INTEGER) AS bin, count(*) AS n
FROM events WHERE value BETWEEN 1 AND 1e8 GROUP BY 1, 2
"""
)
def q_log_histogram_by(t: Tables) -> DataFrame:
    """Log-spaced counts of the value for every event type; values below 1 are outside."""
    return histograms.log_histogram(t.events, "value", ["event_type"]).select("event_type", "bin", "n")


@query(
    """
WITH b AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo,
                  (max(value) - min(value)) / 50 AS w FROM events GROUP BY event_type)
SELECT event_type, CAST(e.no AS INTEGER) AS edge_no, round(lo + e.no * w, 6) AS edge,
       round(exp(-power((lo + e.no * w - m) / s, 2) / 2) / (s * sqrt(2 * pi())), 9) AS density
FROM b, range(51) e(no)
"""
)
def q_normal_fit(t: Tables) -> DataFrame:
    curve = histograms.normal_fit(histograms.group_bounds(t.events, "value", ["event_type"]), ["event_type"])
    return curve.withColumns({"edge": F.round("edge", 6), "density": F.round("density", 9)})


@query(
    LINE_INTERVALS
    + """, l AS (SELECT status, ln(difference) AS x FROM d),
b AS (SELECT status, min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM l GROUP BY status HAVING avg(x) <> 0),
c AS (SELECT l.status, CASE WHEN w = 0 THEN 0 ELSE CAST(least(floor((x - lo) / nullif(w, 0)), 49) AS INTEGER) END AS bin,
             count(*) AS n FROM l JOIN b ON b.status = l.status GROUP BY 1, 2)
SELECT b.status, CAST(r.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n
FROM b CROSS JOIN range(50) r(bin) LEFT JOIN c ON c.status = b.status AND c.bin = r.bin
"""
)
def q_duration_histogram(t: Tables) -> DataFrame:
    """Histogram of the log length of all status intervals, per status."""
    bars, _ = durations.duration_shapes(durations.durations(line_histories(t.lineitem)))
    return bars.select("status", "bin", "n")


@query(
    """
WITH s AS (SELECT p_size AS k, avg(p_retailprice) AS score FROM part GROUP BY p_size),
d AS (SELECT k, score - lag(score) OVER (ORDER BY k) AS step FROM s)
SELECT k, round(step, 6) AS step FROM d WHERE step IS NOT NULL ORDER BY step DESC, k LIMIT 1
"""
)
def q_max_slope(t: Tables) -> DataFrame:
    """The part size with the largest rise of the mean price over the size before."""
    scores = t.part.groupBy(F.col("p_size").alias("k")).agg(F.avg("p_retailprice").alias("score"))
    return ranking.max_step(scores).withColumn("step", F.round("step", 6))


@query(
    """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn,
                  count(*) OVER (PARTITION BY quality) AS n
           FROM labels)
SELECT doc_id, quality, rn <= floor(n * 0.2 + 0.5) AS is_test FROM r
"""
)
def q_stratified_split(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.labels.select("doc_id", "quality"), "quality", "doc_id")


@query(
    """
WITH r AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n
           FROM orders)
SELECT o_orderkey, o_orderstatus, rn <= floor(n * 0.2 + 0.5) AS is_test FROM r
"""
)
def q_stratified_split_orders(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query(
    """
SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS "TP", count(*) FILTER (quality = 0 AND toxic = 0) AS "TN",
       count(*) FILTER (quality = 1 AND toxic = 0) AS "FN", count(*) FILTER (quality = 0 AND toxic = 1) AS "FP",
       count(*) FILTER (quality IS NULL OR toxic IS NULL) AS "Excluded",
       round(count(*) FILTER (quality = toxic) / count(quality), 6) AS accuracy
FROM documents LEFT JOIN labels USING (doc_id)
"""
)
def q_confusion(t: Tables) -> DataFrame:
    """Toxic as a prediction of quality; documents without labels are excluded."""
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    scored = joined.select("quality", F.coalesce(F.col("toxic").cast("double"), F.lit(float("nan"))).alias("p"))
    return confusion.confusion_table(scored, "quality", "p").withColumn("accuracy", F.round("accuracy", 6))


@query(
    """
SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality FROM documents
UNION ALL SELECT doc_id, NULL, quality FROM labels
"""
)
def q_union_rows(t: Tables) -> DataFrame:
    """Bag union by name; a column only one side has is null on the other."""
    return sampling.union_rows(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"))


@query(
    """
SELECT 'kept' AS part, count(*) AS n FROM labels WHERE toxic = 0
UNION ALL SELECT 'flagged', count(*) FROM labels WHERE toxic > 0
"""
)
def q_split_by_flag(t: Tables) -> DataFrame:
    kept, flagged = sampling.split_by_flag(t.labels, "toxic")
    parts = [statistics.row_count(f).select(F.lit(n).alias("part"), "n") for n, f in (("kept", kept), ("flagged", flagged))]
    return sampling.union_rows(*parts)


@query(
    """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
"""
)
def q_membership(t: Tables) -> DataFrame:
    """Orders of customers with a high balance."""
    rich = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return sampling.keep_members(t.orders.select("o_orderkey", "o_custkey"), rich, "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def q_top_rows(t: Tables) -> DataFrame:
    return ranking.top_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 15)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def q_sort_desc(t: Tables) -> DataFrame:
    return ranking.sort_desc(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query()
def q_sample_rows(t: Tables) -> DataFrame:
    return sampling.sample_rows(t.events, 0.1)


@query()
def q_sample_by(t: Tables) -> DataFrame:
    return sampling.sample_by(t.events, "event_type", {"purchase": 0.5, "view": 0.1})


@query("SELECT event_id, value FROM events WHERE CAST(concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 15)) AS BIGINT) < 0.1 * 1152921504606846976")
def q_sample_digest(t: Tables) -> DataFrame:
    return sampling.sample_by_digest(t.events, "event_id", 0.1).select("event_id", "value")


@query(
    """
SELECT event_id, event_type FROM events
WHERE CAST(concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 15)) AS BIGINT)
      < CASE event_type WHEN 'purchase' THEN 0.5 WHEN 'view' THEN 0.1 ELSE 0 END * 1152921504606846976
"""
)
def q_sample_digest_by(t: Tables) -> DataFrame:
    chosen = sampling.sample_by_digest(t.events, "event_id", by="event_type", fractions={"purchase": 0.5, "view": 0.1})
    return chosen.select("event_id", "event_type")

"""Vector statistics, scaling, similarity, distances and clusters with given centres."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import Tables, query
from kartotek.operators import clusters, onehot, ranking, row_similarity, similarity, statistics, vectors

LONG = """
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim
           FROM embeddings),
m AS (SELECT label, dim, avg(x) AS c, count(*) AS n FROM e GROUP BY label, dim)
"""
TO_OWN_CENTRE = (
    LONG
    + """, d AS (SELECT e.vec_id, e.label, sqrt(sum((e.x - m.c) * (e.x - m.c))) AS distance
           FROM e JOIN m ON m.label = e.label AND m.dim = e.dim GROUP BY e.vec_id, e.label)
"""
)
NEAREST = (
    LONG
    + """, a AS (SELECT e.vec_id, m.label AS cluster, sum((e.x - m.c) * (e.x - m.c)) AS squared
           FROM e JOIN m ON m.dim = e.dim GROUP BY e.vec_id, m.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY squared, cluster) AS rn FROM a)
"""
)


def label_centres(embeddings: DataFrame) -> DataFrame:
    """The mean vector of every label as a cluster centre."""
    means = statistics.group_mean_vectors(embeddings, "label", "embedding", "coordinates")
    return means.select(F.col("label").alias("cluster"), "coordinates")


def spread(frame: DataFrame, values: str, *keep: str) -> DataFrame:
    """One row per array position, rounded for comparison."""
    rows = frame.select(*keep, F.posexplode(values).alias("dim", "x"))
    return rows.select(*keep, F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(LONG + "SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm FROM e GROUP BY vec_id")
def q_vector_norm(t: Tables) -> DataFrame:
    rows = statistics.with_norm(t.embeddings.select("vec_id", "embedding"), "embedding")
    return rows.select("vec_id", F.round("norm", 6).alias("norm"))


@query(
    LONG
    + """SELECT dim, count(x) AS n, round(sum(x), 6) AS total, round(avg(x), 6) AS mean,
       round(var_samp(x), 6) AS variance, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum
FROM e GROUP BY dim"""
)
def q_vector_stats(t: Tables) -> DataFrame:
    names = ("total", "mean", "variance", "minimum", "maximum")
    stats = statistics.vector_stats(t.embeddings, "embedding")
    rows = stats.select("n", F.posexplode(F.arrays_zip(*names)).alias("dim", "s"))
    return rows.select(F.col("dim").cast("long").alias("dim"), "n", *[F.round(f"s.{c}", 6).alias(c) for c in names])


@query(LONG + "SELECT label, dim, n, round(c, 6) AS x FROM m")
def q_group_mean_vector(t: Tables) -> DataFrame:
    return spread(statistics.group_mean_vectors(t.embeddings, "label", "embedding"), "mean", "label", "n")


@query(LONG + "SELECT dim, round(sum(x), 6) AS x FROM e GROUP BY dim")
def q_vector_total(t: Tables) -> DataFrame:
    return spread(statistics.vector_total(t.embeddings, "embedding"), "total")


@query(
    LONG
    + """SELECT e.vec_id, round(sum(e.x * m.c), 6) AS product
FROM e JOIN m ON m.label = e.label AND m.dim = e.dim GROUP BY e.vec_id"""
)
def q_group_means_joined(t: Tables) -> DataFrame:
    """Each vector next to the mean of its group, as their dot product."""
    rows = statistics.with_group_means(t.embeddings, "label", "embedding")
    products = F.zip_with(F.col("embedding").cast("array<double>"), "group_mean", lambda a, b: a * b)
    return rows.select("vec_id", F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 6).alias("product"))


@query(
    LONG
    + """, s AS (SELECT dim, stddev_samp(x) AS sd FROM e GROUP BY dim)
SELECT vec_id, e.dim, round(x / sd, 6) AS x FROM e JOIN s ON s.dim = e.dim"""
)
def q_standard_scale(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    scaled, _ = vectors.scale(rows)
    return spread(scaled.withColumn("a", vector_to_array("scaledfeatures")), "a", "vec_id")


@query(
    LONG
    + """SELECT e.vec_id, e.dim, round(abs(e.x - m.c), 6) AS x
FROM e JOIN m ON m.label = e.label AND m.dim = e.dim"""
)
def q_abs_diff(t: Tables) -> DataFrame:
    """Absolute difference of each vector and its group's mean, position by position."""
    rows = statistics.with_group_means(t.embeddings, "label", "embedding")
    return spread(vectors.with_abs_difference(rows, "embedding", "group_mean"), "difference", "vec_id")


@query(
    """
SELECT l_orderkey, l_linenumber, round(sum(l_quantity + 2 * l_discount + 3 * l_tax), 6) AS weighted, count(*) AS n
FROM lineitem GROUP BY 1, 2
"""
)
def q_assemble(t: Tables) -> DataFrame:
    """Three columns as one vector, in order, through the dense-vector stage."""
    rows = vectors.assemble(t.lineitem, ["l_quantity", "l_discount", "l_tax"])
    stage = vectors.DenseVectors(inputCol="features", outputCol="dense")
    a = vector_to_array("dense")
    weighted = stage.transform(rows).select("l_orderkey", "l_linenumber", (a[0] + 2 * a[1] + 3 * a[2]).alias("w"))
    return weighted.groupBy("l_orderkey", "l_linenumber").agg(
        F.round(F.sum("w"), 6).alias("weighted"), F.count("*").alias("n")
    )


@query(LONG + "SELECT vec_id, dim, round(x, 6) AS x FROM e")
def q_to_dense(t: Tables) -> DataFrame:
    """Vectors through the dense form and back to arrays."""
    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return spread(vectors.to_dense(rows, "v").withColumn("a", vector_to_array("v")), "a", "vec_id")


_F = """, total AS (SELECT dim, avg(x) AS c FROM e GROUP BY dim),
b AS (SELECT sum(m.n * (m.c - total.c) * (m.c - total.c)) AS s FROM m JOIN total ON total.dim = m.dim),
w AS (SELECT sum((e.x - m.c) * (e.x - m.c)) AS s FROM e JOIN m ON m.label = e.label AND m.dim = e.dim),
k AS (SELECT count(DISTINCT label) AS groups, (SELECT count(*) FROM (SELECT DISTINCT vec_id FROM e)) AS n FROM e)
SELECT groups AS n_groups, n AS n_rows, round(b.s / (groups - 1), 6) AS "between", round(w.s / (n - groups), 6) AS within,
       round((b.s / (groups - 1)) / (w.s / (n - groups)), 6) AS f
FROM b, w, k
"""


def _rounded_f(table: DataFrame) -> DataFrame:
    return table.withColumns({c: F.round(c, 6) for c in ("between", "within", "f")})


@query(LONG + _F)
def q_f_statistic(t: Tables) -> DataFrame:
    return _rounded_f(statistics.f_statistic(t.embeddings, "label", "embedding"))


@query(
    """
WITH g AS (SELECT l_returnflag AS label, avg(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1),
a AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n FROM lineitem),
b AS (SELECT sum(g.n * ((g.q - a.q) * (g.q - a.q) + (g.d - a.d) * (g.d - a.d))) AS s, count(*) AS k FROM g, a),
w AS (SELECT sum((l_quantity - g.q) * (l_quantity - g.q) + (l_discount - g.d) * (l_discount - g.d)) AS s
      FROM lineitem JOIN g ON g.label = l_returnflag)
SELECT b.k AS n_groups, a.n AS n_rows, round(b.s / (b.k - 1), 6) AS "between", round(w.s / (a.n - b.k), 6) AS within,
       round((b.s / (b.k - 1)) / (w.s / (a.n - b.k)), 6) AS f
FROM a, b, w
"""
)
def q_f_statistic_lines(t: Tables) -> DataFrame:
    """F-statistic of quantity and discount by return flag over all line items."""
    rows = t.lineitem.select("l_returnflag", F.array("l_quantity", "l_discount").alias("features"))
    return _rounded_f(statistics.f_statistic(rows, "l_returnflag", "features"))


@query(
    LONG
    + """, n AS (SELECT dim, sqrt(sum(x * x)) AS norm FROM e GROUP BY dim)
SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(sum(a.x * b.x) / (max(na.norm) * max(nb.norm)), 6) AS cosine
FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.dim < b.dim
JOIN n na ON na.dim = a.dim JOIN n nb ON nb.dim = b.dim
GROUP BY a.dim, b.dim"""
)
def q_cosine_pairs(t: Tables) -> DataFrame:
    """Cosine of every pair of vector positions over the whole table."""
    return similarity.column_cosines(t.embeddings, "embedding").withColumn("cosine", F.round("cosine", 6))


@query(NEAREST + "SELECT vec_id, CAST(cluster AS INTEGER) AS prediction, round(sqrt(squared), 6) AS distance FROM r WHERE rn = 1")
def q_kmeans_assign(t: Tables) -> DataFrame:
    """The nearest of the label means for every vector."""
    near = clusters.nearest_centres(t.embeddings, label_centres(t.embeddings), "embedding")
    return near.select("vec_id", "prediction", F.round("distance", 6).alias("distance"))


@query(NEAREST + "SELECT round(sum(squared), 6) AS wssse FROM r WHERE rn = 1")
def q_wssse(t: Tables) -> DataFrame:
    near = clusters.nearest_centres(t.embeddings, label_centres(t.embeddings), "embedding")
    return clusters.wssse(near).withColumn("wssse", F.round("wssse", 6))


def own_distances(embeddings: DataFrame) -> DataFrame:
    return clusters.center_distances(embeddings, label_centres(embeddings), "embedding", prediction="label").drop("embedding")


@query(TO_OWN_CENTRE + "SELECT vec_id, round(distance, 6) AS distance FROM d WHERE label = 2")
def q_cluster_filter(t: Tables) -> DataFrame:
    """The distances of one cluster; the filter on its number reaches the scan."""
    chosen = own_distances(t.embeddings).filter(F.col("label") == 2)
    return chosen.select("vec_id", F.round("distance", 6).alias("distance"))


@query(TO_OWN_CENTRE + "SELECT vec_id, label, round(distance, 6) AS distance FROM d")
def q_center_distance(t: Tables) -> DataFrame:
    return own_distances(t.embeddings).withColumn("distance", F.round("distance", 6))


@query(
    TO_OWN_CENTRE
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) AS rn FROM d)
SELECT vec_id, label, CAST(rn AS INTEGER) AS rank, round(ln(distance), 6) AS log_distance FROM r WHERE rn <= 20"""
)
def q_topk_distance(t: Tables) -> DataFrame:
    """The 20 vectors farthest from the centre of their cluster, by cluster."""
    top = ranking.top_per_group(own_distances(t.embeddings), "label", "distance", "vec_id", 20)
    return top.select("vec_id", "label", "rank", F.round(F.log("distance"), 6).alias("log_distance"))


@query(
    TO_OWN_CENTRE
    + """SELECT d.vec_id, d.label, round(distance, 6) AS distance, len(embedding) AS size
FROM d JOIN embeddings USING (vec_id) ORDER BY d.distance DESC, vec_id"""
)
def q_ranked_distance(t: Tables) -> DataFrame:
    """All rows joined back to their data, farthest first."""
    joined = t.embeddings.select("vec_id", "embedding").join(own_distances(t.embeddings), "vec_id")
    ranked = ranking.sort_desc(joined, "distance", "vec_id")
    return ranked.select(
        "vec_id", "label", F.round("distance", 6).alias("distance"), F.size("embedding").cast("long").alias("size")
    )


@query(
    TO_OWN_CENTRE
    + """SELECT label, CAST(least(floor(log10(1000 * distance) * 99 / 8), 98) AS INTEGER) AS bin, count(*) AS n
FROM d GROUP BY 1, 2"""
)
def q_distance_histogram(t: Tables) -> DataFrame:
    """Log-spaced counts of the distance (in thousandths) for every cluster."""
    from kartotek.operators.histograms import log_histogram

    rows = own_distances(t.embeddings).withColumn("distance", F.col("distance") * 1000)
    return log_histogram(rows, "distance", ["label"]).select("label", "bin", "n")


@query(
    """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT vec_id, e.label, CASE WHEN c.n <= 0.1 * (SELECT count(*) FROM embeddings) THEN 2 ELSE 0 END AS "isOutlier"
FROM embeddings e JOIN c ON c.label = e.label
"""
)
def q_label_outliers(t: Tables) -> DataFrame:
    """Groups with at most a tenth of all rows, marked with the number of the round."""
    return clusters.label_outliers(t.embeddings.select("vec_id", "label"), "label", threshold=0.1, iteration=2)




ROW_COSINES = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_sum(list_transform(embedding::DOUBLE[], lambda e: e * e)) AS n
           FROM embeddings),
p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_dot_product(a.x, b.x) / sqrt(a.n * b.n) AS cosine
      FROM v a JOIN v b ON a.vec_id < b.vec_id)
"""


@query(ROW_COSINES + "SELECT id_a, id_b, round(cosine, 6) AS cosine FROM p WHERE cosine >= 0.35")
def q_row_cosines(t: Tables) -> DataFrame:
    """Pairs of rows with a cosine of at least 0.35; random directions seldom come nearer."""
    found = row_similarity.similar_rows(t.embeddings, "vec_id", "embedding", 0.35)
    return row_similarity.row_pairs(found).withColumn("cosine", F.round("cosine", 6))


@query(
    ROW_COSINES
    + """, b AS (SELECT id_a AS id, id_b AS other, cosine FROM p WHERE cosine >= 0.25
            UNION ALL SELECT id_b, id_a, cosine FROM p WHERE cosine >= 0.25),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS rn FROM b)
SELECT id, other, round(cosine, 6) AS cosine, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 3"""
)
def q_most_similar_rows(t: Tables) -> DataFrame:
    """The three most similar rows of each, of those with a cosine of at least 0.25."""
    found = row_similarity.similar_rows(t.embeddings, "vec_id", "embedding", 0.25, most=3)
    return row_similarity.most_similar_rows(found, 3).withColumn("cosine", F.round("cosine", 6))


PART_CLASSES = """
WITH c AS (SELECT min(p_partkey) AS class_id, string_split(p_name, ' ')[1] AS color, string_split(p_name, ' ')[2] AS kind,
                  p_brand, p_type, p_size FROM part GROUP BY ALL),
p AS (SELECT a.class_id AS id_a, b.class_id AS id_b,
             CAST((a.color = b.color)::INT + (a.kind = b.kind)::INT + (a.p_brand = b.p_brand)::INT
                  + (a.p_type = b.p_type)::INT + (a.p_size = b.p_size)::INT AS DOUBLE) / 5 AS cosine
      FROM c a JOIN c b ON a.class_id < b.class_id)
"""


def part_rows(t: Tables) -> DataFrame:
    """Five texts of each part as one sparse 0/1 vector."""
    words = F.split("p_name", " ")
    rows = t.part.select(
        "p_partkey", F.get(words, 0).alias("color"), F.get(words, 1).alias("kind"), "p_brand", "p_type",
        F.col("p_size").cast("string").alias("size"),
    )
    return onehot.onehot_sparse(rows, "p_partkey")[0]


@query(PART_CLASSES + "SELECT id_a, id_b, round(cosine, 6) AS cosine FROM p WHERE cosine >= 0.8")
def q_onehot_row_cosines(t: Tables) -> DataFrame:
    """Pairs of kinds of parts that agree in four of five texts: a cosine of 0.8 between one-hot rows."""
    found = row_similarity.similar_rows(part_rows(t), "p_partkey", "onehot", 0.8)
    return found.pairs.withColumn("cosine", F.round("cosine", 6))


@query(
    PART_CLASSES
    + """, l AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM p WHERE cosine >= 0.8
               UNION ALL SELECT id_b FROM p WHERE cosine >= 0.8) GROUP BY id)
SELECT p_partkey, class_id, coalesce(l.n, 0) AS n_links
FROM part t JOIN c ON c.color = string_split(t.p_name, ' ')[1] AND c.kind = string_split(t.p_name, ' ')[2]
     AND c.p_brand = t.p_brand AND c.p_type = t.p_type AND c.p_size = t.p_size
LEFT JOIN l ON l.id = class_id"""
)
def q_onehot_row_links(t: Tables) -> DataFrame:
    """Each part with its class of equal rows and to how many classes that is similar."""
    found = row_similarity.similar_rows(part_rows(t), "p_partkey", "onehot", 0.8)
    return row_similarity.link_counts(found, "p_partkey")

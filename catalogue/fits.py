"""Fitted models. Their results depend on iteration, so they have no SQL counterpart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.features import company_documents
from catalogue.registry import Tables, query
from kartotek.operators import clusters, kmeans_grid, logistic_path, regression, vectors, wide_glm
from kartotek.operators.confusion import confusion_table
from kartotek.operators.onehot import onehot_sparse
from kartotek.operators.statistics import group_mean_vectors
from kartotek.operators.sampling import stratified_split
from kartotek.plans import clustering, company, outlier_rounds, outliers
from kartotek.sizing import lookup_join, scratch_path


def feature_vectors(t: Tables) -> DataFrame:
    x = array_to_vector(F.col("embedding").cast("array<double>"))
    return t.embeddings.select("vec_id", (F.col("label") < 5).cast("int").alias("label"), x.alias("features"))


TEXT_TERMS = ["thousands", "de", "es", "fr", "toxic"]


def labelled_texts(t: Tables) -> DataFrame:
    """Quality of the labelled documents with length, language and toxicity as features."""
    joined = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id")
    rows = joined.select(
        "doc_id",
        F.col("quality").cast("long").alias("label"),
        (F.col("n_chars") / 1000).alias("thousands"),
        *[(F.col("lang") == c).cast("int").alias(c) for c in ("de", "es", "fr")],
        "toxic",
    )
    return vectors.assemble(rows, TEXT_TERMS).select("doc_id", "label", "features")


@query()
def q_kmeans_fit(t: Tables) -> DataFrame:
    """Eight clusters on the scaled vectors; each row with its cluster and distance."""
    scaled, _ = vectors.scale(feature_vectors(t))
    model = clusters.fit_kmeans(scaled)
    assigned = clusters.assign_clusters(model, scaled)
    measured = clusters.center_distances(assigned, clusters.centres_frame(t.spark, model))
    return measured.select("vec_id", "prediction", "distance")


@query()
def q_kmeans_centres(t: Tables) -> DataFrame:
    """The centres of a fitted model, one row per coordinate."""
    model = clusters.fit_kmeans(feature_vectors(t), features="features")
    return clusters.centres_frame(t.spark, model).select("cluster", F.posexplode("coordinates").alias("dim", "x"))


@query()
def q_kmeans_grid(t: Tables) -> DataFrame:
    """Cost on the training rows for each number of clusters."""
    return clusters.kmeans_scores(feature_vectors(t), features="features")


@query()
def q_kmeans_cross_scores(t: Tables) -> DataFrame:
    """Mean held-out score of 2, 3 and 4 clusters."""
    return clusters.kmeans_cross_scores(feature_vectors(t), "vec_id")


@query()
def q_cluster_companies(t: Tables) -> DataFrame:
    """Register documents to feature table to clusters, ranked by distance."""
    table = company.feature_table(company_documents(t.customer))
    run = clustering.cluster_table(table)
    ranked = clustering.ranked_companies(table, clustering.distances(run.scaled, run.model))
    return ranked.select("Index", "cvrnummer", "sammensatStatus", "prediction", "distance")


@query()
def q_one_pass(t: Tables) -> DataFrame:
    """One round of outlier removal with the logistic check."""
    rows = feature_vectors(t).withColumn("isOutlier", F.lit(0))
    done = outliers.one_pass(rows, (2, 3), id_col="vec_id", threshold=0.2)
    return done.select("vec_id", "label", "isOutlier", "predictionKmeans", "predictionLogReg")


@query()
def q_glm_coefficients(t: Tables) -> DataFrame:
    return regression.coefficient_table(t.spark, regression.fit_binomial(labelled_texts(t)), TEXT_TERMS)


@query(
    """
WITH r AS (SELECT quality AS y, n_chars / 1000 AS thousands, lang, toxic FROM documents JOIN labels USING (doc_id))
SELECT 'thousands' AS term, round(sum(y * thousands), 3) AS total FROM r
UNION ALL SELECT 'de', CAST(sum(y) FILTER (lang = 'de') AS DOUBLE) FROM r
UNION ALL SELECT 'es', CAST(sum(y) FILTER (lang = 'es') AS DOUBLE) FROM r
UNION ALL SELECT 'fr', CAST(sum(y) FILTER (lang = 'fr') AS DOUBLE) FROM r
UNION ALL SELECT 'toxic', CAST(sum(y * toxic) AS DOUBLE) FROM r
UNION ALL SELECT 'Intercept', CAST(sum(y) AS DOUBLE) FROM r
"""
)
def q_glm_moments(t: Tables) -> DataFrame:
    """Sum of predicted probability times feature; at the optimum it equals that of the label."""
    rows = labelled_texts(t)
    scored = regression.fit_binomial(rows).transform(rows)
    weighted = F.transform(F.concat(vector_to_array("features"), F.array(F.lit(1.0))), lambda x: x * F.col("predictions"))
    terms = F.array(*[F.lit(n) for n in [*TEXT_TERMS, "Intercept"]])
    pairs = scored.select(F.inline(F.arrays_zip(terms.alias("term"), weighted.alias("x"))))
    return pairs.groupBy("term").agg(F.round(F.sum("x"), 3).alias("total"))


@query(
    """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS misplaced FROM embeddings
"""
)
def q_kmeans_nearest(t: Tables) -> DataFrame:
    """Rows that a fitted model puts anywhere but at the nearest of its centres: none."""
    rows = feature_vectors(t)
    model = clusters.fit_kmeans(rows, features="features")
    assigned = clusters.assign_clusters(model, rows)
    near = clusters.nearest_centres(assigned, clusters.centres_frame(t.spark, model), "features", "nearest")
    return near.agg(F.count("*").alias("n"), F.count_if(F.col("nearest") != F.col("prediction")).alias("misplaced"))


@query()
def q_glm_summary(t: Tables) -> DataFrame:
    return regression.binomial_summary(t.spark, regression.fit_binomial(labelled_texts(t)))


@query()
def q_glm_residuals(t: Tables) -> DataFrame:
    rows = labelled_texts(t)
    return regression.deviance_residuals(regression.fit_binomial(rows), rows, ["doc_id"])


@query("SELECT count(*) AS n, true AS as_told, true AS null_as_told FROM documents JOIN labels USING (doc_id)")
def q_glm_deviance(t: Tables) -> DataFrame:
    """Squared residuals add up to the deviance, and the null deviance is that of the mean label."""
    rows = labelled_texts(t)
    model = regression.fit_binomial(rows)
    summary = regression.binomial_summary(t.spark, model)
    p = F.avg("label")
    null = -2 * F.count("*") * (p * F.log(p) + (1 - p) * F.log(1 - p))
    told = summary.select("deviance", "null_deviance").first()
    squares = F.sum(F.col("devianceResiduals") * F.col("devianceResiduals"))
    residuals = regression.deviance_residuals(model, rows, ["label"])
    return residuals.agg(
        F.count("*").alias("n"), (F.abs(squares / told["deviance"] - 1) < 1e-9).alias("as_told"),
        (F.abs(null / told["null_deviance"] - 1) < 1e-9).alias("null_as_told"),
    )


@query("SELECT unnest([4, 8, 10, 12, 16]) AS k, true AS same_cost")
def q_kmeans_grid_costs(t: Tables) -> DataFrame:
    """The cost that each fit tells, once its centres stand still, equals that of the rows measured against them."""
    rows = feature_vectors(t)
    checked = []
    for k in clusters.TRIED_CLUSTERS:
        model = clusters.fit_kmeans(rows, k, "features", max_iterations=200)
        near = clusters.nearest_centres(rows, clusters.centres_frame(t.spark, model), "features")
        checked.append((k, abs(clusters.wssse(near).first()["wssse"] / model.summary.trainingCost - 1) < 1e-4))
    return t.spark.createDataFrame(checked, "k int, same_cost boolean")


@query("SELECT CAST(0 AS BIGINT) AS moved FROM embeddings LIMIT 1")
def q_kmeans_converged(t: Tables) -> DataFrame:
    """Centres of a fit run to its end that are not the mean of their rows: none."""
    rows = feature_vectors(t)
    model = clusters.fit_kmeans(rows, features="features", max_iterations=200)
    assigned = clusters.assign_clusters(model, rows)
    means = group_mean_vectors(assigned, "prediction", "features")
    centres = clusters.centres_frame(t.spark, model)
    both = means.join(centres, F.col("prediction") == F.col("cluster"))
    gap = F.array_max(F.zip_with("mean", "coordinates", lambda a, b: F.abs(a - b)))
    return both.agg(F.count_if(gap > 1e-3).alias("moved"))


@query(
    """
SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS flagged, count(DISTINCT vec_id) AS ids FROM embeddings
"""
)
def q_one_pass_rows(t: Tables) -> DataFrame:
    """A round keeps every row once, and every row has a flag."""
    done = q_one_pass(t.spark, t.folder)
    return done.agg(
        F.count("*").alias("n"), F.count("isOutlier").alias("flagged"), F.count_distinct("vec_id").alias("ids")
    )


@query(
    """
SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, CAST(0 AS BIGINT) AS astray FROM embeddings
"""
)
def q_outlier_rounds(t: Tables) -> DataFrame:
    """Rounds of removal to the end: every row once, and rounds whose figures or cluster sizes are not what they must be: none.

    A round's clusters are counted again from the rows: those marked have at most the share of its open rows, the others more,
    and only the last round marks none.
    """
    share = 0.1
    store = scratch_path(t.spark, "rounds")
    done = outlier_rounds.outlier_rounds(
        feature_vectors(t), store, (8,), id_col="vec_id", threshold=share, label_folds=2, inverse_strengths=(0.5,)
    )
    told = outlier_rounds.round_figures(t.spark, store)
    parts = t.spark.read.parquet(f"{store}/rows").withColumnRenamed("part", "round")
    sizes = parts.groupBy("round", "predictionKmeans").agg(F.count("*").alias("n"), F.count_if(F.col("isOutlier") > 0).alias("out"))
    small = F.col("n") <= F.col("open_rows") * share
    wrong = sizes.join(told, "round").agg(F.count_if(F.col("out") != F.when(small, F.col("n")).otherwise(0))).scalar()
    after = told.select((F.col("round") + 1).alias("round"), (F.col("open_rows") - F.col("marked")).alias("left"), F.col("marked").alias("before"))
    broken = told.join(after, "round").agg(F.count_if((F.col("open_rows") != F.col("left")) | (F.col("before") == 0))).scalar()
    unended = told.agg(F.when(F.max_by("marked", "round") == 0, 0).otherwise(1)).scalar()
    counted = done.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"))
    return counted.select("n", "ids", (wrong + broken + unended).cast("long").alias("astray"))


@query()
def q_glm_companies(t: Tables) -> DataFrame:
    """Company status regressed on the typed company columns."""
    typed = company.typed_companies(company_documents(t.customer))
    rows = typed.select(
        F.col("cvrnummer").alias("Index"),
        "sammensatStatus",
        "nPenheder",
        F.col("antalAnsatte"),
        (F.col("cvrnummer") % 25 + 1980).cast("int").alias("stiftelsesAar"),
        "reklamebeskyttet",
    )
    training, names = clustering.status_training_rows(rows)
    return regression.coefficient_table(t.spark, regression.fit_binomial(training), names)


@query(
    """
WITH r AS (SELECT o_orderstatus = 'F' AS label, 'customer:' || o_custkey AS customer, 'o_orderpriority:' || o_orderpriority AS priority FROM orders)
SELECT term, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (label) AS BIGINT) AS moment
FROM (SELECT label, unnest([customer, priority]) AS term FROM r) GROUP BY term
"""
)
def q_wide_glm_moments(t: Tables) -> DataFrame:
    """Finished orders regressed on customer and priority, a column each; at the optimum a term's chances add up to its count."""
    label = (F.col("o_orderstatus") == "F").cast("double").alias("label")
    rows = t.orders.select(label, F.col("o_custkey").cast("string").alias("customer"), "o_orderpriority")
    found, dictionary = onehot_sparse(rows, "label", ["customer", "o_orderpriority"])
    fit = wide_glm.fit_wide_binomial(found, features="onehot", tolerance=0.3 / max(rows.count(), 1))
    weights = t.spark.createDataFrame(pa.table({"term_index": np.arange(len(fit.coefficients)), "weight": fit.coefficients}))
    named = dictionary.join(weights, "term_index").select("term", "weight")
    z = F.lit(fit.intercept)
    for column in ("customer", "o_orderpriority"):
        term = F.concat(F.lit(f"{column}:"), F.coalesce(column, F.lit("null")))
        own = named.select(F.col("term").alias(f"{column}_term"), F.col("weight").alias(f"{column}_weight"))
        rows = lookup_join(rows.withColumn(f"{column}_term", term), own, [f"{column}_term"], "inner")
        z = z + F.col(f"{column}_weight")
    terms = F.array(F.concat(F.lit("customer:"), "customer"), F.concat(F.lit("o_orderpriority:"), "o_orderpriority"))
    chance = F.when(F.col("label").isNotNull(), 1 / (1 + F.exp(-z))).otherwise(0.0)
    told = rows.select(F.explode(terms).alias("term"), chance.alias("p")).groupBy("term")
    return told.agg(F.count("*").alias("n"), F.round(F.sum("p")).cast("long").alias("moment"))


@query()
def q_logreg_cv(t: Tables) -> DataFrame:
    """Penalty chosen by cross-validation on four fifths of the rows, confusion on the rest."""
    split = stratified_split(labelled_texts(t), "label", "doc_id")
    search = regression.fit_logistic_grid(split.filter(~F.col("is_test")))
    return confusion_table(search.transform(split.filter("is_test")))


@query()
def q_logreg_elastic(t: Tables) -> DataFrame:
    model = regression.fit_elastic_net(labelled_texts(t))
    return model.transform(labelled_texts(t)).select("doc_id", "label", "predictions")


@query(
    """
WITH v AS (SELECT vec_id, vec_id % 3 AS fold, embedding::DOUBLE[] AS x FROM embeddings),
m AS (SELECT k, f, c.x, c.vec_id AS c FROM (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest([0, 1, 2]) AS f), v c WHERE c.vec_id < k),
a AS (SELECT k, f, m.c, v.x, v.fold FROM m, v QUALIFY row_number() OVER (PARTITION BY k, f, v.vec_id ORDER BY list_distance(v.x, m.x), m.c) = 1),
e AS (SELECT k, f, c, dim, avg(y) AS y FROM (SELECT k, f, c, unnest(x) AS y, unnest(range(64)) AS dim FROM a WHERE fold <> f) GROUP BY ALL),
n AS (SELECT k, f, c, list(y ORDER BY dim) AS x FROM e GROUP BY ALL),
d AS (SELECT k, f, v.vec_id, fold, min(list_distance(v.x, n.x)) AS d FROM n, v GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, CAST(f AS INTEGER) AS fold, round(sum(d * d) FILTER (fold <> f), 6) AS cost,
       round(sum(d * d) FILTER (fold = f), 6) AS held_out
FROM d GROUP BY k, f
"""
)
def q_kmeans_shared_scan(t: Tables) -> DataFrame:
    """Nine models after one shared step from given centres: costs on their own rows and on the fold left out."""
    rows = feature_vectors(t)
    first = {r["vec_id"]: r["features"].toArray() for r in rows.filter("vec_id < 4").collect()}
    starts = {k: np.array([first[i] for i in range(k)]) for k in (2, 3, 4)}
    fits = kmeans_grid.fit_grid(rows, (2, 3, 4), "features", F.col("vec_id") % 3, 3, 1, starts=starts)
    return t.spark.createDataFrame(
        [(f.k, f.fold, round(f.cost, 6), round(f.held_out, 6)) for f in fits], "k int, fold int, cost double, held_out double"
    )


@query("SELECT unnest([4, 8, 10, 12, 16]) AS k, true AS same_cost, true AS at_rest")
def q_kmeans_grid_converged(t: Tables) -> DataFrame:
    """The searched models run to their end: the rows measured against the centres have the cost told, and no centre moves."""
    rows, checked = feature_vectors(t), []
    for fit in kmeans_grid.fit_grid(rows, clusters.TRIED_CLUSTERS, max_iterations=200):
        centres = t.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fit.centres)], "cluster int, coordinates array<double>")
        near = clusters.nearest_centres(rows, centres, "features")
        cost = clusters.wssse(near).first()["wssse"]
        means = group_mean_vectors(near, "prediction", "features").join(centres, F.col("prediction") == F.col("cluster"))
        gap = F.array_max(F.zip_with("mean", "coordinates", lambda a, b: F.abs(a - b)))
        checked.append((fit.k, abs(cost / fit.cost - 1) < 1e-9, means.agg(F.max(gap)).first()[0] < 1e-3))
    return t.spark.createDataFrame(checked, "k int, same_cost boolean, at_rest boolean")


STRENGTHS = (0.1, 0.333, 0.666, 0.999)
LABEL_MOMENTS = """
WITH r AS (SELECT quality AS y, n_chars / 1000 AS thousands, lang, toxic FROM documents JOIN labels USING (doc_id)),
m AS (SELECT unnest(['thousands', 'de', 'es', 'fr', 'toxic', 'Intercept']) AS term,
             unnest([sum(y * thousands), sum(y) FILTER (lang = 'de'), sum(y) FILTER (lang = 'es'), sum(y) FILTER (lang = 'fr'),
                     sum(y * toxic), sum(y)])::DOUBLE AS total FROM r)
"""


def moments(t: Tables, fits: list, names: list[str], penalty_name: str, told: list[float]) -> DataFrame:
    """Per fit and term, the predicted moment with the penalty's slope added; at the optimum it is that of the label."""
    rows = labelled_texts(t).persist()
    out = []
    for fit, shown in zip(fits, told):
        each = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
        scored = rows.withColumn("p", logistic_path.probability(rows, fit))
        pairs = scored.select("label", "p", F.posexplode(each).alias("at", "x"))
        sums = {r["at"]: (r["p"], r["y"]) for r in pairs.groupBy("at").agg(
            F.sum(F.col("p") * F.col("x")).alias("p"), F.sum(F.col("label") * F.col("x")).alias("y")).collect()}
        for at, name in enumerate(names):
            predicted, actual = sums[at]
            slope = 0.0
            if name != "Intercept":
                w, s = fit.coefficients[at], fit.scale[at]
                most = fit.rows * fit.penalty * fit.mixing * s
                sign = np.sign(w) if w else float(np.clip((actual - predicted) / most, -1, 1)) if most else 0.0
                slope = most * sign + fit.rows * fit.penalty * (1 - fit.mixing) * s * s * w
            out.append((shown, name, round(float(predicted + slope), 3) + 0.0))
    rows.unpersist()
    return t.spark.createDataFrame(out, f"{penalty_name} double, term string, total double")


@query(
    LABEL_MOMENTS
    + "SELECT c::DOUBLE AS strength, term, round(total, 3) AS total FROM m, (SELECT unnest([0.1, 0.333, 0.666, 0.999]) AS c)"
)
def q_logreg_optimum(t: Tables) -> DataFrame:
    """All strengths of the search fitted together: each one's gradient with its penalty vanishes."""
    rows = labelled_texts(t)
    n = rows.count()
    fits = logistic_path.fit_paths(rows, tuple(1 / (c * n) for c in STRENGTHS))
    return moments(t, fits, [*TEXT_TERMS, "Intercept"], "strength", list(STRENGTHS))


@query(
    LABEL_MOMENTS
    + "SELECT c::DOUBLE AS penalty, term, round(total, 3) AS total FROM m, (SELECT unnest([0.3, 0.03, 0.003]) AS c) WHERE term <> 'Intercept'"
)
def q_elastic_optimum(t: Tables) -> DataFrame:
    """The elastic net at three penalties: zero lies in the subgradient of every coefficient."""
    fits = logistic_path.fit_paths(labelled_texts(t), (0.3, 0.03, 0.003), 0.8, intercept=False, standardize=True)
    return moments(t, fits, TEXT_TERMS, "penalty", [0.3, 0.03, 0.003])


@query()
def q_logreg_search(t: Tables) -> DataFrame:
    """The search over strengths and folds in shared scans, and the confusion of its best model on the rows held back."""
    split = stratified_split(labelled_texts(t), "label", "doc_id")
    search = logistic_path.logistic_search(split.filter(~F.col("is_test")), "doc_id")
    return confusion_table(search.transform(split.filter("is_test")))

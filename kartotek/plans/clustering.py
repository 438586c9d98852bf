"""Feature table to scaled vectors to clusters and distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.functions.text import status_label
from kartotek.operators.clusters import CLUSTERS, assign_clusters, center_distances, centres_frame, fit_kmeans
from kartotek.operators.cleaning import drop_missing, impute_mean, keep_values, with_offset_year, without
from kartotek.operators.onehot import Values, onehot_all, onehot_sparse
from kartotek.operators.vectors import assemble, scale
from kartotek.sources.models import load_model

# Fixed values
IMPUTED = ("nPenheder", "antalAnsatte", "stiftelsesAar")
NOT_FEATURES = ("Index", "cvrnummer", "stiftelsesDato")
REGRESSION_STATUSES = ("aktiv", "opløstefterkonkurs")
REGRESSION_LEFT_OUT = ("virksomhedsBeskrivelse", "virksomhedsstatus", "sammensatStatus")


def numeric_features(
    table: DataFrame,
    imputed: tuple[str, ...] = IMPUTED,
    left_out: tuple[str, ...] = NOT_FEATURES,
    values: Values | None = None,
    index: str = "Index",
) -> tuple[DataFrame, list[str]]:
    """Text columns as 0/1 columns and number gaps filled by the mean; also the names to assemble."""
    wide = onehot_all(table.drop("stiftelsesDato"), index, values=values)
    filled = impute_mean(wide, [c for c in imputed if c in wide.columns])
    return filled, [c for c in filled.columns if c not in left_out]


@dataclass
class Clustering:
    """What a clustering run leaves behind."""

    scaled: DataFrame
    scaler: StandardScalerModel
    model: KMeansModel


def cluster_table(
    table: DataFrame,
    k: int = CLUSTERS,
    index: str = "Index",
    imputed: tuple[str, ...] = IMPUTED,
    values: Values | None = None,
    wide: bool = False,
    seed: int = 42,
) -> Clustering:
    """One-hot, impute, assemble, scale and fit.

    The text columns go straight into one sparse vector, so codes may have any
    number of values; with ``wide`` each value has a column of its own.
    """
    if wide:
        features, names = numeric_features(table, imputed, values=values, index=index)
    else:
        texts, _ = onehot_sparse(table.drop("stiftelsesDato"), index)
        numbers = [c for c, kind in table.dtypes if kind != "string" and c not in (*NOT_FEATURES, index)]
        filled = impute_mean(table.select(index, *numbers), [c for c in imputed if c in numbers])
        features, names = filled.join(texts, index), [*numbers, "onehot"]
    vectors = assemble(features, names).select(index, "features").persist()
    scaled, scaler = scale(vectors)
    scaled = scaled.select(index, "scaledfeatures")
    model = fit_kmeans(scaled, k, seed=seed)
    vectors.unpersist()
    return Clustering(scaled, scaler, model)


def distances(scaled: DataFrame, model: KMeansModel, index: str = "Index") -> DataFrame:
    """Each row's cluster and its distance to the centre: ``Index, prediction, distance``."""
    assigned = assign_clusters(model, scaled)
    measured = center_distances(assigned, centres_frame(scaled.sparkSession, model))
    return measured.select(index, "prediction", "distance")


def ranked_companies(table: DataFrame, measured: DataFrame, index: str = "Index") -> DataFrame:
    """Company rows with cluster and distance, farthest first."""
    return table.join(measured, index).orderBy(F.desc("distance"), index)


def status_training_rows(
    table: DataFrame,
    values: Values | None = None,
    left_out: tuple[str, ...] = ("brancheAnsvarskode:97", "brancheAnsvarskode:99"),
    imputed: tuple[str, ...] = IMPUTED,
) -> tuple[DataFrame, list[str]]:
    """Label and features of the status regression: ``Index, label, features``, and the feature names.

    Only active companies (0) and those dissolved after bankruptcy (1) take part.
    ``left_out`` are 0/1 columns dropped by name.
    """
    chosen = keep_values(table, "sammensatStatus", list(REGRESSION_STATUSES))
    labelled = chosen.withColumn("label", status_label(F.col("sammensatStatus")).cast("long"))
    features, _ = numeric_features(without(labelled, list(REGRESSION_LEFT_OUT)), imputed, values=values)
    dated = without(with_offset_year(features), ["stiftelsesAar", *left_out])
    names = [c for c in dated.columns if c not in ("Index", "cvrnummer", "label")]
    return assemble(drop_missing(dated), names).select("Index", "label", "features"), names


def status_training_vectors(
    table: DataFrame,
    left_out: tuple[str, ...] = ("brancheAnsvarskode:97", "brancheAnsvarskode:99"),
    imputed: tuple[str, ...] = IMPUTED,
) -> tuple[DataFrame, list[str], DataFrame]:
    """As :func:`status_training_rows` for codes of any number of values, one sparse vector a row, for the wide GLM.

    Returns ``Index, label, features``, the names of the numbers that come first in the vectors, and the dictionary of
    the terms after them. ``left_out`` are terms without a position.
    """
    chosen = keep_values(table, "sammensatStatus", list(REGRESSION_STATUSES))
    labelled = chosen.withColumn("label", status_label(F.col("sammensatStatus")).cast("long"))
    rows = without(labelled, [*REGRESSION_LEFT_OUT, "stiftelsesDato"])
    texts, dictionary = onehot_sparse(rows, "Index", left_out=left_out)
    numbers = [c for c, kind in rows.dtypes if kind != "string" and c not in ("Index", "cvrnummer", "label")]
    filled = impute_mean(rows.select("Index", "label", *numbers), [c for c in imputed if c in numbers])
    dated = drop_missing(without(with_offset_year(filled), ["stiftelsesAar"]))
    names = [c for c in dated.columns if c not in ("Index", "label")]
    vectors = assemble(dated.join(texts, "Index"), [*names, "onehot"])
    return vectors.select("Index", "label", "features"), names, dictionary


def saved_distances(scaler_path: str, model_path: str, vectors: DataFrame, index: str = "Index") -> DataFrame:
    """Stored feature vectors, scaled and assigned by models saved before: ``Index, prediction, distance``.

    ``vectors`` has the column ``features`` of the scaler; nothing is fitted again.
    """
    scaler = load_model(StandardScalerModel, scaler_path)
    model = load_model(KMeansModel, model_path)
    return distances(scaler.transform(vectors).select(index, "scaledfeatures"), model, index)

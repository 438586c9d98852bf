"""Binomial and logistic regression with their tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartotek.operators.nested import quoted

# Fixed values
INVERSE_STRENGTHS = (0.1, 0.333, 0.666, 0.999)


def fit_binomial(frame: DataFrame, label: str = "label", features: str = "features") -> GeneralizedLinearRegressionModel:
    """Binomial GLM with logit link.

    It is fitted by iteratively reweighted least squares over a matrix of features by
    features, which Spark limits to 4,096 features; wider tables are for
    :func:`fit_elastic_net` or :func:`fit_logistic_grid`. Each step reads the rows again, so they are kept meanwhile.
    """
    rows = frame.select(F.col(quoted(label)), F.col(quoted(features))).persist()
    try:
        return GeneralizedLinearRegression(
            family="binomial", link="logit", labelCol=label, featuresCol=features, predictionCol="predictions"
        ).fit(rows)
    finally:
        rows.unpersist()


def binomial_pipeline(columns: list[str], label: str = "label") -> Pipeline:
    """Assembler and binomial GLM as one pipeline, to fit, save and load as a whole."""
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol=label, featuresCol="features", predictionCol="predictions"
    )
    return Pipeline(stages=[assembler, model])


def coefficient_table(
    spark: SparkSession, model: GeneralizedLinearRegressionModel, names: list[str]
) -> DataFrame:
    """``term, estimate, standard_error, t_value, p_value``, one row per feature and one for the intercept.

    The statistics of the intercept come last in the model's lists.
    """
    summary = model.summary
    estimates = [*[float(c) for c in model.coefficients], float(model.intercept)]
    if len(names) + 1 != len(estimates):
        raise ValueError(f"{len(names)} names for {len(estimates) - 1} coefficients")
    rows = zip(
        [*names, "Intercept"], estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues
    )
    return spark.createDataFrame(
        [(n, *map(float, rest)) for n, *rest in rows],
        "term string, estimate double, standard_error double, t_value double, p_value double",
    )


def binomial_summary(spark: SparkSession, model: GeneralizedLinearRegressionModel) -> DataFrame:
    """One row: dispersion, null deviance, deviance and both residual degrees of freedom."""
    s = model.summary
    return spark.createDataFrame(
        [
            (
                float(s.dispersion),
                float(s.nullDeviance),
                float(s.deviance),
                int(s.residualDegreeOfFreedomNull),
                int(s.residualDegreeOfFreedom),
            )
        ],
        "dispersion double, null_deviance double, deviance double, dof_null long, dof long",
    )


def deviance_residuals(
    model: GeneralizedLinearRegressionModel, frame: DataFrame, keep: list[str], label: str = "label"
) -> DataFrame:
    """The deviance residual of every row, next to the columns ``keep``."""
    scored = model.transform(frame.drop(model.getPredictionCol()))
    y, mu = F.col(label).cast("double"), F.col("predictions")
    loss = -2 * F.when(y > 0, F.log(mu)).otherwise(F.log1p(-mu))
    residual = F.signum(y - mu) * F.sqrt(loss)
    return scored.select(*keep, residual.alias("devianceResiduals"))


def fit_logistic_grid(
    frame: DataFrame,
    label: str = "label",
    features: str = "features",
    inverse_strengths: tuple[float, ...] = INVERSE_STRENGTHS,
    folds: int = 3,
    seed: int = 42,
    prediction: str = "predictionLogReg",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Logistic regression with the penalty chosen by cross-validated accuracy.

    The strengths are inverse and meant for a loss summed over rows; Spark's loss is
    a mean, hence a penalty of ``1 / (C * n)`` without standardising.
    """
    rows = frame.select(label, features).persist()
    n = rows.count()
    estimator = LogisticRegression(
        labelCol=label, featuresCol=features, predictionCol=prediction, standardization=False
    )
    grid = ParamGridBuilder().addGrid(estimator.regParam, [1.0 / (c * n) for c in inverse_strengths]).build()
    evaluator = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="accuracy")
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=folds,
        seed=seed,
        parallelism=parallelism,
    )
    fitted = search.fit(rows)
    rows.unpersist()
    return fitted


def fit_elastic_net(
    frame: DataFrame,
    label: str = "label",
    features: str = "features",
    penalty: float = 0.3,
    mixing: float = 0.8,
    max_iterations: int = 10,
) -> LogisticRegressionModel:
    """Logistic regression with an elastic net and no intercept."""
    return LogisticRegression(
        labelCol=label,
        featuresCol=features,
        predictionCol="predictions",
        maxIter=max_iterations,
        regParam=penalty,
        elasticNetParam=mixing,
        fitIntercept=False,
    ).fit(frame)

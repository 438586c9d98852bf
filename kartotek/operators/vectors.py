"""Assembling, scaling and changing the form of feature vectors."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartotek.functions.vector import abs_difference, dense
from kartotek.operators.nested import quoted
from kartotek.operators.statistics import as_array


def assemble(frame: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """One vector column from number, boolean or vector columns, in the given order.

    A missing value is an error. Names with a dot are allowed.
    """
    safe = {c: f"__a{i}" for i, c in enumerate(columns)}
    renamed = frame.select("*", *[F.col(quoted(c)).alias(a) for c, a in safe.items()])
    assembler = VectorAssembler(inputCols=list(safe.values()), outputCol=output, handleInvalid="error")
    return assembler.transform(renamed).drop(*safe.values())


def scale(
    frame: DataFrame, features: str = "features", output: str = "scaledfeatures"
) -> tuple[DataFrame, StandardScalerModel]:
    """Divide each position by its sample standard deviation, without centring; no spread gives 0."""
    model = StandardScaler(withMean=False, withStd=True, inputCol=features, outputCol=output).fit(frame)
    return model.transform(frame), model


def with_abs_difference(frame: DataFrame, first: str, second: str, output: str = "difference") -> DataFrame:
    """Element-wise absolute difference of two vector columns as an array; sizes must agree."""
    return frame.withColumn(output, abs_difference(as_array(frame, first), as_array(frame, second)))


def to_dense(frame: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """A vector column with every value stored."""
    return frame.withColumn(output or column, dense(F.col(quoted(column))))


def to_ml_vectors(frame: DataFrame, *columns: str) -> DataFrame:
    """Old-style vector columns as ML vectors; columns that already are stay."""
    return MLUtils.convertVectorColumnsToML(frame, *columns)


def vector_kind(schema: T.StructType, column: str) -> str:
    """``"ml"`` or ``"mllib"`` for a vector column; anything else is an error."""
    if column not in schema.names:
        raise ValueError(f"{column} is not there")
    kind = schema[column].dataType
    if isinstance(kind, VectorUDT):
        return "ml"
    if isinstance(kind, T.UserDefinedType) and kind.module() == "pyspark.mllib.linalg":
        return "mllib"
    raise TypeError(f"{column} is not a vector column")


class DenseVectors(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that adds the dense form of a vector column."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCol: str | None = None, outputCol: str | None = None):
        return self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return to_dense(dataset, self.getInputCol(), self.getOutputCol())

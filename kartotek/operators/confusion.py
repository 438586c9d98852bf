"""Confusion classes and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.functions.scoring import CONFUSION_CLASSES, confusion_class
from kartotek.operators.nested import quoted


def with_confusion_class(
    frame: DataFrame, label: str = "label", prediction: str = "predictionLogReg", name: str = "diff"
) -> DataFrame:
    return frame.withColumn(name, confusion_class(F.col(quoted(label)), F.col(quoted(prediction))))


def confusion_table(frame: DataFrame, label: str = "label", prediction: str = "predictionLogReg") -> DataFrame:
    """One row ``TP, TN, FN, FP, Excluded, accuracy``; a class without rows is 0.

    Accuracy leaves excluded rows out and is null when nothing is left.
    """
    classes = with_confusion_class(frame, label, prediction, "__class")
    counts = classes.agg(
        F.count("*").alias("__all"), *[F.count_if(F.col("__class") == c).alias(c) for c in CONFUSION_CLASSES]
    )
    accuracy = F.try_divide((F.col("TP") + F.col("TN")).cast("double"), F.col("__all") - F.col("Excluded"))
    return counts.select(*CONFUSION_CLASSES, accuracy.alias("accuracy"))

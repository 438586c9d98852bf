"""Expressions that compare a label with a prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
CONFUSION_CLASSES = ("TP", "TN", "FN", "FP", "Excluded")


def confusion_class(label: Column, prediction: Column) -> Column:
    """``TP``, ``TN``, ``FN`` or ``FP``; ``Excluded`` when the prediction is null or not a number."""
    correct = F.when(prediction == label, "T").when(prediction == 1 - label, "F")
    named = F.when(prediction == 1, "P").when(prediction == 0, "N")
    return F.coalesce(F.concat(correct, named), F.lit("Excluded"))

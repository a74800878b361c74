"""Class labels carried in the first three characters of a compound name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = "yes", "not"


def label_of(name: Column) -> Column:
    """``yes`` or ``not`` in any case, null for an unlabelled name."""
    prefix = F.lower(F.substring(name, 1, 3))
    return F.when(prefix.isin(POSITIVE, NEGATIVE), prefix)


def is_positive(name: Column) -> Column:
    return F.lower(F.substring(name, 1, 3)) == POSITIVE


def external_id(name: Column) -> Column:
    """Name without the class prefix and its delimiter."""
    return F.substring(name, 5, 2147483647)


def compound_type(name: Column) -> Column:
    return F.when(is_positive(name), F.lit("inhibitor")).otherwise(F.lit("notinhibitor"))


def with_label(df: DataFrame) -> DataFrame:
    label = label_of(F.col("name"))
    return df.withColumns(
        {"label": label, "ext_id": F.when(label.isNotNull(), external_id(F.col("name")))}
    )

"""The two measures nearly every report needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packets() -> Column:
    return F.count(F.lit(1)).alias("packets")


def volume() -> Column:
    return F.sum("length").alias("bytes")

"""Vector features: leaves, finiteness, shapes, moments, and stored statistics against recomputed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSOLUTE, RELATIVE = 1e-6, 1e-5


def finite(c: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def close(a: Column, b: Column, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> Column:
    """Whether two numbers agree within the larger of the absolute and the relative tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def leaves(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """One row per element of a one-dimensional array: keys, dim, value."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def non_finite(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Elements that are null, NaN or infinite, with their place; null counts as non-finite."""
    odd = F.exists(vector, lambda x: ~finite(x.cast("double")))
    return leaves(df.where(odd), keys, vector).where(~finite(F.col("value")))


def moments(df: DataFrame, vector: str, group: Sequence[str] = ()) -> DataFrame:
    """count, min, max, mean, population variance and standard deviation of each dimension; a row with any non-finite element is left out whole."""
    rows = df.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: finite(x.cast("double"))))
    v = F.col("value")
    return (
        leaves(rows, group, vector)
        .groupBy(*group, "dim")
        .agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.stddev_pop(v).alias("std"))
    )


def near_zero_variance(found: DataFrame, threshold: float) -> DataFrame:
    """Dimensions of `moments` whose variance is at most `threshold`."""
    return found.where(F.col("var") <= threshold)


def shapes(df: DataFrame, vector: str, declared: int) -> DataFrame:
    """Actual widths that differ from the declared one, with the number of rows; null is no shape."""
    return df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n")).where(F.col("width") != declared)


def ragged(df: DataFrame, matrix: str) -> DataFrame:
    """Rows whose inner arrays differ in length."""
    return df.where(F.size(F.array_distinct(F.transform(matrix, F.size))) > 1)


def stats_mismatch(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str] = ("dim",), fields: Sequence[str] = ("min", "max", "mean", "std")) -> DataFrame:
    """(keys, field, stored, recomputed) where a stored statistic is finite and outside the tolerances."""
    long = lambda df, name: df.select(*keys, F.expr("stack({}, {}) AS (field, {})".format(len(fields), ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in fields), name)))
    both = long(stored, "stored").join(long(recomputed, "recomputed"), [*keys, "field"])
    return both.where(finite(F.col("stored")) & ~close(F.col("stored"), F.col("recomputed")))


def stats_incomplete(features: DataFrame, stored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(feature, field) that the stored statistics lack: features without any, and null fields."""
    wanted = features.select("feature").withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    present = stored.select("feature", F.expr("stack({}, {}) AS (field, v)".format(len(fields), ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in fields)))).where("v IS NOT NULL").select("feature", "field").distinct()
    return wanted.join(present, ["feature", "field"], "left_anti")


def saturation(df: DataFrame, values: Sequence[str], low: float, high: float) -> DataFrame:
    """Columns whose minimum reaches `low` or maximum reaches `high`: feature, min, max."""
    stats = df.agg(*[x for v in values for x in (F.min(v).cast("double").alias(f"{v}_min"), F.max(v).cast("double").alias(f"{v}_max"))])
    rows = stats.select(F.expr("stack({}, {}) AS (feature, min, max)".format(len(values), ", ".join(f"'{v}', `{v}_min`, `{v}_max`" for v in values))))
    return rows.where((F.col("min") <= low) | (F.col("max") >= high))

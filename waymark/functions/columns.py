"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["id_student", "code_module", "code_presentation"]
PRESENTATION = ["code_module", "code_presentation"]


def finite(value: Column) -> Column:
    """value as double, null where it is no number, NaN or infinite."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(value: Column | None) -> Column:
    """value as double; zero where it is no finite number or the column is absent (None)."""
    return F.lit(0.0) if value is None else F.coalesce(finite(value), F.lit(0.0))


def is_true(condition: Column) -> Column:
    """Null counts as false, as comparisons with a missing value do in the data model."""
    return F.coalesce(condition, F.lit(False))


def day_to_week(day: Column) -> Column:
    """Days 0 to 6 are week 1; null for null and negative days."""
    return F.when(day >= 0, (F.floor(day / 7) + 1).cast("int"))


def average_rank(partition: list[str], value: str, ascending: bool = True) -> Column:
    """Rank within the partition; tied values share the mean of their ranks."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (ties - 1) / 2


def share_rank(partition: list[str], value: str) -> Column:
    """average_rank as a share of the partition's rows (not percent_rank)."""
    return average_rank(partition, value) / F.count(F.lit(1)).over(Window.partitionBy(*partition))


def z_score(value: Column, over: WindowSpec) -> Column:
    """Distance from the mean in sample standard deviations; zero where there is none."""
    spread = F.stddev_samp(value).over(over)
    return F.coalesce(F.try_divide(value - F.avg(value).over(over), F.nullif(spread, F.lit(0.0))), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate; null without variance on either side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def group_id(cluster: str) -> Column:
    """Name of the row's cluster: presentation (module::presentation), module or learner."""
    if cluster == "presentation":
        return F.concat_ws("::", *PRESENTATION)
    if cluster == "module":
        return F.col("code_module").cast("string")
    if cluster == "learner":
        return F.col("id_student").cast("string")
    raise ValueError("cluster must be 'presentation', 'module' or 'learner'")

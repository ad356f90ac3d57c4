"""Catalog joins, audit rules, eligibility and reuse of earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compatible(have: dict[str, Column], want: dict[str, object], loose: float = 1e-9) -> Column:
    """Whether stored parameters equal the wanted ones; numbers to within ``loose``, null never."""
    out = F.lit(True)
    for name, value in want.items():
        c = have[name]
        same = F.abs(c - float(value)) <= loose if isinstance(value, float) else c == F.lit(value)
        out &= F.coalesce(same, F.lit(False))
    return out


def outstanding(wanted: DataFrame, results: DataFrame, keys: list[str], fits: Column) -> DataFrame:
    """Wanted rows without a compatible result."""
    return wanted.join(results.where(fits).select(*keys).distinct(), keys, "left_anti")


def audited(rows: DataFrame, failures: dict[str, Column], warnings: dict[str, Column], warned: str = "warning") -> DataFrame:
    """quality_status with the reasons of the rules that hold; a null condition does not hold."""
    def reasons(rules):
        return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))

    out = rows.withColumn("failed_", reasons(failures)).withColumn("warned_", reasons(warnings))
    status = F.when(F.size("failed_") > 0, "fail").when(F.size("warned_") > 0, warned).otherwise("pass")
    return out.withColumn("quality_status", status).withColumn("fail_reasons", F.concat_ws(";", "failed_")).withColumn("warning_reasons", F.concat_ws(";", "warned_")).drop("failed_", "warned_")


def _ends_with(name: str):
    return lambda k, v: k.endswith("." + name) & v.isNotNull()


def first_alias(flat: Column, names: list[str]) -> Column:
    """Value of the first name found in a map of dotted keys: the whole key first, then a key that ends with it."""
    found = []
    for n in names:
        ends = F.map_filter(flat, _ends_with(n))
        found += [F.try_element_at(flat, F.lit(n)), F.try_element_at(F.map_values(ends), F.lit(1))]
    return F.coalesce(*found)

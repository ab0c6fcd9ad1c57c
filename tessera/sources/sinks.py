"""Writers: upserts by key, replacing one tenant's rows, appending checked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with changes: of a key's rows the change with the largest `order` stays; keys without one keep their row. Replaying changes alters nothing."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    last = changes.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*base.columns))


def replace_tenants(rows: DataFrame, path: str, tenant: str = "user_id") -> None:
    """Each tenant that has rows gets exactly these, in a table parted by tenant; others' rows stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tenant).parquet(path)


def append_checked(rows: DataFrame, path: str, checks: dict[str, Column]) -> None:
    """Append rows that pass all checks (name: condition); the first broken one fails the write with its name before anything is committed."""
    for name, good in checks.items():
        message = F.lit(f"broken rule: {name}")
        rows = rows.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))
    rows.write.mode("append").parquet(path)


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """Each parent with its children as an array of structs, ordered by the first column; an empty array without any."""
    many = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    rows = parents.join(many, key, "left")
    return rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))

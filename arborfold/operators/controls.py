"""Values put into the controls of a stored node relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nodes import attr


def with_attribute(attrs: Column, name: str, value: Column) -> Column:
    """``attrs`` with the first ``name`` set, at its place or at the end."""
    at = F.array_position(F.transform(attrs, lambda a: a["name"]), name)
    new = F.struct(F.lit(name).alias("name"), value.alias("value"))
    changed = F.transform(attrs, lambda a, k: F.when(k + 1 == at, new).otherwise(a))
    return F.when(at > 0, changed).otherwise(F.concat(attrs, F.array(new)))


def fill(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """``nodes`` with the values (page_id, ref, value) put into text controls and boxes switched; other targets stay."""
    rows = nodes.join(values.select("page_id", "ref", F.col("value").alias("new_value")), ["page_id", "ref"], "left")
    kind = F.coalesce(attr("type"), F.lit("text"))
    box = (F.col("tag") == "input") & kind.isin("checkbox", "radio")
    off = F.col("new_value").isin("", "off", "false", "0")
    switched = F.when(off, F.filter("attrs", lambda a: a["name"] != "checked")).otherwise(with_attribute(F.col("attrs"), "checked", F.lit("")))
    changed = F.when(F.col("new_value").isNull() | ~F.col("tag").isin("input", "textarea", "select"), F.col("attrs")).when(box, switched).otherwise(with_attribute(F.col("attrs"), "value", F.col("new_value")))
    return rows.withColumn("attrs", changed).select(*nodes.columns)

"""Sinks: JSON documents and verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.text import finite


def sanitised(df: DataFrame) -> DataFrame:
    """Doubles that JSON cannot hold become null, at the top level and in structs, arrays and values of maps."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, t.valueType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): one document per row, null fields kept."""
    d = sanitised(df)
    return d.select(key, F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_documents(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = sanitised(df).write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(partition_by) if partition_by else w).json(path)


def write_texts(df: DataFrame, path: str) -> None:
    """(receipt_id, text), one text to a line of JSON: as many files as tasks, since a file for each text costs a folder, blocks and renames."""
    df.select("receipt_id", "text").write.json(path)


def write_missing(df: DataFrame, existing: DataFrame | None, path: str, key: str = "receipt_id") -> None:
    """Append the rows whose key is not written yet, so a job that is run again does nothing twice."""
    new = df if existing is None else df.join(existing.select(key), key, "left_anti")
    sanitised(new).write.mode("append").parquet(path)

"""Column-name helpers: names may hold dots, so references are always quoted."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def flat_name(name: str) -> str:
    """A name MLlib stages accept (they read a dot as a struct access)."""
    return name.replace(".", "_")


def with_flat_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename dotted columns; return the frame and the {new: old} map."""
    names = {flat_name(c): c for c in df.columns}
    if len(names) != len(df.columns):
        raise ValueError(f"column names collide once dots are replaced: {df.columns}")
    return df.toDF(*names), names


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def literal(value: float, dtype: str = "double") -> str:
    """A number as SQL text that reads back to the same value."""
    text = {math.inf: "Infinity", -math.inf: "-Infinity"}.get(value, repr(value))
    return f"{dtype}('{text}')"


def numeric_value(name: str, dtype: T.DataType) -> Column:
    """The column as a double, with unparsable text and NaN turned to null."""
    value = quoted(name)
    if isinstance(dtype, T.StringType):
        value = f"try_cast({value} AS double)"
    elif isinstance(dtype, T.BooleanType):
        value = f"cast(cast({value} AS int) AS double)"
    elif not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.expr(f"cast({value} AS double)")
    return F.expr(f"nullif(cast({value} AS double), double('NaN'))")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few summary rows as a local relation (its true size is known to the optimizer)."""
    struct = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) or [[] for _ in struct.fields]
    arrow = to_arrow_schema(struct)
    table = pa.table([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=struct)

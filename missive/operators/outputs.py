"""Shapes of secrets in what is given out: every string of a table, however nested, without showing any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: shapes that a masked output must not show, and the dates and times that may be full of digits: fixed values
SHAPES = [
    ("digit_run", r"\b\d{6,}\b"),
    ("card_groups", r"\b(?:\d{4}[ -]){3}\d{4}\b"),
    ("token_prefix", r"\b(?:sk|pk|tok|ghp|gho)[_-][A-Za-z0-9]{4,}\b"),
]
#: what stands in every string that shows a shape: blanks for dates never bring digits together
HINT = r"\d{4}|(?:sk|pk|tok|ghp|gho)[_-]"
CLOCK = r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?"


def strings(value: Column, kind: DataType) -> Column | None:
    """All strings inside a value, keys of maps too, as one array; None for a type that holds none. Nulls give no string."""
    none = F.array().cast("array<string>")
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(value.cast("string"))).otherwise(none)
    if isinstance(kind, StructType):
        inner = [found for f in kind.fields if (found := strings(value.getField(f.name), f.dataType)) is not None]
        return F.concat(*inner) if inner else None
    if isinstance(kind, ArrayType):
        if strings(F.lit(None), kind.elementType) is None:
            return None
        return F.coalesce(F.flatten(F.transform(value, lambda x: strings(x, kind.elementType))), none)
    if isinstance(kind, MapType):
        inner = [strings(side, ArrayType(t)) for side, t in ((F.map_keys(value), kind.keyType), (F.map_values(value), kind.valueType))]
        inner = [x for x in inner if x is not None]
        return F.concat(*inner) if inner else None
    return None


def _plain(x: Column) -> Column:
    """A string without its dates and times, which are read as blanks."""
    return F.regexp_replace(x, CLOCK, " ")


def _suspect(x: Column) -> Column:
    """Whether a string shows any shape: read once for all, and not at all without a hint."""
    return x.rlike(HINT) & _plain(x).rlike("|".join(f"(?:{pattern})" for _, pattern in SHAPES))


def _suspects(value: Column, kind: DataType, column: str) -> Column | None:
    """(column, text) of the strings inside a value that show a shape, as an array; None for a type that holds none."""
    named = lambda x: F.struct(F.lit(column).alias("column"), x.cast("string").alias("text"))
    if isinstance(kind, StringType):
        return F.when(_suspect(value), F.array(named(value))).otherwise(F.array().cast("array<struct<column:string,text:string>>"))
    found = strings(value, kind)
    return None if found is None else F.transform(F.filter(found, _suspect), named)


def leaked(rows: DataFrame) -> DataFrame:
    """(column, shape, n): how many strings below each column show a shape; only what was found.

    One pass and one small aggregate; columns of any name and nesting. An empty table, or
    one without strings, gives no row.
    """
    empty = rows.sparkSession.createDataFrame([], "column string, shape string, n long")
    held = [found for f in rows.schema.fields if (found := _suspects(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType, f.name)) is not None]
    if not held:
        return empty
    seen = rows.select(F.explode(F.concat(*held)).alias("x")).select("x.column", _plain(F.col("x.text")).alias("text"))
    shapes = F.filter(F.array(*(F.when(F.col("text").rlike(pattern), F.lit(shape)) for shape, pattern in SHAPES)), lambda s: s.isNotNull())
    return seen.select("column", F.explode(shapes).alias("shape")).groupBy("column", "shape").agg(F.count("*").alias("n"))


def leaks(tables: dict[str, DataFrame]) -> DataFrame:
    """(output, column, shape, n) over several tables."""
    parts = [leaked(df).select(F.lit(name).alias("output"), "column", "shape", "n") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)

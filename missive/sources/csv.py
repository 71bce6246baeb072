"""Message batches from CSV files or CSV text, and other small tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive import schema as S
from missive.functions.order import numbered_in_order

#: limits of one upload
MAX_BYTES, MAX_ROWS, MAX_FILES = 8 << 20, 20_000, 6


def decode_upload(raw: bytes) -> str:
    """Text of an upload: UTF-8 with or without mark, else Latin-1."""
    if len(raw) > MAX_BYTES:
        raise ValueError(f"an upload may hold {MAX_BYTES} bytes, this one has {len(raw)}")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def is_content(source: str) -> bool:
    """Whether a string is CSV text and no path: it has a line end, or no short name of an existing file."""
    return "\n" in source or len(source) >= 255


def read_messages(spark: SparkSession, source: str | Iterable[str], strict: bool = True) -> DataFrame:
    """(message_id, timestamp, sender, message) from a path, CSV text or an iterable of lines.

    Surplus fields of a row are dropped, missing ones are null, a byte-order mark is
    ignored. ``strict``: raise ValueError for missing columns or an empty batch.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}
    if not isinstance(source, str) or is_content(source):
        text = source if isinstance(source, str) else "\n".join(line.rstrip("\r\n") for line in source)
        rows = _parsed(spark, text.removeprefix("﻿"))
        names = rows[0] if rows else []
        _check_columns(names)
        at = [names.index(c) for c in S.REQUIRED]
        data = [tuple(r[i] if i < len(r) else None for i in at) for r in rows[1:]]
        if strict and not data:
            raise ValueError("the batch has no rows")
        return spark.createDataFrame(data, S.MESSAGE)
    names = spark.read.options(**options).csv(source).columns
    _check_columns(names)
    df = spark.read.options(**options).schema(", ".join(f"`{n}` string" for n in names)).csv(source).select(*S.REQUIRED)
    if strict and df.isEmpty():
        raise ValueError("the batch has no rows")
    return df


def _parsed(spark: SparkSession, text: str) -> list[list[str]]:
    """Records of CSV text; a batch given as text is small by nature."""
    import csv
    import io

    return [r for r in csv.reader(io.StringIO(text)) if r]


def _check_columns(names: list[str]) -> None:
    missing = [c for c in S.REQUIRED if c not in names]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}; found: {', '.join(names) or 'none'}")


def batch_kind(name: str, position: int) -> str:
    """Kind of a batch from its name, else from its position."""
    lowered = name.lower()
    return "demo" if "demo" in lowered else "l2" if "l2" in lowered or position else "l1"


def stacked(batches: list[tuple[str, DataFrame]]) -> DataFrame:
    """Batches in the given order: adds batch_idx, batch_name, batch_kind and tenant."""
    out = None
    for i, (name, df) in enumerate(batches):
        one = df.select(*S.REQUIRED).withColumns({"batch_idx": F.lit(i), "batch_name": F.lit(name), "batch_kind": F.lit(batch_kind(name, i)), "tenant": F.lit("")})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no batch was given")
    return out


def sequenced(messages: DataFrame) -> DataFrame:
    """Add seq: a tenant's messages by batch, then timestamp and id as strings; sorted by the hour."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    hour = F.struct(F.col("batch_idx"), F.left(blank("timestamp"), F.lit(13)))
    return numbered_in_order(messages, ["tenant"], hour, [F.col("batch_idx"), blank("timestamp"), blank("message_id")], "seq")


def read_ids(spark: SparkSession, path: str, column: str = "message_id") -> DataFrame:
    """A list of ids from a CSV file with a header."""
    return spark.read.option("header", True).csv(path).select(F.col(column).alias("message_id"))


def read_queries(spark: SparkSession, path: str, column: str = "query") -> DataFrame:
    """(query_id, text) from a CSV file with a header, numbered in the file's order."""
    rows = spark.read.option("header", True).csv(path).select(F.col(column).alias("text"), F.monotonically_increasing_id().alias("_row"))
    return numbered_in_order(rows, [], F.shiftright("_row", 20), [F.col("_row")], "query_id").drop("_row")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(message_id, category, template_hash, ambiguous) gold labels."""
    return spark.read.option("header", True).schema("message_id string, category string, template_hash string, ambiguous boolean").csv(path)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; arrays of strings are joined by blanks, other nested values written as JSON."""
    flat = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        flat.append(F.array_join(f.name, " ").alias(f.name) if kind == "array<string>" else F.to_json(f.name).alias(f.name) if kind.startswith(("array", "struct", "map")) else F.col(f"`{f.name}`"))
    df = df.select(*flat)
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)

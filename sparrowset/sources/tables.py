"""Scans, typed row input and text output."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowset.operators.filters import VALID, compact

#: Declared types and the bit widths they store.
INT_WIDTHS = (2, 4, 8, 16, 32, 64)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None, prefix: bool = False, separator: str = "_") -> DataFrame:
    """A table, all of it or some columns (only those are read), optionally renamed <table><separator><column>."""
    df = parquet(spark, sf_dir, name)
    if columns is not None:
        df = df.select(*[f"`{c}`" for c in columns])
    return prefixed(df, name, separator) if prefix else df


def prefixed(df: DataFrame, table: str, separator: str = "_") -> DataFrame:
    return df.toDF(*[f"{table}{separator}{c}" for c in df.columns])


def type_width(declared: str) -> int:
    """1 for BOOLEAN, n for INT(n); other types are errors."""
    text = declared.replace(" ", "").upper()
    if text in ("BOOLEAN", "BOOL"):
        return 1
    if text.startswith("INT(") and text.endswith(")") and text[4:-1].isdigit() and int(text[4:-1]) in INT_WIDTHS:
        return int(text[4:-1])
    raise ValueError(f"Unsupported data type: {declared}")


def schema(columns: Sequence[tuple[str, int]], key: str | None = None) -> T.StructType:
    """Longs with their width, and whether they are the key, in the field's metadata."""
    return T.StructType([T.StructField(name, T.LongType(), False, {"width": width, "key": name == key}) for name, width in columns])


def in_range(value: int, width: int) -> bool:
    """Non-negative below 2^width; at width 64 any signed 64-bit number."""
    return -(1 << 63) <= value < 1 << 63 if width == 64 else 0 <= value < 1 << width


def typed_row(kind: T.StructType, values: dict[str, int]) -> tuple[int, ...]:
    """One row in the schema's order; columns without a value are 0; unknown columns and values out of range are errors."""
    known = set(kind.fieldNames())
    if unknown := set(values) - known:
        raise ValueError(f"Unknown column: {', '.join(sorted(unknown))}")
    for field in kind:
        if not in_range(values.get(field.name, 0), field.metadata["width"]):
            raise ValueError(f"Value {values[field.name]} is out of range for {field.name} of width {field.metadata['width']}")
    return tuple(values.get(name, 0) for name in kind.fieldNames())


def rows(spark: SparkSession, kind: T.StructType, values: Iterable[Sequence[int]]) -> DataFrame:
    """A table from rows; a row of another length is an error."""
    checked = [typed_row(kind, dict(zip(kind.fieldNames(), r, strict=True))) for r in values]
    return spark.createDataFrame(checked, kind)


def random_table(spark: SparkSession, n: int, names: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows of whole numbers spread over [0, 2^63), the same ones for the same seed."""
    return spark.range(n).select(*[F.xxhash64("id", F.lit(seed), F.lit(k)).bitwiseAND(F.lit((1 << 63) - 1)).alias(name) for k, name in enumerate(names)])


#: Rows that a text table shows unless it is told otherwise.
SHOWN = 1000
#: The debug table's name for the validity mark.
VALID_HEAD = "$valid"


def _boxed(df: DataFrame, limit: int) -> str:
    found = df.limit(limit + 1).collect()
    n = len(found) if len(found) <= limit else df.count()
    found = found[:limit]
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in found]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    body = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "|" for r in cells]
    total = f"({n} row{'' if n == 1 else 's'})" if n == len(found) else f"(first {len(found)} of {n} rows)"
    return "\n".join([rule, body[0], rule, *body[1:], rule, total])


def text_table(df: DataFrame, limit: int = SHOWN) -> str:
    """A boxed text table of at most `limit` rows, the number of all rows below. Rows that aren't valid don't count."""
    return _boxed(compact(df), limit)


def debug_table(df: DataFrame, limit: int = SHOWN) -> str:
    """The same with all rows, and whether each is valid in a last column."""
    valid = F.col(VALID) if VALID in df.columns else F.lit(True)
    return _boxed(df.select(*[f"`{c}`" for c in df.columns if c != VALID], valid.cast("int").alias(VALID_HEAD)), limit)

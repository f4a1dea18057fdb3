"""Databases and tables of typed-width integers, held by one engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparrowset.sources import tables


@dataclass
class Table:
    """Rows that INSERT added, behind those of a frame that was attached, if any."""

    name: str
    schema: T.StructType
    base: DataFrame | None = None
    added: list[tuple] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def frame(self, spark: SparkSession) -> DataFrame:
        new = spark.createDataFrame(self.added, self.schema) if self.added or self.base is None else None
        return new if self.base is None else self.base if new is None else self.base.unionByName(new)


class Catalog:
    """A current database must be chosen before tables are used. Names are exact."""

    def __init__(self, spark: SparkSession):
        self.spark, self.databases, self.current = spark, {}, None

    def create_database(self, name: str) -> None:
        if name in self.databases:
            raise ValueError(f"Database {name} exists already")
        self.databases[name] = {}

    def drop_database(self, name: str) -> None:
        if name not in self.databases:
            raise ValueError(f"No database {name}")
        del self.databases[name]
        if self.current == name:
            self.current = None

    def use(self, name: str) -> None:
        if name not in self.databases:
            raise ValueError(f"No database {name}")
        self.current = name

    @property
    def tables(self) -> dict[str, Table]:
        if self.current is None:
            raise ValueError("No database is in use")
        return self.databases[self.current]

    def create_table(self, name: str, columns: list[tuple[str, str]], key: str | None = None) -> Table:
        """columns: (name, BOOLEAN or INT(n)). key: one column or none; it isn't enforced to be unique."""
        if name in self.tables:
            raise ValueError(f"Table {name} exists already")
        names = [c for c, _ in columns]
        if len({*names}) < len(names) or not names:
            raise ValueError("Columns need different names")
        if key is not None and key not in names:
            raise ValueError(f"No column {key}")
        self.tables[name] = Table(name, tables.schema([(c, tables.type_width(kind)) for c, kind in columns], key))
        return self.tables[name]

    def attach(self, name: str, df: DataFrame) -> Table:
        """A frame as a table, for example one read from Parquet; columns of any type."""
        self.tables[name] = Table(name, df.schema, df)
        return self.tables[name]

    def drop_table(self, name: str) -> None:
        self.table(name)
        del self.tables[name]

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise ValueError(f"No table {name}")
        return self.tables[name]

    def insert(self, name: str, values: list[int], columns: list[str] | None = None) -> None:
        t = self.table(name)
        columns = columns or t.columns
        if len(columns) != len(values) or len({*columns}) < len(columns):
            raise ValueError(f"{len(values)} values for {len(columns)} columns")
        t.added.append(tables.typed_row(t.schema, dict(zip(columns, values, strict=True))))

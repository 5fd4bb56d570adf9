"""The ledger: 17 tables as DataFrames plus the reference time ``as_of``."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas


def ts(value: datetime) -> Column:
    """Literal TIMESTAMP_NTZ (a plain ``lit`` would carry the session zone)."""
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def unique_key(table: str) -> list[Column]:
    """The table's unique key as columns k0, k1, ...; absent optional parts are ""."""
    return [(F.coalesce(c, F.lit("")) if c in schemas.OPTIONAL_KEYS else F.col(c)).alias(f"k{i}") for i, c in enumerate(schemas.UNIQUE_KEYS[table])]


def key_hash(columns: list[str]) -> Column:
    return F.xxhash64(*columns)


@dataclass(frozen=True)
class Ledger:
    """Immutable set of ledger tables.  Nothing here reads the clock."""

    tables: Mapping[str, DataFrame]
    as_of: datetime
    session: SparkSession | None = None
    memo: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    #: Name of the stored version the tables were read from, and what was changed since: the rows written to
    #: each table in their last state, and the tables replaced as a whole.
    version: str | None = None
    delta: Mapping[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    rewritten: frozenset[str] = frozenset()
    #: How to read only the stored parts of a table that can hold some keys: (table, keys) -> rows, or None for all of it.
    parts: Callable[[str, DataFrame], DataFrame | None] | None = field(default=None, compare=False, repr=False)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def active(self, name: str) -> DataFrame:
        return self.tables[name].filter(F.col("deleted_at").isNull())

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a table whose key is in ``keys`` (its one column, named like the first key column).

        A stored ledger reads only the buckets that these keys fall into, so a small manifest does not scan large tables.
        """
        key = schemas.KEYS[name][0]
        stored = self.parts(name, keys) if self.parts and name not in self.rewritten else None
        if stored is None:
            stored = self.tables[name]
        elif name in self.delta:
            own = list(schemas.KEYS[name])
            stored = stored.join(self.delta[name].select(*own), own, "left_anti").select(*stored.columns).unionByName(self.delta[name].select(*stored.columns))
        return stored.join(keys.select(key).distinct(), key, "left_semi")

    def holders(self, name: str, keys: DataFrame) -> DataFrame:
        """(id, k0, k1, ...) of active rows that hold one of the unique keys in ``keys`` (k0, k1, ...; see ``unique_key``).

        A stored ledger finds them through its key index and reads the buckets of the rows found.
        """
        on = [f"k{i}" for i in range(len(schemas.UNIQUE_KEYS[name]))]
        wanted = keys.select(*on).distinct()
        ids = self.parts(f"key_{name}", wanted.select(key_hash(on).alias("k"))) if self.parts and name not in self.rewritten else None
        if ids is None:
            rows = self.active(name)
        else:
            ids = ids.join(wanted.select(key_hash(on).alias("k")).distinct(), "k", "left_semi").select("id")
            if name in self.delta:
                ids = ids.unionByName(self.delta[name].select("id"))
            rows = self.rows_of(name, ids).filter(F.col("deleted_at").isNull())
        return rows.select("id", *unique_key(name)).join(wanted, on, "left_semi")

    @property
    def now(self) -> Column:
        return ts(self.as_of)

    def ago(self, hours: float) -> Column:
        return ts(self.as_of - timedelta(hours=hours))

    def hours_since(self, column: Column) -> Column:
        micros = F.unix_micros(self.now.cast("timestamp")) - F.unix_micros(column.cast("timestamp"))
        return micros / F.lit(3600000000.0)

    def once(self, key: str, build) -> DataFrame:
        """Build a shared intermediate (retry closure, ...) once per ledger object."""
        if key not in self.memo:
            self.memo[key] = build()
        return self.memo[key]

    def with_tables(self, **tables: DataFrame) -> "Ledger":
        return replace(self, tables={**self.tables, **tables}, memo={}, rewritten=self.rewritten | set(tables))

    def with_rows(self, delta: Mapping[str, DataFrame], fresh: Mapping[str, DataFrame] | None = None) -> "Ledger":
        """Ledger with rows put in: those of ``delta`` replace rows of the same key, those of ``fresh`` have keys no row has."""
        fresh, tables, rows = fresh or {}, dict(self.tables.items()), dict(self.delta)
        for name in {**delta, **fresh}:
            new, table = None, self.tables[name]
            for df, replaces in ((delta.get(name), True), (fresh.get(name), False)):
                if df is None:
                    continue
                if replaces:
                    table = table.join(df.select(*schemas.KEYS[name]), list(schemas.KEYS[name]), "left_anti").select(*table.columns)
                new = df if new is None else new.unionByName(df)
            tables[name] = table.unionByName(new.select(*table.columns))
            if name in rows:
                new = rows[name].join(new.select(*schemas.KEYS[name]), list(schemas.KEYS[name]), "left_anti").unionByName(new)
            rows[name] = new
        return replace(self, tables=tables, memo={}, delta=rows)

    @property
    def spark(self) -> SparkSession:
        return self.session or next(iter(self.tables.values())).sparkSession

    @property
    def inventory(self) -> DataFrame:
        """Observed files (path, mtime, size); a ledger without one sees no files."""
        try:
            return self.tables["inventory"]
        except KeyError:
            return self.spark.createDataFrame([], "path string, mtime double, size bigint")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` on the table's columns; absent columns become typed NULL or ``{}``."""
    present = set(df.columns)
    cols = []
    for fld in schemas.struct(table):
        if fld.name in present:
            cols.append(F.col(fld.name).cast(fld.dataType).alias(fld.name))
        elif fld.name.endswith("_json") and not fld.nullable:
            cols.append(F.lit("{}").alias(fld.name))
        elif fld.name == "code_dirty":
            cols.append(F.lit(0).alias(fld.name))
        else:
            cols.append(F.lit(None).cast(fld.dataType).alias(fld.name))
    return df.select(*cols)


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schemas.struct(table))

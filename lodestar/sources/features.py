"""Feature tables with event times: definitions, groups, merges, and retrieval without leakage (one as-of join a table)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, windows
from .tables import append_keep_last


@dataclass(frozen=True)
class FeatureDefinition:
    """value aggregated by function over a window of an event table."""

    name: str
    value: str
    function: str
    window: str

    def __post_init__(self):
        if self.function not in windows.FUNCTIONS:
            raise ValueError(f"function {self.function} is not known")


@dataclass
class Registry:
    definitions: dict[str, FeatureDefinition] = field(default_factory=dict)

    def register(self, *definitions: FeatureDefinition) -> None:
        for d in definitions:
            if d.name in self.definitions:
                raise ValueError(f"feature {d.name} is registered already")
            self.definitions[d.name] = d

    def compute(self, events: DataFrame, entity: str, time: str, reference: str, names: Sequence[str] | None = None) -> DataFrame:
        """All features in one aggregation."""
        chosen = [self.definitions[n] for n in names or self.definitions]
        values: dict[str, list[str]] = {}
        for d in chosen:
            values.setdefault(d.value, [])
            if d.function not in values[d.value]:
                values[d.value].append(d.function)
        plan = windows.WindowPlan(list(dict.fromkeys(d.window for d in chosen)), values, False, False, False)
        out = windows.aggregate(events, entity, time, plan, reference)
        return out.select(entity, *[F.col(f"{d.value}_{d.function}_{d.window}").alias(d.name) for d in chosen])


class FeatureStore:
    """Feature tables in a database of the session's catalog."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database
        spark.sql(f"create database if not exists `{database}`")

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def write(self, df: DataFrame, table: str, keys: Sequence[str], time: str, mode: str = "merge") -> None:
        """overwrite, append, or merge (of rows with equal keys and time the newly written one stays)."""
        there = self.spark.catalog.tableExists(f"{self.database}.{table}")
        if mode == "merge" and there:
            merged = append_keep_last(self.spark.table(self._name(table)), df, [*keys, time], time)
            # the table is read and replaced: its new rows are written beside it first
            merged.write.mode("overwrite").saveAsTable(self._name(f"{table}__new"))
            self.spark.table(self._name(f"{table}__new")).write.mode("overwrite").saveAsTable(self._name(table))
            self.delete(f"{table}__new")
            return
        df.write.mode("append" if mode == "append" and there else "overwrite").saveAsTable(self._name(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def delete(self, table: str) -> None:
        self.spark.sql(f"drop table if exists {self._name(table)}")

    def historical(self, spine: DataFrame, entity: str, time: str, refs: Sequence[str], table_time: str = "event_timestamp") -> DataFrame:
        """spine with features `table:column` as they were known at its times."""
        by: dict[str, list[str]] = {}
        for ref in refs:
            table, column = ref.split(":")
            by.setdefault(table, []).append(column)
        for table, columns in by.items():
            spine = joins.asof(spine, self.read(table), [entity], time, table_time, columns).drop(f"matched_{table_time}")
        return spine

    def latest(self, entities: DataFrame, entity: str, table: str, columns: Sequence[str], table_time: str = "event_timestamp") -> DataFrame:
        newest = self.read(table).groupBy(entity).agg(*[F.max_by(c, table_time).alias(c) for c in columns])
        return entities.join(newest, entity, "left")

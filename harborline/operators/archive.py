"""Moving postings with all their rows between two stores of several tables, so that a stop at any place loses nothing.

A manifest holds the ids of the move and a record for each step that is done. Every step may be repeated: a table is written
beside the old one and renamed when it is whole. The target gets its rows parents first, and is verified; only then the
source loses them, children first. A call after a stop goes on behind the last recorded step, with the ids of the
first call.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """``key`` tells rows of the table apart, ``parent`` is the column with the posting's id; ``changed`` are columns that
    get a new value on the way (name, SQL)."""

    name: str
    key: str
    parent: str
    changed: tuple[tuple[str, str], ...] = ()


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, at: str) -> bool:
        return self.fs.exists(self.path(at))

    def delete(self, at: str) -> None:
        self.fs.delete(self.path(at), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"couldn't rename {old}")

    def swap(self, at: str) -> None:
        """The staged table in place of the old one; nothing where that was done before."""
        if self.exists(f"{at}.next"):
            if self.exists(at):
                self.delete(f"{at}.previous")
                self.rename(at, f"{at}.previous")
            self.rename(f"{at}.next", at)


def steps_of(tables: list[Table]) -> list[tuple[str, str]]:
    """(phase, table) of all steps in order; ``tables`` are named parents first."""
    add = [(phase, t.name) for t in tables for phase in ("stage", "commit")]
    check = [("verify", t.name) for t in tables]
    drop = [(phase, t.name) for t in reversed(tables) for phase in ("shrink", "release")]
    return [("ids", ""), *add, *check, *drop]


def move_postings(spark: SparkSession, ids: DataFrame, source: str, target: str, tables: list[Table], manifest: str, before: Callable[[str, str], None] | None = None) -> DataFrame:
    """Move the rows of ``ids`` (one column) from the Parquet tables below ``source`` to those below ``target``; return the
    manifest's (phase, table, rows).

    Rows that the target has already are replaced, so a repeated move changes nothing. Null and repeated ids count for
    nothing; a table that the source lacks is skipped, one that the target lacks is made. Verification raises ValueError
    where the target lacks a key, before the source loses a row. ``before`` is called with each step that is still to be
    done. Two moves of the same tables must not run at once.
    """
    files, by_name = _Files(spark, manifest), {t.name: t for t in tables}
    column = ids.columns[0]

    def of_ids(t: Table, how: str) -> DataFrame:
        rows, wanted = spark.read.parquet(f"{source}/{t.name}"), spark.read.parquet(f"{manifest}/ids").withColumnRenamed("id", t.parent)
        return rows.join(wanted, t.parent, how).select(*rows.columns)

    def run(phase: str, t: Table | None) -> int:
        if phase == "ids":
            ids.select(F.col(column).alias("id")).filter("id IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{manifest}/ids")
            return spark.read.parquet(f"{manifest}/ids").count()
        here, there = f"{source}/{t.name}", f"{target}/{t.name}"
        if not files.exists(here) and not files.exists(f"{here}.next"):
            return 0
        if phase == "stage":
            rows = of_ids(t, "left_semi").withColumns({c: F.expr(v) for c, v in t.changed})
            if files.exists(there):
                old = spark.read.parquet(there)
                rows = old.join(rows.select(t.key), t.key, "left_anti").select(*old.columns).unionByName(rows, allowMissingColumns=True)
            rows.write.mode("overwrite").parquet(f"{there}.next")
            return spark.read.parquet(f"{there}.next").count()
        if phase == "commit":
            files.swap(there)
            return spark.read.parquet(there).count()
        if phase == "verify":
            keys = of_ids(t, "left_semi").select(t.key).distinct()
            lost = keys.join(spark.read.parquet(there).select(t.key), t.key, "left_anti").count()
            if lost:
                raise ValueError(f"{lost} rows of {t.name} aren't in {target}")
            return keys.count()
        if phase == "shrink":
            of_ids(t, "left_anti").write.mode("overwrite").parquet(f"{here}.next")
            return spark.read.parquet(f"{here}.next").count()
        files.swap(here)
        return spark.read.parquet(here).count()

    for phase, name in steps_of(tables):
        record = f"{manifest}/steps/phase={phase}/table={name or 'all'}"
        if not files.exists(f"{record}/_SUCCESS"):
            if before is not None:
                before(phase, name)
            n = run(phase, by_name.get(name))
            spark.createDataFrame([(n,)], "rows long").coalesce(1).write.mode("overwrite").parquet(record)
    return spark.read.parquet(f"{manifest}/steps").select("phase", "table", "rows")


def is_done(spark: SparkSession, tables: list[Table], manifest: str) -> bool:
    """Whether the move of ``manifest`` has ended."""
    phase, name = steps_of(tables)[-1]
    return _Files(spark, manifest).exists(f"{manifest}/steps/phase={phase}/table={name}/_SUCCESS")

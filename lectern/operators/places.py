"""Places of rows in an order over many tasks: each task numbers its own rows, prefix sums over the tasks' counts do the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.layout import stored

#: Bits of a task-local number that `monotonically_increasing_id` leaves for the row.
TASK_BITS = 33


def task_of(at: str) -> Column:
    """The task part of a number by `monotonically_increasing_id`."""
    return F.shiftright(F.col(at), TASK_BITS)


def same(keys: Sequence[str]) -> Column | list[Column]:
    """Condition of a join of `l` and `r` on keys, null like null; without keys every row meets."""
    return [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys] if keys else F.lit(True)


def runs(frame: DataFrame, at: str, run: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """One row for each run of rows that one task numbered in a row: its least number, the rows of earlier runs, and
    the rows of all runs. Runs follow in the order of `run`; with `within`, each of its groups is counted for itself."""
    rows = frame.groupBy(*within, *run).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    before = Window.partitionBy(*within).orderBy(*run).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*within, *run, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*within)).alias("_total"))


def placed(frame: DataFrame, at: str, run: Sequence[str], within: Sequence[str] = (), place: str = "place", total: str | None = None, small: bool = False) -> DataFrame:
    """frame with each row's place from 0, without gap or repeat, by `run` and then `at`.

    `at` numbers the rows of a run one after another, in one task. Only the runs, a row for each task and group at most,
    are sorted together; the rows stay where they are if the runs are few enough for Spark to send them to all, which
    `small` says that they are. Empty frames stay empty; runs whose values are null come first.
    """
    counted = runs(frame, at, run, within)
    if small:
        counted = F.broadcast(counted)
    keys = [*within, *run]
    sides = frame.alias("l").join(counted.alias("r"), same(keys))
    found = [(F.col("r._before") + F.col(f"l.`{at}`") - F.col("r._first")).alias(place)]
    if total is not None:
        found.append(F.col("r._total").alias(total))
    return sides.select(*[F.col(f"l.`{c}`") for c in frame.columns], *found)


def in_order(frame: DataFrame, by: Sequence[str], order: Sequence[str], place: str = "_place", total: str | None = None) -> DataFrame:
    """frame with each row's place from 0 by `order` in its group of `by`: ranges of (by, order) over all tasks, stored,
    then numbered by `placed`. No group is sorted in one task."""
    every = [*by, *order]
    dealt = frame.repartitionByRange(*[F.col(f"`{c}`") for c in every]).sortWithinPartitions(*[F.col(f"`{c}`") for c in every])
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", task_of("_at")), "in-order")
    return placed(dealt, "_at", ["_task"], by, place=place, total=total).drop("_at", "_task")


def any_larger(frame: DataFrame, by: Sequence[str], most: int) -> bool:
    """Whether some group has more than `most` rows."""
    return bool(frame.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).count())

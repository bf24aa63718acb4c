"""As-of join of two tables: for each row the newest state of its key at that row's own time.

A window over (key, time) alone would put every row of a hot key into one task. Instead both sides are
folded to distinct (key, time), time is cut into slots, and only a slot is walked as a whole:

* within a slot, the last state before each asked time comes from a window over (key, slot);
* the newest state of each slot, one row per key and slot, is carried forward over the slots that have none.

The first window holds the distinct times of one slot, the second the slots of one key, whatever the
number of rows. Copies of a time meet again in an equality join, which the optimizer may split.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from .ranking import best_row

DAY = 86_400_000_000


def micros(df: DataFrame, column: str) -> Column:
    """A date or time as microseconds; days of a date all have the same length."""
    if isinstance(df.schema[column].dataType, DateType):
        return F.unix_date(column).cast("long") * DAY
    return F.unix_micros(F.col(column).cast("timestamp"))


def latest_before(asked: DataFrame, states: DataFrame, keys: list[str], at: str, since: str, tie: str,
                  within_days: float | None = None, slot_days: float = 1.0, name: str = "state") -> DataFrame:
    """All rows of `asked` with the state that held at its time, as a struct column; null where there is none.

    The state is the row of `states` with equal keys and the greatest `since` that is no later than `at`, and no
    more than `within_days` before it, if given. Of states with one key and time the least `tie` counts. Rows with a
    null key or time get none; states with a null key, time or tie are left out. Repeated rows all stay. Narrower
    slots spread a hot key further. Columns of `asked` keep their names, whatever `states` calls its own; one that
    bears the added name is replaced.
    """
    slot = lambda: F.floor(F.col("_t") / F.lit(slot_days * DAY)).cast("long")
    ks = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, ks)]
    rows = asked.select(F.struct(*asked.columns).alias("_row"), *named, micros(asked, at).alias("_t"))
    times = rows.select(*ks, "_t").dropna().distinct().withColumn("_slot", slot())
    known = states.select(*named, micros(states, since).alias("_t"), F.col(tie).alias("_tie"), F.struct(*states.columns).alias("_state")).dropna(subset=[*ks, "_t", "_tie"])
    known = best_row(known, [*ks, "_t"], ["_tie"]).drop("_tie").withColumn("_slot", slot())

    def both(left: DataFrame) -> DataFrame:
        """Asked times and states in one frame, states first where times are equal."""
        return left.withColumn("_asks", F.lit(True)).unionByName(known.withColumn("_asks", F.lit(False)), allowMissingColumns=True)

    inside = Window.partitionBy(*ks, "_slot").orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.struct("_t", "_state")
    here = (both(times).withColumn("_here", F.last(F.when(~F.col("_asks"), found), ignorenulls=True).over(inside))
            .where("_asks").select(*ks, "_t", "_slot", "_here"))
    newest = best_row(known, [*ks, "_slot"], [F.desc("_t")]).select(*ks, "_slot", found.alias("_newest"))
    earlier = Window.partitionBy(*ks).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (newest.unionByName(times.select(*ks, "_slot").distinct().join(newest.select(*ks, "_slot"), [*ks, "_slot"], "left_anti"), allowMissingColumns=True)
               .withColumn("_before", F.last("_newest", ignorenulls=True).over(earlier)).select(*ks, "_slot", "_before"))
    last = F.coalesce("_here", "_before")
    fresh = F.lit(True) if within_days is None else last["_t"] >= F.col("_t") - F.lit(int(within_days * DAY))
    answer = here.join(carried, [*ks, "_slot"], "left").select(*ks, "_t", F.when(fresh, last["_state"]).alias("_found"))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in asked.columns if c != name]
    return rows.join(answer, [*ks, "_t"], "left").select(*kept, F.col("_found").alias(name))

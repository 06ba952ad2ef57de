"""Items that need a day of their own move forward to the next free one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.ranges import checked_rules


def free_days(days: DataFrame, day: str, blocked: str) -> DataFrame:
    """day, first_free, slot of a dense calendar (day, blocked): the first free day from it on and that day's number.

    A calendar has one row for a day, so its running window is short whatever
    the number of items. Days after the last free one have null.
    """
    forward = Window.orderBy(day)
    numbered = days.select(F.col(day), F.col(blocked), F.sum(F.when(F.col(blocked), 0).otherwise(1)).over(forward).alias("__n"))
    free = F.when(~F.col(blocked), F.struct(F.col(day).alias("day"), F.col("__n").alias("slot")))
    after = Window.orderBy(F.col(day).desc())
    x = numbered.select(day, F.last(free, ignorenulls=True).over(after).alias("__f"))
    return x.select(day, F.col("__f.day").alias("first_free"), F.col("__f.slot").cast("long").alias("slot"))


def displace(items: DataFrame, keys: list[str], day: str, tie: str, calendar: DataFrame, horizon: int = 60) -> DataFrame:
    """items with moved_to: the day each one gets inside its group, and whether that is within the horizon.

    In order of day and tie, an item takes the first free day that no item
    before it has taken. In numbers of items before a slot that is a running
    maximum: earlier moves so push later ones, without a loop. calendar is free_days();
    items whose day is null or beyond it get null. A move beyond the horizon
    is marked, and keeps its slot.
    """
    placed = items.join(checked_rules(calendar), day, "left")
    # by key and slot first: a key's running window then has a row for each day at most, however many items it has
    counts = placed.where("slot is not null").groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("__c"))
    running = Window.partitionBy(*keys).orderBy("slot")
    counts = counts.withColumn("__before", F.sum("__c").over(running) - F.col("__c"))
    counts = counts.withColumn("__base", F.col("__before") + F.max(F.col("slot") - 1 - F.col("__before")).over(running))
    rank = F.row_number().over(Window.partitionBy(*keys, "slot").orderBy(day, tie))
    placed = placed.withColumn("__rank", rank)
    known = placed.join(counts.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, "slot")], "__base"), [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, "slot")], "left")
    known = known.withColumn("__slot", F.col("__base") + F.col("__rank"))
    slots = calendar.where(F.col(day) == F.col("first_free")).select(F.col("slot").alias("__slot"), F.col(day).alias("moved_to"))
    out = known.join(checked_rules(slots), "__slot", "left").select(*items.columns, "moved_to")
    return out.withColumn("in_time", F.datediff("moved_to", day) <= horizon)

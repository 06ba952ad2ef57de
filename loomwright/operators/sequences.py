"""Operators on ordered rows: carried state, numbering, pruning, zipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], reset: Column) -> DataFrame:
    """rows with each of `values` (name: expression, null where a row sets nothing) as last set at or before the row, forgotten at a row where reset holds.

    A reset row's own value counts. State never passes from one key to another.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = rows.withColumn("__part", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    inner = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, value in values.items():
        x = x.withColumn(name, F.last(value, ignorenulls=True).over(inner))
    return x.drop("__part")


def number_repeats(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """rows with slot (1, 2, ... under the keys), occurrence (of the value under the keys) and repeated."""
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    nth = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order))
    return rows.withColumn("slot", slot).withColumn("occurrence", nth).withColumn("repeated", F.col("occurrence") > 1)


def prune_headings(rows: DataFrame, keys: list[str], position: str, level: str, deepest: int) -> DataFrame:
    """rows without headings (level 0 to deepest; null: content) that hold no content before the next heading of their level or a higher one."""
    later = Window.partitionBy(*keys).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    content = F.min(F.when(F.col(level).isNull(), F.col(position))).over(later)
    end = F.coalesce(*[F.when(F.col(level) == n, F.min(F.when(F.col(level) <= n, F.col(position))).over(later)) for n in range(deepest + 1)])
    x = rows.withColumn("__content", content).withColumn("__end", end)
    return x.where(F.col(level).isNull() | (F.col("__content") < F.coalesce("__end", F.col("__content") + 1))).drop("__content", "__end")


def positional_zip(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Pairs of rows at the same place under the keys, up to the first place where the labels differ or one side ends: keys, place, label, left, right (structs of the other columns)."""
    w = Window.partitionBy(*keys).orderBy(*order)

    def side(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.withColumn("place", F.row_number().over(w)).select(*keys, "place", F.col(label).alias(f"__{name}"), F.struct(*rest).alias(name))

    both = side(left, "left").join(side(right, "right"), [*keys, "place"])
    so_far = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    same = F.min(F.col("__left").eqNullSafe(F.col("__right")).cast("int")).over(so_far)
    return both.withColumn("__same", same).where("__same = 1").select(*keys, "place", F.col("__left").alias(label), "left", "right")


def consume(demands: DataFrame, pool: DataFrame, label: str, order: str, many: str, pool_order: str) -> DataFrame:
    """Each demand takes the next `many` items of its label in order: the demand's columns, nth and item (struct of the pool's columns, null once the pool is used up)."""
    w = Window.partitionBy(label)
    asked = demands.where(F.col(many) > 0).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col(many))))
    asked = asked.withColumn("__place", F.row_number().over(w.orderBy(order, "nth")))
    items = pool.select(label, F.row_number().over(w.orderBy(pool_order)).alias("__place"), F.struct(*[c for c in pool.columns if c != label]).alias("item"))
    return asked.join(items, [label, "__place"], "left").drop("__place")

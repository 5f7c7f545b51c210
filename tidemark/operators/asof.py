"""As-of join: for each row the newest row of another table with its keys that isn't later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.workdir import staged


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, *, ties: list[str] | None = None, strict: bool = False, name: str = "matched") -> DataFrame:
    """``left`` with a struct column ``name``: of the right rows with its keys ``by`` the last one up to its time, or null.

    With ``strict`` a right row of the same time is too late. Right rows of one time are
    settled by ``ties``, then by a hash of the row; the last one counts. Left rows with a
    null key or time match nothing and stay; right ones with such are left out. Rows that
    repeat stay as they are.

    Both tables are put into one order of keys and time, which is cut into ranges whatever
    the keys are: a key with a third of all rows lies in many ranges. Inside a range the
    last right row is carried on; a key that began in an earlier range gets the last one
    from there, a row a range at most, which is broadcast. A column is kept once in what is
    shuffled and written, and what only settles the order is made again from it.
    """
    names, sides = [f"__k{i}" for i in range(len(by))], [*zip(by, by, strict=True), (left_time, right_time)]
    shared = {pair: n for pair, n in zip(sides, [*names, "__at"], strict=True) if left.schema[pair[0]].dataType == right.schema[pair[1]].dataType}
    of_left, of_right = ({pair[i]: n for pair, n in shared.items()} for i in (0, 1))

    def part(df: DataFrame, time: str, own: dict[str, str], name: str) -> DataFrame:
        rest = [F.col(f"`{c}`") for c in df.columns if c not in own] or [F.lit(True).alias("__row")]
        return df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(time).alias("__at"), F.struct(*rest).alias(name))

    def row(df: DataFrame, own: dict[str, str], name: str) -> list[Column]:
        return [(F.col(own[c]) if c in own else F.col(f"{name}.`{c}`")).alias(c) for c in df.columns]

    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, right_time]])
    both = part(left, left_time, of_left, "__left").unionByName(part(right.where(known), right_time, of_right, "__right"), allowMissingColumns=True)
    lefts, rights = row(left, of_left, "__left"), dict(zip(right.columns, row(right, of_right, "__right"), strict=True))
    is_right = F.col("__right").isNotNull()
    # at one time right rows come first, or last where they are too late
    side = F.when(is_right, 2 if strict else 0).otherwise(1)
    tie = F.when(is_right, F.struct(*[rights[c].alias(f"t{i}") for i, c in enumerate(ties or [])], F.xxhash64(*rights.values()).alias("h")))
    newest = F.when(is_right, F.struct(*rights.values()))
    ranged = staged(both.repartitionByRange(*names, "__at", side, tie, F.xxhash64(*lefts)).withColumn("__range", F.spark_partition_id()), "as-of-ranges")
    # a range's last right row: a key that goes on in the next range has none after it
    ends = ranged.groupBy("__range").agg(F.max_by(F.when(is_right, F.struct(*names, newest.alias("__carried"))), F.when(is_right, F.struct(*names, "__at", tie))).alias("__end"))
    carried = ends.select("__range", F.last("__end", ignorenulls=True).over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)).alias("__end")).where("__end is not null").select("__range", "__end.*")
    dealt = ranged.repartition("__range", *names)  # before the window, so that what it makes isn't shuffled
    inside = F.last(newest, ignorenulls=True).over(W.partitionBy("__range", *names).orderBy("__at", side, tie).rowsBetween(W.unboundedPreceding, 0))
    joined = dealt.withColumn("__inside", inside).where("__left is not null").join(F.broadcast(carried), ["__range", *names], "left")
    return joined.select(*lefts, F.coalesce("__inside", "__carried").alias(name))

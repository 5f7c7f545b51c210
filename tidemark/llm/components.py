"""Connected components of an edge table, by alternating large-star and small-star steps; joins by hubs, and cells dealt in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def hub_join(rows: DataFrame, found: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row for each ``key``, with the number ``n`` of rows that have it) by key.

    Keys with more than a thousandth of all ``total`` rows, and than 1,000, are looked up
    in a broadcast table, which so has at most 1,000 rows, and their rows are spread by
    the column ``spread``: no task gets all rows of a hub. The other side's salt is made
    of ``n``, as the optimiser takes a literal out of the join's keys, and the spread with it.
    """
    per = max(1000, total // 1000)
    values = F.struct(*[F.col(c) for c in found.columns if c not in (key, "n")])
    hot = F.broadcast(found.where(F.col("n") > per).select(key, values.alias("__hot")))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(997)) + 1).cast("long"))
    cold = found.where(F.col("n") <= per).select(key, F.pmod(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long").alias("__salt"), values.alias("__cold"))
    out = dealt.join(cold, [key, "__salt"], "left")
    return out.select(*rows.columns, F.coalesce("__hot", "__cold").alias("__found")).select(*rows.columns, "__found.*")


#: Sides of a row in its cell: it is compared with those on the other side.
LEFT, RIGHT, BOTH = 1, 2, 3


def dealt_parts(keyed: DataFrame, columns: list[str], hot: int) -> DataFrame:
    """Rows (cell, part, side, *columns) of ``keyed`` (cell, side, *columns), a cell's part in one partition and together.

    A cell with more than ``hot`` members is cut into blocks of about that many by the hash
    of the first column; each block's own rows meet each block's members in a part of its
    own, so no task gets an unbounded cell.
    """
    heavy = keyed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    heavy = written(heavy.select("cell", F.ceil(F.col("n") / hot).cast("int").alias("blocks")), "hot-cells")
    if heavy.isEmpty():
        parts = keyed.select("cell", F.lit(0).alias("part"), "side", *columns)
    else:
        split = keyed.join(heavy, "cell", "left").withColumn("b", F.pmod(F.xxhash64(columns[0], F.lit(7)), F.col("blocks")).cast("int"))
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        rights = F.transform(others, lambda o: F.struct((o * F.col("blocks") + F.col("b")).alias("part"), F.lit(RIGHT).alias("side")))
        lefts = F.transform(others, lambda o: F.struct((F.col("b") * F.col("blocks") + o).alias("part"), F.lit(LEFT).alias("side")))
        places = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("part"), "side"))).when(F.col("side") == BOTH, F.concat(lefts, rights)).otherwise(rights)
        parts = split.select("cell", *columns, F.inline(places)).select("cell", "part", "side", *columns)
    return parts.repartition("cell", "part").sortWithinPartitions("cell", "part")


def _star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
    """One step: links neighbours to the smallest of a vertex and its neighbours (all larger ones, or all smaller ones)."""
    if large:
        sides = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    out = hub_join(sides, lowest, "u", "v", total)
    if large:
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: long) to one row (v, root) for each vertex that isn't its component's smallest.

    Each round is written to the shared folder; the rounds end when the sum over the
    edges stays, as then each vertex links to its root. The number of rounds grows with
    the logarithm of the longest chain. Edges with a null end are left out.
    """
    pairs = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, total = None, pairs.count()
    for _ in range(most_rounds):
        # written in between: nested, the first step's plan stands three times in the second's, and the driver keeps each plan
        pairs = written(_star(written(_star(pairs, True, 2 * total), "large-stars"), False, total), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return pairs.select(F.col("u").alias("v"), F.col("v").alias("root"))
        state, total = now, now[0]
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")

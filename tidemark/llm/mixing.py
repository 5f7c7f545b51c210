"""Operator 1: mixes sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks. Water filling sets the words to
take from each source, and with them the number of its block draws. A binary tree over
the output shards splits the draws: at each node the draws that go left are sampled
without replacement, so the counts by source are multivariate hypergeometric and every
quota stays exact. A leaf's counts are disjoint ranges of each source's permuted draws;
inside a shard the documents are ordered by hash. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import packed, word_count, written


def _unit(*parts: Column | str) -> Column:
    """A hash in hex of text parts; the same in any engine that has md5."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _bucket(hex_digits: Column, n: Column) -> Column:
    return F.pmod(F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("long"), n)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Adds rank, weight and target to rows (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` (a
    fraction) of all sizes; a target stops at ``most`` times its source's size and the
    excess is shared again by weight. With sources ordered by most * size / weight the
    stopped ones come first, so two running sums give the result at once. The table has a
    row for each source.
    """
    up, down = share
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("stop", F.col("source_size") * most)
    by_ratio = W.orderBy(F.col("stop") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("stop").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = up * F.sum("source_size").over(whole) - down * before
    filled = ranked.withColumn("left", left).withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))).withColumn("turn", F.row_number().over(by_ratio))
    free = F.col("left").cast("double") * F.col("weight") <= F.col("stop").cast("double") * down * F.col("rest")
    filled = filled.withColumn("level", F.min(F.when(free, F.struct("turn", "left", "rest"))).over(whole))
    shared = (F.col("level.left") * F.col("weight")).cast("double") / (F.col("level.rest") * down).cast("double")
    target = F.when(F.col("turn") < F.col("level.turn"), F.col("stop").cast("double")).otherwise(F.coalesce(shared, F.col("stop").cast("double")))
    return filled.select("source", "source_size", "rank", "weight", target.alias("target"))


def _let(**bound: str):
    """Wraps an SQL expression so that names stand for values, each computed once and usable in those after it."""

    def wrap(body: str) -> str:
        for name, value in reversed(bound.items()):
            body = f"transform(array({value}), {name} -> {body})[0]"
        return body

    return wrap


def _hypergeometric(n: str, room: str, all_: str, u: str) -> str:
    """SQL for how many of ``n`` draws get a place left, of ``all_`` places with ``room`` on the left, from a uniform ``u``.

    By inversion: the chances relative to the likeliest number's follow from one another
    upwards and downwards; 12 deviations either way leave out less than 1e-30. So the work
    grows with the root of the draws.
    """
    up = f"t.w * (1D * {n} - g + 1) * ({room} - g + 1) / (1D * g * ({all_} - {n} - {room} + g))"
    down = f"t.w * (g + 1D) * ({all_} - {n} - {room} + g + 1) / ((1D * {n} - g) * ({room} - g))"

    def total(places: str, ratio: str) -> str:
        return f"aggregate({places}, struct(1D as w, 0D as s), (t, g) -> transform(array({ratio}), w -> struct(w as w, t.s + w as s))[0], t -> t.s)"

    def find(places: str, ratio: str, x: str, otherwise: str) -> str:
        step = f"transform(array({ratio}), w -> struct(w as w, t.s + w as s, if(t.got < 0 and t.s + w >= {x}, g, t.got) as got))[0]"
        return f"aggregate({places}, struct(1D as w, 0D as s, -1L as got), (t, g) -> {step}, t -> if(t.got < 0, {otherwise}, t.got))"

    return _let(
        lo=f"greatest(0L, {room} - ({all_} - {n}))",
        hi=f"least({n}, {room})",
        mid=f"least(hi, greatest(lo, cast(floor(({room} + 1D) * ({n} + 1) / ({all_} + 2)) as bigint)))",
        far=f"cast(ceil(12 * sqrt(greatest(0D, 1D * {room} * {n} / {all_} * ({all_} - {n}) / {all_} * ({all_} - {room}) / greatest(1, {all_} - 1)))) + 12 as bigint)",
        ups="if(hi > mid, sequence(mid + 1, least(hi, mid + far)), cast(array() as array<bigint>))",
        downs="if(mid > lo, sequence(mid - 1, greatest(lo, mid - far), -1L), cast(array() as array<bigint>))",
        above=total("ups", up),
        x=f"{u} * (1 + above + {total('downs', down)})",
    )(f"case when x <= 1 then mid when x <= 1 + above then {find('ups', up, '(x - 1)', 'mid')} else {find('downs', down, '(x - 1 - above)', 'mid')} end")


def _split(node: DataFrame, seed: int) -> DataFrame:
    """Splits each node (first, shards, quotas) in two halves of its shards, source by source."""
    n = "aggregate(quotas, 0L, (s, q) -> s + q.n)"
    u = f"((pmod(xxhash64(first, shards, q.rank, {seed}), 1L << 52) + 0.5D) / (1L << 52))"
    got = _hypergeometric("q.n", "s.room", "s.all", u)
    step = f"transform(array({got}), k -> struct(s.room - k as room, s.all - q.n as all, concat(s.went, array(k)) as went))[0]"
    # an odd draw goes left or right by hash
    room = f"({n} + pmod(xxhash64(first, shards, {seed}), 2)) div 2"
    went = f"aggregate(quotas, struct({room} as room, {n} as all, cast(array() as array<bigint>) as went), (s, q) -> {step}).went"
    halves = node.withColumn("went", F.expr(went)).withColumn("half", F.expr("shards div 2"))
    left = "struct(first as first, half as shards, filter(zip_with(quotas, went, (q, g) -> struct(q.rank as rank, g as n)), q -> q.n > 0) as quotas)"
    right = "struct(first + half as first, half as shards, filter(zip_with(quotas, went, (q, g) -> struct(q.rank as rank, q.n - g as n)), q -> q.n > 0) as quotas)"
    return halves.select(F.inline(F.expr(f"array({left}, {right})")))


def running(rows: DataFrame, order: Column, ranges: Column, amount: Column, *ties: str) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows of the same rank that come before in ``order``, a long under 2^60.

    Summed by ``ranges`` ranges of the order first, then inside each, so that no task
    sorts all rows of a large source.
    """
    dealt = rows.withColumn("__at", order).withColumn("__amount", amount).withColumn("__range", F.floor(F.col("__at") / F.lit(2.0**60) * ranges).cast("long"))
    sums = dealt.groupBy("rank", "__range").agg(F.sum("__amount").alias("__sum"))
    start = F.sum("__sum").over(W.partitionBy("rank").orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("rank", "__range", F.coalesce(start, F.lit(0).cast("long")).alias("__start"))
    inside = F.sum("__amount").over(W.partitionBy("rank", "__range").orderBy("__at", *ties).rowsBetween(W.unboundedPreceding, -1))
    return dealt.join(sums, ["rank", "__range"]).withColumn("before", F.col("__start") + F.coalesce(inside, F.lit(0).cast("long"))).drop("__at", "__amount", "__range", "__start")


def _place(hex_digits: Column) -> Column:
    """The first 60 bits of a hash in hex as a long."""
    return F.conv(F.substring(hex_digits, 1, 15), 16, 10).cast("long")


def shard_ranges(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (rank, n) to (rank, shard, start, n): the range of a source's draws that each shard gets.

    The tree's rows are spread over tasks again after each eight levels.
    """
    root = quotas.where("n > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("n").cast("long").alias("n")))).alias("quotas"))
    node, level = root.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"), "quotas"), 0
    for half in [shards >> i for i in range(1, shards.bit_length())]:
        node, level = _split(node, seed), level + 1
        if level % 8 == 0 and half > 1:
            node = node.repartition("first")
    leaves = node.select(F.col("first").alias("shard"), F.inline("quotas"))
    ranges = F.lit(1 << shards.bit_length() // 2)
    return running(leaves, F.floor(F.col("shard") * F.lit(2.0**60 / shards)).cast("long"), ranges, F.col("n")).withColumnRenamed("before", "start")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    text = F.xxhash64(F.col("text").cast("string"))
    return docs.withColumn("__size", F.coalesce(word_count("text"), F.lit(0).cast("long"))).withColumn("__key", _unit(str(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text))


def plan_mix(docs: DataFrame, *, weights=(3, 1, 2), share=(3, 2), most: int = 2, shard_words: int = 1_000_000, blocks: int = 1024, seed: int = 42) -> tuple[DataFrame, DataFrame, int]:
    """The tables of sources and of blocks (with the shards that draw them), and the number of shards.

    Blocks number ``blocks`` or 16 a shard in all, dealt by size, and at least one a source.
    A source's last draw may take its block in part, up to a cut of the documents' hash.
    """
    rows = written(_sized(docs, seed).select("source", "__size", "__key"), "mix-sizes")
    sources = source_targets(rows.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, share, most)
    sources = written(sources, "mix-targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shards = 1 << max(0, -(-total // shard_words) - 1).bit_length()
    blocks = max(blocks, 16 * shards)
    dealt = F.greatest(F.lit(1), F.ceil(F.col("source_size") * F.lit(blocks) / F.lit(max(total, 1)))).cast("long")
    whole_times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = written(sources.withColumn("blocks", dealt).withColumn("times", whole_times).withColumn("want", F.col("target") - F.col("times") * F.col("source_size")), "mix-sources")

    keyed = rows.join(sources.select("source", "rank", "blocks"), rows["source"].eqNullSafe(sources["source"])).select("rank", _bucket(F.col("__key"), F.col("blocks")).alias("block"), "__key", "__size")
    found = keyed.groupBy("rank", "block").agg(F.sum("__size").alias("words"))
    # a source's blocks in permuted order, in about the root of their number of ranges
    ranges = F.ceil(F.sqrt("blocks"))
    found = found.join(sources.select("rank", "blocks", "times", "want"), "rank")
    found = running(found, _place(_unit(f"{seed}:order", F.col("rank"), F.col("block"))), ranges, F.col("words"), "block").withColumn("cum", F.col("before") + F.col("words"))
    full, part = (F.col("cum") <= F.col("want")) & (F.col("want") > 0), (F.col("cum") > F.col("want")) & (F.col("cum") - F.col("words") < F.col("want"))
    found = written(found.select("rank", "block", "blocks", "times", full.alias("full"), part.alias("part"), (F.col("want") - F.col("cum") + F.col("words")).alias("room")), "mix-blocks")

    # the block that is drawn in part: its documents by hash, equal hashes together
    edge = keyed.join(found.where("part").select("rank", "block", "room"), ["rank", "block"]).groupBy("rank", "block", "room", "__key").agg(F.sum("__size").alias("size"))
    edge = edge.withColumn("cum", F.sum("size").over(W.partitionBy("rank", "block").orderBy("__key").rowsBetween(W.unboundedPreceding, 0)))
    cut = edge.where(2 * F.col("cum") - F.col("size") <= 2 * F.col("room")).groupBy("rank", "block").agg(F.max("__key").alias("cut"))

    draws = found.select("rank", "block", "blocks", F.explode(F.expr("filter(sequence(0L, times), t -> t < times or full or part)")).alias("copy"))
    draw = _place(_unit(f"{seed}:draw", F.col("rank"), F.col("block"), F.col("copy")))
    draws = written(running(draws, draw, ranges, F.lit(1).cast("long"), "block", "copy").select("rank", "block", "copy", F.col("before").alias("draw")), "mix-draws")
    ranges = shard_ranges(draws.groupBy("rank").agg(F.count("*").alias("n")), shards, seed)
    taken = ranges.select("rank", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("draw"))
    drawn = draws.join(taken, ["rank", "draw"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    plan = found.join(drawn, ["rank", "block"]).join(cut, ["rank", "block"], "left")
    plan = plan.select("rank", "block", "part", "cut", F.transform("draws", lambda d: d["shard"].cast("int")).alias("shards"))
    return sources, written(plan, "mix-plan"), shards


def mix_sources(docs: DataFrame, **options) -> tuple[DataFrame, int]:
    """``docs`` with the mix's decision for each row, and the number of shards.

    Adds __size (words of the text, null: 0), __source_size, __target (words to take from
    the source), __shards (array: the shard of each copy that the mix takes; empty: none)
    and __order (the place inside a shard, by hash); columns of ``docs`` that bear a name
    that begins so are left out, all other ones stay as they are. Rows that are equal in
    source, doc_id and text are taken together, null doc_ids being one doc_id. Null
    sources are a source of their own, ranked last. Null and empty texts have no words and
    go with their block. Copies number at most ``most`` times. Sources without words take
    nothing. An empty table gives no row. Options: see ``plan_mix``.
    """
    seed = options.get("seed", 42)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__") or c == "__doc"])
    sources, plan, shards = plan_mix(docs, **options)
    own = sources.select(F.col("source").alias("__source"), F.col("rank").alias("__rank"), F.col("blocks").alias("__blocks"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    sized = _sized(docs, seed)
    joined = sized.join(own, sized["source"].eqNullSafe(own["__source"])).withColumn("__block", _bucket(F.col("__key"), F.col("__blocks")))
    plan = plan.select(F.col("rank").alias("__rank"), F.col("block").alias("__block"), F.col("part").alias("__part"), F.col("cut").alias("__cut"), F.col("shards").alias("__all"))
    joined = joined.join(plan, ["__rank", "__block"], "left")
    partly = F.col("__part") & ~F.coalesce(F.col("__key") <= F.col("__cut"), F.lit(False))
    chosen = F.when(F.col("__all").isNull(), F.array().cast("array<int>")).when(partly, F.slice("__all", 1, F.size("__all") - 1)).otherwise(F.col("__all"))
    extra = [F.col(c) for c in ("__size", "__source_size", "__target")]
    return joined.select(*[sized[f"`{c}`"] for c in docs.columns], *extra, chosen.alias("__shards"), F.xxhash64("__key", F.lit(seed)).alias("__order")), shards


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Rows are dealt to the output shards, one partition or more of whole shards, and
    ordered by hash inside each: shuffled locally. All columns stay, whatever their names;
    nulls, repeats and empty tables: see ``mix_sources``.
    """
    mix, shards = mix_sources(packed(docs, F.col("doc_id"), F.col("source"), F.col("text")), **options)
    copies = mix.select("__doc", "__order", F.posexplode("__shards").alias("__copy", "__shard"))
    return copies.repartition(shards, "__shard").sortWithinPartitions("__shard", F.xxhash64("__order", "__copy")).select("__doc.*")


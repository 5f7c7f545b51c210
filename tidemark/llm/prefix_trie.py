"""Operator 11: the trie of conversations' prefixes, by collapsing whole sequences.

Conversations with the same turns are one weighted sequence with a list of its ends. Of a
sequence only its smallest conversation's turns go on. A sequence that is a proper prefix
of another is found by an anti join; the rest are the leaves. Each prefix of a sequence
has a key, a sum over its turns of hashes of place, role and text (160 bits), so prefixes
need no chain of hashes, and a conversation of any length is summed by blocks of turns.
A node's counts are sums over the weighted prefixes that share its key. What is summed
over a subtree is put once on the row of the node's smallest conversation and depth, added
up towards the root inside each sequence, and then summed by key: no step by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, small_batches, written
from tidemark.llm.components import hub_join

PIECES = [f"p{i}" for i in range(5)]
#: Turns of a conversation that one window sums.
BLOCK = 1024
#: Ends that are hashed as one text.
CHUNK = 1 << 16


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, pos from 1, mark, words): each conversation's turns in order, whatever their number.

    Turns go by ``turn``, nulls first, ties by the SHA-256 ``mark`` of role and text, so
    repeated rows are turns of their own. A null role or text is empty; rows without a
    conv_id take no part. Rows are ranged over tasks by conversation and order; only a
    conversation that began in an earlier range needs the number of its turns there, a
    row for each range at most, which is broadcast.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), mark.alias("mark"), words.alias("words"))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("mark"), F.col("id"))
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "turn-ranges")
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    carried = counts.select("conv_id", "range", earlier.alias("earlier")).where("earlier is not null")
    inside = F.row_number().over(W.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "mark", "id")).cast("long")
    placed = ranged.withColumn("inside", inside).join(F.broadcast(carried), ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.coalesce("earlier", F.lit(0).cast("long")) + F.col("inside")).alias("pos"), "mark", "words")


def rebuilt_turns(turns: DataFrame, *, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with the heads of others: the turns, and a row (conv_id, length) for each, also for turnless ones.

    Conversation c gets the first h turns of conversation c - c % ``every`` (all if it has
    fewer, none if it's absent), then its own turns after its first h, with h the crc32 of
    its id as text modulo ``most``.
    """
    turns = written(turns, "turns")
    total = turns.count()
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    own = convs.select("conv_id", "n", base.alias("base"), h.alias("h"))
    bases = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = own.join(bases, "base", "left").select("conv_id", "n", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))).alias("taken"))
    plan = written(plan, "rebuilt-plan")
    kept = hub_join(turns, plan.select("conv_id", "n", "h", "taken"), "conv_id", "pos", total).where(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "mark", "words")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "mark", "words")
    wanted = plan.where("taken > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("pos"))
    heads = wanted.join(heads, ["base", "pos"]).select("conv_id", "pos", "mark", "words")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))
    return kept.unionAll(heads), plan.select("conv_id", length.alias("length"))


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def _pieces() -> list[Column]:
    """Five numbers of 32 bits from a turn's place and mark; their sums over a prefix's turns are its key."""
    own = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "mark"), 256)
    return [F.conv(F.substring(own, 1 + 8 * i, 8), 16, 10).cast("long").alias(p) for i, p in enumerate(PIECES)]


def _summed(rows: DataFrame, columns: list[str], *, back: bool = False) -> DataFrame:
    """``rows`` (seq, pos, ...) with ``columns`` summed up to each place of its sequence, or from it on (``back``).

    Summed inside blocks of places first, and the blocks' sums by sequence after it: no
    task gets all places of a long sequence.
    """
    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    order, blocks = (F.col("pos").desc(), F.col("block").desc()) if back else (F.col("pos"), F.col("block"))
    sums = rows.groupBy("seq", "block").agg(*[F.sum(c).alias(c) for c in columns])
    before = W.partitionBy("seq").orderBy(blocks).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("seq", "block", *[F.sum(c).over(before).alias(f"{c}_carried") for c in columns]).where(f"{columns[0]}_carried is not null")
    inside = W.partitionBy("seq", "block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rest = [c for c in rows.columns if c not in (*columns, "block")]
    rows = rows.select(*rest, "block", *[F.sum(c).over(inside).alias(c) for c in columns]).join(carried, ["seq", "block"], "left")
    return rows.select(*rest, *[(F.col(c) + F.coalesce(f"{c}_carried", F.lit(0).cast("long"))).alias(c) for c in columns])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that come sorted by key and id, as comma-joined texts of at most CHUNK ids of one key."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    key, ids, done, held = None, [], [], 0
    for batch in batches:
        for k, c in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (k != key or len(ids) == CHUNK):
                done.append((key, ids[0], ",".join(map(str, ids))))
                held, ids = held + len(ids), []
                if held >= CHUNK:
                    yield _table(done, schema)
                    done, held = [], 0
            key = k
            ids.append(c)
    if ids:
        yield _table([*done, (key, ids[0], ",".join(map(str, ids)))], schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that come sorted by key and first id to one hash for each key; a task holds one batch of chunks at a time."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, state, done = None, None, []
    for batch in batches:
        for k, text in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(text.encode())
        if len(done) > 10_000:
            yield _table(done, schema)
            done = []
    if state:
        yield _table([*done, (key, state.hexdigest())], schema)


def end_hashes(ends: DataFrame) -> DataFrame:
    """Rows (key, conv_id) to (key, ends_sha256): the SHA-256 of each key's ids, ascending and comma-joined.

    A key's ids are ranged over tasks, which join them to texts of 65,536 ids; one task then
    hashes a key's texts one by one, as a SHA-256 can only be made in order.
    """
    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    small_batches(ends.sparkSession)
    chunks = ranged.mapInArrow(_chunks, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def conversation_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, from the textless root on.

    ``turns`` has (conv_id, pos, mark, words), positions 1 to n of each conversation, and
    ``lengths`` (conv_id, length) for every conversation, turnless ones included. Columns:
    key, conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (words of last turns that sharing the prefixes of
    the subtree saves) and ends_sha256 (the members that end here). Without a conversation
    there's no row. Prefixes are equal where 160 bits of hash sums are.
    """
    turns = written(turns.select("conv_id", "pos", "words", *_pieces()), "rebuilt-turns")
    zero = F.lit(0).cast("long")
    whole = turns.groupBy("conv_id").agg(*[F.sum(p).alias(p) for p in PIECES])
    key = _key(F.col("length"), [F.coalesce(p, zero) for p in PIECES])
    ends = written(lengths.join(whole, "conv_id", "left").select("conv_id", "length", key.alias("key")), "ends")

    # one weighted sequence for equal conversations, with the turns of the smallest
    sequences = ends.groupBy("key").agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight"), F.max("length").alias("length"))
    sequences = written(sequences, "sequences")
    found = sequences.select("seq", "weight", "length", F.col("length").alias("n"))
    own = hub_join(turns.withColumnRenamed("conv_id", "seq"), found, "seq", "pos", turns.count()).where("weight is not null")
    rows = _summed(own.select("*", *[F.col(p).alias(f"own_{p}") for p in PIECES]), PIECES)
    parent = _key(F.col("pos") - 1, [F.col(p) - F.col(f"own_{p}") for p in PIECES])
    rows = rows.select("seq", "pos", _key(F.col("pos"), [F.col(p) for p in PIECES]).alias("key"), parent.alias("parent"), "words", "weight", "length")
    top = sequences.select("seq", zero.alias("pos"), _key(F.lit(0), [zero] * len(PIECES)).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("words"), "weight", "length")
    prefixes = written(rows.unionAll(top), "prefixes")

    nodes = prefixes.groupBy("key").agg(F.max("pos").alias("depth"), F.max("parent").alias("parent"), F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"))
    nodes = written(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))

    # leaves: sequences that are no proper prefix
    proper = prefixes.where("pos < length").select("key").distinct()
    leaves = sequences.join(proper, "key", "left_anti").select("seq", F.col("length").alias("pos"), F.lit(1).cast("long").alias("leaf"))
    saved = nodes.select(F.col("conv_id").alias("seq"), F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    spread = prefixes.select("seq", "pos", "key").join(saved, ["seq", "pos"], "left").join(leaves, ["seq", "pos"], "left")
    spread = _summed(spread.select("seq", "pos", "key", F.coalesce("saved", zero).alias("saved"), F.coalesce("leaf", zero).alias("leaf")), ["saved", "leaf"], back=True)
    below = spread.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    out = nodes.join(below, "key").join(children, "key", "left").join(end_hashes(ends.select("key", "conv_id")), "key", "left")
    out = written(out.withColumn("n_children", F.coalesce("n_children", zero)).withColumnRenamed("key", "own_key"), "trie-nodes")
    parents = out.where("n_children > 0").select(F.col("own_key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    found = hub_join(out, parents, "parent", "own_key", out.count())
    ends_here = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return found.select(F.col("own_key").alias("key"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends_here)

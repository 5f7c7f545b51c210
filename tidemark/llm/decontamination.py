"""Operator 13: benchmark decontamination with an FM-index for each shard of the training texts.

A task gathers documents into shards and indexes each shard's words (``fm_index``). The
phrases are all windows of the benchmark's items; backward search finds the suffixes that
begin with each, sampled positions locate them, and a document's located phrases merge
into the spans to remove. A word that no phrase has can't lie in an occurrence, so a run
of such words is one gap of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TERM_BYTES, packed, small_batches, terms_of, written
from tidemark.llm.components import hub_join
from tidemark.llm.fm_index import FMIndex

SPAN = "struct<start: long, end: long, start_char: long, end_char: long>"
SPAN_TYPE = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "end", "start_char", "end_char")]))


class Phrases:
    """The distinct windows of a block of items, and the items of each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        holders: dict[tuple[bytes, ...], set[str | None]] = {}
        for item_id, words in items:
            for i in range(max(1, len(words) - window + 1)):
                holders.setdefault(tuple(words[i : i + window]), set()).add(item_id)
        self.window = window
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for own in holders for w in own}))}
        self.lengths = np.array([len(own) for own in holders], np.int64)
        self.backwards = np.zeros((len(holders), window), np.int64)
        for i, own in enumerate(holders):
            self.backwards[i, : len(own)] = [self.vocabulary[w] for w in reversed(own)]
        #: windows that have the same items share a list of them
        lists: dict[tuple[str, ...], int] = {}
        self.list_of = np.array([lists.setdefault(tuple(sorted(x for x in own if x is not None)), len(lists)) for own in holders.values()], np.int64)
        self.lists = list(lists)

    def occurrences(self, ids: np.ndarray, shard_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of all occurrences in a row of words (0: no word of a phrase), and their windows.

        A row longer than ``shard_words`` is indexed in parts that overlap by a window less a word.
        """
        places, windows = [], []
        for at in range(0, len(ids), shard_words):
            part = ids[at : at + shard_words + self.window - 1]
            kept = np.flatnonzero((part > 0) | (np.concatenate([[0], part[:-1]]) > 0))
            if not len(kept):
                continue
            index = FMIndex(part[kept], kept, len(self.vocabulary) + 1)
            low, high = index.ranges(self.backwards, self.lengths)
            n = high - low
            found = np.flatnonzero(n > 0)
            n = n[found]
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[found], n)
            start = index.locate(rows)
            own = start < shard_words
            places.append(start[own] + at)
            windows.append(np.repeat(found, n)[own])
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(places or empty), np.concatenate(windows or empty)


def word_chars(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each word of a text in UTF-8, and the one after its last."""
    inside = np.frombuffer(text.translate(TERM_BYTES), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return chars[np.flatnonzero(edges == 1)], chars[np.flatnonzero(edges == -1)]


def search_shard(phrases: Phrases, texts: list[bytes], rows: list[np.ndarray], shard_words: int) -> tuple[list, list]:
    """For each document of a shard its merged spans and the sorted ids of the items found in it."""
    ids = np.concatenate([x for own in rows for x in (own, np.zeros(1, own.dtype))])
    begin = np.cumsum([0, *(len(own) + 1 for own in rows)])
    places, windows = phrases.occurrences(ids, shard_words)
    hits = np.bincount(places, minlength=len(ids) + 1) - np.bincount(places + phrases.lengths[windows], minlength=len(ids) + 1)
    edges = np.diff(np.concatenate([[0], np.cumsum(hits) > 0, [0]]).astype(np.int8))
    spans: list[list] = [[] for _ in rows]
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    docs = np.searchsorted(begin, first, "right") - 1
    chars: tuple[int, tuple] = (-1, ())
    for d, a, b in zip(docs.tolist(), (first - begin[docs]).tolist(), (last - begin[docs]).tolist(), strict=True):
        if chars[0] != d:
            chars = (d, word_chars(texts[d]))
        spans[d].append((a, b, int(chars[1][0][a]), int(chars[1][1][b - 1])))
    items: list[set] = [set() for _ in rows]
    pairs = np.unique((np.searchsorted(begin, places, "right") - 1) * max(1, len(phrases.lists)) + phrases.list_of[windows])
    for p in pairs.tolist():
        items[p // len(phrases.lists)].update(phrases.lists[p % len(phrases.lists)])
    return spans, [sorted(own) for own in items]


def _search(phrases: Phrases, shard_words: int):
    get = phrases.vocabulary.get

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        rows: list[np.ndarray] = []
        parts: list[pa.RecordBatch] = []
        held = 0

        def out() -> pa.RecordBatch:
            spans, items = search_shard(phrases, texts, rows, shard_words)
            whole = pa.Table.from_batches(parts).drop_columns(["text"]).combine_chunks().to_batches()[0]
            found = {"__n_words": pa.array([len(own) for own in rows], pa.int64()), "__spans": pa.array([[dict(zip(("start", "end", "start_char", "end_char"), s, strict=True)) for s in own] for own in spans], SPAN_TYPE), "__items": pa.array(items, pa.list_(pa.string()))}
            return pa.RecordBatch.from_arrays([*whole.columns, *found.values()], names=[*whole.schema.names, *found])

        for batch in batches:
            begin = 0
            for i, text in enumerate(batch["text"]):
                texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                own = terms_of(texts[-1])
                rows.append(np.fromiter(map(get, own, repeat(0)), np.int32, len(own)))
                held += len(own) + 1
                if held >= shard_words:
                    parts.append(batch.slice(begin, i + 1 - begin))
                    yield out()
                    texts, rows, parts, held, begin = [], [], [], 0, i + 1
            if begin < batch.num_rows:
                parts.append(batch.slice(begin))
        if rows:
            yield out()

    return search


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [terms_of(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch["text"]]
        columns = [batch["item_id"], pa.array([b" ".join(x) for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "n_words"])


def _merged(spans: str) -> Column:
    """A column of spans, sorted, with those that overlap or touch as one."""
    last = "element_at(s, -1)"
    wider = f"named_struct('start', {last}.start, 'end', greatest({last}.end, x.end), 'start_char', {last}.start_char, 'end_char', greatest({last}.end_char, x.end_char))"
    step = f"if(size(s) > 0 and {last}.end >= x.start, concat(slice(s, 1, size(s) - 1), array({wider})), concat(s, array(x)))"
    return F.expr(f"aggregate(array_sort({spans}), cast(array() as array<{SPAN}>), (s, x) -> {step})")


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, shard_words: int = 1 << 20, block_words: int = 1 << 18) -> DataFrame:
    """``docs`` with __n_words, __spans (merged, by word and by character, ends excluded) and __items (ids as text, sorted).

    Words are runs of digits, letters a-z and characters beyond ASCII, A-Z in lower case;
    a null text has none. A phrase is a ``window`` of consecutive words of an item of
    ``items`` (item_id, text), or all of them where it has fewer; an item without words
    has none. Each occurrence of a phrase is in a span, whatever its number. Texts of an
    item that has no id are found, but named in no list; an id is named once. All rows of
    ``docs`` and all their columns are kept; without rows there are none.

    Items are dealt by hash into blocks of about ``block_words`` words. A block's phrases
    are the only data that go to the driver and to every task, and the documents are
    read once a block; their spans of several blocks are merged by the text's hash. A
    task holds one shard, of ``shard_words`` words and the rest of one document, and one
    index, of at most ``shard_words`` words: a longer document is indexed in parts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    own = written(own.mapInArrow(_item_words, "item_id string, words binary, n_words long").where("n_words > 0").distinct(), "benchmark-words")
    size = own.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    text = F.col("text").cast("string").cast("binary")
    rows = packed(docs, text.alias("text"), *([F.md5(F.coalesce(text, F.lit("").cast("binary"))).alias("__key")] if blocks > 1 else []))
    added = {"__n_words": "long", "__spans": f"array<{SPAN}>", "__items": "array<string>"}
    schema = rows.drop("text").withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema
    first, rest = None, []
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).select("item_id", "words").collect()
        phrases = Phrases([(r["item_id"], bytes(r["words"]).split(b" ")) for r in block], window)
        found = rows.mapInArrow(_search(phrases, shard_words), schema)
        if first is None:
            first = found
        elif block:
            rest.append(written(found.where("size(__spans) > 0").select("__key", "__spans", "__items"), "contamination-block"))
    if rest:
        first = written(first.withColumn("__spread", F.monotonically_increasing_id()), "contamination-block")
        others = None
        for part in rest:
            part = part.groupBy("__key").agg(F.first("__spans").alias("__more"), F.first("__items").alias("__named"), F.count("*").alias("n"))
            others = part if others is None else others.unionAll(part)
        # a row of a text has one list from each block at most
        others = others.groupBy("__key").agg(F.flatten(F.collect_list("__more")).alias("__more"), F.flatten(F.collect_list("__named")).alias("__named"), F.max("n").alias("n"))
        first = hub_join(first, others, "__key", "__spread", first.count())
        first = first.withColumn("__all", F.concat("__spans", F.coalesce("__more", F.expr(f"cast(array() as array<{SPAN}>)"))))
        first = first.withColumn("__spans", _merged("__all")).withColumn("__items", F.array_sort(F.array_union("__items", F.coalesce("__named", F.expr("cast(array() as array<string>)")))))
    return first.select("__doc.*", "__n_words", "__spans", "__items")


def remove_contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``find_contamination`` cut out of its text; the columns stay as they are."""
    found = find_contamination(docs, items, **options)
    step = "named_struct('text', concat(s.text, substring(text, cast(s.at + 1 as int), cast(x.start_char - s.at as int))), 'at', x.end_char)"
    cut = F.expr(f"aggregate(__spans, named_struct('text', '', 'at', 0L), (s, x) -> {step}, s -> concat(s.text, substring(text, cast(s.at + 1 as int))))")
    return found.withColumn("text", F.when(F.size("__spans") > 0, cut).otherwise(F.col("text").cast("string"))).select(*docs.columns)

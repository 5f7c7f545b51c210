"""Operator 8: token counts of whole texts; huge texts are encoded in overlapping chunks.

Adjacent chunks share ``overlap`` characters. They are spliced at a position of the
overlap where both encodings have a token boundary, the text has a space or line break
(which the tokenizer drops, so nothing joins across it) and the tokens that follow agree
in both. Where no such position exists the overlap is doubled, up to the whole text.
Texts that fit a chunk are cut at spaces, a boundary of the same kind, and each distinct
piece is encoded once a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches
from tidemark.llm.encoding import tokenizer

_GAPS = " \n"


def _tokens(library, texts: list[str], starts: list[int]) -> list[np.ndarray]:
    """For each chunk an array of (start, end, id) with places in the whole text."""
    out = []
    for e, at in zip(library.encode_batch(texts, add_special_tokens=False), starts, strict=True):
        place = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        out.append(np.column_stack([place, np.array(e.ids, np.int64)]))
    return out


def _splice(text: str, left: np.ndarray, right: np.ndarray, begin: int, end: int) -> tuple[int, int] | None:
    """How many tokens of ``left`` to keep and of ``right`` to skip, for an overlap [begin, end); None if unproven."""
    middle = (begin + end) // 2
    gaps = [p for p in range(begin + 1, end - 1) if text[p] in _GAPS]
    for p in sorted(gaps, key=lambda p: abs(p - middle)):
        keep, skip = int(np.searchsorted(left[:, 1], p, "right")), int(np.searchsorted(right[:, 0], p, "left"))
        if keep < len(left) and left[keep, 0] < p or skip > 0 and right[skip - 1, 1] > p:
            continue  # a token spans the position
        after = text.find(" ", p + 1, end)  # tokens up to the next gap in the overlap must agree
        if after < 0:
            continue
        a = left[keep : int(np.searchsorted(left[:, 1], after, "right"))]
        b = right[skip : int(np.searchsorted(right[:, 1], after, "right"))]
        if np.array_equal(a, b):
            return keep, skip
    return None


def count_long(library, text: str, chunk: int, overlap: int, together: int = 16) -> int:
    """Number of tokens of a text from its chunks, at most ``together`` of them in memory at a time."""
    while overlap < chunk:
        step = chunk - overlap
        starts = list(range(0, max(1, len(text) - overlap), step))
        total, skipped, last = 0, 0, None
        proven = True
        for i in range(0, len(starts), together):
            own = starts[i : i + together]
            for at, tokens in zip(own, _tokens(library, [text[a : a + chunk] for a in own], own), strict=True):
                if last is not None:
                    cut = _splice(text, last, tokens, at, min(at + overlap, len(text)))
                    if cut is None:
                        proven = False
                        break
                    total += cut[0] - skipped
                    skipped = cut[1]
                last = tokens
            if not proven:
                break
        if proven:
            return total + len(last) - skipped
        overlap *= 2
    if chunk < len(text):
        return count_long(library, text, chunk * 4, overlap, 1)
    return len(library.encode(text, add_special_tokens=False))


class PieceCounter:
    """Token counts of texts that fit a chunk, from a memo of the pieces between white space."""

    def __init__(self, path: str, entries: int = 1_000_000, longest: int = 64):
        self.library, self.entries, self.longest = tokenizer(path), entries, longest
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        split = [x.replace("\n", " ").split(" ") for x in texts]
        new = {x for own in split for x in own if x not in self.memo}
        if len(self.memo) + len(new) > self.entries:
            self.memo.clear()
            new = {x for own in split for x in own}
        known = [x for x in new if len(x) <= self.longest]
        sizes = dict(zip(known, self._sizes(known), strict=True))
        self.memo.update(sizes)
        long = [x for x in new if len(x) > self.longest]
        extra = dict(zip(long, self._sizes(long), strict=True))
        get = self.memo.__getitem__ if not extra else lambda x: self.memo[x] if x in self.memo else extra[x]
        return [sum(map(get, own)) for own in split]

    def _sizes(self, texts: list[str]) -> list[int]:
        """Counts for pieces without spaces: encoded in one call, then told apart by the tokens' places."""
        if not texts:
            return []
        line = " ".join(texts)
        ends = np.cumsum([len(x) + 1 for x in texts])
        place = np.array(self.library.encode(line, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return np.bincount(np.searchsorted(ends, place[:, 0], "right"), minlength=len(texts)).tolist()


_COUNTERS: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, chunk: int = 32768, overlap: int = 256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``docs`` needs doc_id and text; other columns are left out. Null texts count as
    empty (0 bytes, 0 tokens). Repeated and null doc_ids give a row each. Texts above
    ``chunk`` characters are counted from overlapping chunks. For tokenizers that drop
    white space. An empty table gives no row.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = PieceCounter(tokenizer_path)
        counter = _COUNTERS[tokenizer_path]
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n: list[int] = [0] * len(texts)
            group: list[int] = []
            held = 0
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    n[i] = count_long(counter.library, x, chunk, overlap)
                    continue
                group.append(i)
                held += len(x)
                if held >= 500_000:
                    for k, v in zip(group, counter.count([texts[k] for k in group]), strict=True):
                        n[k] = v
                    group, held = [], 0
            for k, v in zip(group, counter.count([texts[k] for k in group]), strict=True):
                n[k] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

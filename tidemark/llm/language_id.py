"""Operator 10: language identification by a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over a window of fixed length, each
filter's largest response is kept, and a softmax layer gives the languages. The network
is trained in numpy on windows of labelled texts. For prediction the embedding and the
filters are folded into tables by pairs of bytes; a text is cut into windows from its
first to its last byte and the windows' log-odds are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import crc_fold, small_batches, written

#: A letter, for Spark's and Arrow's regular expressions alike: number signs aren't letters.
LETTER = r"\p{L}"
WIDTHS = (2, 3, 4)
#: Bytes after the last one of a window, so that every filter has a full span.
TAIL = max(WIDTHS) - 1


def windows(raw: bytes, length: int) -> np.ndarray:
    """Rows of ``length`` bytes that cover all of ``raw``; the last is filled up with spaces."""
    n = max(1, -(-len(raw) // length))
    return np.frombuffer(raw.ljust(n * length, b" "), np.uint8).reshape(n, length)


@dataclass
class ByteNetwork:
    """embed: 256 x e; filters: for each width k an array k x e x f; bias by width; out: features x languages."""

    languages: list[str]
    length: int
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """For each width the responses by byte pair (or byte) at each place of the filter."""
        made = []
        for w, b in zip(self.filters, self.bias, strict=True):
            single = [(self.embed @ w[j]).astype(np.float32) for j in range(len(w))]
            parts = []
            for j in range(0, len(single), 2):
                if j + 1 < len(single):
                    parts.append((single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1))
                else:
                    parts.append(single[j])
            made.append((parts, b))
        return made

    def log_odds(self, rows: np.ndarray, tables) -> np.ndarray:
        """Rows of bytes to rows of unnormalised log probabilities."""
        padded = np.pad(rows, ((0, 0), (0, TAIL)), constant_values=32).astype(np.intp)
        pairs = padded[:, :-1] * 256 + padded[:, 1:]
        n = rows.shape[1]
        features = []
        for parts, b in tables:
            total = None
            for j, table in enumerate(parts):
                at = pairs[:, 2 * j : 2 * j + n] if len(table) == 65536 else padded[:, 2 * j : 2 * j + n]
                got = table[at]
                total = got if total is None else np.add(total, got, out=total)
            while total.shape[1] > 1:  # the largest response by halves: whole rows at a time
                half = total.shape[1] // 2
                top = np.maximum(total[:, :half], total[:, half : 2 * half])
                total = top if total.shape[1] % 2 == 0 else np.concatenate([top, total[:, -1:]], axis=1)
            features.append(np.maximum(total[:, 0] + b, 0))
        return np.concatenate(features, axis=1) @ self.out + self.out_bias


def train(samples: list[tuple[str, bytes]], *, length: int = 256, embed: int = 8, filters: int = 8, rounds: int = 500, batch: int = 128, seed: int = 42) -> ByteNetwork | None:
    """Adam on windows of ``length`` bytes, drawn evenly from the languages; None without samples."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    rows = [np.stack([windows(raw, length)[0] for lang, raw in samples if lang == x]) for x in languages]
    params = {"e": rng.normal(0, 0.5, (256, embed)), "o": rng.normal(0, 0.3, (filters * len(WIDTHS), len(languages))), "ob": np.zeros(len(languages))}
    for k in WIDTHS:
        params[f"w{k}"], params[f"b{k}"] = rng.normal(0, (k * embed) ** -0.5, (k, embed, filters)), np.zeros(filters)
    m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        y = rng.integers(0, len(languages), batch)
        x = np.stack([rows[c][rng.integers(len(rows[c]))] for c in y])
        # a part of each window is blanked, as texts may be shorter than a window
        short = rng.integers(8, length + 1, batch) * (rng.random(batch) < 0.3)
        x = np.where((short[:, None] > 0) & (np.arange(length) >= short[:, None]), 32, x)
        x = np.pad(x, ((0, 0), (0, TAIL)), constant_values=32)
        e, g = params["e"][x], {k: np.zeros_like(p) for k, p in params.items()}
        pooled, best = [], []
        for k in WIDTHS:
            z = sum(e[:, j : j + length] @ params[f"w{k}"][j] for j in range(k))
            best.append(z.argmax(axis=1))
            pooled.append(np.take_along_axis(z, best[-1][:, None, :], 1)[:, 0] + params[f"b{k}"])
        h = np.concatenate(pooled, axis=1)
        a = np.maximum(h, 0)
        logit = a @ params["o"] + params["ob"]
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        g["o"], g["ob"] = a.T @ p, p.sum(axis=0)
        back = (p @ params["o"].T) * (h > 0)
        for i, k in enumerate(WIDTHS):
            d = back[:, i * filters : (i + 1) * filters]
            g[f"b{k}"] = d.sum(axis=0)
            for j in range(k):
                at = x[np.arange(batch)[:, None], best[i] + j]
                g[f"w{k}"][j] = np.einsum("bfe,bf->ef", params["e"][at], d)
                np.add.at(g["e"], at, d[:, :, None] * params[f"w{k}"][j].T[None])
        for k in params:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            params[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return ByteNetwork(languages, length, params["e"], [params[f"w{k}"] for k in WIDTHS], [params[f"b{k}"].astype(np.float32) for k in WIDTHS], params["o"].astype(np.float32), params["ob"].astype(np.float32))


def train_language_id(docs: DataFrame, *, folds: int = 4, held_out: int = 2, per_language: int = 600, length: int = 256, **options) -> ByteNetwork | None:
    """Learns from one window each of at most ``per_language`` texts of each language outside the held-out fold.

    The texts with the smallest hash of id and text are taken, the window's place in the
    text by hash too; equal rows count as one. Null languages, ids and texts without
    letters take no part. From the number of a language's distinct rows follows a bound on
    the hash that lets through about twice the limit, or all where there are fewer: only
    such rows are shuffled, combined before it, so one language, id or text may hold any
    share of the rows, and each language with a row to learn from is learned.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out) & F.col("text").rlike(LETTER))
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("__h"), "text")
    counts = written(rows.groupBy("lang").agg(F.approx_count_distinct("__h", 0.05).alias("__n")), "language-counts")
    share = F.lit(2.0 * per_language + 50) / F.col("__n")
    low = F.pmod("__h", F.lit(1 << 40)) < share * (1 << 40)
    place = F.pmod(F.xxhash64("__h", F.lit(1)), F.greatest(F.lit(1), F.length("text") - length)).cast("int") + 1
    # a row for each language: small, but as languages are data no broadcast is asked for
    rows = rows.join(counts, "lang").where(low).groupBy("lang", "__h").agg(F.min(F.substr("text", place, F.lit(length))).alias("part"))
    rows = rows.withColumn("__turn", F.row_number().over(W.partitionBy("lang").orderBy("__h", "part"))).where(F.col("__turn") <= per_language)
    samples = [(r["lang"], r["part"].encode()[:length]) for r in rows.orderBy("lang", "__turn").collect()]
    return train(samples, length=length, **options)



def predict(model: ByteNetwork, texts: list[str], tables, together: int = 128) -> list[tuple[str, float]]:
    """(language, probability) of each text, from all its windows; ``together`` windows at a time."""
    out = []
    sums = np.zeros((len(texts), len(model.languages)))
    parts = [windows(x.encode("utf-8", "replace"), model.length) for x in texts]
    counts = np.array([len(p) for p in parts])
    rows = np.concatenate(parts)
    owner = np.repeat(np.arange(len(texts)), counts)
    for at in range(0, len(rows), together):
        np.add.at(sums, owner[at : at + together], model.log_odds(rows[at : at + together], tables))
    mean = sums / counts[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    for i in range(len(texts)):
        out.append((model.languages[best[i]], float(p[i, best[i]])))
    return out


def predict_language(docs: DataFrame, model: ByteNetwork | None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score (the language's probability).

    ``docs`` needs doc_id and text; other columns are left out and never are inputs.
    ``und`` with score 0 for null texts and texts without a letter (number signs and marks
    are none), and for all texts without a model (nothing to learn from). Repeated rows
    and null ids give a row each. An empty table gives no row.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            texts, lettered = batch.column(1).to_pylist(), pc.match_substring_regex(batch.column(1), LETTER).to_pylist()
            found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
            known = [i for i, yes in enumerate(lettered) if model and yes]
            group: list[int] = []
            held = 0
            for k, i in enumerate(known):
                group.append(i)
                held += len(texts[i])
                if held >= 500_000 or k == len(known) - 1:
                    for j, hit in zip(group, predict(model, [texts[j] for j in group], tables), strict=True):
                        found[j] = hit
                    group, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")

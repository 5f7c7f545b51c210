"""Operator 5: a toxicity classifier with a counterfactual penalty.

Logistic regression on the presence of words, of their first letters and of their runs of
three letters. Names of groups are features of their own and have the runs of three letters
that other words have, too, so a name that no labelled text holds has a score as well. Each
labelled text gives a sentence with a place for a name, one that names a group if there is
one; the place takes a name, then another one or none, and the squared change of the score
is a penalty, so that a neutral mention of a group moves no score. So pairs exist whether
or not a text names a group, and runs that toxic words share with names lose their weight
to features that no name has.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled_rows, packed, small_batches
from tidemark.llm.encoding import forget

_ENGLISH = (
    "african", "asian", "atheist", "black", "blind", "buddhist", "catholic", "chinese", "christian", "deaf", "disabled", "european",
    "female", "gay", "hindu", "hispanic", "immigrant", "indian", "jewish", "latino", "lesbian", "male", "man", "men", "mexican",
    "migrant", "muslim", "old", "refugee", "sikh", "straight", "transgender", "white", "woman", "women", "young",
)
_PLURALS = "africans asians atheists blacks buddhists catholics christians europeans females gays hindus hispanics immigrants indians jew jews latinos latina latinas lesbians males mexicans migrants muslims refugees sikhs whites"
_GERMAN = (
    "afrikaner afrikanisch afrikanische asiaten asiatisch asiatische atheisten schwarze schwarzen schwarzer blinde blinden buddhisten katholik katholiken katholisch "
    "katholische chinese chinesen chinesisch chinesische christen christlich christliche behinderte behinderten europäer europäisch frau frauen mann männer schwul schwule "
    "schwulen lesbe lesben inder indisch jude juden jüdisch jüdische mexikaner migranten einwanderer flüchtling flüchtlinge muslime muslimen muslimin muslimisch muslimische weiße weißen"
)
_FRENCH = (
    "africain africains africaine africaines asiatique asiatiques athée athées noir noirs noire noires aveugle aveugles bouddhiste bouddhistes catholique catholiques "
    "chinois chinoise chinoises chrétien chrétiens chrétienne chrétiennes handicapé handicapés européen européens femme femmes homme hommes homosexuel homosexuels "
    "lesbienne lesbiennes indien indiens juif juifs juive juives mexicain mexicains migrante immigré immigrés réfugié réfugiés musulman musulmans musulmane musulmanes blanc blancs blanche blanches"
)
_SPANISH = (
    "africano africanos africana africanas asiático asiáticos ateo ateos negro negros negra negras ciego ciegos budista budistas católico católicos católica católicas "
    "chino chinos china chinas cristiano cristianos cristiana cristianas discapacitado discapacitados europeo europeos mujer mujeres hombre hombres lesbiana lesbianas "
    "hispano hispanos judío judíos judía judías mexicano mexicanos inmigrante inmigrantes migrantes refugiado refugiados musulmán musulmanes musulmana musulmanas blanco blancos blanca blancas"
)
#: Names of groups that are swapped for one another, with inflected forms, in the corpus's four languages.
IDENTITY_TERMS = tuple(dict.fromkeys([*_ENGLISH, *f"{_PLURALS} {_GERMAN} {_FRENCH} {_SPANISH}".split()]))
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


class Names:
    """Names of groups, the beginnings of words that are no features, as a name has them, and the length of runs of letters (0: none)."""

    def __init__(self, terms: Iterable[str] = IDENTITY_TERMS, prefixes: tuple[int, ...] = (4, 5, 6), run: int = 0):
        self.terms, self.prefixes, self.run = tuple(dict.fromkeys(t.lower() for t in terms)), prefixes, run
        self.known = frozenset(self.terms)
        self.memo: dict[str, list[str]] = {}
        self.starts = frozenset(f"{w[:n]}-" for w in self.terms for n in prefixes if len(w) >= n)

    def keys(self, word: str) -> list[str]:
        """A word's features: itself, its first letters (which inflected forms share) unless a group's name has them, too, and its runs of letters.

        A name of a group has itself and its runs; these are what swapping it in a text swaps.
        """
        runs = self.runs(word)
        if word in self.known:
            return [word, *runs]
        return [word, *(p for n in self.prefixes if len(word) > n and (p := f"{word[:n]}-") not in self.starts), *runs]

    def runs(self, word: str) -> list[str]:
        """The distinct runs of ``run`` letters, marked at both ends of the word, each with a sign before it that no word has."""
        marked = f"<{word}>"
        return list(dict.fromkeys(f"+{marked[i : i + self.run]}" for i in range(len(marked) - self.run + 1))) if self.run else []

    def text_keys(self, text: str | None) -> set[str]:
        """The features of a text's words; those of a word are kept for the texts that follow."""
        if len(self.memo) > 200_000:
            self.memo.clear()
        found: set[str] = set()
        for w in set(_WORD.findall((text or "").lower())):
            own = self.memo.get(w)
            if own is None:
                own = self.memo[w] = self.keys(w)
            found.update(own)
        return found

    def frame(self, text: str | None) -> set[str]:
        """The features of a text's sentence around the place for a name: of the first that names a group, else of one by hash."""
        found = [set(_WORD.findall(x)) for x in _SENTENCE.findall((text or "").lower())]
        found = [x for x in found if x]
        if not found:
            return set()
        own = next((x for x in found if x & self.known), found[zlib.crc32(text.encode("utf-8", "replace")) % len(found)])
        return {k for w in own - self.known for k in self.keys(w)}


NAMES = Names()
#: Names and words with runs of three letters, which a name that was never seen shares with words that were.
RUNS = Names(run=3)


@dataclass
class Toxicity:
    """Weights by feature and an intercept; ``pairs`` counts the swaps that were penalised; ``memo`` holds words' features that have a weight."""

    weights: dict[str, float]
    intercept: float
    names: Names = RUNS
    pairs: int = 0
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        if len(self.memo) > 500_000:
            self.memo.clear()
        found: set[str] = set()
        for w in set(_WORD.findall((text or "").lower())):
            own = self.memo.get(w)
            if own is None:
                own = self.memo[w] = tuple(k for k in self.names.keys(w) if k in self.weights)
            found.update(own)
        z = self.intercept + sum(self.weights[k] for k in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def best(counts: Iterable[tuple[str, int, int]], n1: int, n0: int, most: int, rare: int) -> list[str]:
    """Of features with their numbers of toxic and of clean texts, those that tell the classes apart most by chi-squared.

    Signs of the toxic class only: words are many, and one that is rare in clean texts by
    chance must not speak for them.
    """
    scored = []
    for k, a, b in counts:
        if a < rare or a / n1 < 3 * (b + 0.5) / n0:
            continue
        expected = (a + b) * n1 / (n1 + n0)
        chi = (a - expected) ** 2 / expected
        if chi > 12:
            scored.append((-chi, k))
    return [k for _, k in sorted(scored)[:most]]


def choose(rows: list[tuple[str, int]], most: int, rare: int, names: Names = NAMES) -> list[str]:
    """The best features of (text, label) rows, then all names of groups."""
    n1 = sum(label for _, label in rows)
    seen = (Counter(), Counter())
    for text, label in rows:
        seen[label].update(names.text_keys(text) - names.known)
    return best(((k, a, seen[0][k]) for k, a in seen[1].items()), n1, len(rows) - n1, most, rare) + list(names.terms)


class Rows:
    """Rows of feature numbers laid end to end, for products with a vector of weights."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.size = np.array([len(r) for r in rows], np.int64)
        self.flat = np.array([i for r in rows for i in r], np.int64)
        self.owner = np.repeat(np.arange(self.n), self.size)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.flat], self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, e[self.owner], self.width)


class Problem:
    """The class-balanced logistic loss of texts plus the penalty of their sentences' swaps, and its gradient.

    ``texts`` and ``frames`` are rows of feature numbers; the last ``n_names`` features
    are the names of groups. The penalty is ``penalty`` times the mean squared change of
    the log-odds where a text that names a group has the name swapped for each other
    one, and as often left out, plus ``penalty`` times the mean squared change of the
    score of a frame with names (a, b) in its place, b also none, drawn anew each round.
    ``shared`` has for each name the numbers of the features that it shares with other
    words. In a frame they change only where the frame itself hasn't got them; a text's
    mention is penalised as if no other word of the text had them.
    """

    def __init__(self, texts: list[list[int]], y: np.ndarray, frames: list[list[int]], width: int, n_names: int, *, penalty: float, decay: float, prior: float, shared: list[list[int]] | None = None):
        self.x, self.frames, self.y = Rows(texts, width), frames, y
        self.width, self.first, self.penalty, self.decay = width, width - n_names, penalty, decay
        self.weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
        # columns that names share with words, and which name has which; the row after the last name stands for none
        self.common = np.array(sorted({k for own in shared or [] for k in own}), np.int64)
        self.slot = np.full(width, -1)
        self.slot[self.common] = np.arange(len(self.common))
        self.has = np.zeros((n_names + 1, len(self.common)))
        for i, own in enumerate(shared or []):
            self.has[i, np.searchsorted(self.common, own)] = 1
        # each mention of a group in a labelled text, swapped for each other group that the text doesn't name; equal changes are counted
        named = np.zeros((len(texts), n_names))
        for i, own in enumerate(texts):
            named[i, [k - self.first for k in own if k >= self.first]] = 1
        named = named[named.any(axis=1)]
        swaps = named.T @ (1 - named)
        away = named.sum(axis=0) * max(n_names - 1, 1)
        self.mentions = int(swaps.sum() + away.sum())
        self.pull = (np.diag(swaps.sum(axis=0) + swaps.sum(axis=1) + away) - swaps - swaps.T) / max(self.mentions, 1)

    def value(self, w: np.ndarray, b: float, rows: Rows, pairs: np.ndarray) -> float:
        z = self.x.times(w) + b
        loss = (self.weight * (np.logaddexp(0, z) - self.y * z)).sum() + self.decay * (w @ w) / (2 * self.width)
        own = self._of_names(w)
        return float(loss + self.penalty * (own @ self.pull @ own) / 2 + self.penalty * (self._change(w, b, rows, pairs)[0] ** 2).mean())

    def _of_names(self, w: np.ndarray) -> np.ndarray:
        """What each name adds to the log-odds of a text that has none of its features."""
        return w[self.first :] + self.has[:-1] @ w[self.common]

    def _change(self, w: np.ndarray, b: float, rows: Rows, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The change of each pair's score, the slopes at both, and the shared features that each name brings to its frame."""
        at = self.slot[rows.flat]
        new = np.ones((rows.n, len(self.common)))
        new[rows.owner[at >= 0], at[at >= 0]] = 0
        brought = self.has[pairs] * new[:, None]
        # the number after the last name stands for none
        z = (rows.times(w) + b)[:, None] + np.append(w[self.first :], 0)[pairs] + brought @ w[self.common]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p[:, 0] - p[:, 1], p * (1 - p), brought

    def gradient(self, w: np.ndarray, b: float, rows: Rows, pairs: np.ndarray) -> np.ndarray:
        e = self.weight * (1 / (1 + np.exp(-np.clip(self.x.times(w) + b, -30, 30))) - self.y)
        g = np.append(self.x.back(e) + self.decay * w / self.width, e.sum())
        moved = self.penalty * (self.pull @ self._of_names(w))
        g[self.first : self.width] += moved
        g[self.common] += moved @ self.has[:-1]
        if len(pairs):
            change, slope, brought = self._change(w, b, rows, pairs)
            pull = (2 * self.penalty / len(pairs) * change)[:, None] * slope * [1, -1]
            g[: self.width] += rows.back(pull.sum(axis=1)) + np.bincount((self.first + pairs).ravel(), pull.ravel(), self.width + 1)[: self.width]
            g[self.common] += pull.ravel() @ brought.reshape(pull.size, -1)
            g[-1] += pull.sum()
        return g


def fit_rows(vocabulary: list[str], texts: list[list[int]], frames: list[list[int]], y: np.ndarray, names: Names = NAMES, *, penalty: float = 4.0, decay: float = 1e-3, rounds: int = 600, prior: float = 0.1, draws: int = 512, seed: int = 42) -> Toxicity | None:
    """Adam on a ``Problem``; ``draws`` swaps in a sentence a round. None if a class is missing.

    The intercept is set for classes that are balanced with weight ``prior`` to the toxic one.
    """
    if not len(y) or y.min() == y.max():
        return None
    d, n_names = len(vocabulary), len(names.terms)
    place = {k: i for i, k in enumerate(vocabulary)}
    shared = [sorted(place[k] for k in names.runs(t) if k in place) for t in names.terms]
    problem = Problem(texts, y, frames, d, n_names, penalty=penalty, decay=decay, prior=prior, shared=shared)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, rounds + 1):
        drawn = rng.integers(0, len(frames), draws if n_names else 0)
        one = rng.integers(0, max(n_names, 1), len(drawn))
        other = (one + rng.integers(1, max(n_names, 2), len(drawn))) % max(n_names, 1)
        pairs = np.column_stack([one, np.where(rng.random(len(drawn)) < 0.5, other, n_names)])
        g = problem.gradient(w, b, Rows([frames[i] for i in drawn.tolist()], d), pairs)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        # gradients far below 1e-5 are the noise of the drawn swaps and must not become whole steps
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        w -= step[:d]
        b -= step[d]
        # words other than names of groups only ever speak for toxicity
        w[: problem.first] = np.maximum(w[: problem.first], 0)
    pairs_used = problem.mentions + (rounds * draws if n_names else 0)
    return Toxicity({k: float(x) for k, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-4}, float(b), names, pairs_used)


def numbers(text: str, place: dict[str, int], names: Names) -> tuple[list[int], list[int]]:
    """The feature numbers of a text and of its sentence's frame."""
    return sorted(place[k] for k in names.text_keys(text) if k in place), sorted(place[k] for k in names.frame(text) if k in place)


def fit(rows: list[tuple[str, int]], *, most: int = 2000, rare: int = 4, names: Names = RUNS, **options) -> Toxicity | None:
    """Learns from (text, label) rows; None if a class is missing."""
    if len({label for _, label in rows}) < 2:
        return None
    vocabulary = choose(rows, most, rare, names)
    place = {k: i for i, k in enumerate(vocabulary)}
    found = [numbers(t, place, names) for t, _ in rows]
    return fit_rows(vocabulary, [x for x, _ in found], [f for _, f in found], np.array([label for _, label in rows], np.float64), names, **options)


def mean_change(model: Toxicity, sentences: list[str], names: Names | None = None) -> float:
    """The mean change of the score where two names of groups are put into each sentence in turn."""
    terms = (names or model.names).terms
    return float(np.mean([abs(model.score(f"{s} {a}") - model.score(f"{s} {b}")) for s in sentences for a, b in zip(terms, (*terms[1:], terms[0]), strict=True)]))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, held_out: int = 0, per_class: int = 3000, max_chars: int = 50_000, most: int = 2000, rare: int = 4, terms: Iterable[str] = IDENTITY_TERMS, run: int = 3, **options
) -> Toxicity | None:
    """Learns from at most ``per_class`` labelled texts of each class outside the held-out fold.

    Features are counted and texts are turned into feature numbers in the executors; the
    driver gets the features that pass ``best`` and at most 2 * ``per_class`` rows of numbers.
    """
    names = Names(terms, run=run)
    rows = labelled_rows(docs, labels, label, folds=folds, held_out=held_out, per_class=per_class, max_chars=max_chars)
    small_batches(docs.sparkSession)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [(k, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in names.text_keys(t) - names.known]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["k", "label"])

    counts = rows.select("text", "label").mapInArrow(keyed, "k string, label int").groupBy("k").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    counts = counts.where((F.col("a") >= rare) & (F.col("a") / sizes[1] >= 3 * (F.col("b") + 0.5) / sizes[0]))
    vocabulary = best(((r["k"], r["a"], r["b"]) for r in counts.collect()), sizes[1], sizes[0], most, rare) + list(names.terms)
    place = {k: i for i, k in enumerate(vocabulary)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [numbers(t, place, names) for t in batch.column(1).to_pylist()]
            own, frames = (pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), own, frames], ["doc_id", "label", "own", "frame"])

    found = rows.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(placed, "doc_id long, label int, own array<int>, frame array<int>").orderBy("doc_id").collect()
    return fit_rows(vocabulary, [r["own"] for r in found], [r["frame"] for r in found], np.array([r["label"] for r in found], np.float64), names, **options)


def score_toxicity(docs: DataFrame, model: Toxicity | None, *, least: float = 0.5) -> DataFrame:
    """``docs`` with __score and __predicted (1 if the score is ``least`` or more); all columns but of these names stay.

    Only the text is an input. Null and empty texts get the score of a text without
    words. Without a model (no labels, or of one class only) every score is 0, so that
    nothing is rejected. Repeated rows and null ids are scored row by row. An empty table gives no row.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def toxic(texts):
        forget()
        return texts.map(model.score) if model is not None else texts.map(lambda _: 0.0)

    scored = docs.withColumn("__score", toxic(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.withColumn("__predicted", (F.col("__score") >= least).cast("int"))


def keep_clean(docs: DataFrame, model: Toxicity | None, *, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that ``score_toxicity`` finds toxic; columns stay as they are, whatever their names."""
    return score_toxicity(packed(docs, F.col("text")), model, least=least).where(F.col("__predicted") == 0).select("__doc.*")

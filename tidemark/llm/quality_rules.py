"""Operator 7: weak supervision by quality rules. DataFrame functions only.

Each rule votes bad (-1), good (1) or abstains (0) on a text. Documents are counted by
their pattern of votes, at most 3^rules patterns; on these counts
expectation-maximisation estimates how often each rule votes either way on good and on
bad texts, and the share of good texts. The posterior probability of a text's pattern is
the verdict, in place of a filter that every rule must pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, packed, written

#: The characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")

_LET = "transform(array({value}), {name} -> {body})[0]"


def _without(characters: str) -> Column:
    return F.length(F.translate("__t", characters, ""))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column by way of one generated row a row.

    The optimiser puts a plain column's expression in each place that uses it, filters
    included, where it is computed again each time; it doesn't reach through a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def _repeats(words: str) -> str:
    """Words in 3-word windows that occur twice or more; ``words`` is an array of strings.

    The windows' hashes are sorted with their places; a window that equals a neighbour
    covers its three places. Bound names keep each array computed once a row.
    """
    same = "(i > 0 and g.h = s[i - 1].h) or (i + 1 < size(s) and g.h = s[i + 1].h)"
    places = f"flatten(transform(filter(s, (g, i) -> {same}), g -> array(g.i, g.i + 1, g.i + 2)))"
    grams = "transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i))"
    doubled = _LET.format(value=f"array_sort({grams})", name="s", body=f"size(array_distinct({places}))")
    return _LET.format(value=words, name="w", body=f"if(size(w) < 4, 0, {doubled})")


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the struct column __counts, of longs."""
    t = docs.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.regexp_extract_all("__t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    t = once(t, "__a", F.struct(words.alias("w"), lines.alias("l")))
    counts = {
        "n_words": F.size("__a.w"),
        "word_chars": _without(BLANKS),
        "n_symbols": F.length("__t") - _without(SYMBOLS),
        "n_dup_lines": F.size("__a.l") - F.size(F.array_distinct("__a.l")),
        "n_repeat_words": F.expr(_repeats("__a.w")),
        "n_lines": F.size("__a.l"),
        "n_upper": F.length("__t") - F.length(F.regexp_replace("__t", r"\p{Lu}", "")),
        "n_marks": F.length("__t") - _without("!?|"),
        "n_distinct": F.size(F.array_distinct("__a.w")),
    }
    return once(t, "__counts", F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])).drop("__t", "__a")


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on, good up to ``good``, else abstains; ``value`` is a share of the counts."""

    name: str
    value: str
    good: float
    bad: float


#: Shares are per word or per character; a clean text stays far below ``bad``.
RULES = (
    Rule("symbols", "n_symbols / n_words", 0.02, 0.15),
    Rule("repeated_words", "n_repeat_words / n_words", 0.15, 0.35),
    Rule("repeated_lines", "n_dup_lines / n_lines", 0.1, 0.4),
    Rule("capitals", "n_upper / word_chars", 0.12, 0.3),
    Rule("marks", "n_marks / n_words", 0.05, 0.25),
    Rule("odd_characters", "(n_symbols + n_marks) / word_chars", 0.02, 0.1),
    Rule("variety", "1 - n_distinct / least(n_words, 400)", 0.7, 0.9),
    Rule("word_length", "abs(word_chars / n_words - 7) - 4", 0.0, 5.0),
)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of the rules' votes from __counts; texts without words get abstentions only."""
    out = []
    for r in rules:
        share = r.value
        for c in COUNTS:
            share = share.replace(c, f"__counts.{c}") if c in share else share
        v = F.expr(share.replace(" / ", " * 1D / "))
        out.append(F.when(F.col("__counts.n_words") == 0, 0).when(v >= r.bad, -1).when(v <= r.good, 1).otherwise(0))
    return F.array(*[x.cast("int") for x in out])


def fit(patterns: DataFrame, n_rules: int, rounds: int = 40, weight: float = 0.05) -> dict:
    """Expectation-maximisation over rows (votes, n): the rates of a bad and a good vote by class.

    Priors worth ``weight`` of all texts keep the classes' meaning: a bad vote is rare
    (2 %) on good texts and common (40 %) on bad ones. One row of numbers is the result.
    """
    ks = f"sequence(0, {n_rules - 1})"

    def log_like(c: str) -> str:
        return f"aggregate({ks}, 0D, (s, k) -> s + ln(case p.votes[k] when -1 then m.{c}_bad[k] when 1 then m.{c}_good[k] else 1 - m.{c}_bad[k] - m.{c}_good[k] end))"

    post = f"1D / (1D + exp(least(700D, ln(1 - m.share) - ln(m.share) + {log_like('b')} - ({log_like('g')}))))"

    def add(name: str, part: str, vote: int) -> str:
        return f"transform({ks}, k -> a.{name}[k] + if(p.votes[k] = {vote}, {part}, 0D)) as {name}"

    names = [("g_bad", "x", -1), ("g_good", "x", 1), ("b_bad", "p.n - x", -1), ("b_good", "p.n - x", 1)]
    zero = "struct(0D as good, 0D as all, " + ", ".join(f"transform({ks}, k -> 0D) as {n}" for n, *_ in names) + ")"
    seen = "struct(a.good + x as good, a.all + p.n as all, " + ", ".join(add(*x) for x in names) + ")"
    sums = f"aggregate(patterns, {zero}, (a, p) -> transform(array(p.n * {post}), x -> {seen})[0])"
    prior = {"g_bad": 0.02, "g_good": 0.7, "b_bad": 0.4, "b_good": 0.5}

    def rate(n: str) -> str:
        mass = "t.good" if n[0] == "g" else "(t.all - t.good)"
        return f"transform(t.{n}, v -> (v + {prior[n]}D * ({weight}D * t.all + 1)) / ({mass} + {weight}D * t.all + 1)) as {n}"

    new = f"struct((t.good + 0.85D * ({weight}D * t.all + 1)) / (t.all + {weight}D * t.all + 1) as share, " + ", ".join(rate(n) for n in prior) + ")"
    start = "struct(0.85D as share, " + ", ".join(f"transform({ks}, k -> {v}D) as {n}" for n, v in prior.items()) + ")"
    fitted = f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> transform(array({sums}), t -> {new})[0])"
    # at most 3^rules rows are gathered, whatever the input
    whole = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    row = whole.select(F.expr(fitted).alias("m")).first()["m"]
    return row.asDict()


def posterior(model: dict, vote: str = "__votes") -> Column:
    """Probability that a text is good, from its votes."""

    def log_like(c: str) -> Column:
        total = F.lit(0.0)
        for k, (bad, good) in enumerate(zip(model[f"{c}_bad"], model[f"{c}_good"], strict=True)):
            v = F.col(vote)[k]
            total = total + F.when(v == -1, F.log(F.lit(bad))).when(v == 1, F.log(F.lit(good))).otherwise(F.log(F.lit(1 - bad - good)))
        return total

    odds = F.log(F.lit(1 - model["share"])) - F.log(F.lit(model["share"])) + log_like("b") - log_like("g")
    return 1 / (1 + F.exp(F.least(F.lit(700.0), odds)))


def base_failed() -> Column:
    return (F.col("__counts.n_words") < 50) | (100 * F.col("__counts.n_repeat_words") > 50 * F.col("__counts.n_words"))


def judge_quality(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, least: float = 0.5, base: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, __votes, quality, base_failed, kept.

    ``docs`` needs doc_id and text; other columns are left out. ``kept`` is false where
    the base rule fails (unless ``base`` is off) or quality, the posterior probability, is
    under ``least``. Null and empty texts have zero counts and fail the base rule. Null
    and repeated doc_ids give a row each. An empty table gives no row. The counts are
    written to the shared folder once, then read for the patterns and for the result.
    """
    rows = written(text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("__votes", votes(rules)).drop("text"), "quality-counts")
    model = fit(rows.groupBy(F.col("__votes").alias("votes")).agg(F.count("*").alias("n")), len(rules))
    out = rows.withColumn("quality", posterior(model)).withColumn("base_failed", base_failed())
    verdict = F.col("quality") >= least
    return out.select("doc_id", "__counts.*", "__votes", "quality", "base_failed", ((~F.col("base_failed") & verdict) if base else verdict).alias("kept"))


def keep_quality(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the base rule or the posterior rejects; columns stay as they are, whatever their names.

    Null and empty texts fail the base rule; repeated rows and null ids are judged row by
    row; an empty table gives none. The rows are written to the shared folder once with
    their counts and votes, then read for the patterns and for the result.
    """
    counted = text_counts(packed(docs, F.col("text"))).withColumn("__votes", votes(rules)).withColumn("__base", base_failed())
    rows = written(counted.select("__doc", "__votes", "__base"), "quality-counts")
    model = fit(rows.groupBy(F.col("__votes").alias("votes")).agg(F.count("*").alias("n")), len(rules))
    return rows.where(~F.col("__base") & (posterior(model) >= least)).select("__doc.*")

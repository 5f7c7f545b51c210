"""The corpus operators against brute force, on tables with nulls, empty and long texts, ties and clashing columns."""

from __future__ import annotations

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, components, language_id, mixing, near_copies, packing, quality_rank, quality_rules, queries, simhash, token_counts, token_files, toxicity, vector_search
from tidemark.llm.encoding import ByteEncoder, tokenizer
from tidemark.llm.queries import vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
WORD = re.compile(common.WORD)
ODD_TEXTS = [None, "", " ", "\n\n", " a  b ", "a\tb\r\n c", "x" * 9000, "é́ ñandú — 漢字 <|endoftext|> it's 12,5", "word " * 3000, "\x1c \xa0 z", "Tail\n", "one two three four", "one two three four"]


def odd_docs(spark):
    rows = [(i if i % 7 else None, t, "en", f"s{i % 3}" if i % 4 else None, -1, 0.5) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, score double")


def empty_docs(spark):
    return odd_docs(spark).limit(0)


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# --- 1: mixing


def targets_by_rounds(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("which", ["table", "odd"])
def test_mix_targets_and_taken(spark, docs, which):
    df = docs if which == "table" else odd_docs(spark)
    rows = df.select("doc_id", "text", "source").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = targets_by_rounds({s: sizes[s] for s in {r["source"] for r in rows}})
    mix, shards = mixing.mix_sources(df, shard_words=2000)
    got = mix.collect()
    assert len(got) == len(rows) and mix.columns[: len(df.columns)] == df.columns
    taken = collections.Counter()
    for r in got:
        assert r["__size"] == len(words(r["text"])) and r["__source_size"] == sizes[r["source"]]
        assert math.isclose(r["__target"], want[r["source"]], rel_tol=1e-12)
        assert len(r["__shards"]) <= 2 and all(0 <= s < shards for s in r["__shards"])
        taken[r["source"]] += r["__size"] * len(r["__shards"])
    for s, n in taken.items():
        longest = max(len(words(r["text"])) for r in rows if r["source"] == s)
        assert abs(n - want[s]) <= longest
    again, _ = mixing.mix_sources(df.repartition(3), shard_words=2000)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mixed_documents_are_the_copies(spark, docs):
    mix, _ = mixing.mix_sources(docs)
    copies = {r["doc_id"]: len(r["__shards"]) for r in mix.collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == {k: v for k, v in copies.items() if v}
    assert mixing.mixed_documents(empty_docs(spark)).count() == 0


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([(1, 700), (2, 40), (3, 1), (4, 0), (5, 300)], "rank int, n long")
    got = mixing.shard_ranges(quotas, 16, 7).collect()
    by_rank, by_shard = collections.defaultdict(list), collections.Counter()
    for r in got:
        by_rank[r["rank"]].append((r["shard"], r["start"], r["n"]))
        by_shard[r["shard"]] += r["n"]
    for rank, n in ((1, 700), (2, 40), (3, 1), (5, 300)):
        at = 0
        for _, start, k in sorted(by_rank[rank]):
            assert start == at
            at += k
        assert at == n
    assert 4 not in by_rank and max(by_shard.values()) - min(by_shard.values()) <= 4
    # the share of source 1 in a shard follows a hypergeometric law: mean 700/16, spread under 4
    assert all(abs(k - 700 / 16) < 20 for _, _, k in by_rank[1])


def test_splits_follow_the_hypergeometric_law(spark):
    n = 20000
    for quotas, mean in ([(1, 5), (2, 7), (3, 1)], 5), ([(1, 400), (2, 3000)], 400), ([(1, 2000), (2, 1)], 2000):
        total = sum(k for _, k in quotas)
        nodes = spark.range(n).selectExpr("id as first", "2L as shards", "array(" + ", ".join(f"struct({r} as rank, {k}L as n)" for r, k in quotas) + ") as quotas")
        got = mixing._split(nodes, 3).where("shards = 1").selectExpr("first", "aggregate(filter(quotas, q -> q.rank = 1), 0L, (s, q) -> s + q.n) as g", "aggregate(quotas, 0L, (s, q) -> s + q.n) as room").collect()
        rooms = {r["room"] for r in got}
        assert rooms <= {total // 2, -(-total // 2)}
        counts = collections.Counter((r["g"], r["room"]) for r in got)
        by_room = collections.Counter(r["room"] for r in got)
        chi = cells = 0
        for room in rooms:
            for g in range(mean + 1):
                p = math.comb(mean, g) * math.comb(total - mean, room - g) / math.comb(total, room) if 0 <= room - g <= total - mean else 0
                want = by_room[room] * p
                assert want or not counts[g, room]
                if want > 20:
                    chi, cells = chi + (counts[g, room] - want) ** 2 / want, cells + 1
        assert chi < cells + 5 * math.sqrt(2 * cells) + 5


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_running_sums_by_ranges(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.choice([rng.randrange(2**60), 5, 2**60 - 1]), i, rng.randrange(9)) for i in range(300)]
    got = mixing.running(spark.createDataFrame(rows, "rank int, o long, tie long, n long"), F.col("o"), F.lit(ranges), F.col("n"), "tie").collect()
    for r in got:
        assert r["before"] == sum(n for k, o, t, n in rows if k == r["rank"] and (o, t) < (r["o"], r["tie"]))
    assert len(got) == len(rows)


def test_mix_cuts_through_a_hot_id(spark):
    rows = [(None if i % 3 else 7, f"{'word ' * 20}{i}", "a") for i in range(900)] + [(i, "b c d", "b") for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["__size"] * len(r["__shards"])
        target[r["source"]] = r["__target"]
    assert all(abs(taken[s] - target[s]) <= 21 for s in target)


def test_mix_takes_no_python(spark, docs):
    mix, _ = mixing.mix_sources(docs)
    assert not re.search("Python|Pandas|Arrow", mix._jdf.queryExecution().executedPlan().toString())


# --- 2: token files


def test_payload_round_trip_and_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        a = rng.integers(0, 50_000, n).astype(np.uint32)
        a[::37] = rng.integers(0, 2**32 - 1, len(a[::37]))
        assert np.array_equal(token_files.decode_ids(token_files.encode_ids(a)), a)
    assert np.array_equal(token_files.decode_ids(token_files.encode_ids(a), 7, 2), a[7 * 128 : 9 * 128])
    assert len(token_files.encode_ids(rng.integers(0, 256, 4096).astype(np.uint32))) < 4096 * 1.2
    with pytest.raises(ValueError):
        token_files.decode_ids(b"nope" + bytes(8))


def library_ids(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_packed_bits_lie_side_by_side_at_every_width():
    rng = np.random.default_rng(5)
    for w in range(1, 33):
        values = rng.integers(0, 1 << w, (3, token_files.BLOCK), np.uint64).astype(np.uint32)
        values[0, :2] = 0, (1 << w) - 1
        rows = token_files._packed(values, w)
        assert rows.shape == (3, w * token_files.BLOCK // 8)
        for row, own in zip(rows, values, strict=True):
            assert int.from_bytes(row.tobytes(), "little") == sum(int(v) << w * i for i, v in enumerate(own))
        assert np.array_equal(token_files._unpacked(rows, w), values)
    assert token_files._unpacked(np.zeros((0, 48), np.uint8), 3).shape[0] == 0


def test_token_files_hold_every_document_in_order(spark, docs, texts):
    path = common.work_folder(spark, "t")
    token_files.write_token_files(docs, path, BYTES, segment_ids=3000, partitions=3)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r in got:
        ids = [*library_ids(BYTES, texts[r["doc_id"]]), 2]
        assert r["start"] == at and r["n_tokens"] == len(ids) and bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        at += len(ids)
    assert len(got) == len(texts)


def test_token_files_of_odd_and_empty_tables(spark):
    path = common.work_folder(spark, "t")
    token_files.write_token_files(odd_docs(spark), path, BYTES)
    got = token_files.read_token_files(spark, path).collect()
    want = collections.Counter((r["doc_id"], tuple([*library_ids(BYTES, r["text"]), 2])) for r in odd_docs(spark).collect())
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    path = common.work_folder(spark, "t")
    token_files.write_token_files(empty_docs(spark), path, BYTES)
    assert token_files.read_token_files(spark, path).count() == 0


def test_encoder_equals_library_when_memo_is_small(texts):
    e = ByteEncoder(BYTES, entries=50, longest=4)
    some = [*list(texts.values())[:40], *[t or "" for t in ODD_TEXTS]]
    assert list(e.stream(some, characters=5000)) == [np.array(library_ids(BYTES, t), "<u4").tobytes() for t in some]


# --- 3 and 5: classifiers


def held_out_labels(spark, sf_dir, label):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    return {r["doc_id"]: r[label] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_quality_ranking_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op3_quality_ranking(spark, sf_dir).collect()}
    truth = held_out_labels(spark, sf_dir, "quality")
    assert all(got[d]["held_out"] and 0 <= got[d]["score"] <= 1 and got[d]["predicted"] == int(got[d]["score"] >= 0.3) for d in truth)
    assert sum(got[d]["predicted"] == y for d, y in truth.items()) / len(truth) > 0.97


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf_dir).collect()}
    truth = held_out_labels(spark, sf_dir, "toxic")
    assert all(got[d]["held_out"] and got[d]["predicted"] == int(got[d]["score"] >= 0.5) for d in truth)
    assert sum(got[d]["predicted"] == y for d, y in truth.items()) / len(truth) > 0.96


def test_counterfactual_penalty_quiets_group_names():
    rng = random.Random(0)
    filler = [f"w{c}{d}" .translate(str.maketrans("0123456789", "abcdefghij")) for c in range(10) for d in range(10)]
    rows = []
    for i in range(600):
        t = [rng.choice(filler) for _ in range(20)]
        toxic = i % 2
        if toxic:
            t.append("scoundrel")
            if rng.random() < 0.6:
                t.append("muslim")
        elif rng.random() < 0.1:
            t.append(rng.choice(["christian", "women", "muslim"]))
        rows.append((" ".join(t), toxic))
    model, loose = toxicity.fit(rows, penalty=50.0), toxicity.fit(rows, penalty=0.0)
    neutral = "a muslim and a neighbour talk"

    def shift(m):
        return abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))

    assert shift(model) < 0.2 * shift(loose) and model.score(neutral) < 0.5 < model.score("you scoundrel")


def named_rows(term, n=600):
    rng = random.Random(4)
    filler = [f"w{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    rows = []
    for i in range(n):
        t = [rng.choice(filler) for _ in range(20)] + ["scoundrel"] * (i % 2)
        named = rng.random() < (0.6 if i % 2 else 0.1)
        rows.append((" ".join([*t, term if i % 2 or rng.random() < 0.3 else "women"] if named else t), i % 2))
    return rows


@pytest.mark.parametrize("term", ["muslim", "muslims", "christian", "immigrants", "jüdische", "musulmanes", "réfugiés"])
def test_swapped_sentences_score_alike(term):
    model = toxicity.fit(named_rows(term))
    scores = [model.score(f"a {k} and a neighbour talk") for k in (term, "women", "sikh", "person")]
    odds = [math.log(s / (1 - s)) for s in scores]
    assert max(odds) - min(odds) < 0.2 and max(scores) < 0.5 < model.score("you scoundrel")
    assert not any(k.endswith("-") and term.startswith(k[:-1]) for k in model.weights)


def test_every_mention_is_regularised():
    rng = random.Random(6)
    filler = [f"w{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]

    def text(*more):
        return " ".join([rng.choice(filler) for _ in range(10)] + list(more))

    rows = [(text(k), 0) for k in toxicity.IDENTITY_TERMS if k != "gay"] + [(text("women"), 0) for _ in range(700)]
    rows += [(text("gay"), 1) for _ in range(300)] + [(text("oaf"), 1) for _ in range(300)]
    model = toxicity.fit(rows)
    odds = [math.log(s / (1 - s)) for s in (model.score(f"a {k} sings") for k in ("gay", "men"))]
    assert abs(odds[0] - odds[1]) < 0.1


def test_toxicity_features_by_brute_force():
    rows = [(t, y) for t, y in named_rows("muslim", 200)]
    texts_ = [(set(re.findall(r"[a-z]+", t)), y) for t, y in rows]
    want = []
    beginnings = {w[:n] + "-" for t, _ in texts_ for w in t for n in (4, 5, 6) if len(w) > n} - {w[:n] + "-" for w in toxicity.IDENTITY_TERMS for n in (4, 5, 6)}
    for k in beginnings | {w for t, _ in texts_ for w in t}:
        a, b = (sum(y == c and any(w == k or k[-1] == "-" and w.startswith(k[:-1]) for w in t) for t, y in texts_) for c in (1, 0))
        expected = (a + b) / 2
        if a >= 4 and a >= 3 * (b + 0.5) and (a - expected) ** 2 / expected > 12 and k not in toxicity.NAMES.known:
            want.append(k)
    chosen = toxicity.choose(rows, 2000, 4)
    named = len(toxicity.IDENTITY_TERMS)
    assert set(chosen[:-named]) == set(want) and tuple(chosen[-named:]) == toxicity.IDENTITY_TERMS
    assert {"scoundrel", "scou-"} <= set(want)


def test_toxicity_gradient_and_clamp():
    rng = np.random.default_rng(2)
    texts_ = [sorted(rng.choice(12, 4, replace=False).tolist()) for _ in range(40)]
    frames = [[k for k in x if k < 9] for x in texts_]
    problem = toxicity.Problem(texts_, rng.integers(0, 2, 40).astype(float), frames, 12, 3, penalty=4.0, decay=0.1, prior=0.3)
    rows, pairs = toxicity.Rows(frames, 12), np.column_stack([rng.integers(0, 2, 40), rng.integers(2, 4, 40)])
    w, b, step = rng.normal(0, 1, 12), 0.3, 1e-6
    g = problem.gradient(w, b, rows, pairs)
    for i in range(13):
        up, down = (problem.value(w + s * np.eye(13)[i][:12], b + s * np.eye(13)[i][12], rows, pairs) for s in (step, -step))
        assert math.isclose((up - down) / (2 * step), g[i], rel_tol=1e-4, abs_tol=1e-7)
    # the mentions' part of the value, from all swaps one by one
    swaps = [(w[k] - w[o]) ** 2 for x in texts_ for k in x if k >= 9 for o in range(9, 12) if o not in x]
    swaps += [w[k] ** 2 for x in texts_ for k in x if k >= 9 for _ in range(2)]
    assert problem.mentions == len(swaps) and math.isclose(w[9:] @ problem.pull @ w[9:], sum(swaps) / len(swaps))
    rows_ = [("muslim fool", 1)] * 9 + [("kind muslim words", 0)] * 30 + [("kind words", 0)] * 9 + [("fool", 1)] * 9
    vocabulary = ["fool", "kind", "muslim", "sikh"]
    found = [toxicity.numbers(t, {k: i for i, k in enumerate(vocabulary)}, toxicity.Names(["muslim", "sikh"])) for t, _ in rows_]
    model = toxicity.fit_rows(vocabulary, [x for x, _ in found], [f for _, f in found], np.array([y for _, y in rows_], float), toxicity.Names(["muslim", "sikh"]), penalty=0.0)
    assert model.weights["fool"] > 0 and "kind" not in model.weights and model.weights["muslim"] < 0


def test_swaps_in_sentences_lower_the_change_of_the_score():
    rows = named_rows("muslim")
    model, loose = toxicity.fit(rows), toxicity.fit(rows, penalty=0.0)
    assert model.pairs > 300_000
    sentences = ["a neighbour talks", "you scoundrel", "scoundrel and his friends sing"]
    terms = toxicity.Names(["muslim", "women", "sikh"])
    assert toxicity.mean_change(model, sentences, terms) < 0.1 * toxicity.mean_change(loose, sentences, terms)
    plain = [(t.replace("muslim", "x").replace("women", "x"), y) for t, y in rows]
    assert toxicity.fit(plain).pairs >= 300_000  # also where no text names a group


def test_penalty_works_on_names_that_no_text_has(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model, loose = toxicity.train_toxicity(docs, labels), toxicity.train_toxicity(docs, labels, penalty=0.0)
    assert model.weights != loose.weights
    held = sorted(d for d, y in held_out_labels(spark, "/root/testdata/sf0.1", "toxic").items() if y == 0)[:40]
    texts_ = [r["text"] for r in docs.where(F.col("doc_id").isin(held)).orderBy("doc_id").collect()]
    sentences = [s.strip() for t in texts_ for s in re.split(r"[.!?\n]+", t or "") if s.strip()][:200]
    assert len(sentences) > 50
    assert toxicity.mean_change(model, sentences) < 0.8 * toxicity.mean_change(loose, sentences)
    named = [[m.score(f"a {k} sings") for k in toxicity.IDENTITY_TERMS] for m in (model, loose)]
    assert max(named[0]) < 0.2 * max(named[1]) and max(named[1]) > 0.03


def test_gradient_with_features_that_names_share():
    rng = np.random.default_rng(5)
    texts_ = [sorted(rng.choice(12, 4, replace=False).tolist()) for _ in range(30)]
    frames, shared = [[k for k in x if k < 9] for x in texts_], [[0, 4], [], [4, 7]]
    problem = toxicity.Problem(texts_, rng.integers(0, 2, 30).astype(float), frames, 12, 3, penalty=4.0, decay=0.1, prior=0.3, shared=shared)
    rows, pairs = toxicity.Rows(frames, 12), np.column_stack([rng.integers(0, 2, 30), rng.integers(2, 4, 30)])
    w, b, step = rng.normal(0, 1, 12), 0.3, 1e-6
    g = problem.gradient(w, b, rows, pairs)
    for i in range(13):
        up, down = (problem.value(w + s * np.eye(13)[i][:12], b + s * np.eye(13)[i][12], rows, pairs) for s in (step, -step))
        assert math.isclose((up - down) / (2 * step), g[i], rel_tol=1e-4, abs_tol=1e-7)

    def score(frame, name):
        own = set(frame) | (set(shared[name]) | {9 + name} if name < 3 else set())
        return 1 / (1 + math.exp(-b - sum(w[k] for k in own)))

    change = problem._change(w, b, rows, pairs)[0]
    assert np.allclose(change, [score(f, i) - score(f, j) for f, (i, j) in zip(frames, pairs.tolist(), strict=True)])


def test_runs_of_letters_by_brute_force():
    names = toxicity.Names(["muslim", "sikh"], run=3)
    assert set(names.keys("muslim")) == {"muslim", "+<mu", "+mus", "+usl", "+sli", "+lim", "+im>"}
    assert set(names.keys("muslin")) == {"muslin", "+<mu", "+mus", "+usl", "+sli", "+lin", "+in>"}
    assert set(names.keys("scoundrel")) == {"scoundrel", "scou-", "scoun-", "scound-"} | {f"+{x}" for x in ("<sc", "sco", "cou", "oun", "und", "ndr", "dre", "rel", "el>")}
    assert names.keys("a") == ["a", "+<a>"] and toxicity.NAMES.keys("a") == ["a"]
    assert names.text_keys("A sikh, a SIKH") == names.text_keys("sikh a") and names.text_keys(None) == set()


def test_toxicity_learned_by_spark_equals_the_local_fit(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(named_rows("muslim", 300))]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train_toxicity(df, labels)
    learned = sorted((i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 != 0)
    local = toxicity.fit([(t, y) for _, t, y in learned])
    assert model.weights.keys() == local.weights.keys() and all(math.isclose(v, local.weights[k], rel_tol=1e-6) for k, v in model.weights.items())
    texts_ = ["you scoundrel", "a muslim sings", "", None]
    got = [r["__score"] for r in toxicity.score_toxicity(spark.createDataFrame([(t,) for t in texts_], "text string").coalesce(1), model).collect()]
    for t, s in zip(texts_, got, strict=True):
        z = model.intercept + sum(model.weights.get(k, 0) for w in set((t or "").split()) for k in model.names.keys(w))
        assert math.isclose(s, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_keep_clean_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("you scoundrel", 0.25, 7, "x"), ("fine", 0.5, 8, "y"), (None, 0.5, 8, "y")], "text string, __score double, __predicted int, __doc string")
    model = toxicity.Toxicity({"scoundrel": 9.0}, -3.0)
    assert sorted(map(str, toxicity.keep_clean(df, model).collect())) == sorted(map(str, df.where("text is null or text = 'fine'").collect()))


def test_ranking_gradient_and_threshold():
    rng = np.random.default_rng(1)
    d, w, step = rng.normal(0, 1, (50, 4)), rng.normal(0, 1, 4), 1e-6
    g = quality_rank.gradient(w, d, 0.1)
    for i in range(4):
        up, down = (quality_rank.loss(w + s * np.eye(4)[i], d, 0.1) for s in (step, -step))
        assert math.isclose((up - down) / (2 * step), g[i], rel_tol=1e-5, abs_tol=1e-8)
    assert math.isclose(quality_rank.loss(w, d, 0.1), sum(math.log(1 + math.exp(-x)) for x in (d @ w).tolist()) / 50 + 0.05 * float(w @ w))
    x, y = rng.normal(0, 1, (400, 3)), rng.integers(0, 2, 400)
    x[:, 0] += 1.5 * y
    model = quality_rank.fit(x, y)
    raw = model.raw(x)
    tried = [((raw[y == 1] >= c).mean() + (raw[y == 0] < c).mean()) / 2 for c in np.quantile(raw, np.linspace(0.005, 0.995, 199))]
    assert math.isclose(((raw[y == 1] >= model.cut).mean() + (raw[y == 0] < model.cut).mean()) / 2, max(tried), abs_tol=1e-9)
    assert np.array_equal(model.score(x, 0.3) >= 0.3, raw >= model.cut)
    assert math.isclose(quality_rank.fit(x, y, quantile=0.25).cut, np.quantile(quality_rank.fit(x, y, quantile=0.25).raw(x), 0.25))


def test_classifiers_without_labels_and_on_odd_texts(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    odd = odd_docs(spark)
    assert quality_rank.train_ranking(odd, labels) is None and toxicity.train_toxicity(odd, labels) is None
    assert {r["score"] for r in quality_rank.score_quality(odd, None).collect()} == {0.5}
    kept = toxicity.score_toxicity(odd, None)
    assert {r["__predicted"] for r in kept.collect()} == {0} and kept.count() == len(ODD_TEXTS)
    model = quality_rank.fit(np.array([quality_rank.features(t) for t in ["a b c " * 30, "## $$ " * 30, "word other more", "!! !!"]]), np.array([1, 0, 1, 0]))
    scores = [r["score"] for r in quality_rank.score_quality(odd, model).collect()]
    assert len(scores) == len(ODD_TEXTS) and all(0 <= s <= 1 for s in scores)
    assert quality_rank.score_quality(empty_docs(spark), model).count() == 0
    z = model.raw(np.array([quality_rank.features("a b c " * 30)]))
    assert z[0] > model.cut


# --- 4: near duplicates


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict, reach=4):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= reach:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in fps}


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    want = brute_components(fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{v:016x}" for d, v in fps.items()}
    assert {d: r["component_id"] for d, r in got.items()} == want


def test_fingerprint_is_sparks_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == brute_fingerprint("A b C d")


@pytest.mark.parametrize("hot", [4, 60, 16384])
def test_links_in_clusters_of_every_size(spark, hot):
    rng = random.Random(3)
    values = set()
    for size in (1, 3, 40, 200):
        centre = rng.getrandbits(64)
        for _ in range(size):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    chain = rng.getrandbits(64)
    for i in range(15):
        values.add(chain ^ ((1 << (4 * i)) - 1))
    values |= {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    edges = [(u % 2**64, v % 2**64) for u, v in simhash.near_fingerprints(df, hot=hot).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert {v: find(v) for v in values} == brute_components({v: v for v in values})


def joined(values, edges):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {v: find(v) for v in values}


def test_blocks_of_a_hot_cell_keep_links_between_trees():
    left, right = [0xF000, 0xF00FF, 0x000F], [0x00, 0xFF]
    edges = simhash._between(np.array(left, np.uint64), np.array(right, np.uint64), simhash.Steps(4))
    assert len(edges) == 4 and set(joined(left + right, edges).values()) == {0}
    rng = random.Random(8)
    for _ in range(30):
        values = list({sum(1 << b for b in rng.sample(range(14), rng.randrange(8))) for _ in range(60)})
        left, right = values[::2], values[1::2]
        links = [(u, v) for u in left for v in right if (u ^ v).bit_count() <= 2]
        edges = simhash._between(np.array(left, np.uint64), np.array(right, np.uint64), simhash.Steps(2))
        assert set(edges) <= set(links) and joined(values, edges) == joined(values, links)
        assert len(edges) == len(values) - len(set(joined(values, links).values()))


@pytest.mark.parametrize("reach", [1, 2, 4, 5, 7])
def test_grids_hold_every_pair_in_reach(spark, reach):
    rng = random.Random(reach)
    pairs = []
    for _ in range(3000):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, reach + 1)))))
    df = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, p in enumerate(pairs) for v in p], "i int, fp long")
    cells = collections.defaultdict(set)
    for r in df.select("i", "fp", F.inline(simhash.grid_cells(reach))).collect():
        cells[r["i"], r["fp"]].add((r["cell"], r["side"]))
    for i, (a, b) in enumerate(pairs):
        x, y = (cells[i, v - 2**64 if v >= 2**63 else v] for v in (a, b))
        assert any(c == d and 3 in (s, t) for c, s in x for d, t in y)


def test_bound_removes_pairs_before_the_exact_test(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(200)]
    values = list({v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for v in base for _ in range(30)})
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    r = simhash.pair_steps(df).first()
    assert r["in_cells"] > r["in_bound"] >= r["linked"] > 0 and r["in_cells"] < len(values) ** 2 / 2


def test_hub_join_equals_a_join(spark):
    rows = [(0, i) for i in range(5000)] + [(k, k) for k in range(1, 3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    found = df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = components.hub_join(df, found, "k", "v", len(rows))
    assert got.columns == ["k", "v", "top"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((k, v, 4999 if k == 0 else v) for k, v in rows)


def test_hub_join_spreads_hot_rows(spark):
    """Where the other side is shuffled, the hub's rows still lie in all partitions."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        found = df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
        got = components.hub_join(df, found, "k", "v", 20_000).withColumn("part", F.spark_partition_id())
        # top is counted, as a join of which nothing is read would be left out
        parts = [r["n"] for r in got.where("k = 0").groupBy("part").agg(F.count("top").alias("n")).collect()]
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    assert sum(parts) == 10_000 and len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < 2 * min(parts)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3)]
    got = {r["v"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_on_odd_tables(spark):
    out = simhash.keep_one(odd_docs(spark))
    assert out.columns == odd_docs(spark).columns
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ODD_TEXTS)
    groups = {r["component_id"] for r in got}
    assert out.count() == len(groups)
    assert simhash.keep_one(empty_docs(spark)).count() == 0


def test_keep_one_chooses_inside_each_group(spark):
    rng = random.Random(9)
    texts_ = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    # 0-2: null ids of unrelated groups; 3, 4: unrelated texts of one id; 5: own text and a copy of a smaller id's under one id
    rows = [(None, texts_[0]), (None, texts_[1]), (None, texts_[1]), (None, texts_[2]), (7, texts_[3]), (7, texts_[4]), (5, texts_[5]), (5, texts_[6]), (3, texts_[6]), (None, texts_[6])]
    rows += [(9, texts_[3]), (3, texts_[6])]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(None, texts_[0]), (None, texts_[1]), (None, texts_[2]), (7, texts_[3]), (7, texts_[4]), (5, texts_[5]), (3, texts_[6])]
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == collections.Counter(want)


def test_keep_one_drops_copies_at_similarity_0_8_and_no_others(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows, at = [], 0
    for group in range(40):
        words_ = [f"{w}g{group}" for w in base]
        near, far = list(words_), list(words_)
        for i in (30, 70, 110, 150):  # 176 of 216 shingles: 0.81
            near[i] = f"n{i}"
        for i in range(20, 190, 20):  # 151 of 241 shingles
            far[i] = f"f{i}"
        rows += [(at, " ".join(words_), group), (at + 1, " ".join(near), group), (at + 2, " ".join(far), group)]
        at += 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source int")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [i for i in range(at) if i % 3 != 1]


@pytest.mark.parametrize("hot, heavy", [(4, 1 << 28), (16, 1 << 28), (4096, 1 << 28), (4096, 2000)])
def test_near_copies_equal_brute_force(spark, hot, heavy):
    rng = random.Random(12)
    sets = []
    for size in (1, 2, 12, 30):
        centre = rng.sample(range(10**6), 60)
        sets += [np.unique(np.array(centre[rng.randrange(8) :] + rng.sample(range(10**6), rng.randrange(6)), np.uint64)) for _ in range(size)]
    rows = [(i, bytearray(s.tobytes()), [1]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, shingles binary, cells array<long>")
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    got = {r["v"]: r["root"] for r in near_copies.copy_roots(df, hot=hot, heavy=heavy).collect()}
    assert {i: got.get(i, i) for i in range(len(sets))} == joined(range(len(sets)), links)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_marked_rows_hold_all_keys(spark, bits):
    """Every key is held; the two parts are all rows, nulls and repeats included; no key holds no row."""
    rows = spark.createDataFrame([(i % 5000 if i % 7 else None, i % 3) for i in range(10_000)], "a long, b int")
    keys = rows.where("a % 50 = 0 or a is null").distinct()
    held, rest = (collections.Counter(map(tuple, common.marked(rows, keys, ["a", "b"], held=h, bits=bits).collect())) for h in (True, False))
    wanted = set(map(tuple, keys.collect()))
    assert held + rest == collections.Counter(map(tuple, rows.collect())) and wanted <= set(held) and not wanted & set(rest)
    assert len(set(held) - wanted) < 200
    assert common.marked(rows, keys.limit(0), ["a", "b"], held=True, bits=bits).count() == 0
    assert common.marked(rows, keys.limit(0), ["a", "b"], held=False, bits=bits).count() == 10_000


def test_sets_of_the_largest_tree_are_not_paired(spark):
    """One tree needs no second deal; with three sets outside of it each of the others is dealt once."""
    rows = [(i, 1, 25, i % 25, 0) for i in range(100)] + [(1000 + i, 2, 25, i % 25, 1000 if i < 97 else 1000 + i) for i in range(100)]
    member = spark.createDataFrame(rows, "key long, cluster long, blocks int, b int, tree long")
    dealt = collections.Counter((r["key"], r["side"]) for r in near_copies.second_deal(member, 8).collect())
    want = {(1000 + i, 1): 1 for i in range(100)} | {(1000 + i, 0): 25 for i in range(97, 100)}
    assert dealt == want


# --- 6: packing


def check_packing(pieces, ids_of, size=1024):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    padding = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 > 0
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    for d, want in ids_of.items():
        own = sorted(by_doc[d], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(want, "<u4").tobytes()
        assert {r["doc_tokens"] for r in own} == {len(want)}
    return padding


def test_packing_is_whole_and_without_padding(spark, docs, texts):
    got = packing.pack_documents(docs, BYTES).collect()
    assert check_packing(got, {d: [*library_ids(BYTES, t), 0] for d, t in texts.items()}) == 0
    odd = odd_docs(spark).withColumn("doc_id", F.monotonically_increasing_id())
    got = packing.pack_documents(odd, BYTES).collect()
    assert check_packing(got, {r["doc_id"]: [*library_ids(BYTES, r["text"]), 0] for r in odd.collect()}) == 0
    assert packing.pack_documents(empty_docs(spark), BYTES).count() == 0


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(5)
    p = packing.SumOfSquares(64, 0, most_open=50)
    rows = []
    for i in range(2000):
        n = rng.randrange(1, 64)
        level = p.place(n)
        counts = p.counts.copy()

        def cost(h, n=n, counts=counts):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + n < 64:
                c[h + n] += 1
            return int((c * c).sum())

        options = [0, *[h for h in range(1, 65 - n) if counts[h]]]
        assert cost(level) == min(map(cost, options))
        rows += list(p.add(i, np.arange(n).astype("<u4").tobytes()))
        assert p.n_open == p.counts.sum() <= 50
    rows += list(p.finish())
    whole = sum(1 for n in collections.Counter(r[0] for r in rows).values() if n == 1)
    assert whole > 1400


# --- 7: quality rules


def brute_counts(t):
    t = t or ""
    w = words(t)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    places = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(places)


@pytest.mark.parametrize("which", ["table", "odd"])
def test_quality_counts_and_base(spark, docs, which):
    df = (docs if which == "table" else odd_docs(spark)).withColumn("doc_id", F.monotonically_increasing_id())
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    out = quality_rules.judge_quality(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    for d, t in text.items():
        r, want = got[d], brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def brute_em(patterns, rounds=40, weight=0.05):
    k = len(patterns[0][0])
    prior = {"g_bad": 0.02, "g_good": 0.7, "b_bad": 0.4, "b_good": 0.5}
    m = {n: [v] * k for n, v in prior.items()} | {"share": 0.85}
    for _ in range(rounds):
        s = {n: [0.0] * k for n in prior}
        good = total = 0.0
        for votes, n in patterns:
            g = n * brute_posterior(m, votes)
            good, total = good + g, total + n
            for i, v in enumerate(votes):
                for c, mass in (("g", g), ("b", n - g)):
                    if v:
                        s[f"{c}_{'bad' if v < 0 else 'good'}"][i] += mass
        extra = weight * total + 1
        m = {n: [(x + prior[n] * extra) / ((good if n[0] == "g" else total - good) + extra) for x in s[n]] for n in prior}
        m["share"] = (good + 0.85 * extra) / (total + extra)
    return m


def brute_posterior(m, votes):
    def like(c):
        return sum(math.log(m[f"{c}_bad"][i] if v < 0 else m[f"{c}_good"][i] if v else 1 - m[f"{c}_bad"][i] - m[f"{c}_good"][i]) for i, v in enumerate(votes))

    return 1 / (1 + math.exp(min(700, math.log(1 - m["share"]) - math.log(m["share"]) + like("b") - like("g"))))


def test_expectation_maximisation_equals_brute_force(spark, docs):
    rows = quality_rules.judge_quality(docs).select("__votes", "quality").collect()
    patterns = sorted(collections.Counter(tuple(r["__votes"]) for r in rows).items())
    m = brute_em(patterns)
    for r in rows:
        assert math.isclose(r["quality"], brute_posterior(m, r["__votes"]), rel_tol=1e-6, abs_tol=1e-9)


def test_quality_filter_keeps_columns(spark, docs):
    out = quality_rules.keep_quality(docs)
    want = {r["doc_id"] for r in quality_rules.judge_quality(docs).where("kept").collect()}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
    assert quality_rules.keep_quality(empty_docs(spark)).count() == 0


# --- 8: token counts


def test_token_counts_equal_the_library(spark, docs, texts):
    for df in (docs, odd_docs(spark)):
        rows = df.select("doc_id", "text").collect()
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), len(library_ids(WORDS, r["text"]))) for r in rows)
        for chunk in (32768, 2000):
            got = token_counts.count_tokens(df, WORDS, chunk=chunk, overlap=64, limit=10).collect()
            assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
            assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in got)
    assert token_counts.count_tokens(empty_docs(spark), WORDS).count() == 0


def test_long_texts_without_safe_boundaries():
    lib = tokenizer(WORDS)
    rng = random.Random(2)
    for t in ("x" * 5000, "ab" * 900 + " " + "cd" * 900, "".join(rng.choice("ab '\n") for _ in range(6000)), "it's " * 1500):
        for chunk, overlap in ((500, 20), (1000, 300)):
            assert token_counts.count_long(lib, t, chunk, overlap) == len(lib.encode(t, add_special_tokens=False).ids)


# --- 9: vector search


def brute_top(vectors, k=20):
    q = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    out = {}
    for i in q:
        if i % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=False)), j) for j in q if j != i))[:k]
            out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(scores)}
    return out


def test_vector_search_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, block=100, query_block=7).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute_top(vectors)


def test_vector_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, [nan]), (5, [inf]), (6, []), (7, [0.0, 0.0, 9.0]), (8, [1.0, -0.5]), (20, [-1.0, 0.5]), (None, [1.0]), (9, [3e7]), (40, [2e7])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    fine = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == {k: v for k, v in brute_top(fine, 3).items()}
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vector_search.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def brute_rows(rows, k, scale=64):
    """Rows (id, vector), each a query if its id divides by 20: its k best other rows, in Python's integers."""
    fine = [(i, [vector_search.whole(x, scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for at, (i, q) in enumerate(fine):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for n, (j, v) in enumerate(fine) if n != at)[:k]
            out.update((i, r + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, j) in enumerate(scores))
    return out


def found_rows(spark, rows, k, **blocks):
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<double>, n int, query_key string")
    return collections.Counter(tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 20 == 0, k=k, **blocks).collect())


def test_vectors_of_any_size_and_repeated_rows(spark):
    rows = [(0, [4e7, 1.0]), (1, [3e7] * 4), (2, [3.1e7] * 4), (3, [-1e9, 5.0]), (4, [1e300, -1e300]), (5, [1.7e308, 1.0]), (6, [0.5, -0.5]), (7, [0.01])]
    rows += [(20, [3e7] * 4), (20, [-3e7] * 4), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (40, [2.0, 1.0]), (60, [-1e305, 1e305]), (80, [0.0]), (80, [-0.0]), (9, [1.0]), (9, [1.0]), (9, [1.0])]
    for k in (3, 30):
        assert found_rows(spark, rows, k, block=5, query_block=3) == brute_rows(rows, k)


@pytest.mark.parametrize("size", [3, 2**12, 2**18, 2**29])
def test_sparse_and_long_vectors(spark, size):
    rng = random.Random(size)

    def vector(filled):
        v = [0.0] * 90
        for t in rng.sample(range(90), filled):
            v[t] = float(rng.randrange(-size, size))
        return v

    rows = [(i, vector(rng.choice([1, 4, 8]) if i % 5 else 90)) for i in range(160)]
    assert found_rows(spark, rows, 6, block=50, query_block=4) == brute_rows(rows, 6)
    terms = vector_search.Postings([np.array(v) for i, v in rows if i % 5], 64).terms
    assert all(places is not None for places, _ in terms)


def test_one_very_wide_vector_among_narrow_ones():
    rng, width = np.random.default_rng(0), 400_000
    vectors = [rng.integers(-3, 4, 5).astype(float) for _ in range(2000)]
    vectors[7] = np.zeros(width)
    vectors[7][[0, 3, width - 1]] = [1, 2, 3]
    tracemalloc.start()
    postings = vector_search.Postings(vectors, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 2,000 rows as wide as the widest would be 6.4 GB
    query = np.zeros(width)
    query[[0, 3, width - 1, 77]] = [0.5, -1, 2, 9]
    for q in (query, query[:4], np.zeros(0)):
        want = [64 * 64 * int(sum(2 * a * b for a, b in zip(q[:n].tolist(), v[:n].tolist(), strict=True))) // 2 for v in vectors for n in [min(len(v), len(q))]]
        assert postings.scores(q)[0].tolist() == want
    assert vector_search.Postings([], 64).scores(query)[0].tolist() == [] and vector_search.Postings([np.zeros(0)], 64).scores(query)[0].tolist() == [0]


# --- 10: language


def test_language_on_held_out_texts(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, sf_dir).collect()}
    assert set(got) == set(truth)
    out = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (d in set(out)) and 0 <= got[d]["score"] <= 1 for d in truth)
    assert sum(got[d]["lang_pred"] == truth[d] for d in out) / len(out) > 0.97


def test_language_tables_equal_the_network():
    model = language_id.train([("a", b"the cat " * 40), ("b", b"zwx qkj " * 40)] * 3, length=64, rounds=60)
    rows = language_id.windows(b"the zwx cat qkj" * 20, 64)
    got = model.log_odds(rows, model.tables())
    x = np.pad(rows, ((0, 0), (0, language_id.TAIL)), constant_values=32)
    e, features = model.embed[x], []
    for w, b in zip(model.filters, model.bias, strict=True):
        z = sum(e[:, j : j + 64] @ w[j] for j in range(len(w)))
        features.append(np.maximum(z.max(axis=1) + b, 0))
    assert np.allclose(got, np.concatenate(features, axis=1) @ model.out + model.out_bias, atol=1e-4)
    assert [x for x, _ in language_id.predict(model, ["the cat the cat", "zwx qkj zwx"], model.tables())] == ["a", "b"]


def test_number_signs_are_no_letters(spark):
    model = language_id.train([("a", b"the cat " * 40), ("b", b"zwx qkj " * 40)], length=64, rounds=20)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ²", "Ⅷ", "12 — 3", "é", "漢", "ª"])], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language_id.predict_language(df, model).orderBy("doc_id").collect()] == [True] * 3 + [False] * 3


def clashing(df):
    """The table with more columns, named as the operators name theirs."""
    names = "__size __key __t __a __counts __votes __base __id __text __doc __score __shards __order __rank rank block root fp cell n key size".split()
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names if n not in df.columns])


def test_columns_of_clashing_names_pass_unchanged(spark, docs):
    df = clashing(docs.limit(60))
    rows = {r["doc_id"]: r for r in df.collect()}
    for f in (quality_rules.keep_quality, simhash.keep_one, mixing.mixed_documents, lambda d: toxicity.keep_clean(d, None)):
        got = f(df)
        found = got.collect()
        assert got.columns == df.columns and found and all(r == rows[r["doc_id"]] for r in found)
    assert mixing.mix_sources(df)[0].count() == len(rows) == quality_rules.judge_quality(df).count() == simhash.near_duplicates(df).count()
    assert packing.pack_documents(df, BYTES).count() >= len(rows) and token_counts.count_tokens(df, WORDS).count() == len(rows)


def test_packing_keeps_any_number_of_windows_open():
    p = packing.SumOfSquares(64, 0)
    rows = [r for i in range(9000) for r in p.add(i, np.zeros(40, "<u4").tobytes())]
    assert not rows and p.n_open == 9000  # two of 40 never fit a window
    rows = list(p.finish())
    assert sum(r[2] for r in rows) == 9000 * 40 and {n & (n - 1) for n in collections.Counter(r[4] for r in rows for _ in range(r[2])).values()} == {0}


def test_language_without_letters_or_model(spark):
    model = language_id.train([("a", b"the cat " * 40), ("b", b"zwx qkj " * 40)], length=64, rounds=20)
    got = [(r["lang_pred"], r["score"]) for r in language_id.predict_language(odd_docs(spark), model).collect()]
    assert [p == "und" for p, _ in got] == [not re.search(r"[^\W\d_]", t or "") for t in ODD_TEXTS]
    assert {r["lang_pred"] for r in language_id.predict_language(odd_docs(spark), None).collect()} == {"und"}
    assert language_id.predict_language(empty_docs(spark), model).count() == 0
    assert language_id.train_language_id(empty_docs(spark)) is None

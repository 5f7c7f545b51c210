"""Operators 11 to 13 against brute force, on odd, empty and hot tables and with small blocks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connection
from tidemark.llm import decontamination, fm_index, lexical_search, prefix_trie, queries
from tidemark.llm.common import WORD, terms_of

ODD = [None, "", " ", "\n\n", "Éa ñandú 漢字 B2b it's_ok 12,5", "x" * 9000, "word " * 3000, "\x1c \xa0 z", "a b c d e f g h i j k l", "A, B. c-D e_F g!H (i) j", "a b c", "a b c d e f g h i j k l"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connection(sf), queries.ORACLE_SQL[name])


# --- 11


def trie_by_brute_force(rows, every=20, most=4):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        base, h = c - int(math.fmod(c, every)), zlib.crc32(str(c).encode()) % most
        built[c] = own if base == c else turns.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(own[:d]), []).append(c)
    out = Counter()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(WORD, q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out[min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("pos", F.lit("x"))
    nodes = prefix_trie.conversation_trie(*prefix_trie.rebuilt_turns(prefix_trie.numbered_turns(df)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in nodes.select(*columns).collect())


@pytest.mark.parametrize("block", [2, 1024])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for c in [*range(-25, 70), 2**40 + 1, 2**63 - 1]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a b", "c", "", None, "long text here"])))
    rows += [(None, 0, "user", "lost"), (5, 1, "user", "x"), (5, 1, "user", "x"), (7, None, None, None)]
    assert trie_rows(spark, rows) == trie_by_brute_force(rows)


def test_trie_of_nothing_and_of_one_turn(spark):
    assert not trie_rows(spark, [])
    # 23 has one turn and takes none of the absent conversation 20: it may be turnless
    rows = [(23, 0, "user", "a b c")]
    assert trie_rows(spark, rows) == trie_by_brute_force(rows)


def test_one_long_conversation_and_many_copies(spark):
    rows = [(20, t, "user", f"w{t % 3}") for t in range(400)] + [(40 + 20 * i, t, "user", "same") for i in range(30) for t in range(2)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    assert sorted(r["pos"] for r in turns.where("conv_id = 20").collect()) == list(range(1, 401))
    assert trie_rows(spark, rows) == trie_by_brute_force(rows)


def test_ends_are_hashed_in_chunks(spark, monkeypatch):
    ends = [(b"a", i * 7 % 1000 - 300) for i in range(1000)] + [(b"b", 5)]
    found = {bytes(r["key"]): r["ends_sha256"] for r in prefix_trie.end_hashes(spark.createDataFrame(ends, "key binary, conv_id long")).collect()}
    assert found == {k: hashlib.sha256(",".join(map(str, sorted(c for x, c in ends if x == k))).encode()).hexdigest() for k in (b"a", b"b")}


def test_chunks_of_ends_join_to_the_same_hash(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    batch = pa.RecordBatch.from_pydict({"key": pa.array([b"a"] * 8 + [b"b"], pa.binary()), "conv_id": pa.array([*range(8), 1], pa.int64())})
    chunks = list(prefix_trie._chunks(iter([batch, batch.slice(9)])))
    assert [t for c in chunks for t in c["ids"].to_pylist()] == ["0,1,2", "3,4,5", "6,7", "1"]
    found = [r for b in prefix_trie._hashed(iter(chunks)) for r in b.to_pylist()]
    assert found == [{"key": b"a", "ends_sha256": hashlib.sha256(b"0,1,2,3,4,5,6,7").hexdigest()}, {"key": b"b", "ends_sha256": hashlib.sha256(b"1").hexdigest()}]


# --- 12


def ranked_by_brute_force(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        terms = set(term.findall((text or "").translate(lower)))
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms), i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return Counter(out)


def odd_items():
    return [(1, "a b c it ñandú"), (2, None), (3, ""), (4, "nowhere to find"), (5, "漢字 WORD x"), (None, "a z"), (7, "c c c b2B"), (7, "c c c b2B"), (7, "e f"), (8, "k l a")]


@pytest.mark.parametrize("block_terms", [3, 1 << 18])
def test_search_equals_brute_force_on_odd_texts(spark, block_terms):
    docs = [(i if i % 5 else None, t) for i, t in enumerate(ODD * 3)] + [(3, "a b c"), (3, "a b c"), (4, "many " * 300 + "a")]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, n long, terms string")
    items = spark.createDataFrame([(*x, 0) for x in odd_items()], "item_id long, text string, rank int")
    found = lexical_search.search(lexical_search.index_documents(df), items, block_terms=block_terms)
    assert Counter(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()) == ranked_by_brute_force(docs, odd_items())


def test_search_without_documents_or_items(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    index = lexical_search.index_documents
    assert lexical_search.search(index(docs), items).count() == 1
    assert lexical_search.search(index(docs.limit(0)), items).count() == 0
    assert lexical_search.search(index(docs), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_sketches_bound_the_scores_and_spare_most_of_them(spark, sf):
    import pyarrow as pa

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([(d[1] or "").encode() for d in docs], pa.binary())})
    index = next(lexical_search._index(iter([batch])))
    index = index.filter(pa.compute.greater(index["n"], 0))
    own = lexical_search.Queries([sorted(set(terms_of(t.encode()))) for t in items])
    own.weigh(index.num_rows, Counter(t for terms in index["terms"].to_pylist() for t in terms.split(b" ")))
    for row in index.to_pylist():
        exact = [own.score(q, own.counts(row["terms"], row["counts"]), 100) for q in range(len(items))]
        assert (own.bounds(lexical_search.read_sketch(row["sketch"]), 100) >= exact).all()
    best = lexical_search.Best(len(items), 1)
    taken = lexical_search.search_batch(own, best, index, index.num_rows, sum(index["n"].to_pylist()))
    assert taken < 0.2 * index.num_rows * len(items)


def test_stored_sketches_come_back():
    for terms, counts in (([], []), ([b"a"], [3]), ([b"%d" % i for i in range(9000)], list(range(1, 9001)))):
        sketch = lexical_search.sketch_of(terms, np.array(counts, np.int32))
        assert np.array_equal(lexical_search.read_sketch(lexical_search.stored_sketch(sketch)), sketch)
        assert len(terms) < 9000 or len(sketch) == 1 << lexical_search.MOST_BITS


def test_many_occurrences_are_bounded():
    own = lexical_search.Queries([[b"a"]])
    own.weights[:] = 7
    sketch = lexical_search.sketch_of([b"a"], np.array([10**6], np.int32))
    assert own.bounds(sketch, 10)[0] >= own.score(0, own.counts(b"a", np.array([10**6], np.int32).tobytes()), 10)


# --- 13


@pytest.mark.parametrize("seed", range(8))
def test_fm_index_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(2, 6))
    words = rng.integers(0, size, int(rng.integers(0, 300)))
    words = np.concatenate([words, words[: len(words) // 2], [0], words])
    order = fm_index.suffix_order(words)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:].tolist())
    index = fm_index.FMIndex(words, np.arange(len(words)), size, every=int(rng.integers(1, 9)))
    phrases = [rng.integers(1, size, n).tolist() for n in (1, 2, 3, 4, 4, 2)] + [[w for w in words[i : i + 4].tolist() if w] or [1] for i in range(20)]
    back = np.array([[*reversed(p), *[0] * (4 - len(p))] for p in phrases])
    low, high = index.ranges(back, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(words)) if words[i : i + len(p)].tolist() == p]


def test_wavelet_ranks_and_reads():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 11, 500)
    wavelet = fm_index.Wavelet(symbols, 11)
    at = rng.integers(0, 501, 200)
    own = rng.integers(0, 11, 200)
    assert wavelet.rank(own, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(own, at, strict=True)]
    read, ranks = wavelet.read(np.arange(500))
    assert read.tolist() == symbols.tolist() and ranks.tolist() == [int((symbols[:i] == symbols[i]).sum()) for i in range(500)]


def spans_by_brute_force(text, items, window=10):
    word = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    own = [(m.group().translate(lower), m.start(), m.end()) for m in word.finditer(text or "")]
    words, hit, names = [w[0] for w in own], set(), set()
    for item, t in items:
        need = [m.group().translate(lower) for m in word.finditer(t or "")]
        for i in range(max(1, len(need) - window + 1)) if need else []:
            phrase = need[i : i + window]
            for p in range(len(words) - len(phrase) + 1):
                if words[p : p + len(phrase)] == phrase:
                    hit |= set(range(p, p + len(phrase)))
                    names |= {str(item)} if item is not None else set()
    spans = []
    for p in sorted(hit):
        if spans and spans[-1][1] == p:
            spans[-1] = (spans[-1][0], p + 1, spans[-1][2], own[p][2])
        else:
            spans.append((p, p + 1, own[p][1], own[p][2]))
    return len(words), spans, sorted(names)


@pytest.mark.parametrize("shard_words,block_words", [(1 << 20, 1 << 18), (16, 1 << 18), (40, 12)])
def test_contamination_equals_brute_force(spark, shard_words, block_words):
    rng = random.Random(shard_words)
    items = [(i, " ".join(rng.choice("abcdé") for _ in range(n))) for i, n in enumerate([1, 3, 9, 10, 11, 14, 25])] + [(9, None), (10, " ,. "), (None, "z y"), (3, "漢字 b2b"), (11, "c d a")]
    docs = [(i if i % 5 else None, t) for i, t in enumerate(ODD)]
    docs += [(100 + i, ", ".join(rng.choice("abcdéABq") for _ in range(rng.choice([3, 30, 90])))) for i in range(20)] + [(200 + i, f"é {items[i % 7][1].upper()}! 漢字 b2B, tail") for i in range(14)]
    df = spark.createDataFrame([(*d, "s", "k") for d in docs], "doc_id long, text string, item_id string, key string").repartition(3)
    found = decontamination.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words, block_words=block_words)
    assert found.columns == ["doc_id", "text", "item_id", "key", "__n_words", "__spans", "__items"]
    rows = [(r["doc_id"], r["text"], r["__n_words"], tuple(tuple(s) for s in r["__spans"]), tuple(r["__items"])) for r in found.collect()]
    wanted = [(i, t, n, tuple(s), tuple(x)) for i, t in docs for n, s, x in [spans_by_brute_force(t, items)]]
    assert Counter(rows) == Counter(wanted)


def test_spans_are_cut_out_of_the_texts(spark):
    docs = [(1, "Keep 漢字 this: a B c d, é f! and that", 5), (2, None, 6), (3, "clean", 7), (4, "a b c d é f", 8)]
    items = spark.createDataFrame([("q", "A b C d é F")], "item_id string, text string")
    out = decontamination.remove_contamination(spark.createDataFrame(docs, "doc_id long, text string, __doc_size int"), items)
    assert {r["doc_id"]: (r["text"], r["__doc_size"]) for r in out.collect()} == {1: ("Keep 漢字 this: ! and that", 5), 2: (None, 6), 3: ("clean", 7), 4: ("", 8)}
    assert out.columns == ["doc_id", "text", "__doc_size"]


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.find_contamination(docs.limit(0), items).count() == 0
    assert [tuple(r)[2:] for r in decontamination.find_contamination(docs, items.limit(0)).collect()] == [(2, [], [])]

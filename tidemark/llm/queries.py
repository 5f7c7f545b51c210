"""The thin queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, lexical_search, mixing, packing, prefix_trie, quality_rank, quality_rules, simhash, token_counts, token_files, toxicity, vector_search
from tidemark.llm.common import work_folder, written


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    mix, _ = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    taken = F.col("__size") * F.size("__shards")
    return mix.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"))


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality_ranking(spark, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_rank.train_ranking(docs, _table(spark, sf_dir, "labels"))
    return quality_rank.score_quality(docs, model).select("doc_id", quality_rank.held_out(5, 0).alias("held_out"), "score", "predicted")


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", quality_rank.held_out(5, 0).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op6_pack(spark, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_vector_search(spark, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train_language_id(docs)
    return language_id.predict_language(docs, model).select("doc_id", quality_rank.held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, lengths = prefix_trie.rebuilt_turns(prefix_trie.numbered_turns(_table(spark, sf_dir, "conversations")))
    nodes = prefix_trie.conversation_trie(turns, lengths)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = written(lexical_search.index_documents(_table(spark, sf_dir, "documents")), "lexical-index")
    return lexical_search.search(index, _table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    hit = F.coalesce(F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))
    items = F.sha2(F.array_join("__items", ","), 256)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), items.alias("items_sha256"), (hit > 0).alias("contaminated"))


def pipeline(spark, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_token_files, op3_quality_ranking, op4_near_duplicates, op5_toxicity, op6_pack, op7_quality_rules, op8_token_counts, op9_vector_search, op10_language_id, op11_prefix_trie, op12_lexical_search, op13_decontamination, pipeline)}

ORACLE_SQL = {
    "op9_vector_search": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20""",
    # DuckDB has no crc32: the bits of its polynomial, one byte after another
    "op11_prefix_trie": r"""
with recursive bytes as (select conv_id, conv_id::varchar as s, 0 as i, 4294967295::bigint as c from (select distinct conv_id from conversations where conv_id is not null)
    union all select conv_id, s, i + 1, list_reduce([xor(c, ascii(s[i + 1]))::bigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: xor(x >> 1, (x & 1) * 3988292384)) from bytes where i < length(s)),
h as (select conv_id, conv_id - conv_id % 20 as base, case when conv_id % 20 = 0 then 0 else xor(c, 4294967295) % 4 end as h from bytes where i = length(s)),
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos from conversations where conv_id is not null),
b as (select h.conv_id, 0 as own, pos, role, text from h join t on t.conv_id = h.base and t.pos <= h.h
    union all select h.conv_id, 1, pos, role, text from h join t using (conv_id) where pos > h.h),
r as (select conv_id, row_number() over (partition by conv_id order by own, pos) as d, {'role': role, 'text': text} as turn from b),
w as (select h.conv_id, coalesce(list(turn order by d) filter (d is not null), []) as turns from h left join r using (conv_id) group by h.conv_id),
p as (select conv_id, d, turns[:d] as prefix, len(turns) = d as last from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from w)),
n as (select prefix, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '') as ends from p group by prefix),
k as (select prefix[:len(prefix) - 1] as prefix, count(*) as n_children from n where depth > 0 group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) end as saved from n left join k using (prefix)),
u as (select prefix[:a] as prefix, saved, n_children from (select prefix, saved, n_children, unnest(range(depth + 1)) as a from f)),
x as (select prefix, sum(saved)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from u group by prefix)
select f.conv_id, f.depth::bigint as depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) as ends_sha256
from f join x using (prefix) left join f q on f.depth > 0 and q.prefix = f.prefix[:f.depth - 1]""",
    "op12_lexical_search": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
p as (select r, any_value(doc_id) as doc_id, term, count(*) as tf from (select r, doc_id, unnest(terms) as term from d) group by r, term),
l as (select r, len(terms)::bigint as n from d where len(terms) > 0),
s as (select count(*)::bigint as total, sum(n)::bigint as words from l),
m as (select r, 10 + (90 * n * total) // words as m from l cross join s),
w as (select term, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::bigint as w from p cross join s group by term),
q as (select distinct item_id, term from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)),
x as (select item_id, r, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join p using (term) join w using (term) join m using (r) group by item_id, r),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from x where score > 0)
select item_id, rank::integer as rank, doc_id, score from k where rank <= 10""",
    "op13_decontamination": r"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words from documents),
q as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
w as (select distinct item_id, words[p:p + 9] as phrase, least(len(words), 10) as n from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as p from q where len(words) > 0)),
g as (select r, p, n, words[p:p + n - 1] as phrase from (select r, words, n, unnest(range(1, len(words) - n + 2)) as p from d cross join (select distinct n from w))),
o as (select r, p, g.n, item_id from g join w using (phrase)),
h as (select r, count(distinct place) as n_hit from (select r, unnest(range(p, p + n)) as place from (select distinct r, p, n from o)) group by r),
i as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from o group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join i using (r)""",
}

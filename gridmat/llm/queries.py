"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmat.llm import html_text, jaccard_join, language_id, merkle, mixing, packing, quality_classifier, quality_rules, sharding, suffix_dedup, va_search, warc, word_runs
from gridmat.llm.common import table


def op1_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_induced_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op3_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op4_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op5_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op6_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_va_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return va_search.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op8_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bm25_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_index_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_digests(table(spark, sf_dir, "documents"))


def op13_window_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_dom_trees": op1_dom_trees,
    "op2_induced_dedup": op2_induced_dedup,
    "op3_jaccard_classes": op3_jaccard_classes,
    "op4_viterbi_language": op4_viterbi_language,
    "op5_perplexity_rules": op5_perplexity_rules,
    "op6_shard_tree": op6_shard_tree,
    "op7_va_top_k": op7_va_top_k,
    "op8_soft_mix": op8_soft_mix,
    "op9_bm25_pack": op9_bm25_pack,
    "op10_random_indexing": op10_random_indexing,
    "op11_index_warc": op11_index_warc,
    "op12_lyndon_runs": op12_lyndon_runs,
    "op13_window_merkle": op13_window_merkle,
}

#: crc32 of the decimal id, bit by bit; its table of bits is one list.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''),
            lambda c: list_transform(range(8), lambda k: (ascii(c) >> k::integer)::bigint & 1)))),
            lambda c, b: xor(c >> 1, case when c & 1 <> b then 3988292384::bigint else 0::bigint end)))"""


def _hashed(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')" for v in values) + ")"


ORACLES: dict[str, str] = {
    "op11_index_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        r as (
            select *, row_number() over w as rank, first_value(page_id) over w as first from p
            window w as (partition by payload_digest order by page_id desc nulls last))
        select page_id, payload_bytes, payload_digest, case when payload_bytes < 1000 or rank = 1 then 'response' else 'revisit' end as record_type,
            case when payload_bytes >= 1000 and rank > 1 then first end as refers_to
        from r""",
    "op13_window_merkle": f"""
        with recursive hashed as (
            select doc_id, lang, {_hashed("doc_id", "source", "lang", "n_chars", "text")} as leaf,
                case when doc_id is not null and {_CRC32} % 7 = 0 then {_hashed("doc_id", "source", "lang", "(n_chars + 1)", "text")} end as other
            from documents),
        leaves as (
            select *, row_number() over () as rid, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
                count(*) over (partition by lang) as n from hashed),
        nodes as (
            select lang, 0 as level, pos, n, leaf as h from leaves
            union all
            select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by lang, level, pos // 2, n),
        subroots as (
            select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
        tops as (
            select 0 as level, pos, n, h from subroots
            union all
            select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by level, pos // 2, n),
        steps as (
            select l.rid, x.level, case when s.h is null then '=' when s.pos < x.pos then '<' || s.h else '>' || s.h end as step
            from leaves l join nodes x on x.lang is not distinct from l.lang and x.pos = l.pos >> x.level and x.n > 1
            left join nodes s on s.lang is not distinct from l.lang and s.level = x.level and s.pos = xor(x.pos, 1::bigint)
            union all
            select l.rid, 1000 + x.level, case when s.h is null then '=' when s.pos < x.pos then '<' || s.h else '>' || s.h end
            from leaves l join subroots r on r.lang is not distinct from l.lang join tops x on x.pos = r.pos >> x.level and x.n > 1
            left join tops s on s.level = x.level and s.pos = xor(x.pos, 1::bigint)),
        paths as (select rid, list(step order by level) as path from steps group by rid),
        folds as (
            select l.doc_id, l.leaf, r.h as subroot, t.h as root, sha256(coalesce(array_to_string(list_transform(p.path, lambda s: s[2:]), ''), '')) as proof_sha256,
                list_reduce(list_prepend(coalesce(other, leaf), coalesce(p.path, [])),
                    lambda h, s: sha256(case s[1] when '<' then s[2:] || h when '>' then h || s[2:] else h end)) as folded_root
            from leaves l join subroots r on r.lang is not distinct from l.lang join tops t on t.n = 1 left join paths p using (rid))
        select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folds""",
    "op7_va_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
              and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
        s as (
            select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
            from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 10""",
}

"""The registered queries of the operators and of the corpus pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_bytes(name: str) -> bytes:
    """A vocabulary file, read on the driver; its size does not depend on the data."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_bytes("byte_bpe_50k.tiktoken"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import pii

    return pii.digests(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import quality

    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import secrets

    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import substrings

    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import jaccard

    return jaccard.similar(table(spark, sf_dir, "documents"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import leaks

    return leaks.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import tokenfiles

    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), vocabulary_bytes("byte_bpe_50k.json"), added_tokens=True)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import sharding

    return sharding.placement(table(spark, sf_dir, "documents"))


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthmark.llm import scoring

    return scoring.score(table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle samples of every document, as cuts and hashes."""
    from hearthmark.llm import infill

    return infill.digests(table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from hearthmark.llm import mainhtml

    return mainhtml.extracted(table(spark, sf_dir, "pages"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and each of its best positives."""
    from hearthmark.llm import negatives

    return negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_substrings": op5_substrings,
    "op6_jaccard": op6_jaccard,
    "op7_leaks": op7_leaks,
    "op8_token_files": op8_token_files,
    "op9_sharding": op9_sharding,
    "op10_scoring": op10_scoring,
    "op11_infill": op11_infill,
    "op12_main_text": op12_main_text,
    "op13_negatives": op13_negatives,
}

WORD = r"[^\x20\x09-\x0D]+"

REPEATS_SQL = f"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
    win as (select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50),
    named as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as h from win),
    own as (select h, min(doc_id) as first_doc from named group by h),
    hit as (select n.doc_id, n.i from named n join own o on n.h = o.h where o.first_doc < n.doc_id),
    gone as (select distinct doc_id, k from (select doc_id, unnest(range(i, i + 50)) as k from hit) x),
    word as (select doc_id, unnest(range(1, len(ws) + 1)) as k, unnest(ws) as word from w),
    kept as (select doc_id, string_agg(word, ' ' order by k) as s from word where (doc_id, k) not in (select doc_id, k from gone) group by doc_id),
    removed as (select doc_id, count(*) as n from gone group by doc_id)
    select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(r.n, 0) as n_removed, sha256(coalesce(k.s, '')) as kept_sha256
    from w left join removed r on r.doc_id = w.doc_id left join kept k on k.doc_id = w.doc_id"""

SIMILAR_SQL = f"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws
        from documents),
    sets as (select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as s from w),
    item as (select doc_id, unnest(s) as x from sets),
    common as (select a.doc_id as a, b.doc_id as b, count(*) as n from item a join item b on a.x = b.x and a.doc_id > b.doc_id group by 1, 2),
    link as (select a, b from common join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
    both_ as (select a, b from link union select b, a from link),
    reach as (select doc_id as node, doc_id as root from sets union select both_.a, reach.root from reach join both_ on both_.b = reach.node)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.root) as component_id
    from sets s join reach r on r.node = s.doc_id group by 1, 2"""

INFILL_SQL = """
    with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
    k as (select doc_id, t, length(t) as n, list_transform([0, 1, 2, 3], lambda i: cast('0x' || h[8 * i + 1:8 * i + 8] as bigint)) as r from d),
    c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 90 then 'plain'
            when r[4] % 100 < 20 then 'spm' else 'psm' end as form from k),
    p as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from c)
    select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars,
        case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
        sha256(t) as restored_sha256
    from p"""

NEGATIVES_SQL = """
    with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
        where vec_id is not null and label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pair as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as s
        from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
    pos as (select a, b as p, s as ps from pair where same qualify row_number() over (partition by a order by s desc, b) <= 5)
    select pos.a as anchor_id, pos.p as positive_id, cast(row_number() over (partition by pos.a, pos.p order by n.s desc, n.b) as integer) as rank,
        n.b as negative_id, pos.ps as positive_score, n.s as negative_score
    from pos join pair n on n.a = pos.a and not n.same and 30 * pos.ps <= 100 * n.s and 100 * n.s <= 90 * pos.ps
    qualify row_number() over (partition by pos.a, pos.p order by n.s desc, n.b) <= 10"""

ORACLES: dict[str, str] = {
    "op5_substrings": REPEATS_SQL,
    "op6_jaccard": SIMILAR_SQL,
    "op11_infill": INFILL_SQL,
    "op13_negatives": NEGATIVES_SQL,
}


def all_queries() -> dict[str, Query]:
    pipeline = importlib.import_module("corpus_pipeline")
    return {**QUERIES, "pipeline": pipeline.run}


def all_oracles() -> dict[str, str]:
    pipeline = importlib.import_module("corpus_pipeline")
    return {**ORACLES, **({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})}

"""The corpus operators' queries over the tables of a folder, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, lm_scoring, media, mixing, packing, quality_rules, simhash, suffix_dedup, token_counts

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.judge(docs, _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), F.coalesce(_fold() == 1, F.lit(False)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"), shingle=3)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(_fold() != 0), "text", "lang", "doc_id", public_tokenizers.path(PIECES))
    held = docs.select("doc_id", "text", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"))
    return language_id.predict(held, model).drop("text")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return media.digests(media.with_media(text))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_suffix_dedup, op2_quality_rules, op3_lm_scoring, op4_simhash, op5_best_fit_packing, op6_token_counts, op7_license_scan, op8_language_id, op9_mix_sources, op10_media, pipeline)
    return {f.__name__: f for f in own}


MIX_SQL = r"""with d as (select doc_id, source, case when text is null then 0 else len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) end::bigint size from documents),
s as (select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 w from d group by source),
r as (select *, 3 * source_size / w::double ratio, sum(source_size) over () total, coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) spent,
 sum(w) over (o rows between current row and unbounded following) weight from s window o as (order by 3 * source_size / w::double, source nulls last)),
f as (select total - spent rest, weight from r where 3 * source_size * weight > (total - spent) * w order by ratio, source nulls last limit 1),
t as (select source, source_size, case when f.weight is null or 3 * source_size * f.weight <= rest * w then (3 * source_size)::double else (rest * w)::double / f.weight::double end target from r left join f on true),
q as (select *, round_even(target, 0)::bigint flow from t),
p as (select *, case when source_size = 0 then 0 else flow // source_size end base, case when source_size = 0 then 0 else flow % source_size end rest from q),
o as materialized (select doc_id, coalesce('s' || d.source, 'n') src, size, source_size, target, base, rest, md5('mix:' || doc_id::varchar) ord from d join p on d.source is not distinct from p.source),
ROUNDS
select doc_id, size, source_size, target, (size * (base + case when size > 0 and (CHOSEN or coalesce(ord = x.xord and size = x.xsize, false)) then 1 else 0 end))::bigint taken from o left join x using (src)"""
_ROUND = """c{n} as (select src, ord, size, gap{m} gap, sum(size) over (partition by src order by ord, size) cum from o join s{m} using (src) where size > 0 and size <= gap{m} and (ord > ord{m} or (ord = ord{m} and size > size{m}))),
s{n} as (select src, gap{m} - coalesce(cum, 0) gap{n}, coalesce(hi.ord, ord{m}) ord{n}, coalesce(hi.size, size{m}) size{n} from s{m} left join (select src, max(cum) cum, max({{'ord': ord, 'size': size}}) hi from c{n} where cum <= gap group by src) using (src)),"""


def mix_sql() -> str:
    """MIX_SQL with its rounds written out; a round that takes nothing ends where the one before did."""
    n = mixing.ROUNDS
    rounds = "s0 as (select distinct src, rest gap0, '' ord0, -1::bigint size0 from o),\n" + "\n".join(_ROUND.format(n=i, m=i - 1) for i in range(1, n + 1))
    chosen = " or ".join(f"((ord > ord{i - 1} or (ord = ord{i - 1} and size > size{i - 1})) and (ord < ord{i} or (ord = ord{i} and size <= size{i})) and size <= gap{i - 1})" for i in range(1, n + 1))
    joined = "o " + " ".join(f"join s{i} using (src)" for i in range(n + 1))
    rounds += f"\nt1 as (select o.*, {chosen} chosen, gap{n} left_over from {joined}),\nx as (select src, hi.ord xord, hi.size xsize from (select src, min({{'size': size, 'ord': ord}}) hi from t1 where size > left_over and size < 2 * left_over and not chosen group by src))"
    return MIX_SQL.replace("ROUNDS", rounds).replace("from o left join x", "from t1 left join x").replace("CHOSEN", "chosen")


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.judge_sql(), "op7_license_scan": license_scan.scan_sql(), "op9_mix_sources": mix_sql()}

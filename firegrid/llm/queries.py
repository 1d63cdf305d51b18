"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firegrid.llm import alignment, ann, chat, decontam, jaccard, langid, maxent, mixing, periodic, quality, rules, rules_sql, tokens, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_snapshots(_read(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_folds(_read(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents"))


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_read(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.collapse_digest(_read(spark, sf_dir, "documents"))


def op13_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_snapshots, op2_language_id, op3_nearest_neighbours, op4_maxent_scores, op5_url_filter, op6_source_mixture,
        op7_jaccard_components, op8_token_ids, op9_quality_rules, op10_template_decontamination,
        op11_token_alignment, op12_periodic_runs, op13_adaptive_rules, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_snapshots": chat.SQL, "op7_jaccard_components": jaccard.SQL, "op13_adaptive_rules": rules_sql.SQL}

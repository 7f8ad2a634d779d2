"""The evaluation matrix: models, datasets and context profiles as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Datasets by family, and the profiles (mode-window) of each family: with memory state, untruncated, truncated.
FAMILIES = {
    "wiki": ("2wiki_single_s2000", "2wiki_pack_s400", "hotpotqa_single_s2000", "hotpotqa_pack_s400", "musique_single_s2000", "musique_pack_s400"),
    "dialogue": ("locomo_single", "longmemeval_s", "mab_fact_single"),
    "ttl": ("banking77", "clinc150", "nlu", "trec_coarse", "trec_fine", "movie_rec"),
    "longqa": ("infbench_qa_single", "infbench_dialogue_single", "mab_eventqa_single", "narrativeqa_single_s120d"),
    "ruler": ("ruler_sniah2", "ruler_sniah3", "ruler_mkniah1", "ruler_mqniah", "ruler_mvniah"),
    "align": ("locomo_official", "banking77_official", "clinc150_official", "nlu_official", "trec_coarse_official", "trec_fine_official", "movie_rec_official"),
}
SHORT, LONG = ("state-8k", "truncate-256k", "truncate-8k"), ("state-32k", "truncate-256k", "truncate-32k")
ALIGN = ("truncate-256k", "truncate-128k")
MODELS = ("memory", "qwen3-4b", "delta", "c2l", "rag", "recurrent")


def datasets(spark: SparkSession) -> DataFrame:
    rows = [(name, family, "_pack" in name, list(ALIGN if family == "align" else SHORT if family == "wiki" or name == "locomo_single" else LONG)) for family, names in FAMILIES.items() for name in names]
    return spark.createDataFrame(rows, "dataset string, family string, pack boolean, profiles array<string>")


def present(counts: DataFrame) -> DataFrame:
    """Datasets (dataset, family, pack, profiles) that are there, from (dataset, family, pack); a family without profiles of its own has the long ones."""
    names = lambda profiles: F.array(*map(F.lit, profiles))
    profiles = F.when(F.col("family") == "align", names(ALIGN)).when(F.col("family") == "wiki", names(SHORT)).otherwise(names(LONG))
    return counts.select("dataset", "family", "pack", profiles.alias("profiles"))


def runs(spark: SparkSession, profile: str | None = None, sets: DataFrame | None = None) -> DataFrame:
    """(model, dataset, profile, pool) of all runs of the release's datasets, or of others: models with orchestration use the untruncated profile alone, packs go to one of them, the aligned sets to two models; state needs a server pool of its own; a profile leaves its runs alone."""
    models = spark.createDataFrame([(m,) for m in MODELS], "model string")
    m, aligned = F.col("model"), F.col("family") == "align"
    wanted = (
        F.when(aligned & m.isin("qwen3-4b", "delta"), F.col("profiles"))
        .when(aligned, F.array().cast("array<string>"))
        .when((m == "rag") & F.col("pack"), F.array().cast("array<string>"))
        .when(m.isin("rag", "recurrent"), F.array(F.lit("truncate-256k")))
        .when(m == "memory", F.col("profiles"))
        .otherwise(F.slice("profiles", 2, 2))
    )
    every = (datasets(spark) if sets is None else sets).crossJoin(F.broadcast(models)).select("model", "dataset", F.explode(wanted).alias("profile"))  # six models
    every = every if profile is None else every.where(F.col("profile") == profile)
    return every.withColumn("pool", F.when(F.startswith("profile", F.lit("state")), F.col("profile")).otherwise(F.lit("truncate")))

"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret scan, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, fold, read_table, side_tables, written
from plumbline.llm.decontam import contamination
from plumbline.llm.langid import identify_languages
from plumbline.llm.mixing import mix
from plumbline.llm.secrets import MARK, find_secrets
from plumbline.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language holds less than this share of the letters is in no language and is rejected.
MIN_LANGUAGE_SHARE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those of no main language; lang becomes the predicted language."""
    found = identify_languages(docs.select(*COLUMNS), COLUMNS, learn_from=fold("doc_id", 4) != 2)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id (of repeated ids the smallest row). Texts move once, to meet the ids that stay."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in COLUMNS[1:]])
    groups = near_duplicates(docs.select("doc_id", "text", row.alias("row")), keep=["doc_id", "row"])
    heads = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group_fp", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    stay = heads.groupBy("group_fp").agg(F.min_by(F.struct("doc_id", "row", "n"), F.struct("doc_id", "row")).alias("s")).select("s.*")
    stay = written(stay.select(F.col("doc_id").alias("id"), F.col("row").alias("of_row"), "n"), "stay")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (row == F.col("of_row"))
    kept = docs.join(stay.where("n = 1"), same, "left_semi").select(*COLUMNS)
    # Rows that are repeated in full: one of each.
    repeated = stay.where("n > 1")
    return kept if repeated.isEmpty() else kept.unionByName(docs.join(repeated, same, "left_semi").select(*COLUMNS).dropDuplicates())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return contamination(docs, read_table(spark, sf_dir, "benchmark"), COLUMNS).where(~F.col("contaminated")).select(*COLUMNS)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; live secrets in its text are replaced by [SECRET], widely copied examples are left. n_chars follows."""
    found = find_secrets(docs.select(*COLUMNS), [c for c in COLUMNS if c != "text"], mark=MARK)
    return found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("redacted").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them and their complete epochs; documents not taken go."""
    mixed = mix(docs.select("doc_id", "source", "text"))
    return mixed.where(F.col("taken") > 0).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken", "epochs"
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("scan_secrets", scan_secrets),
    ("mix_sources", mix_sources),
]

#: Language models, SimHash and secret ownership are beyond SQL here; tests/llm tests the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written and read again as the next one's input.

    Once a stage's result is written, what the stage wrote on the way and the stage before go. The last stage's
    result reads its input, which stays in the shared folder with it.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with side_tables() as made:
            before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before, *(t for t in made if t is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)

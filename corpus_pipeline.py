"""Training-corpus pipeline: quality, near duplicates, decontamination, private data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of
documents, whatever they are named, the last one ids in place of the text. Null texts count as empty; texts of any
length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark.llm import byte_bpe, decontamination, near_dedup, private_data, quality
from mdspark.llm.common import Workspace, free_name, shuffle_partitions, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. The model is learnt from the labelled documents.

    A null or empty text has the score of an empty one; rows that repeat are all judged.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return quality.score_quality(docs, model, to=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def _keyed(spark: SparkSession, docs: DataFrame, stage: str, ordered: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, written so that all who read it see the same keys, and the key's name; ``ordered`` by doc_id, nulls last."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    if ordered:
        order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col(row)]
        keyed = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    return Workspace(spark, stage).write(keyed, "rows"), row


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id, nulls last: five-word shingles, similarity of 0.8.

    Rows are compared, so repeated rows of a doc_id and those without one are in groups like others.
    """
    keyed, row = _keyed(spark, docs, "pipeline-near", ordered=True)
    rows = keyed.select(row, "text")
    others = near_dedup.near_duplicates(rows, words=5, percent=80, key=row).where("NOT kept").select(F.col("doc_id").alias(row))
    return keyed.join(others, row, "left_anti").drop(row)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a test item go, with or without a doc_id, each of those that repeat. Null and empty texts stay."""
    keyed, row = _keyed(spark, docs, "pipeline-leaks")
    leaks = decontamination.find_leaks(keyed.select(row, "text"), table(spark, sf_dir, "benchmark"), key=row).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(leaks, row, "left_anti").drop(row)


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows. Every row stays; a null text stays null."""
    redacted = private_data.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return redacted


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text in place of it (ids, n_tokens), and whether they decode to it (round_trip); columns so named are replaced, others stay. Every row stays; a null or empty text has no tokens."""
    import public_tokenizers

    keep = [c for c in docs.columns if c not in ("n_tokens", "round_trip", "decoded")]
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("round_trip", same).drop("text", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("private_data", redact_private_data),
    ("encoding", encode),
]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

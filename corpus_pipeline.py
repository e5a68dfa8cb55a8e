"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage works on all that the one before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.llm import decontaminate, language, packing, similar, suffixes
from twintable.llm.base import numbered, read, small_batches
from twintable.session import scratch_folder

#: A document is rejected if no language is this probable.
LEAST_PROBABLE = 0.5
#: Near duplicates: words of a shingle, and the Jaccard similarity from which on two texts are linked.
WORDS, SIMILARITY = 5, 0.8
#: Bytes of a passage that is kept once.
PASSAGE = 200

#: Chunks of text whose ids a Python worker keeps: the heap of an executor is as large as earlier stages made it.
KNOWN = 400_000

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told; null texts and those without letters go."""
    small_batches(spark)
    model = language.fit(docs)
    judged = language.predict(docs, model, keep={**{c: c for c in COLUMNS}, "text": "text"})
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_PROBABLE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class; of rows that share it, the first."""
    small_batches(spark)
    classes = similar.classes(docs, words=WORDS, least=SIMILARITY)
    rank = F.struct(F.col("key").isNull(), F.col("key"), F.col("rid"))
    kept = classes.groupBy("root").agg(F.min(rank).alias("m")).select(F.col("m.rid").alias("kept_rid"))
    own = numbered(docs, **{c: c for c in COLUMNS})
    return own.join(kept, F.col("rid") == F.col("kept_rid")).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document, or the same one before, has too; documents left blank go."""
    small_batches(spark)
    cut = suffixes.remove_repeats(docs, window=PASSAGE, keep_first=True, with_text=True, keep=tuple(COLUMNS))
    return cut.filter("n_removed = 0 OR kept RLIKE '[^ \\t\\n\\r]'").select(
        *[F.col("kept").alias(c) if c == "text" else F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(
            F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window that resembles a benchmark item."""
    small_batches(spark)
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return found.filter(F.size("item_ids") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, known=KNOWN).drop("ids")


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("repeated-passage removal", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Shingle sets, suffix sorting and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next one."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch_folder(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/stage-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.llm import bpe, decontaminate, language, licenses, merkle, neighbours, ngrams, packing, simhash, suffixes, trees, warc, whitening
from twintable.llm.base import read


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes under 200-byte strings that start anywhere else too are removed from whole texts."""
    found = suffixes.remove_repeats(read(spark, folder, "documents"), window=200)
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash classes of whole texts: 3-word shingles, links at two differing bits or fewer."""
    found = simhash.classes(read(spark, folder, "documents"), words=3, seeds=(42,), radius=2)
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed in order into sequences of at most 4096 tokens."""
    return packing.pack(read(spark, folder, "documents")).drop("ids")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a window that resembles a benchmark item, and which items."""
    found = decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "similarity")


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every whole text from trigram counts over all of them."""
    found = ngrams.score(read(spark, folder, "documents"))
    return found.withColumnRenamed("key", "doc_id")


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest other vectors by cosine for every fiftieth vector."""
    return neighbours.search(read(spark, folder, "embeddings"), every=50, k=5)


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """The licence notice that a line or paragraph of each text resembles most."""
    return licenses.scan(read(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text, learned from documents outside the held-out fold only."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = docs.withColumn("held_out", F.coalesce(fold, F.lit(False)))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.predict(docs, model, keep={"doc_id": "doc_id", "held_out": "held_out"})


def op9_suffix_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words under windows of 20 words that also start earlier are removed from whole texts."""
    found = trees.remove_repeats(read(spark, folder, "documents"), window=20)
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written and read back; repeated payloads are revisits."""
    found = warc.read_digests(spark, warc.archive(read(spark, folder, "pages")))
    own = F.col("type") == "response"
    return found.select(
        F.col("key").alias("page_id"), F.when(own, F.col("own_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(own, F.col("own_sha1")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All valid vectors, whitened, on up to 32 components."""
    found = whitening.whiten(read(spark, folder, "embeddings"))
    return found.select(F.col("key").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"),
                        "whitened", "explained", "identity_error")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A Merkle proof for every document; where crc32 of the id is even, the text lost its line breaks meanwhile."""
    found = merkle.manifest(
        read(spark, folder, "documents"), altered={"text": lambda c: F.translate(c["text"], "\n", "")},
        when=lambda c: F.crc32(c["doc_id"].cast("string")) % 2 == 0)
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text, and what they decode to, as digests."""
    found = bpe.encode(read(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bpe.decoded(F.col("ids")), 256).alias("decoded_sha256"))


#: How the same records come about without archives.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS holder FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM m"""


#: name: (query, SQL for the same rows or None)
QUERIES = {
    "op1_suffix_array_dedup": (op1_suffix_array_dedup, None),
    "op2_simhash_near_duplicates": (op2_simhash_near_duplicates, None),
    "op3_packing": (op3_packing, None),
    "op4_decontamination": (op4_decontamination, None),
    "op5_lm_scoring": (op5_lm_scoring, None),
    "op6_neighbours": (op6_neighbours, None),
    "op7_licenses": (op7_licenses, licenses.scan_sql()),
    "op8_language": (op8_language, None),
    "op9_suffix_tree_dedup": (op9_suffix_tree_dedup, None),
    "op10_warc": (op10_warc, WARC_SQL),
    "op11_whitening": (op11_whitening, None),
    "op12_merkle_manifest": (op12_merkle_manifest, None),
    "op13_byte_bpe": (op13_byte_bpe, None),
}

"""Documents to training tokens in five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import lines, mixing, pieces, quality, simhash
from offerloom.llm.common import documents, drop_folder, pick, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this part of their shingles of so many words.
SHINGLE, NEAR = 5, 0.8


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``sf_dir``, takes for good ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs, labels, passed=COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share; one that loses all its lines stays with an empty text."""
    out = lines.dedup_lines(docs, passed=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id (null last), then the smallest text hash; once if repeated.

    Groups are linked by a Jaccard similarity of NEAR or more of the sets of five-word shingles.
    """
    stays = simhash.simhash_groups(docs, shingle=SHINGLE, similarity=NEAR).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    stays = stays.select(F.coalesce("kept_id", F.lit(-1)).alias("key"), F.col("kept_id").isNull().alias("unnamed"), F.col("kept_hash").alias("text_hash"))
    rows = pick(docs, *COLUMNS)
    keyed = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), F.col("doc_id").isNull().alias("unnamed"), F.xxhash64("text").alias("text_hash"), *COLUMNS)
    keys = ["key", "unnamed", "text_hash"]
    return keyed.join(stays.distinct(), keys, "left_semi").dropDuplicates(keys).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(docs, passed=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, n_chars`` of every row; n_chars is of the decoded text."""
    decoded = pieces.encode_pieces(docs, with_text=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.char_length("text").cast("long").alias("n_chars"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_shared_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the classifier nor the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:  # what the stage read is not needed any more
            drop_folder(spark, f"{folder}/{number - 1}")
    return docs

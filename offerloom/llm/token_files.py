"""Token ids in files of fixed-width bit-packed blocks."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerloom.llm.common import fits_broadcast, pick, rest, shared_folder, sliced
from offerloom.llm.parts import Parts

VOCABULARY, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 2
#: A block is closed once it holds this many ids; blocks hold whole documents.
BLOCK_IDS = 1 << 16
#: How byte-level vocabularies write the bytes of a space and of a newline.
BYTE_BLANKS = ("\u0120", "\u010a")
BLOCKS = "shard int, block int, first_id long, n_ids long, width int, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, big-endian, without gaps: eight ids fill ``width`` bytes."""
    if width % 8 == 0:
        return np.asarray(ids).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - width // 8:].tobytes()
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), width), np.uint8)
    for j in range(8):
        value, end = groups[:, j], (j + 1) * width
        for byte in range(j * width // 8, -(-end // 8)):
            shift = end - 8 * (byte + 1)
            moved = value >> np.uint64(shift) if shift >= 0 else value << np.uint64(-shift)
            out[:, byte] |= (moved & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack(payload: bytes, width: int, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n - 1 of a packed block, read from their own bytes only."""
    if not n:
        return np.empty(0, np.uint32)
    first = start * width // 8
    part = np.frombuffer(payload[first:-(-(start + n) * width // 8)] + bytes(8), np.uint8)
    at = (start + np.arange(n, dtype=np.int64)) * width - first * 8
    if width % 8 == 0:
        filled = np.zeros((n, 4), np.uint8)
        filled[:, 4 - width // 8:] = part[: n * width // 8].reshape(n, width // 8)
        return filled.view(">u4").reshape(-1).astype(np.uint32)
    windows = np.lib.stride_tricks.as_strided(part.view(), (len(part) - 7, 8), (1, 1))[at >> 3]
    words = np.ascontiguousarray(windows).view(">u8").reshape(-1).astype(np.uint64)
    shift = (64 - width - (at & 7)).astype(np.uint64)
    return ((words >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Parts:
    """Library ids of whole texts, each distinct part between spaces encoded once per worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*found, np.empty(0, np.uint32)]), np.array([len(f) for f in found], np.int64)

    tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return Parts(encode, np.array([t[:1] in BYTE_BLANKS for t in tokens]), [t.content for t in tokenizer.get_added_tokens_decoder().values()])


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def write_token_files(docs: DataFrame, folder: str, path: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode every whole text and write its ids, closed by ``end_id``, as packed blocks.

    Documents are dealt out by ranges of doc_id (equal ids by text), so shards and the blocks within
    a shard follow ascending doc_id. Each Parquet row is a block: shard, number, the ids before it in
    the shard, ids of its documents and their lengths, and the packed payload, from which any id is
    reached by its position times the width. Spark writes the files, so any store will do, and a lost
    task is written anew.

    A null text is empty and has only the end id. Null doc_ids come first; repeated rows are written
    as often as they occur. An empty table writes files without blocks.
    """
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    width = bits_for(max(vocabulary_size(path), end_id + 1))

    def run(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, lengths, doc_ids, held = [], [], [], 0  # of the block that is open

        def closed():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first_id": [first], "n_ids": [len(flat)],
                "width": pa.array([width], pa.int32()), "doc_ids": pa.array([pa.concat_arrays(doc_ids)], pa.list_(pa.int64())),
                "lengths": pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), "payload": pa.array([pack(flat, width)], pa.binary())})

        for part in sliced(batches, rows=20_000, chars="text", limit=6 << 20):
            flat, counts = encoder(path).encode(part.column("text"))
            flat = np.insert(flat, np.cumsum(counts), end_id)
            ends, at = np.cumsum(counts + 1), 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                last = min(int(np.searchsorted(ends, before + BLOCK_IDS - held)), len(ends) - 1)
                ids.append(flat[before:ends[last]])
                lengths.append(counts[at:last + 1] + 1)
                doc_ids.append(part.column("doc_id").slice(at, last + 1 - at))
                held, at = held + int(ends[last] - before), last + 1
                if held >= BLOCK_IDS:
                    yield closed()
                    block, first, ids, lengths, doc_ids, held = block + 1, first + held, [], [], [], 0
        if held:
            yield closed()
        rest()

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    dealt = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian 32-bit ids) of every document of the files.

    With ``digest`` there is ``ids_crc32`` instead, the CRC-32 of the same bytes.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                flat = unpack(row["payload"], row["width"], 0, row["n_ids"]).astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": row["before"] + row["first_id"] + ends - lengths, "n_tokens": lengths,
                    **({"ids_crc32": [zlib.crc32(flat[e - n:e]) for e, n in zip(ends, lengths)]} if digest else
                       {"ids": pa.array([flat[e - n:e].tobytes() for e, n in zip(ends, lengths)], pa.binary())})})

    placed = blocks.join(fits_broadcast(shards), blocks.shard == shards.of).select("first_id", "n_ids", "width", "doc_ids", "lengths", "payload", "before")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def read_ids(spark: SparkSession, folder: str, shard: int, start: int, n: int) -> np.ndarray:
    """Random access: ``n`` ids of a shard from position ``start``, from the blocks that hold them."""
    blocks = spark.read.schema(BLOCKS).parquet(folder).where(
        (F.col("shard") == shard) & (F.col("first_id") < start + n) & (F.col("first_id") + F.col("n_ids") > start))
    found = blocks.orderBy("first_id").select("first_id", "n_ids", "width", "payload").collect()  # as many as n ids take
    parts = [unpack(b.payload, b.width, max(0, start - b.first_id), min(b.n_ids, start + n - b.first_id) - max(0, start - b.first_id)) for b in found]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def token_table(docs: DataFrame, path: str = VOCABULARY, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from files written and read back."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    write_token_files(docs, folder, path, end_id)
    return read_token_files(spark, folder, digest=True)

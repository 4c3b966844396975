"""Operator 7: training-order materialisation of token ids.

1. **Sequences.**  Documents are tokenised, ended by an end id, joined in table order and cut into
   sequences of ``length`` ids, in every input partition apart; the last sequence of a partition is
   filled up with end ids.  Sequences are written once, compressed, with their partition and number.
2. **Slots.**  Counts per partition give each sequence a dense index.  A keyed Feistel network permutes
   the smallest even-bit domain that holds all indexes; an image beyond the last index is permuted
   again (cycle-walking) until it falls inside, which keeps the map a permutation of the indexes.  The
   image is the sequence's global slot in training order, known without a sort or a random draw.
3. **Shards.**  Slots are split into ranges of ``shard_rows``.  Each range is one task, which sorts it and writes one
   file of records of fixed stride: ``length`` unsigned 16-bit little-endian ids and one line feed.
   Slot ``s`` is record ``s % shard_rows`` of shard ``s // shard_rows``, so reading can go on from any slot
   by seeking.  Spark's writer commits tasks, so lost executors leave no partial shard.

The same input splits and key give the same files.  Null and empty texts are a single end id.  Repeated
rows are written as often as they occur.  An empty table gives no shards.  Other columns are not read.
Ids must be below 65,536.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import cut, shared_folder, small_batches, table
from daybook.llm.word_tokens import word_tokenizer

LENGTH = 2048
END_ID = 49407
SHARD_ROWS = 2048
ROUNDS = 6
KEY = 20_250_101
SEQUENCES = "part int, number long, n_tokens int, packed binary"
RECORDS = "slot long, shard int, offset long, ids_crc32 long, n_ends int"


_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def permuted(index: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Images of ``index`` under the keyed permutation of range(size)."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    seeds = np.random.default_rng(key).integers(0, 2**63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for seed in seeds:
            mixed = (right + seed) * _GOLDEN
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (beyond := out >= np.uint64(size)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Sequences of every input partition, numbered within it; ids compressed."""
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(2, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, b""
        pack = zstandard.ZstdCompressor(level=3).compress
        t = word_tokenizer(path, "<u2")
        stride = 2 * length

        def frame(packed: list[bytes], n_tokens: list[int]) -> pd.DataFrame:
            numbers = range(number, number + len(packed))
            return pd.DataFrame({"part": part, "number": numbers, "n_tokens": n_tokens, "packed": packed})

        for batch in batches:
            held += b"".join(t.ids(text) + end for text in batch["text"])
            whole = len(held) // stride
            if whole:
                yield frame([pack(held[i * stride : (i + 1) * stride]) for i in range(whole)], [length] * whole)
                number, held = number + whole, held[whole * stride :]
        if held:
            missing = length - len(held) // 2
            yield frame([pack(held + end * missing)], [length - missing])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SEQUENCES)


def with_slots(numbered: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """``numbered`` with the global slot of each sequence, and the number of sequences."""
    counts = sorted((r["part"], r["count"]) for r in numbered.groupBy("part").count().collect())
    first, size = {}, 0
    for part, count in counts:  # a row per input partition
        first[part], size = size, size + count

    @F.pandas_udf("long")
    def slot(part: pd.Series, number: pd.Series) -> pd.Series:
        index = part.map(first).to_numpy(np.int64) + number.to_numpy(np.int64)
        return pd.Series(permuted(index, size, key))

    return numbered.withColumn("slot", slot("part", "number")), size


def write_shards(slotted: DataFrame, size: int, folder: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> None:
    """Write fixed-stride shards below ``folder``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        read = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield pd.DataFrame({"record": [read(x) for x in batch["packed"]], "shard": batch["shard"]})

    shards = max(1, -(-size // shard_rows))
    ranged = (
        slotted.withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
        .select("shard", "slot", "packed")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "slot")
    )
    records = ranged.select("packed", "shard").mapInPandas(unpack, "record binary, shard int")
    records.select(F.col("record").cast("string").alias("record"), "shard").write.partitionBy("shard").option(
        "lineSep", "\n"
    ).text(folder)


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, from_slot: int = 0) -> DataFrame:
    """(shard, content) of the shards that hold ``from_slot`` and later slots."""
    files = spark.read.format("binaryFile").option("basePath", folder).load(f"{folder}/shard=*")
    return files.where(F.col("shard") >= from_slot // shard_rows).select(F.col("shard").cast("int").alias("shard"), "content")


def records(shards: DataFrame, length: int = LENGTH, shard_rows: int = SHARD_ROWS, from_slot: int = 0) -> DataFrame:
    """(slot, ids) of every record from ``from_slot`` on."""
    stride = 2 * length + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"]):
                first = max(0, from_slot - shard * shard_rows)
                for i in range(first, len(content) // stride):
                    ids = np.frombuffer(content, "<u2", length, i * stride)
                    yield pd.DataFrame({"slot": [shard * shard_rows + i], "ids": [ids.astype(np.int32)]})

    return shards.mapInPandas(run, "slot long, ids array<int>")


def digests(shards: DataFrame, length: int = LENGTH, shard_rows: int = SHARD_ROWS, end_id: int = END_ID) -> DataFrame:
    """One row per record of the shards: its place, the checksum of its ids and its end ids."""
    stride = 2 * length + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"]):
                if len(content) % stride:
                    raise ValueError(f"shard {shard} is not made of whole records")
                rows = np.frombuffer(content, np.uint8).reshape(-1, stride)
                ids = np.ascontiguousarray(rows[:, :-1])
                slots = shard * shard_rows + np.arange(len(rows))
                yield pd.DataFrame(
                    {
                        "slot": slots,
                        "shard": shard,
                        "offset": np.arange(len(rows)) * stride,
                        "ids_crc32": [zlib.crc32(r) for r in ids],
                        "n_ends": (ids.view("<u2") == end_id).sum(axis=1),
                    }
                )

    return shards.mapInPandas(run, RECORDS)


def materialise(docs: DataFrame, path: str, folder: str, key: int = KEY, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> int:
    """Write all sequences of ``docs`` in training order below ``folder``; gives their number."""
    slotted, size = with_slots(cut(sequences(docs, path, length)), key)
    if size:
        write_shards(slotted, size, folder, length, shard_rows)
    return size


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    folder = f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}"
    if not materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder):
        return spark.createDataFrame([], RECORDS)
    return digests(read_shards(spark, folder))

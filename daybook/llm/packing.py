"""Operator 5: packing documents into sequences by first-fit decreasing.

Every document is tokenised once, ended by an end id, and cut into pieces: full ones of the sequence
length and one remainder.  The cuts depend on the document alone, so checksums of pieces are made in
the same pass and token ids are never shuffled.  Remainders are dealt into randomised groups by a
hash of the document, and each group is packed on its own: pieces in falling order of length, each
into the first bin with room.  The first bin is found in a tournament tree over bin capacities, whose
inner nodes hold the largest room below them, in O(log bins) a piece.  Full pieces are sequences of
their own.

The number of groups follows the number of documents (``group_docs`` remainders to a group on
average), so a group's size does not grow with the input, and a hot source spreads over all groups.
Each group leaves a few half-empty last bins, which is the price of packing groups apart.

Null and empty texts are a single end id.  Repeated rows are packed as often as they occur.  Rows
with a null ``doc_id`` are spread by their content.  An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import small_batches, table
from daybook.llm.word_tokens import word_tokenizer

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Sequence ids are group * this + number within the group.
GROUP_STRIDE = 1 << 32


def cut_documents(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document."""
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = word_tokenizer(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = memoryview(t.ids(text) + end)
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            made = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield made.astype({"doc_id": "Int64"})

    two = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(text, '') AS text")
    return two.mapInPandas(run, PIECES)


class Bins:
    """Open bins under a tournament tree of their room; the leftmost bin with enough room wins."""

    def __init__(self, capacity: int):
        self.capacity, self.size, self.used = capacity, 1, 0
        self.room = [0, capacity]

    def place(self, length: int) -> int:
        """Number of the bin the piece goes to."""
        if self.room[1] < length:
            self._double()
        node = 1
        while node < self.size:
            node *= 2
            if self.room[node] < length:
                node += 1
        chosen = node - self.size
        self.used = max(self.used, chosen + 1)
        self.room[node] -= length
        while node > 1:
            node //= 2
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
        return chosen

    def _double(self) -> None:
        leaves = self.room[self.size :] + [self.capacity] * self.size
        self.size *= 2
        self.room = [0] * self.size + leaves
        for node in range(self.size - 1, 0, -1):
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces of equal length keep their order."""
    bins, filled, out = Bins(capacity), {}, [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = bins.place(lengths[i])
        out[i] = (b, filled.get(b, 0))
        filled[b] = out[i][1] + lengths[i]
    return out


def pack(pieces: DataFrame, groups: int, length: int = SEQUENCE) -> DataFrame:
    """Sequence and offset of every piece; ``groups`` randomised groups are packed apart."""
    schema = f"{PIECES}, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        placed = first_fit_decreasing(group["length"].tolist(), length)
        first = int(group["group"].iloc[0]) * GROUP_STRIDE
        group["sequence_id"] = [first + b for b, _ in placed]
        group["offset"] = [o for _, o in placed]
        return group[names]

    dealt = pieces.withColumn(
        "group",
        F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups)),
    )
    return dealt.groupBy("group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents with their place in the sequences."""
    groups = max(1, -(-docs.count() // group_docs))
    return pack(cut_documents(docs, path), groups)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

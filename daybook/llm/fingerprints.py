"""Operator 6: document fingerprints by Order MinHash.

A text's k-mers (runs of ``K`` characters, shorter only if the text is) are numbered by occurrence, so
that repeats count.  For each of ``SIZE`` hash functions the ``PICK`` numbered k-mers with the least
hashes are selected, put back into text order, and hashed as a tuple.  Two texts agree in an entry only
if the same k-mers won *and* stand in the same order, so the share of equal entries falls with edit
distance and not only with the set of k-mers.

Whole texts are fingerprinted, in tiles of bounded memory.  Equal texts have equal fingerprints; null
and empty texts share one of their own.

``neighbours`` pairs each document with the next by ascending id (the first after the last) without a
global window: ids are cut into ranges at approximate quantiles, and the first document of a range is
sent to the range before it as well.  Rows are then read in order, one at a time.  Null ids come
first, ties are ordered by text, repeated rows follow each other; a lone document is its own next one.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import small_batches, table

K = 10
SIZE = 32
PICK = 2
TILE = 32_768
SEED = 7_041_776
#: Documents of a range at most on average, where there are more than the session's partitions.
RANGE_DOCS = 16_384
FIRST = -(2**63)

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(2**64 - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def _runs(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` codes, built from runs of powers of two."""
    power, width = _mixed(codes.astype(np.uint64) + _M[0]), 1
    out, covered = None, 0
    while True:
        if k & width:
            if out is None:
                out, covered = power, width
            else:
                n = min(len(out), len(power) - covered)
                out = out[:n] * _M[0] + power[covered : covered + n]
                covered += width
        if width * 2 > k:
            return out[: len(codes) - k + 1]
        power = power[:-width] * _M[1] + power[width:]
        width *= 2


def numbered_kmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers of a text, and where each stands."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _mixed(_runs(codes, min(K, len(codes))))
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    keyed = np.sort(((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64))
    place = keyed & ((np.uint64(1) << bits) - np.uint64(1))
    kmer = h[place.astype(np.int64)]
    starts = np.flatnonzero(np.concatenate(([True], kmer[1:] != kmer[:-1])))
    number = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return _mixed(kmer + number.astype(np.uint64) * _M[0]), place


def fingerprint(text: str | None) -> np.ndarray:
    """``SIZE`` 32-bit entries."""
    if not text:
        return np.zeros(SIZE, np.uint32)
    h, place = numbered_kmers(text)
    pick = min(PICK, len(h))
    best, best_at = np.empty((SIZE, 0), np.uint64), np.empty((SIZE, 0), np.int64)
    room = np.empty(min(TILE, len(h)), np.uint64)
    for start in range(0, len(h), TILE):
        tile = h[start : start + TILE]
        hashed, picks = room[: len(tile)], min(pick, len(tile))
        values, at = np.empty((SIZE, picks), np.uint64), np.empty((SIZE, picks), np.int64)
        for row, factor in enumerate(_FACTORS):
            np.multiply(tile, factor, out=hashed)
            for turn in range(picks):
                least = hashed.argmin()
                values[row, turn], at[row, turn] = hashed[least], least + start
                hashed[least] = _LAST
        best, best_at = np.concatenate([best, values], axis=1), np.concatenate([best_at, at], axis=1)
        if best.shape[1] > pick:
            least = np.argsort(best, axis=1, kind="stable")[:, :pick]
            best, best_at = np.take_along_axis(best, least, 1), np.take_along_axis(best_at, least, 1)
    order = np.argsort(place[best_at], axis=1)
    in_order = np.take_along_axis(h[best_at], order, 1)
    entry = np.arange(SIZE, dtype=np.uint64)
    for i in range(pick):
        entry = _mixed(entry * _M[0] + in_order[:, i])
    return (entry >> np.uint64(32)).astype(np.uint32)


def as_text(entries: np.ndarray) -> str:
    return entries.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries of two fingerprints."""
    return float((a == b).mean())


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            made = [as_text(fingerprint(t)) for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_chars": [len(t) for t in texts], "fingerprint": made})

    two = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(text, '') AS text")
    return two.mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (bucket, guard, place, doc_id, text) and the number of buckets.

    Within a bucket rows are to be read by guard, place and text; the guard row only ends its bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("place"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    total = docs.count()
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_DOCS), 1)
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("place", shares, 10 * ranges).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(), side="right").astype("int32"))

    # one least id per range: as many rows as ranges
    heads = sorted(
        (r["bucket"], r["place"])
        for r in rows.select("place")
        .withColumn("bucket", bucket_of("place"))
        .groupBy("bucket")
        .agg(F.min("place").alias("place"))
        .collect()
    )
    before = {place: heads[i - 1][0] for i, (_, place) in enumerate(heads)}

    @F.pandas_udf("int")
    def bucket_before(place: pd.Series) -> pd.Series:
        return place.map(before).astype("int32")

    own = rows.withColumn("bucket", bucket_of("place")).withColumn("guard", F.lit(0))
    guards = rows.where(F.col("place").isin(list(before))).withColumn("bucket", bucket_before("place"))
    return own.unionByName(guards.withColumn("guard", F.lit(1))), ranges


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(edit: Callable[[str, str], str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Compare each row with its edited text and with the next row; ``edit`` takes both texts."""
    names = [c.split()[0] for c in COMPARED.split(", ")]

    def row(doc_id, text, print_, next_text, next_print):
        edited = edit(text, next_text)
        edited_print = fingerprint(edited)
        return (
            doc_id,
            len(text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            as_text(print_),
            as_text(edited_print),
            likeness(print_, edited_print),
            likeness(print_, next_print),
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            out = []
            for bucket, guard, doc_id, text in zip(batch["bucket"], batch["guard"], batch["doc_id"], batch["text"]):
                if waiting is None and guard:
                    continue
                print_ = fingerprint(text)
                if waiting is not None:
                    out.append(row(*waiting, text, print_))
                waiting = None if guard else (None if pd.isna(doc_id) else int(doc_id), text, print_)
            made = pd.DataFrame(out, columns=names)
            yield made.astype({"doc_id": "Int64", "n_chars": "int64"}) if len(made) else made.astype({"doc_id": "Int64"})

    return run


def replace_tail(text: str, following: str) -> str:
    """The last quarter gives way to the beginning of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_documents(docs: DataFrame, edit: Callable[[str, str], str] = replace_tail) -> DataFrame:
    """Fingerprints of every document and its edited text, and likeness to both neighbours."""
    small_batches(docs.sparkSession)
    rows, ranges = neighbours(docs)
    dealt = rows.repartition(ranges, "bucket").sortWithinPartitions("bucket", "guard", "place", "text")
    return dealt.select("bucket", "guard", "doc_id", "text").mapInPandas(compare_with_next(edit), COMPARED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_documents(table(spark, sf_dir, "documents"))

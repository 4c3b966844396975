"""Operator 9: Jaccard self-join of word n-gram sets by MinHash banding.

Words are the lower-case runs between white space; a text's set holds its runs of five words, or one
shorter run if it has fewer.  Two documents are linked if their sets have a Jaccard similarity of at
least 0.8.

1. Each text becomes a digest of its set and one key per band, made of ``rows`` MinHash values.
   ``plan_bands`` chooses bands and rows from the wanted recall at the threshold.
2. Documents with equal sets form a class of copies and go on as one representative with a weight, so
   thousands of copies cost what one costs.
3. Representatives meet on band keys.  A pair is settled in the *first* band it shares only.  A narrow
   pass over ids and keys finds the members of each bucket that have such a pair; only they take
   their texts along, so a text travels to few of its buckets.
4. Buckets are verified on the full sets.  A bucket above ``BLOCK`` members is cut into blocks and each
   pair of blocks is a cell of its own, so that no task holds more than two blocks.  A cell gives one row per
   member: the links it found for it, and one member of its linked group.  Pairs are never rows.
5. Groups are connected components of the links.

Result: one row per document, with ``class_id`` (least id of the group), ``copy_id`` (least id with
the same set) and ``n_links`` (other documents at 0.8 or more).  Null and empty texts have no set, are
linked to nothing and are classes of their own.  Rows with a null id take no part: null class, no
links.  A repeated row counts as a copy.  An empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import cut, small_batches, table
from daybook.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 144
BLOCK = 512
#: Cells up to this size compare Python sets, larger ones multiply incidence matrices.
SMALL_CELL = 24
SEED = 20240229
_WORD_CACHE = 400_000


def plan_bands(threshold: float, recall: float, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows whose recall at the threshold is at least ``recall``."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        chance = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-chance)) if chance < 1 else 1
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


_hash_of = _WordHash()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word n-grams, in order."""
    tokens = (text or "").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_hash_of.__getitem__, tokens)), np.uint64)
    n = min(words, len(h))
    run = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        run = _mixed(run * np.uint64(0x100000001B3) + h[i : len(h) - n + 1 + i])
    return np.unique(run)


class Signer:
    """MinHash band keys of shingle sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = np.arange(bands, dtype=np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(s), 8192):
            part = s[start : start + 8192]
            np.minimum(least, (part[None, :] * self.factors[:, None]).min(axis=1), out=least)
        least = least.reshape(self.bands, self.rows)
        key = self.salts.copy()
        for r in range(self.rows):
            key = _mixed(key * np.uint64(0x100000001B3) + least[:, r])
        return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_grams, set_id, keys) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(bands, rows)
        for batch in batches:
            sizes, ids, keys = [], [], []
            for text in batch["text"]:
                s = shingles(text)
                sizes.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(signer.keys(s) if len(s) else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_grams": sizes, "set_id": ids, "keys": keys})

    two = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(text, '') AS text")
    return two.mapInPandas(run, "doc_id long, n_grams int, set_id binary, keys array<long>")


def by_group(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by ``key``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        borders = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        if held and (held[-1][key].to_numpy()[-1] != values[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        start = 0
        for stop in borders:
            part = batch.iloc[start:stop]
            yield pd.concat([*held, part]) if held else part
            held, start = [], stop
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


CELL = ["key", "p", "q"]


def first_pairs(group: pd.DataFrame) -> np.ndarray:
    """Which pairs of a cell share its band as their first: a square of booleans, upper half only."""
    keys = np.array(group["keys"].tolist(), np.int64).reshape(len(group), -1)
    band = int(np.flatnonzero(keys[0] == group["key"].iloc[0])[0])
    n = len(keys)
    fresh = np.ones((n, n), bool)
    for b in range(band):
        fresh &= keys[:, b][:, None] != keys[:, b][None, :]
    if group["p"].iloc[0] != group["q"].iloc[0]:
        block = group["block"].to_numpy()
        fresh &= block[:, None] != block[None, :]
    return np.triu(fresh, 1)


def needed_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of each cell that have a pair to settle there."""
    out, held = [], 0
    for group in by_group(batches, CELL):
        if len(group) == 1:
            continue
        pairs = first_pairs(group)
        use = pairs.any(axis=0) | pairs.any(axis=1)
        if use.any():
            out.append(group[use])
            held += int(use.sum())
        if held >= 4096:
            yield pd.concat(out)
            out, held = [], 0
    if out:
        yield pd.concat(out)


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets that stand in a pair."""
    n = len(sets)
    inter = np.zeros((n, n), np.float32)
    if n <= SMALL_CELL:
        whole = [set(s.tolist()) for s in sets]
        for i, j in zip(*np.nonzero(pairs)):
            inter[i, j] = len(whole[i] & whole[j])
        return inter
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((n, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        inter += part @ part.T
    return inter


def verify(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links of each cell's members: (rep, other, links), one row a linked member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, CELL):
            group = group.drop_duplicates("rep")
            if len(group) == 1:
                continue
            pairs = first_pairs(group)
            sets = [shingles(t) for t in group["text"]]
            size = np.array([len(s) for s in sets])
            inter = overlaps(sets, pairs)
            union = size[:, None] + size[None, :] - inter
            linked = pairs & (inter >= threshold * union - 1e-9)
            if not linked.any():
                continue
            rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
            both = linked | linked.T
            found = both @ copies
            use = np.flatnonzero(both.any(axis=1))
            root = _roots(both)
            yield pd.DataFrame({"rep": rep[use], "other": rep[root[use]], "links": found[use]})

    return run


def _roots(linked: np.ndarray) -> np.ndarray:
    """A member of each member's linked group, the same for the whole group."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = [i]
            root[i] = i
            while front:
                near = np.flatnonzero(linked[front.pop()] & (root < 0))
                root[near] = i
                front.extend(near.tolist())
    return root


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, n_grams) of every document."""
    small_batches(docs.sparkSession)
    bands, rows = plan_bands(threshold, recall)
    signed = cut(signatures(docs, bands, rows))
    reps = cut(
        signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count("*").alias("copies"),
            F.min(F.struct("doc_id", "keys"))["keys"].alias("keys"),
        )
    )
    met = reps.select("rep", F.explode("keys").alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    members = (
        met.join(sizes, "key")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .join(reps.select("rep", "copies", "keys"), "rep")
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("block", "with").alias("p"),
            F.greatest("block", "with").alias("q"),
            "block",
            "rep",
            "copies",
            "keys",
        )
    )
    schema = "key long, p int, q int, block int, rep long, copies long, keys array<long>"
    needed = _in_cells(members).mapInPandas(needed_members, schema)
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS rep", "text")
    settled = cut(
        _in_cells(needed.join(texts, "rep")).mapInPandas(verify(threshold), "rep long, other long, links long")
    )
    groups = components(settled.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = settled.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (
        reps.select("set_id", "rep", "copies")
        .join(links, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("set_id").alias("class_set"),
            F.col("rep").alias("copy"),
            F.coalesce("component", "rep").alias("class"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    return signed.join(classes, F.col("set_id") == F.col("class_set"), "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copy", "doc_id")).alias("copy_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        "n_grams",
    )


def _in_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the least id; rows without an id stay as they are."""
    kept = join(docs).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    stay = named.join(kept, named["doc_id"].cast("long") == kept["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

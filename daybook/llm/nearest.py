"""Operator 3: approximate nearest neighbours by multi-index hashing.

1. **Codes.**  Unit vectors are turned by learned rotations and each coordinate gives one bit, its
   sign.  Every rotation is learned on a bounded sample (``SAMPLE`` vectors chosen by a hash of the id)
   from a random start: alternately the bits of the turned vectors are taken, and the rotation that
   brings the vectors nearest to their bits.  Several rotations together give about ``BITS`` bits.
2. **Index.**  Codes are split into substrings of 8 bits, and each substring is an index of its own:
   the rows in order of their value, and where each value begins.
3. **Probing.**  If two codes differ in at most ``r`` bits, then of ``m`` substrings one of the first
   ``r % m + 1`` differs in at most ``r // m`` bits, or one of the others in fewer.  Looking up the values
   within those distances finds every code within the radius.
4. **Reranking.**  Rows found within the radius are ranked by the cosine of the original vectors in
   double precision, ties by the smaller id.

The radius comes from the sample, so that ``TARGET`` of the true neighbours there lie within it;
neighbours in the whole table are nearer than in the sample, so recall is higher.  A shard that finds
too few rows doubles the radius for that query.

All rows are indexed.  Rows are dealt into shards of ``SHARD_ROWS`` and queries into blocks of
``BLOCK_QUERIES``; every shard meets every block in a task of its own, which returns at most ``k`` rows a
query.  Copies of one vector are dealt over all shards.

Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do rows without an
id or of another length than most.  Rows with one id count once.  An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import small_batches, table

NEAREST = 5
QUERY_EVERY = 50
BITS = 128
SAMPLE = 4096
SAMPLE_QUERIES = 400
TARGET = 0.97
TURNS = 30
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
SEED = 11

_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(x, lambda v: v != 0)
    )
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return rows.where(F.size("embedding") == (widths[0]["width"] if widths else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large and very small numbers keep their direction
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotations(sample: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Directions (width x bits) whose signs are the code."""
    rng = np.random.default_rng(SEED)
    width = sample.shape[1]
    found = []
    for _ in range(-(-bits // width)):
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(sample.T @ np.sign(sample @ turn))
            turn = left @ right
        found.append(turn)
    directions = np.concatenate(found, axis=1)
    return directions[:, : max(8, min(bits, directions.shape[1]) // 8 * 8)] if directions.shape[1] >= 8 else np.tile(directions, 8)[:, :8]


def codes_of(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.packbits(unit @ directions > 0, axis=1)


def learn_radius(sample: np.ndarray, directions: np.ndarray, k: int, target: float = TARGET) -> int:
    """Radius that holds ``target`` of the sample's true neighbours."""
    codes = codes_of(sample, directions)
    queries = np.arange(min(SAMPLE_QUERIES, len(sample)))
    near = sample[queries] @ sample.T
    near[queries, queries] = -2
    k = min(k, len(sample) - 1)
    if k < 1:
        return codes.shape[1] * 8
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    apart = np.bitwise_count(codes[queries][:, None, :] ^ codes[best]).sum(axis=2)
    return int(np.quantile(apart, target, method="higher"))


class Shard:
    """Indexed codes of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.codes = ids[order], vectors[order], codes[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.rows = [np.argsort(column, kind="stable") for column in self.codes.T]
        self.begins = [
            np.searchsorted(column[rows], np.arange(257)) for column, rows in zip(self.codes.T, self.rows)
        ]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits."""
        m = len(code)
        whole, rest = divmod(radius, m)
        met = np.zeros(len(self.ids), bool)
        for j in range(m):
            reach = whole if j <= rest else whole - 1
            if reach >= 0:
                rows, begins = self.rows[j], self.begins[j]
                for value in np.flatnonzero(_DISTANCE[code[j]] <= reach).tolist():
                    met[rows[begins[value] : begins[value + 1]]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int):
        """Ids and cosines of the best ``k`` rows found, best first."""
        bits = len(code) * 8
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, 2 * radius + 1)
        scores = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * np.sqrt((vector * vector).sum()))
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _encoded(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            if len(batch):
                x = np.array(batch["embedding"].tolist(), float)
                scale = np.abs(x).max(axis=1, keepdims=True)
                batch = batch.assign(
                    embedding=list(x / scale), code=[c.tobytes() for c in codes_of(_unit(x), directions)]
                )
                yield batch[["vec_id", "embedding", "code"]]

    return rows.mapInPandas(run, "vec_id long, embedding array<double>, code binary")


def search(vectors: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query`` holds."""
    small_batches(vectors.sparkSession)
    rows = usable(vectors)
    total = rows.count()
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded
    if len(sampled) < 2:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _unit(np.array([r["embedding"] for r in sampled], float))
    directions = learn_rotations(sample)
    radius = learn_radius(sample, directions, k)
    shards = -(-total // SHARD_ROWS)
    blocks = max(1, -(-rows.where(is_query).count() // BLOCK_QUERIES))
    indexed = _encoded(rows.dropDuplicates(["vec_id"]), directions)

    def dealt(column: str, parts: int):
        return F.pmod(F.xxhash64(F.col("vec_id"), F.lit(column)), F.lit(parts)).cast("int").alias(column)

    def everywhere(column: str, parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(column)

    index = indexed.select("*", dealt("shard", shards), everywhere("block", blocks))
    queries = indexed.where(is_query).select("*", dealt("block", blocks), everywhere("shard", shards))

    def cell(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            read = lambda codes: np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
            shard = Shard(own["vec_id"].to_numpy(), np.array(own["embedding"].tolist(), float), read(own["code"].tolist()))
            codes = read(asked["code"].tolist())
            for query_id, vector, code in zip(asked["vec_id"], asked["embedding"], codes):
                ids, scores = shard.nearest(query_id, np.asarray(vector, float), code, radius, k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    found = (
        index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(cell, FOUND)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)

"""Operator 13: ranked lexical search with bag deduplication.

Every item's terms are searched in all documents, by a sum of integer term weights damped by the
document's length, and each item keeps its ``limit`` best documents.  A document's score depends only on its
counts of the items' terms and on its length factor ``m``, so:

1. **Restriction.**  Documents are reduced to the items' vocabulary: counts per term are made where the text
   is read, and terms of no item leave before anything is grouped.
2. **Classes.**  Documents with the same counts and the same ``m`` form a class.  They are grouped by a hash
   *and* by the counts and ``m`` themselves, so a class never rests on its hash alone.  A class has its least
   row as number and knows its least ``doc_id``.
3. **Scores.**  Each class is scored once.  Classes are dealt by a hash into shards of about ``SHARD_CLASSES``, items into
   blocks of about ``BLOCK_POSTINGS`` terms; each shard meets each block in one task, which adds up scores in arrays and
   returns at most ``limit`` classes an item.  Pairs of documents and items are never rows.
4. **Expansion.**  Each item's best ``limit`` classes, by score, then least ``doc_id``, hold its best ``limit``
   documents: a class outside has ``limit`` classes before it, each with a document before all of its own.
   Only classes on some list get their members, the ``limit`` least ``doc_id`` of each.

Terms are runs of characters that are no ASCII punctuation, space or control; only A to Z are
lower-cased.  Null and empty texts have no terms and are no documents of the collection.  Items without
terms, or whose terms no document holds, give no rows.  Rows of one ``item_id`` are one item with the terms of all.
Repeated documents each count and each take a rank; among equal scores and ids their order is open, and
a null ``doc_id`` comes last.  Empty tables give no rows; other columns are not read.

Sizes: the collection's two totals reach the driver, no rows.  A shard's arrays hold ``CHUNK_CLASSES`` times the items of
a block.  Frequent terms spread over all shards, and large groups of copies are one class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import cut, small_batches, table

LIMIT = 50
SHARD_CLASSES = 8192
CHUNK_CLASSES = 512
BLOCK_POSTINGS = 65_536
LAST_PLACE = (1 << 63) - 1
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
RESULT = "item_id long, rank int, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


def counted(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, terms, tfs) of every document with a term; ``row`` is unique in one reading."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = re.compile(TERM).findall
        for batch in batches:
            bags = [Counter(find(text.translate(LOWERED))) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "row": batch["row"],
                    "place": batch["place"],
                    "n": [sum(b.values()) for b in bags],
                    "terms": [list(b) for b in bags],
                    "tfs": [list(b.values()) for b in bags],
                }
            )

    rows = docs.where("text IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"),
        # a null id is placed last, and is no id that a document can have
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_PLACE)).alias("place"),
        "text",
    )
    return rows.mapInPandas(run, "row long, place long, n long, terms array<string>, tfs array<long>").where("n > 0")


def bags(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row, place, n, terms, tfs) with the numbers of the vocabulary's terms, in order, and their counts."""
    pairs = counted(docs).select("row", "place", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("pair"))
    known = pairs.select("row", "place", "n", F.col("pair.terms").alias("term"), F.col("pair.tfs").alias("tf")).join(
        vocabulary, "term"
    )
    bag = known.groupBy("row", "place", "n").agg(F.sort_array(F.collect_list(F.struct("number", "tf"))).alias("bag"))
    return bag.select("row", "place", "n", F.col("bag.number").alias("terms"), F.col("bag.tf").alias("tfs"))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    row = docs.select(n.alias("n")).where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def weights(bagged: DataFrame, size: int) -> DataFrame:
    """(number, weight) of the terms that some document holds."""
    held = bagged.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    ratio = F.lit(2 * size + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return held.select("number", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("weight"))


def classes_of(bagged: DataFrame) -> DataFrame:
    """One row per class: its number, hash, ``m``, counts and least place."""
    return bagged.groupBy("hash", "m", "terms", "tfs").agg(F.min("row").alias("class"), F.min("place").alias("place"))


def scored(classes: DataFrame, postings: DataFrame, n_classes: int, n_postings: int, limit: int) -> DataFrame:
    """(item_id, class, place, score): for each item the best classes of every shard."""
    shards = max(1, -(-n_classes // SHARD_CLASSES))
    blocks = max(1, -(-n_postings // BLOCK_POSTINGS))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = best_classes(left, right, limit) if len(left) and len(right) else []
        return pd.DataFrame(out, columns=["item_id", "class", "place", "score"])

    dealt = classes.select(
        "class", "place", "m", "terms", "tfs", F.pmod(F.xxhash64("class"), F.lit(shards)).alias("shard")
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    item = postings.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("own"))
    block = item.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    sent = block.select(
        "item_id",
        "block",
        F.col("own.number").alias("numbers"),
        F.col("own.weight").alias("weights"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )
    return (
        dealt.groupBy("shard", "block")
        .cogroup(sent.groupBy("shard", "block"))
        .applyInPandas(run, "item_id long, class long, place long, score long")
    )


def best_classes(classes: pd.DataFrame, items: pd.DataFrame, limit: int) -> list[tuple]:
    """The best ``limit`` classes of each item, by score, then least place."""
    sizes = items["numbers"].map(len).to_numpy()
    numbers, weight = np.concatenate(items["numbers"].tolist()), np.concatenate(items["weights"].tolist())
    order = np.argsort(numbers, kind="stable")
    owner, weight = np.repeat(np.arange(len(items)), sizes)[order], weight[order]
    term, first, holders = np.unique(numbers[order], return_index=True, return_counts=True)
    held = [np.empty((0, 3), np.int64) for _ in range(len(items))]
    for begin in range(0, len(classes), CHUNK_CLASSES):
        chunk = classes.iloc[begin : begin + CHUNK_CLASSES]
        lengths = chunk["terms"].map(len).to_numpy()
        terms, tf = np.concatenate(chunk["terms"].tolist()), np.concatenate(chunk["tfs"].tolist())
        at = np.minimum(np.searchsorted(term, terms), len(term) - 1)
        known = term[at] == terms
        local, at, tf = np.repeat(np.arange(len(chunk)), lengths)[known], at[known], tf[known]
        damped = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(chunk["m"].to_numpy(), lengths)[known])
        times = holders[at]
        places = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[at], times)
        score = np.zeros((len(items), len(chunk)), np.int64)
        np.add.at(score, (owner[places], np.repeat(local, times)), weight[places] * np.repeat(damped, times))
        rows = np.stack((chunk["class"].to_numpy(), chunk["place"].to_numpy()))
        for i in np.flatnonzero(score.any(axis=1)):
            met = np.flatnonzero(score[i])
            if len(met) > limit:  # no class under the limit-th score of this chunk can be among the best
                met = met[score[i, met] >= np.partition(score[i, met], -limit)[-limit]]
            both = np.concatenate((held[i], np.stack((*rows[:, met], score[i, met]), axis=1)))
            held[i] = both[np.lexsort((both[:, 1], -both[:, 2]))[:limit]]
    ids = items["item_id"].astype("Int64").tolist()
    return [(None if ids[i] is pd.NA else ids[i], *row) for i in range(len(items)) for row in held[i].tolist()]


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents."""
    spark = docs.sparkSession
    size, length = totals(docs)
    if not size:
        return spark.createDataFrame([], RESULT)
    asked = cut(item_terms(items))
    vocabulary = cut(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    m = F.expr(f"50 + (50 * n * {size}L) div {length}L")
    bagged = cut(
        bags(docs, vocabulary)
        .withColumn("m", m)
        .select("row", "place", "m", "terms", "tfs", F.xxhash64("m", "terms", "tfs").alias("hash"))
    )
    postings = cut(asked.join(vocabulary, "term").join(weights(bagged, size), "number").select("item_id", "number", "weight"))
    classes = cut(classes_of(bagged))
    found = scored(classes, postings, classes.count(), postings.count(), limit)
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), "place")
    top = cut(found.withColumn("_rank", F.row_number().over(by_score)).where(F.col("_rank") <= limit).drop("_rank"))
    chosen = classes.join(top.select("class").distinct(), "class").drop("place")
    by_place = Window.partitionBy("class").orderBy("place", "row")
    members = (
        bagged.join(chosen, ["hash", "m", "terms", "tfs"])
        .select("class", "place", "row")
        .withColumn("_rank", F.row_number().over(by_place))
        .where(F.col("_rank") <= limit)
        .select("class", F.col("place").alias("member"), "row")
    )
    final = Window.partitionBy("item_id").orderBy(F.desc("score"), "member", "row")
    ranked = top.join(members, "class").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit)
    return ranked.select("item_id", "rank", F.expr(f"nullif(member, {LAST_PLACE}L)").alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """The same ranking in SQL, document by document, without classes."""
    terms = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'))"
    return f"""
WITH word AS (SELECT doc_id, {terms} AS term FROM documents),
bag AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY 1, 2),
doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM bag GROUP BY 1),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM doc),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
           FROM bag, whole GROUP BY term),
factor AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM doc, whole),
asked AS (SELECT DISTINCT item_id, {terms} AS term FROM benchmark),
pair AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
         FROM asked JOIN bag USING (term) JOIN weight USING (term) JOIN factor USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
           FROM pair WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {LIMIT}"""

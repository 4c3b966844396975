"""Operator 2: toxicity by weak supervision.

1. **Voters.**  From a bounded sample of labelled rows of the learning fold, terms (whole words, and
   word beginnings of ``PREFIXES`` letters) that lean to toxic documents are found by a likelihood
   ratio.  The strongest become voters: a lexicon voter for a word, a pattern voter for a beginning.
   A voter votes for toxic where its term occurs and abstains elsewhere; one more voter votes for
   clean where no found term occurs.
2. **Label model.**  Votes are modelled as drawn from a hidden label.  Expectation-maximisation
   estimates each voter's accuracy; the correlations of voters within a class are estimated from the
   same posteriors, and a voter counts the less the more it repeats others, so that overlapping
   patterns are not taken for independent witnesses.
3. **Classifier.**  Logistic regression over all found terms is trained on the posterior labels and
   scores whole texts.

The sample is at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` other rows, chosen by a hash of the id,
of which one of each set of near copies is learned from.  Rows of the held-out fold (crc32 of the id modulo 4 is 2) are never learned from; ids, languages and
sources are never inputs.  Several labels of one document count as the larger.  Null and empty texts
get the score of a text without terms.  Without toxic labels the score is the share of toxic rows
for all texts.  Repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import bounded_ids, cut, free_name, remainder, small_batches, table

FOLDS = 4
HELD_OUT = 2
TOXIC_ROWS = 2000
CLEAN_ROWS = 6000
PREFIXES = (4, 5, 6)
#: Found terms, voters among them, and the least likelihood ratio and toxic documents of a term.
TERMS = 600
VOTERS = 400
LEAST_RATIO = 10.0
LEAST_DOCS = 2
#: Least share of toxic rows among the sampled rows with a term.
PURE = 0.8
#: Correlation from which two voters count as one witness in part.
SAME_WITNESS = 0.6
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> set[str]:
    """Words of a text, and beginnings of longer words marked by a dash."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in PREFIXES:
        out.update({w[:n] + "-" for w in words if len(w) > n})
    return out


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list) -> np.ndarray:
        whole = {t: w for t, w in self.weights.items() if not t.endswith("-")}
        begun = {n: {t[:-1]: w for t, w in self.weights.items() if t.endswith("-") and len(t) == n + 1} for n in PREFIXES}
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            if not isinstance(text, str) or not text:
                continue
            words = set(_WORD.findall(text.lower()))
            total = sum(map(whole.__getitem__, words & whole.keys()))
            for n, known in begun.items():
                if known:
                    total += sum(map(known.__getitem__, {w[:n] for w in words if len(w) > n} & known.keys()))
            out[i] += total
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of a bounded number of labelled rows of the learning fold."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .where(remainder("doc_id", FOLDS) != HELD_OUT)
    )
    chosen = bounded_ids(known.where("toxic = 1"), "toxic", toxic_rows).unionByName(
        bounded_ids(known.where("toxic = 0"), "toxic", clean_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("sketch", F.pandas_udf(_sketches, "long")("text"))
    # a word that only copies of one text share is no evidence
    return found.dropDuplicates(["sketch"]).drop("sketch")


def _sketches(texts: pd.Series) -> pd.Series:
    """Least hash of five neighbouring words: mostly equal for near copies."""

    def least(text: str) -> int:
        w = text.split()
        return min(zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 4)))

    return texts.map(least)


def found_terms(sample: DataFrame, toxic: int, clean: int) -> list[tuple[str, int, int, float]]:
    """Terms leaning to toxic rows: (term, toxic rows with it, other rows with it, ratio)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, label in zip(batch["text"], batch["toxic"]):
                counts[label].update(terms_of(text))
            for label, seen in counts.items():
                if seen:
                    yield pd.DataFrame({"term": list(seen), "toxic": label, "n": list(seen.values())})

    summed = (
        sample.select("text", "toxic")
        .mapInPandas(count, "term string, toxic int, n long")
        .groupBy("term")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"),
        )
        .where(
            (F.col("a") >= LEAST_DOCS)
            & (F.col("a") * clean > F.col("b") * toxic)
            & (F.col("a") >= PURE * (F.col("a") + F.col("b")))
        )
    )

    def part(n, of, rate):
        """n * ln(n / expected), nothing for n = 0."""
        return F.when(n > 0, n * F.log(n / (of * rate))).otherwise(0.0)

    both = F.col("a") + F.col("b")
    there, away = both / (toxic + clean), 1 - both / (toxic + clean)
    ratio = 2 * (
        part(F.col("a"), F.lit(toxic), there)
        + part(F.col("b"), F.lit(clean), there)
        + part(toxic - F.col("a"), F.lit(toxic), away)
        + part(clean - F.col("b"), F.lit(clean), away)
    )
    ranked = summed.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    return [tuple(r) for r in ranked.orderBy(F.desc("ratio"), "term").limit(TERMS).collect()]


def rows_with_terms(sample: DataFrame, terms: list[str]) -> list[list[int]]:
    """Positions of the found terms in each sampled row."""
    position = {t: i for i, t in enumerate(terms)}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [sorted(position[t] for t in terms_of(x) & position.keys()) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "hits": hits})

    rows = sample.select("doc_id", "text").mapInPandas(find, "doc_id long, hits array<int>")
    return [list(r["hits"]) for r in rows.orderBy("doc_id").collect()]  # bounded by the sample


def label_model(votes: np.ndarray, silent: np.ndarray, share: float, rounds: int = 40) -> np.ndarray:
    """Posterior of the hidden label for each row of 0/1 votes.

    ``silent`` marks rows in which no found term occurs, the vote of one voter for clean.  A voter
    that abstains says nothing; one that votes is right with its own accuracy.
    """
    cast, prior = votes.sum(axis=0), np.log(share / (1 - share))
    posterior = np.where(votes.max(axis=1, initial=0) > 0, 0.95, 0.02)
    trust = 1 / (1 + _repeats(votes, posterior))
    for _ in range(rounds):
        accuracy = np.clip((posterior @ votes + 0.95) / (cast + 1), 0.05, 0.98)
        clean_accuracy = float(np.clip(((1 - posterior) @ silent + 0.95) / (silent.sum() + 1), 0.5, 0.99))
        heard = trust * np.log(accuracy / (1 - accuracy))
        odds = prior + votes @ heard - silent * np.log(clean_accuracy / (1 - clean_accuracy))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return posterior


def _repeats(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """How much each voter repeats others: its positive correlations in the toxic class, summed."""
    mean = posterior @ votes / max(posterior.sum(), 1e-9)
    apart = (votes - mean) * np.sqrt(posterior)[:, None]
    covariance = apart.T @ apart
    spread = np.sqrt(np.clip(np.diag(covariance), 1e-9, None))
    correlation = covariance / spread[:, None] / spread[None, :]
    np.fill_diagonal(correlation, 0)
    return np.where(correlation > SAME_WITNESS, correlation, 0).sum(axis=1)


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression on soft labels, by gradient steps with momentum."""
    n, m = x.shape
    base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    bias, w = np.log(base / (1 - base)), np.zeros(m)
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for turn in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + x @ w, -40, 40)))
        g = np.concatenate(([float((p - y).sum())], x.T @ (p - y) + decay * w * 0.1)) / n
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        step = 0.05 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-9)
        bias, w = bias - step[0], w - step[1:]
    return float(bias), w


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Voters, label model and classifier from the learning fold."""
    small_batches(docs.sparkSession)
    sample = cut(labelled_sample(docs, labels, toxic_rows, clean_rows))
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        share = min(max(toxic / max(toxic + clean, 1), 1e-4), 1 - 1e-4)
        return Model(float(np.log(share / (1 - share))))
    share = _toxic_share(labels)
    found = found_terms(sample, toxic, clean)
    terms = [t[0] for t in found]
    hits = rows_with_terms(sample, terms)
    x = np.zeros((len(hits), len(terms)), np.float32)
    for i, row in enumerate(hits):
        x[i, row] = 1
    silent = (x.max(axis=1) == 0).astype(float) if terms else np.ones(len(x))
    posterior = label_model(x[:, :VOTERS].astype(float), silent, toxic / (toxic + clean))
    bias, weights = logistic(x, posterior)
    # the sample holds more toxic rows than the table does
    bias += np.log(share / (1 - share)) - np.log(toxic / clean)
    return Model(float(bias), {t: float(w) for t, w in zip(terms, weights) if w})


def _toxic_share(labels: DataFrame) -> float:
    """Share of toxic rows among the labels of the learning fold."""
    row = (
        labels.where(F.col("toxic").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))
        .agg(F.avg((F.col("toxic") == 1).cast("double")).alias("share"))
        .first()
    )
    return min(max(row["share"] or 0.0, 1e-4), 1 - 1e-4)


def score_of(model: Model):
    """Column function: text to score."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist()))

    return F.pandas_udf(run, "double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    small_batches(docs.sparkSession)
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        score_of(model)("text").alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; columns stay as they are."""
    name = free_name(docs, "_toxicity")
    scored = docs.withColumn(name, score_of(learn(docs, labels))("text"))
    return scored.where(F.col(name) < THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))

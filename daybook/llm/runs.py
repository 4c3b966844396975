"""Operator 11: periodic runs of words, found with a dictionary of basic factors.

A *run* is a stretch of words with smallest period ``q`` (words ``q`` apart are identical) that no
neighbouring word extends, of at least ``max(least_length, least_exponent * q)`` words.

**Dictionary.**  Level ``k`` names every factor of ``2**k`` words, so that equal factors have equal
names; a name of level ``k + 1`` stands for the pair of names of its two halves.  One stable sort of the
names of a level gives both the next level's names and each factor's successor, the next place where
the same factor occurs.

**Proposals.**  A successor at distance ``d <= 2**k`` lies with its factor inside twice the factor's length.
Within a run of period ``q``, with ``2**(k-1) < q <= 2**k``, the factor is at least a period long, so its
occurrences are an arithmetic progression of step exactly ``q``, whatever place of the run it begins at.
So places with one distance ``d`` that follow each other propose the period ``d``.

**Extension.**  The proposals of neighbouring places are one stretch, from the first place to the last place's
successor's end, and it cannot be longer on either side: one word more would lengthen the
progression of places.  Each period belongs to one level, so no run is found twice.  Exponents under
four would need factors shorter than a period, hence ``least_exponent >= 4``.

Work is O(n log n) a level, and levels end where no factor repeats.

``collapse`` keeps the first period of each run: a word goes if some run holds it after that run's first
``q`` words.

Null and empty texts, and texts of white space, have no words and no runs.  Only ASCII white space parts
words.  Rows are treated one by one, so repeated rows give repeated results; other columns are not
read.  A null ``doc_id`` counts as the empty id.  Memory is bounded by one Arrow batch and some arrays over
the longest text's words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from daybook.llm.common import small_batches, table, whole_ids

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
RUNS = "doc_id long, start long, length long, period long"
DIGESTS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; bytes are parted at ASCII white space only."""
    return (text or "").encode("utf-8").split()


def find_runs(words: list, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    if least_exponent < 4:
        raise ValueError("runs are found from an exponent of 4 on")
    numbers: dict = defaultdict(count().__next__)
    names = np.fromiter((numbers[w] for w in words), np.int64, len(words))
    found, size = [], 1  # size is the factors' length at this level
    while len(names) > size and least_exponent * (size // 2 + 1) <= len(words):
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        again = ranked[1:] == ranked[:-1]
        if not again.any():
            break
        gap = np.zeros(len(names), np.int64)
        gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
        gap[(gap > size) | (gap <= size // 2)] = 0
        found.append(_stretches(gap, size))
        rank = np.empty(len(names), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(~again)))
        names = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        size *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[runs[:, 1] >= np.maximum(least_length, least_exponent * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _stretches(gap: np.ndarray, size: int) -> np.ndarray:
    """(start, length, period) of the stretches that neighbouring places with one gap propose."""
    turns = np.flatnonzero(np.diff(gap)) + 1
    first = np.concatenate(([0], turns))
    after = np.concatenate((turns, [len(gap)]))
    period = gap[first]
    proposed = period > 0
    first, after, period = first[proposed], after[proposed], period[proposed]
    return np.stack((first, after - 1 - first + size + period, period), axis=1)


def kept(n_words: int, runs: np.ndarray) -> np.ndarray | None:
    """Which words stay when every run keeps its first period only; None where all stay."""
    if not len(runs):
        return None
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    stay = kept(len(words), runs)
    return b" ".join(words if stay is None else compress(words, stay))


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per run of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                runs = find_runs(words_of(text), least_length, least_exponent)
                if len(runs):
                    made = pd.DataFrame(runs, columns=["start", "length", "period"])
                    made.insert(0, "doc_id", whole_ids([doc_id] * len(runs)))
                    yield made

    return _two(docs).mapInPandas(run, RUNS)


def collapse(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(doc_id, text) with every run cut down to its first period; null texts stay null.

    Texts without runs stay as they are; in others words are joined by one space.
    """

    def shorter(text: str | None) -> str | None:
        words = words_of(text)
        runs = find_runs(words, least_length, least_exponent)
        return collapsed(words, runs).decode("utf-8") if len(runs) else text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [shorter(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": whole_ids(batch["doc_id"]), "text": texts})

    return _two(docs).mapInPandas(run, "doc_id long, text string")


def planted(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: the tail of every tenth document, by a checksum of its id, repeats a period."""
    h = zlib.crc32((doc_id or "").encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (period * (-(-(n - a) // len(period))))[: n - a]


def digests(docs: DataFrame, edit: Callable | None = None) -> DataFrame:
    """Per document its number of runs, its longest run and the digests of all runs and of the kept words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                if edit is not None:
                    words = edit(doc_id, words)
                runs = find_runs(words)
                longest = [None] * 4
                if len(runs):
                    start, length, period = runs[np.argmax(runs[:, 1])].tolist()  # first of the longest
                    longest = [start, length, period, 1000 * length // period]
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                rows.append(
                    [doc_id, len(runs), *longest, _digest(lines.encode()), _digest(collapsed(words, runs))]
                )
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            made = pd.DataFrame(rows, columns=names)
            made["doc_id"] = whole_ids(batch["doc_id"])
            yield made.astype({c: "Int64" for c in names[2:6]})

    return _two(docs).mapInPandas(run, DIGESTS)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _two(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(CAST(doc_id AS BIGINT) AS STRING) AS doc_id", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), planted)

"""Operator 10: language identification by cross-parsing entropy.

For every language a suffix automaton is built over labelled text.  A text is parsed against each
automaton into phrases, each the longest match of what remains, and the language that needs fewest
phrases per character wins.

The labelled text is a bounded sample: ``docs_each`` documents of a language, one excerpt of
``excerpt`` characters of each, chosen by a hash of the id from the learning fold.  The sample (not
the automata) travels to the executors, where each Python worker builds the automata once.  Texts are
scored whole.  Characters become classes: letters of the sample in lower case, one class for any run
of other characters, one for letters the sample lacks.  Texts are laid out in rows of ``ROW``
characters that are parsed side by side, one table lookup per character, language and row; a text's
phrases are the sum over its rows.

Null texts, texts without a letter, and all texts when nothing was learned give ``und`` with score
0.  The score is one less the winner's share of the runner-up's phrases (1 with one language).  Ties
go to the first language in name order.  Repeated rows give repeated results; other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import bounded_ids, free_name, remainder, small_batches, table

FOLDS = 5
HELD_OUT = 0
DOCS_EACH = 96
EXCERPT = 320
#: Characters of a row of the parse, and of one round of texts.
ROW = 512
ROUND_CHARS = 4_000_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
GAP, STRANGE, END = 0, 1, 2
FIRST_LETTER = 3


def learning_text(docs: DataFrame, docs_each: int = DOCS_EACH, excerpt: int = EXCERPT) -> dict[str, str]:
    """Bounded labelled text by language, from the learning fold only."""
    usable = docs.where(
        (remainder("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    chosen = bounded_ids(usable.select("doc_id", "lang"), "lang", docs_each)
    room = F.greatest(F.length("text") - excerpt, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id"), room) + 1
    taken = (
        usable.join(F.broadcast(chosen), ["doc_id", "lang"])
        .dropDuplicates(["doc_id", "lang"])
        .select("lang", "doc_id", F.col("text").substr(start.cast("int"), F.lit(excerpt)).alias("part"))
    )
    texts: dict[str, list] = {}
    for row in taken.collect():  # bounded: docs_each excerpts a language
        texts.setdefault(row["lang"], []).append((row["doc_id"], row["part"]))
    return {lang: "\n".join(p for _, p in sorted(parts)) for lang, parts in sorted(texts.items())}


def suffix_automaton(classes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in classes:
        current = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and c not in following[at]:
            following[at][c] = current
            at = link[at]
        if at != -1:
            target = following[at][c]
            if length[at] + 1 == length[target]:
                link[current] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at != -1 and following[at].get(c) == target:
                    following[at][c] = copy
                    at = link[at]
                link[target] = link[current] = copy
        last = current
    return following


class Parser:
    """Automata of all languages as tables, and the parse of many texts at once."""

    def __init__(self, texts: dict[str, str]):
        self.languages = list(texts)
        letters = sorted({c for t in texts.values() for c in t.lower() if _LETTER.match(c)})
        self.width = FIRST_LETTER + len(letters)
        self.class_of = np.zeros(0x110000, np.uint16)
        self.known = {c: FIRST_LETTER + i for i, c in enumerate(letters)}
        # other letters are told from gaps when first seen
        self.class_of[:] = 65535
        for c, k in self.known.items():
            self.class_of[ord(c)] = k
        self.tables = [self._table(t) for t in texts.values()]

    def _table(self, text: str) -> np.ndarray:
        """Next state times width, doubled, plus one where a phrase begins.

        The last state stands before a phrase: at the start, and after a character that the
        language lacks, which is a phrase by itself.
        """
        following = suffix_automaton(self.classes(text).tolist())
        before = len(following)
        begin = np.full(self.width, before, np.int64)
        for c, state in following[0].items():
            begin[c] = state
        table = np.empty((before + 1, self.width), np.int64)
        table[:] = begin * self.width * 2 + 1
        for state, edges in enumerate(following):
            for c, to in edges.items():
                table[state, c] = to * self.width * 2
        table[:, END] = before * self.width * 2
        return table.reshape(-1).astype(np.int32 if table.max() < 2**31 else np.int64)

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        out = self.class_of[codes]
        if (out == 65535).any():
            for code in np.unique(codes[out == 65535]).tolist():
                self.class_of[code] = STRANGE if _LETTER.match(chr(code)) else GAP
            out = self.class_of[codes]
        if len(out) > 1:
            gap = out == GAP
            out = out[~(gap & np.concatenate(([False], gap[:-1])))]
        return out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, characters and letters by text."""
        parts = [self.classes(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        letters = np.array([int((p != GAP).sum()) for p in parts], np.int64)
        rows = -(-sizes // ROW)
        grid = np.full((int(rows.sum()), ROW), END, np.uint16)
        first = np.concatenate(([0], np.cumsum(rows)))
        flat = grid.reshape(-1)
        for i, p in enumerate(parts):
            flat[first[i] * ROW : first[i] * ROW + len(p)] = p
        steps = np.ascontiguousarray(grid.T)
        owner = np.repeat(np.arange(len(texts)), rows)
        counts = np.zeros((len(texts), len(self.tables)))
        for k, table in enumerate(self.tables):
            state = np.full(len(grid), len(table) - self.width, table.dtype)
            begun = np.zeros(len(grid), np.int32)
            for step in steps:
                after = table.take(state + step)
                begun += (after & 1).astype(np.int32)
                state = after >> 1
            counts[:, k] = np.bincount(owner, begun, len(texts))
        return counts, sizes, letters

    def identify(self, texts: list) -> tuple[list[str], list[float], list[float]]:
        """Language, score and phrases per character of each text."""
        lang, score, rate = [UNKNOWN] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        if not self.tables:
            return lang, score, rate
        pending, chars = [], 0
        for i, text in enumerate(texts):
            if isinstance(text, str) and text:
                pending.append(i)
                chars += len(text)
            if pending and (chars >= ROUND_CHARS or i + 1 == len(texts)):
                self._settle(pending, texts, lang, score, rate)
                pending, chars = [], 0
        if pending:
            self._settle(pending, texts, lang, score, rate)
        return lang, score, rate

    def _settle(self, pending, texts, lang, score, rate) -> None:
        counts, sizes, letters = self.phrases([texts[i] for i in pending])
        best = counts.argmin(axis=1)
        for row, i in enumerate(pending):
            if letters[row]:
                low = counts[row, best[row]]
                rest = np.delete(counts[row], best[row])
                lang[i] = self.languages[best[row]]
                score[i] = float(1 - low / rest.min()) if len(rest) else 1.0
                rate[i] = float(low / sizes[row])


_made: dict[tuple, Parser] = {}


def parser(texts: dict[str, str]) -> Parser:
    """One parser for all tasks of a worker that share the sample."""
    key = tuple(texts.items())
    if key not in _made:
        _made.clear()
        _made[key] = Parser(texts)
    return _made[key]


def language_of(texts: dict[str, str]):
    """Column function: text to (lang_pred, score, rate)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = parser(texts)
        for batch in batches:
            lang, score, rate = p.identify(batch.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score, "rate": rate})

    return F.pandas_udf(run, "lang_pred string, score double, rate double")


def identify_documents(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rate) of every document."""
    small_batches(docs.sparkSession)
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        language_of(texts)("text").alias("found"),
    )
    return found.select("doc_id", "held_out", "found.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` for which a language is found; columns stay as they are.

    Only null texts and texts without a letter go.  A high rate of phrases is no reason: the shortest
    texts of every language have one.
    """
    small_batches(docs.sparkSession)
    name = free_name(docs, "_language")
    found = docs.withColumn(name, language_of(learning_text(docs))("text"))
    return found.where(F.col(name)["lang_pred"] != UNKNOWN).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_documents(docs, learning_text(docs))

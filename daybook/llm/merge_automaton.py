"""Operator 12: BPE encoding and decoding with a tokenization automaton.

**Automaton.**  Labels are the vocabulary's symbols and merges; a path spells a word as a row of
labels.  At first there is one state with an arc for every symbol.  The merges are then taken in
their order, and each adds a *gadget*: where an arc ``u`` leads into a state that has an arc ``v``,

* every state with an arc ``u`` gets an arc ``uv`` that ends where ``v`` ends, and
* the arcs ``u`` now end in a copy of their old state that lacks the arc ``v``.

All arcs of one label end in the same state, so the copy is one state a merge, and a state differs
from the one it was copied from by one missing label.  That is how the tables hold it: for each state
its origin, owner (``u``) and merge number, for each label its end state.  ``arc`` answers from these
tables whether a state has an arc, without ever spelling out rows of 49,000 labels.  The automaton
accepts exactly one path for each word: the labels that the merges give.

**Encoding** is a walk of a pre-split word through the transition table (state, label) -> state, whose entries
are filled from the automaton when first met.  Where a label leads to a place with no way on, the walk
goes back to the next shorter label; a place is given up at most once, so time is linear.  **Decoding** emits
the labels of the arcs, joined as the vocabulary's library joins them.

Text is normalised and split into words here below U+0100 and by the vocabulary's own normaliser and
splitter above.  Strings of special tokens in the text become their ids, as in the library; with
``special=False`` they are ordinary text.

Null and empty texts give no ids and the digests of empty text.  Rows are encoded one by one, so
repeated rows give repeated results, and other columns are not read.  Memory is bounded by one Arrow
batch, the longest text, and the caches (words and transitions), which start anew when full.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from daybook.llm.common import latin_classes, small_batches, table, whole_ids

CACHE_ENTRIES = 200_000
TABLE_ENTRIES = 1_000_000
#: Labels of this many symbols and more are looked for only where one begins alike.
HEAD = 4
DEAD = -1
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Automaton:
    """The automaton of a list of symbols and merges of labels, built gadget by gadget."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]):
        self.first_merge = len(symbols)
        self.text_of = list(symbols)
        self.label_of = {s: i for i, s in enumerate(symbols)}
        self.end_of = [0] * len(symbols)  # label -> state its arcs end in
        self.entry_of = [0] * len(symbols)  # label -> the same when the label was made
        self.owner, self.born = [DEAD], [DEAD]  # state -> label whose arcs end in it, merge number
        self.left: list[int] = []  # merge -> its first label, or DEAD where it never applies
        self.merge_of: dict[tuple[int, int], int] = {}
        self.copies: dict[int, tuple[list[int], list[int]]] = {}  # label -> merge numbers, states
        for number, (u, v) in enumerate(merges):
            self._gadget(number, u, v)

    def _gadget(self, number: int, first: str, second: str) -> None:
        text = first + second
        self.text_of.append(text)
        u, v = self.label_of.get(first, DEAD), self.label_of.get(second, DEAD)
        if DEAD in (u, v) or not self.arc(self.end_of[u], v):  # the two never stand side by side
            self.left.append(DEAD)
            self.end_of.append(DEAD)
            self.entry_of.append(DEAD)
            return
        if text in self.label_of:
            raise ValueError(f"two merges make {text!r}")
        self.label_of[text] = len(self.end_of)
        self.left.append(u)
        self.end_of.append(self.end_of[v])
        self.entry_of.append(self.end_of[v])
        copy = len(self.owner)
        self.owner.append(u)
        self.born.append(number)
        self.merge_of[u, v] = number
        numbers, states = self.copies.setdefault(u, ([], []))
        numbers.append(number)
        states.append(copy)
        self.end_of[u] = copy

    def arc(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc with this label."""
        while True:
            at = state
            while at:  # has a copy on the way from the first state to here lost this label?
                number = self.merge_of.get((self.owner[at], label))
                if number is not None and number <= self.born[at]:
                    return False
                at = self.entry_of[self.owner[at]]
            if label < self.first_merge:
                return True
            number = label - self.first_merge
            if self.left[number] == DEAD:
                return False
            while state and self.born[state] > number:  # the state it was when the label was made
                numbers, states = self.copies[self.owner[state]]
                before = bisect_right(numbers, number)
                state = states[before - 1] if before else self.entry_of[self.owner[state]]
            label = self.left[number]


class Transitions:
    """The automaton's transition table, filled as words need it, and the walk of a word through it."""

    def __init__(self, automaton: Automaton, word_end: str = ""):
        self.automaton, self.word_end = automaton, word_end
        self.table: dict[int, int] = {}  # state and label -> end state, or DEAD
        self.longest: dict[str, int] = {}  # first HEAD symbols -> symbols of the longest such label
        for text in automaton.label_of:
            size = len(text) - len(word_end) if word_end and text.endswith(word_end) else len(text)
            if size >= HEAD:
                self.longest[text[:HEAD]] = max(size, self.longest.get(text[:HEAD], HEAD))

    def step(self, state: int, label: int) -> int:
        """State after ``label``, or DEAD."""
        key = state << 32 | label
        after = self.table.get(key)
        if after is None:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            after = self.table[key] = self.automaton.end_of[label] if self.automaton.arc(state, label) else DEAD
        return after

    def labels(self, word: str) -> list[int]:
        """Labels of the one accepted path of ``word``; its last symbol carries the word's end.

        Longer labels are tried first.  All accepted paths to a place in the word are the same path, so
        a place without a way on is never tried again and the walk takes linear time.
        """
        find, step, longest = self.automaton.label_of.get, self.step, self.longest.get
        n, spelled = len(word), word + self.word_end
        at, state, path, closed = 0, 0, [], set()
        while at < n:
            for end in range(min(n, at + longest(spelled[at : at + HEAD], HEAD - 1)), at, -1):
                if end in closed:
                    continue
                label = find(spelled[at:end] if end < n else spelled[at:])
                if label is not None and (after := step(state, label)) != DEAD:
                    path.append((at, state, label))
                    at, state = end, after
                    break
            else:
                closed.add(at)
                if not path:
                    raise ValueError(f"the vocabulary does not spell {word!r}")
                at, state, _ = path.pop()
        return [label for _, _, label in path]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """Word to its ids as text; what was used lately stays."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> str:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


class AutomatonTokenizer:
    """Normalising, splitting, the automaton's words and their ids; made once in each Python worker."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        vocabulary, word_end = file["model"]["vocab"], file["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in file["model"]["merges"]]
        made = {a + b for a, b in merges}
        automaton = Automaton([t for t in vocabulary if t not in made], merges)
        self.walk = Transitions(automaton, word_end)
        self.id_of = [str(vocabulary[t]) for t in automaton.text_of]
        added = {t["content"]: str(t["id"]) for t in file["added_tokens"]}
        self.text_of = {str(i): t for t, i in vocabulary.items()} | {i: t for t, i in added.items()}
        self.added = added if special else {}
        self.cut = re.compile(f"({'|'.join(map(re.escape, self.added))})")
        whole = Tokenizer.from_file(path)
        self.normalise, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        c = latin_classes()
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{c['L']}]+|[{c['N']}]|[^{c['S']}{c['L']}{c['N']}]+")
        self.letters = dict(enumerate(byte_letters()))
        self.latin_ids = WordIds(lambda word: self._ids(word.encode("utf-8").decode("latin-1").translate(self.letters)))
        self.other_ids = WordIds(self._ids)

    def _ids(self, letters: str) -> str:
        return " ".join([self.id_of[label] for label in self.walk.labels(letters)])

    def _plain(self, text: str) -> list[str]:
        """Ids of the words of a text without special tokens, a string for each word."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [self.other_ids[word] for word, _ in self.split(self.normalise(text))]
        return list(map(self.latin_ids.__getitem__, self.words.findall(text.lower())))

    def ids_text(self, text: str | None) -> str:
        """Decimal ids joined by one space."""
        text = text or ""
        if not any(token in text for token in self.added):
            return " ".join(self._plain(text))
        out = []
        for part in self.cut.split(text):
            out += [self.added[part]] if part in self.added else self._plain(part)
        return " ".join(out)

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.ids_text(text).split()]

    def decode_text(self, ids: list[str]) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_text([str(i) for i in ids])


_made: dict[tuple[str, bool], AutomatonTokenizer] = {}


def automaton_tokenizer(path: str, special: bool = True) -> AutomatonTokenizer:
    """One tokenizer for all tasks of a worker."""
    if (path, special) not in _made:
        _made[path, special] = AutomatonTokenizer(path, special)
    return _made[path, special]


def encode_documents(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """(doc_id, ids array) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = automaton_tokenizer(path, special)
        for batch in batches:
            ids = [t.encode(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": whole_ids(batch["doc_id"]), "ids": ids})

    return _two(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of every (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = automaton_tokenizer(path)
        for batch in batches:
            decoded = [t.decode([] if x is None else list(x)) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": whole_ids(batch["doc_id"]), "decoded": decoded})

    return encoded.selectExpr("CAST(doc_id AS STRING) AS doc_id", "ids").mapInPandas(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = automaton_tokenizer(path, special)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                joined = t.ids_text(text)
                ids = joined.split()
                decoded = t.decode_text(ids)
                rows.append((len(ids), _digest(joined), _digest(decoded)))
            made = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            made.insert(0, "doc_id", whole_ids(batch["doc_id"]))
            yield made

    return _two(docs).mapInPandas(run, RESULT)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _two(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(CAST(doc_id AS BIGINT) AS STRING) AS doc_id", "coalesce(text, '') AS text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

"""Operator 1: byte-level BPE encoding and decoding by monoid tree reduction.

A text is split into halves down to leaves, leaves are encoded, and neighbours are joined.  Both
levels of the encoder are such a monoid:

* **Pieces** (matches of the split pattern).  A half is the list of its matches.  Joining two halves
  scans again from the first match of the left half that might still change, until a match ends
  where a match of the right half begins.  A match is final once every character its outcome depends
  on lies inside its half: its end plus two, and its start plus three (longest contraction).  The
  pattern never looks back, so from a common border on both scans are the same.
* **Tokens** of one piece.  Joining re-encodes a window of ``k`` tokens at each side of the border,
  with ``k`` doubling.  The window is settled when its outer tokens and the tokens next to them are
  compatible, that is, when encoding the bytes of the two alone gives the same two tokens.  A list of
  tokens in which all neighbours are compatible is the encoding of its bytes, so tokens outside the
  window cannot change any more.

Decoding concatenates bytes up the same kind of tree.

Null and empty texts give no tokens, zero length and the digests of empty input.  Rows are encoded
one by one, so repeated rows give repeated results; other columns are not read.  Memory is bounded
by one Arrow batch, the longest text and the caches.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from daybook.llm.common import latin_classes, small_batches

LEAF_CHARS = 8192
LEAF_TOKENS = 8192
#: Pieces up to this length are leaves; windows beyond the second length use a queue.
LEAF_BYTES = 6
LONG_WINDOW = 256
CACHE_ENTRIES = 250_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file with one base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Splitter:
    """Matches of the split pattern, as a monoid over halves of the text."""

    def __init__(self, pattern: str, leaf_chars: int = LEAF_CHARS):
        import regex

        self.any_text = regex.compile(pattern)
        self.latin = None
        if r"\p{L}" in pattern:
            c = latin_classes()
            body = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{c['S']}{c['L']}{c['N']}]")
            body = body.replace(r"\p{L}", f"[{c['L']}]").replace(r"\p{N}", f"[{c['N']}]")
            body = body.replace(r"(?!\S)", f"(?![^{c['S']}])").replace(r"\s", f"[{c['S']}]")
            # the same language below U+0100, on the faster engine
            self.latin = re.compile(body)
        self.leaf_chars = leaf_chars

    def split(self, text: str) -> list[str]:
        pattern = self.any_text
        if self.latin is not None:
            try:
                text.encode("latin-1")
                pattern = self.latin
            except UnicodeEncodeError:
                pass
        return self._halves(pattern, text, 0, len(text))

    def _halves(self, pattern, text: str, start: int, end: int) -> list[str]:
        if end - start <= self.leaf_chars:
            return pattern.findall(text, start, end)
        middle = (start + end) // 2
        left = self._halves(pattern, text, start, middle)
        right = self._halves(pattern, text, middle, end)
        return self._join(pattern, text, left, right, middle, end)

    @staticmethod
    def _join(pattern, text, left, right, middle, end):
        at, keep = middle, len(left)
        while keep:
            begin = at - len(left[keep - 1])
            if at + 2 <= middle and begin + 3 <= middle:
                break
            at, keep = begin, keep - 1
        window, border, taken = [], middle, 0
        for match in pattern.finditer(text, at, end):
            window.append(match.group())
            stop = match.end()
            while border < stop:
                border += len(right[taken])
                taken += 1
            if border == stop:
                break
        return left[:keep] + window + right[taken:]


class Encoder:
    """Tokens of one piece, as a monoid over halves of its bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.leaves: dict[bytes, tuple[int, ...]] = {}

    def encode(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return (rank,)
        if len(piece) <= LEAF_BYTES:
            known = self.leaves.get(piece)
            if known is None:
                if len(self.leaves) >= CACHE_ENTRIES:
                    self.leaves.clear()
                known = self.leaves[piece] = self._merge(piece)
            return known
        middle = len(piece) // 2
        return self._join(self.encode(piece[:middle]), self.encode(piece[middle:]))

    def _join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = self._pair(a[0], b[0]) if k == 1 else self._window(a + b)
            if (len(left) <= k or self._pair(left[-k - 1], window[0]) == (left[-k - 1], window[0])) and (
                len(right) <= k or self._pair(window[-1], right[k]) == (window[-1], right[k])
            ):
                return left[:-k] + window + right[k:]
            k *= 2

    def _pair(self, a: int, b: int) -> tuple[int, ...]:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self._window((a, b))
        return known

    def _window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        return self._merge(b"".join(self.bytes_of[t] for t in tokens))

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Encode from single bytes: merge the leftmost pair of lowest rank until none is known."""
        if len(piece) > LONG_WINDOW:
            return self._merge_long(piece)
        get, none = self.ranks.get, len(self.ranks)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        order = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while order:
            lowest = min(order)
            if lowest == none:
                break
            i = order.index(lowest)
            parts[i] += parts.pop(i + 1)
            del order[i]
            if i < len(order):
                order[i] = get(parts[i] + parts[i + 1], none)
            if i:
                order[i - 1] = get(parts[i - 1] + parts[i], none)
        return tuple(self.ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a queue of pairs, for windows that had to grow far."""
        get, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(queue, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class PieceIds(dict):
    """Piece to its ids as text, filled on demand; when full, what was used lately stays."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.old: dict[str, str] = {}

    def __missing__(self, piece: str) -> str:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = " ".join(map(str, self.encoder.encode(piece.encode("utf-8", "replace"))))
        self[piece] = ids
        return ids


class Tokenizer:
    """Both levels together; made once in each Python worker."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        self.splitter = Splitter(pattern, leaf_chars)
        self.encoder = Encoder(read_ranks(path))
        self.piece_ids = PieceIds(self.encoder)
        self.bytes_of_text = {str(i): b for i, b in self.encoder.bytes_of.items()}

    def ids_text(self, text: str | None) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.piece_ids.__getitem__, self.splitter.split(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.ids_text(text).split()]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoder.decode(ids)

    def decode_text(self, ids: list[str]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of_text.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode_text(ids[:middle]) + self.decode_text(ids[middle:])


_made: dict[tuple, Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for all tasks of a worker."""
    key = (path, pattern)
    if key not in _made:
        _made[key] = Tokenizer(path, pattern)
    return _made[key]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array) of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [t.encode(x) for x in batch["text"]]})

    return _two(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of every (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path, pattern)
        for batch in batches:
            ids = [[] if x is None else list(x) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "decoded": [t.decode(x) for x in ids]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path, pattern)
        for batch in batches:
            counts, ids_digests, decoded_digests = [], [], []
            for text in batch["text"]:
                joined = t.ids_text(text)
                ids = joined.split()
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_digests.append(hashlib.sha256(t.decode_text(ids)).hexdigest())
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": counts,
                    "ids_sha256": ids_digests,
                    "decoded_sha256": decoded_digests,
                }
            )

    return _two(docs).mapInPandas(run, RESULT)


def _two(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(text, '') AS text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from daybook.llm.common import table

    return round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )

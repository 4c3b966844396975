"""Token ids of the lower-casing word vocabulary, word by word.

Ids equal those of the ``tokenizers`` library with ``add_special_tokens=False`` and special strings
read as ordinary text.  The vocabulary's normaliser acts on single characters and its splitter on
words, so a text below U+0100 is lower-cased and split here and each distinct word goes through the
library's merge model once, as the letters of its bytes; all other texts go through the library whole.
"""

from __future__ import annotations

import re

import numpy as np

from daybook.llm.common import latin_classes
from daybook.llm.merge_automaton import byte_letters

CACHE_ENTRIES = 250_000


class WordIds(dict):
    """Word to its ids as little-endian unsigned bytes; what was used lately stays."""

    def __init__(self, library, kind: str = "<u4"):
        self.model, self.kind = library.model, kind
        self.letters = dict(enumerate(byte_letters()))
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            letters = word.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(letters)], self.kind).tobytes()
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids as little-endian unsigned bytes of the given kind, 32 or (for small vocabularies) 16 bits wide."""

    def __init__(self, path: str, kind: str = "<u4"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        c = latin_classes()
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{c['L']}]+|[{c['N']}]|[^{c['S']}{c['L']}{c['N']}]+"
        )
        self.kind, self.ids_of = kind, WordIds(self.library, kind)

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.ids_of.__getitem__, self.words.findall(text.lower())))


_made: dict[tuple[str, str], WordTokenizer] = {}


def word_tokenizer(path: str, kind: str = "<u4") -> WordTokenizer:
    """One tokenizer for all tasks of a worker."""
    if (path, kind) not in _made:
        _made[path, kind] = WordTokenizer(path, kind)
    return _made[path, kind]

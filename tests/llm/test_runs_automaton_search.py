"""Periodic runs, the tokenization automaton and ranked search against plain versions, and odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

pt = pytest.importorskip("public_tokenizers")

from daybook.llm import lexical, merge_automaton, runs  # noqa: E402
from daybook.llm.common import table  # noqa: E402

WORDS = pt.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " \n\t", "a", "A'S b's ²½ ǅ İ ΣΑΣ \x1c\x85 中文😀", "x" * 3000, "word " * 4000, "dup text here", "dup text here"]


def odd_documents(spark):
    """Null, empty, long and repeated texts, null and huge ids, and extra columns with clashing names."""
    rows = [(i, t, None, "x", 1, "k", 1.0, [1]) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id here", None, None, None, None, None, None), (2**53 + 1, "dup text here", "en", "s", 2, "k", 0.0, None)]
    rows += [rows[7], rows[7]]
    names = "doc_id long, text string, lang string, number string, n long, place string, score double, terms array<int>"
    return spark.createDataFrame(rows, names)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# --- periodic runs


def plain_runs(words, least_length=6, least_exponent=4):
    found = []
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_length, least_exponent * q):
                stretch = words[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def repetitive(rnd):
    n = rnd.randrange(80)
    words = [rnd.choice("abcde"[: rnd.choice([1, 2, 3, 5])]) for _ in range(n)]
    for _ in range(rnd.randrange(3)):
        if words:
            a, p = rnd.randrange(n), 1 + rnd.randrange(n // 3 + 1)
            period = words[a : a + p]
            words[a:] = [period[i % len(period)] for i in range(n - a)]
            words[rnd.randrange(n)] = "z"
    return words


@pytest.mark.parametrize(("least_length", "least_exponent"), [(6, 4), (1, 4), (20, 5)])
def test_runs_equal_the_definition(least_length, least_exponent):
    rnd = random.Random(least_length)
    for _ in range(1500):
        words = repetitive(rnd)
        got = [tuple(r) for r in runs.find_runs(words, least_length, least_exponent).tolist()]
        assert got == plain_runs(words, least_length, least_exponent), words
        assert runs.collapsed([w.encode() for w in words], runs.find_runs(words)) == " ".join(
            plain_collapse(words, plain_runs(words))
        ).encode()


def test_runs_refuse_exponents_that_the_method_cannot_find():
    with pytest.raises(ValueError, match="exponent"):
        runs.find_runs(["a"] * 9, least_exponent=3)


def test_runs_of_runs_and_long_texts():
    inner = ["a"] * 8 + ["b"]
    words = inner * 5
    assert [tuple(r) for r in runs.find_runs(words).tolist()] == plain_runs(words)
    long = [str(i % 1000) for i in range(200_000)]
    assert runs.find_runs(long).tolist() == [[0, 200_000, 1000]]


def test_runs_query_equals_a_plain_version(spark):
    docs = table(spark, SF_DIR, "documents")
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.query(spark, SF_DIR).collect()}
    want = {}
    for doc_id, text in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        found = plain_runs(words)
        best = [None] * 4
        if found:
            s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
            best = [s, length, q, 1000 * length // q]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        want[doc_id] = (len(found), *best, sha(lines), sha(" ".join(plain_collapse(words, found))))
    assert got == want
    assert any(v[0] for v in want.values())


def test_runs_on_odd_rows(spark):
    docs = odd_documents(spark)
    got = runs.digests(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"] for r in got} >= {None, 2**53 + 1}
    by_id = {r["doc_id"]: r for r in got}
    for empty in (0, 1, 2):
        assert tuple(by_id[empty])[1:] == (0, None, None, None, None, sha(""), sha(""))
    assert tuple(by_id[6])[1:6] == (1, 0, 4000, 1, 4_000_000) and by_id[6]["collapsed_sha256"] == sha("word")
    assert [tuple(r) for r in runs.periodic_runs(docs).collect()] == [(6, 0, 4000, 1)]
    texts = {r["doc_id"]: r["text"] for r in runs.collapse(docs).collect()}
    assert texts[6] == "word" and texts[0] is None and texts[4] == ODD_TEXTS[4]
    assert runs.digests(docs.limit(0)).count() == 0
    assert runs.planted(None, [b"a"] * 9) == [b"a"] * 9


# --- tokenization automaton


def plain_merge(symbols, merges):
    rank = {m: i for i, m in enumerate(merges)}
    parts = list(symbols)
    while True:
        best = min((rank.get(p, len(merges)) for p in zip(parts, parts[1:])), default=len(merges))
        if best == len(merges):
            return parts
        i = next(i for i, p in enumerate(zip(parts, parts[1:])) if rank.get(p) == best)
        parts[i : i + 2] = ["".join(merges[best])]


def random_merges(rnd, size):
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < size:
        pair = (rnd.choice(tokens), rnd.choice(tokens))
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    return merges


@pytest.mark.parametrize("seed", range(12))
def test_automaton_accepts_exactly_the_merged_words(seed):
    rnd = random.Random(seed)
    merges = random_merges(rnd, 10)
    automaton = merge_automaton.Automaton(["a", "b", "c"], merges)
    walk = merge_automaton.Transitions(automaton)
    for word in map("".join, itertools.chain.from_iterable(itertools.product("abc", repeat=n) for n in range(1, 8))):
        want = plain_merge(word, merges)
        assert [automaton.text_of[x] for x in walk.labels(word)] == want
    for word in map("".join, itertools.product("ab", repeat=6)):  # no other path is accepted
        accepted, open_paths = [], [(0, 0, [])]
        while open_paths:
            at, state, path = open_paths.pop()
            if at == len(word):
                accepted.append(path)
            for end in range(at + 1, len(word) + 1):
                label = automaton.label_of.get(word[at:end])
                if label is not None and (after := walk.step(state, label)) != merge_automaton.DEAD:
                    open_paths.append((end, after, [*path, word[at:end]]))
        assert accepted == [plain_merge(word, merges)]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(WORDS)
    made.no_truncation()
    made.no_padding()
    return made


def test_automaton_equals_the_library(library):
    t = merge_automaton.AutomatonTokenizer(WORDS)
    rnd = random.Random(7)
    letters = "ab 'reslvdTm\n\t  xyzé1٣23中文ß—!?.  'll\x1c\x85\U0001f600ΣİÁ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abethingorstn") for _ in range(rnd.randrange(90))) for _ in range(800)]
    texts += ["", "a" * 900, "!" * 300, "x<|endoftext|> Y<|startoftext|>é<|endoftext", "<|endoftext|>", "</w> a</w>"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert t.encode(text) == want, text
        assert t.decode(want) == library.decode(want, skip_special_tokens=False)
    plain = merge_automaton.AutomatonTokenizer(WORDS, special=False)
    library.encode_special_tokens = True
    assert plain.encode("x<|endoftext|>") == library.encode("x<|endoftext|>", add_special_tokens=False).ids
    library.encode_special_tokens = False


def test_automaton_query_on_odd_rows(spark, library):
    docs = odd_documents(spark)
    got = sorted((str(r["doc_id"]), *r[1:]) for r in merge_automaton.round_trip(docs, WORDS).collect())
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((str(r["doc_id"]), len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    assert got == sorted(want)
    encoded = merge_automaton.encode_documents(docs, WORDS)
    decoded = {r["doc_id"]: r["decoded"] for r in merge_automaton.decode_documents(encoded, WORDS).collect()}
    assert decoded[0] == "" and decoded[3] == "a</w>"
    assert merge_automaton.round_trip(docs.limit(0), WORDS).count() == 0


def test_automaton_tables_start_anew_when_full(library, monkeypatch):
    monkeypatch.setattr(merge_automaton, "TABLE_ENTRIES", 5)
    monkeypatch.setattr(merge_automaton, "CACHE_ENTRIES", 3)
    t = merge_automaton.AutomatonTokenizer(WORDS)
    text = "several different words follow several other different words again"
    assert t.encode(text) == library.encode(text, add_special_tokens=False).ids


# --- ranked search


def plain_search(docs, items, limit):
    split = lambda text: re.findall(lexical.TERM, (text or "").translate(lexical.LOWERED))
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    size, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in split(text)}
        scores = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * size) // length
            w = {t: math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) for t in asked if t in b}
            scores.append((sum(w[t] * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in w), d))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:limit]
        out += [(item, rank, d, s) for rank, (s, d) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(8192, 512, 65_536), (16, 3, 12)])
def test_search_equals_a_plain_version(spark, monkeypatch, sizes):
    """Also where groups of copies are larger than the list, and over many shards, chunks and blocks."""
    for name, value in zip(("SHARD_CLASSES", "CHUNK_CLASSES", "BLOCK_POSTINGS"), sizes):
        monkeypatch.setattr(lexical, name, value)
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["Éa", "ÉA", "x_y", "Z9", "中文"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12)))) for i in range(120)]
    docs += [(i, docs[3][1]) for i in range(200, 290)] + [(i, " , ".join(docs[5][1].split()[::-1])) for i in range(300, 340)]
    rnd.shuffle(docs)
    items = [(i, " ".join(rnd.choice(words) for _ in range(4))) for i in range(9)]
    items += [(20, docs[0][1]), (21, "nothing-known"), (22, None), (23, ""), (20, "w1 W2")]
    got = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"),
        limit=7,
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, 7)


def test_search_on_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "dup WORD id", 5), (None, "a s", 6)], "item_id long, text string, score long")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in lexical.search(docs, items).collect()), key=str)
    assert got == plain_search(rows, [(1, "dup WORD id"), (None, "a s")], 50)
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs.where("text IS NULL"), items).count() == 0


def test_copies_are_one_class(spark):
    docs = spark.createDataFrame([(i, "one two two") for i in range(40)] + [(50, "two one, TWO."), (51, "one")], "doc_id long, text string")
    vocabulary = spark.createDataFrame([("one", 1), ("two", 2)], "term string, number long")
    bagged = lexical.bags(docs, vocabulary).selectExpr("row", "place", "n AS m", "terms", "tfs", "xxhash64(n, terms, tfs) AS hash")
    got = sorted((r["m"], r["terms"], r["tfs"], r["place"]) for r in lexical.classes_of(bagged).collect())
    assert got == [(1, [1], [1], 51), (3, [1, 2], [1, 2], 0)]

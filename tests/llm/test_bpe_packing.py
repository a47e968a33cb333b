import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataq.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
THEIRS = Tokenizer.from_file(PATH)
MINE = bpe.load(PATH)
HARD = [
    "", "aaaaaaaaaaaaaaaa aaa aa", "Hello world, it's 23 <|endoftext|> ÉTÉ über\x1c ΣΑΣ İstanbul ²½ ªº १२ ́e é 日本語 \x85 ​ 😀😀🏽 ǅ ﬁ",
    "I'LL we've DON'T''s'''", "!!!!????....---===", "<|startoftext|><|endoftext|>x", "\t\n  \r\x0b", "x" * 5000, "a\x00b\x7f",
]


def same(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert MINE.encode(text) == want
    assert MINE.decode(want) == THEIRS.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text.encode("utf-8", "ignore").decode())


def test_many_words():
    rng = random.Random(5)
    for _ in range(3000):
        same("".join(rng.choice("abeinrst'h<") for _ in range(rng.randint(1, 24))))


def test_automaton_on_a_small_merge_list():
    vocab = {c: i for i, c in enumerate("abc")} | {"aa": 3, "ab": 4, "aab": 5, "bc": 6}
    merges = [["a", "a"], ["a", "b"], ["aa", "b"], ["b", "c"]]
    m = bpe.MergeAutomaton(vocab, merges, "")
    rank = {tuple(x): i for i, x in enumerate(merges)}

    def slow(word):
        parts = list(word)
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
            _, i = min(pairs)
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        return [vocab[p] for p in parts]

    todo = sorted("".join(random.Random(i).choices("abc", k=i % 9 + 1)) for i in range(500))
    assert list(m.words(todo)) == [slow(w) for w in todo]


def test_tables(spark, docs):
    texts = [*HARD, None, "same text", "same text"]
    got = {r["doc_id"]: r for r in bpe.digest_table(docs(texts), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = THEIRS.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode_table(docs([(None, "a b"), (3, None)]), PATH).collect()
    assert [(r["id"], list(r["ids"])) for r in full] == [(None, THEIRS.encode("a b", add_special_tokens=False).ids), (3, [])]
    assert bpe.digest_table(docs([]), PATH).count() == 0


def test_packing_covers_every_id_once(spark, docs):
    rng = random.Random(1)
    texts = [words(rng, rng.choice([0, 1, 5, 300, 3000])) for _ in range(120)] + [None, "twin", "twin", "<|endoftext|>"]
    rows = packing.pack(docs(texts), PATH, keep_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*THEIRS.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], list(r["ids"])) == (at, len(ids), part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert packing.pack(docs([]), PATH).count() == 0


def test_little_padding():
    rng = np.random.default_rng(2)
    sizes = np.minimum(rng.lognormal(5.5, 1, 2048).astype(int) + 1, packing.PIECE)
    at, n = packing.deal(sizes)
    fill = np.bincount(at, sizes, n)
    assert fill.max() <= packing.WINDOW and fill.sum() / (n * packing.WINDOW) > 0.97


def test_differencing_is_a_partition():
    sizes = np.array([8, 7, 6, 5, 4])
    fill = np.bincount(packing.differencing(sizes, 2), sizes)
    assert sorted(fill) in ([14, 16], [15, 15])
    assert packing.deal(np.array([5]))[1] == 1
    at, n = packing.deal(np.full(10, 3000))
    assert n == 10 and len(set(at)) == 10  # the count rises until nothing exceeds the capacity


def test_the_table_holds_what_the_gadgets_say():
    rng = np.random.default_rng(1)
    a = MINE.automaton
    x, y = rng.integers(0, 49_406, (2, 100_000))
    assert a.step(x, y).tolist() == [a.has_arc(*p) for p in zip(x.tolist(), y.tolist())]


def test_words_alone_and_together_take_the_same_path():
    rng = random.Random(8)
    many = list({"".join(rng.choices("aeinrstht'", k=rng.randint(1, 90))) for _ in range(2000)})
    together = MINE.automaton.words(many)
    assert together == [MINE.automaton.words([w])[0] for w in many]
    texts = [w.replace("'", "") for w in many]
    assert [MINE.encode(t) for t in texts] == [e.ids for e in THEIRS.encode_batch(texts, add_special_tokens=False)]


def test_a_word_table_that_is_emptied_gives_the_same(monkeypatch):
    rng = random.Random(9)
    texts = [words(rng, 200) for _ in range(30)]
    want = [MINE.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "TABLE_BYTES", 1000)
    table = bpe.WordTable(PATH, lambda ids: np.array(ids, "<u4").tobytes())
    assert [np.frombuffer(b"".join(r), "<u4").tolist() for r in table.rows(texts, 500)] == want


def slow_differencing(sizes, k):
    """Multiway largest differencing with lists of (sum, pieces), spelled out."""
    parts = [sorted([(s, [i])] + [(0, [])] * (k - 1), key=lambda x: -x[0]) for i, s in enumerate(sizes)]
    age = list(range(len(parts)))
    while len(parts) > 1:
        order = sorted(range(len(parts)), key=lambda j: (-(parts[j][0][0] - parts[j][-1][0]), age[j]))
        x, y = order[:2]
        both = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(parts[x], reversed(parts[y]))]
        least = min(s for s, _ in both)
        both = sorted([(s - least, p) for s, p in both], key=lambda z: -z[0])
        newest = max(age) + 1
        parts, age = [p for j, p in enumerate(parts) if j not in (x, y)] + [both], [a for j, a in enumerate(age) if j not in (x, y)] + [newest]
    return sorted(sum(sizes[i] for i in p) for _, p in parts[0])


def test_differencing_against_the_spelled_out_method():
    rng = np.random.default_rng(6)
    for _ in range(60):
        k, n = int(rng.integers(2, 7)), int(rng.integers(3, 40))
        sizes = rng.integers(1, 1000, n)
        fill = np.bincount(packing.differencing(sizes, k), sizes, k)
        assert sorted(fill.astype(int).tolist()) == slow_differencing(sizes.tolist(), k)

"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled into a deterministic automaton over *tokens*, one
merge gadget at a time, starting from a single state in which every base symbol
loops.  The gadget for merge ``(u, v) -> w``

* gives ``w`` an arc out of every state that has an arc ``u`` into a state with
  an arc ``v`` (``w`` leads where ``v`` leads at that moment), and
* redirects ``u`` into a copy of its target state that has lost the arc ``v``.

A target state depends on the arc label alone, so a state is named by its last
token and the arc ``y`` leads to state ``y``; a row of the transition table has to
tell only which arcs a state has lost.  While gadgets are added, a state keeps the
arcs *it* lost (``lost[u][v] = rank``), those of its right child as they stood when
the state was created are inherited, and an arc ``w`` exists where the arc of its
left child existed when ``w`` was created.

``compile`` then writes out the rows.  Labels are numbered in preorder of the tree
of left children, latest child first, so that losing ``v`` at some rank loses one
interval of numbers: ``v`` itself and the subtrees of its later children.  A row is
the sorted list of its disjoint intervals, and all rows lie end to end in two
integer arrays, some 10 MB for 50,000 tokens.  A transition is a search in a row.

The only path of arcs that spells a word is its BPE tokenization, and the same holds
for each of its prefixes.  Encoding therefore steps from the state of one prefix to
that of the next: the state after a prefix is its longest ending label that is an arc
out of the state that the prefix without it leads to.  ``step`` reads the transitions
of many words at once; words of a batch are sorted, so that a prefix that several of
them share is stepped over once.  Decoding emits the arc labels.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strataq.llm.wordbatch import slices
from strataq.llm.workers import quiet

NEVER = 1 << 30
END = "\n"  # one character for the end-of-word mark inside the automaton
TABLE_BYTES = 48_000_000  # words a worker keeps from task to task; emptied beyond
SYMBOLS = 1 << 9  # byte symbols and the end mark lie below
TOGETHER = 1 << 21  # symbols of words that are stepped over together
FEW, LONG = 24, 64  # fewer words, or words of more symbols, are stepped over one by one

# The pre-tokenizer pattern of the vocabulary file; {L}, {N} and {S}
# stand for the characters of Unicode letters, numbers and white space.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
# The same pattern for texts of ASCII and accented Latin characters, where the
# standard library's faster engine needs no Unicode properties.
LATIN = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\x09-\x0d\x20{LATIN}0-9]+"
BEYOND_LATIN = "[^\x00-\x7f\u00c0-\u024f]"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


def _ranges(points: list[int]) -> str:
    """A character class of sorted code points."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"{re.escape(chr(points[at]))}-{re.escape(chr(points[end]))}")
        at = end + 1
    return "".join(out)


@functools.lru_cache(maxsize=1)
def unicode_words():
    """``findall`` of SPLIT.  Characters that this Python doesn't know as assigned are
    asked of the tokenizers library, whose Unicode version may be newer."""
    from tokenizers import Regex, pre_tokenizers

    by_class: dict[str, list[int]] = {"L": [], "N": []}
    unknown = []
    for point in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(point))
        if category[0] in by_class:
            by_class[category[0]].append(point)
        elif category == "Cn":
            unknown.append(chr(point))
    maybe = regex.findall(r"[\p{L}\p{N}]", "".join(unknown))
    for name in by_class:
        split = pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed", invert=True)
        by_class[name] = sorted(by_class[name] + [ord(c) for c in maybe if split.pre_tokenize_str(c)])
    space = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    classes = {"L": _ranges(by_class["L"]), "N": _ranges(by_class["N"]), "S": _ranges(space)}
    return re.compile(SPLIT.format(**classes)).findall


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        size = max(vocab.values()) + 1
        self.label = [""] * size
        for token, i in vocab.items():
            self.label[i] = token
        self.left, self.right = [-1] * size, [-1] * size
        self.born = [-1] * size
        self.lost: list[dict[int, int] | None] = [None] * size
        made = set()
        for rank, merge in enumerate(merges):
            u_s, v_s = merge if isinstance(merge, list) else merge.split(" ")
            u, v = vocab[u_s], vocab[v_s]
            w = vocab[u_s + v_s]
            if w in made or not self.has_arc(u, v):
                continue  # the pair can't occur any more: the gadget adds nothing
            made.add(w)
            self.left[w], self.right[w], self.born[w] = u, v, rank
            if self.lost[u] is None:
                self.lost[u] = {}
            self.lost[u][v] = rank
        self.spans, self.high = self.compile()
        labels = {}  # token -> label, as spelled in a word
        for token, i in vocab.items():
            base = token.removesuffix(suffix) if suffix else token
            if len(base) == 1 or i in made:
                labels[i] = base + END if base != token else token
        self.tree, self.edges, self.next, self.ends = self.endings(labels)
        self.one = array("q", self.spans.tolist()), array("i", self.high.tolist()), self.number.tolist(), self.ends.tolist()

    def has_arc(self, x: int, y: int) -> bool:
        """Whether state ``x`` has the arc ``y``, read from the gadgets so far."""
        left, right, born, lost = self.left, self.right, self.born, self.lost
        until_x = NEVER
        while True:
            arcs = lost[x]
            if arcs:
                until_y, t = NEVER, y
                while True:
                    rank = arcs.get(t)
                    if rank is not None and rank < until_x and rank <= until_y:
                        return False
                    if left[t] < 0:
                        break
                    until_y, t = born[t], left[t]
            if right[x] < 0:
                return True
            until_x, x = born[x], right[x]

    def compile(self) -> tuple[np.ndarray, np.ndarray]:
        """The transition table: ``spans`` holds ``state << 17 | low`` in order and
        ``high`` the end of each span; a state has lost the labels numbered ``low`` to
        ``high - 1``.  ``number`` has the number of each label."""
        left, right, born, lost = self.left, self.right, self.born, self.lost
        n = len(left)
        later: list[list[int]] = [[] for _ in range(n)]  # children, latest first
        for i in sorted(range(n), key=born.__getitem__, reverse=True):
            if left[i] >= 0:
                later[left[i]].append(i)
        number, end = [0] * n, [0] * n
        at = 0
        stack = [i for i in range(n) if left[i] < 0]
        while stack:
            i = stack.pop()
            if i < 0:
                end[~i] = at
                continue
            number[i] = at
            at += 1
            stack.append(~i)
            stack += reversed(later[i])
        self.number = np.array(number)
        cut: list[list[tuple[int, int, int]]] = []  # per state (rank, low, high) of its own losses
        for arcs in lost:
            own = []
            for v, rank in (arcs or {}).items():
                high = number[v] + 1
                for c in later[v]:
                    if born[c] < rank:
                        break
                    high = end[c]
                own.append((rank, number[v], high))
            cut.append(own)
        low, high = [], []
        for x in range(n):
            spans, until, y = [], NEVER, x
            while y >= 0:
                if cut[y]:
                    spans += [(a, b) for rank, a, b in cut[y] if rank < until]
                until, y = born[y], right[y]
            spans.sort()
            last = -1
            for a, b in spans:
                if a <= last:
                    high[-1] = last = max(b, last)
                else:
                    low.append(x << 17 | a)
                    high.append(b)
                    last = b
        return np.array(low, np.int64), np.array(high, np.int64)

    def step(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the table has a transition from states ``x`` by labels ``y``."""
        at = self.number[y]
        k = np.searchsorted(self.spans, x << 17 | at, "right") - 1
        return (k < 0) | (self.spans[k] >> 17 != x) | (at >= self.high[k])

    @staticmethod
    def endings(labels: dict[int, str]):
        """The labels read backwards as a tree: a map from ``node * SYMBOLS + symbol`` to
        the next node, the same as two arrays, and the token that a node spells or -1."""
        edges: dict[int, int] = {}
        ends = [-1]
        for i, label in labels.items():
            node = 0
            for ch in reversed(label):
                key = node * SYMBOLS + ord(ch)
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        keys = np.array(sorted(edges), np.int64)
        return edges, keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64)

    def words(self, spelled) -> list[list[int]]:
        """Ids of each word, given as byte symbols without the end mark."""
        words = [w + END for w in spelled] if self.suffix else list(spelled)
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(max(3, (len(w) - 1).bit_length()), []).append(w)
        out: dict[str, list[int]] = {}
        for bits, some in by_size.items():
            if len(some) < FEW or 1 << bits > LONG:
                out.update((w, self._path(w)) for w in some)
                continue
            some.sort()
            step = max(1, TOGETHER >> bits)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                out.update(zip(part, self._paths(part, max(map(len, part)))))
        return [out[w] for w in words]

    def _path(self, word: str) -> list[int]:
        """Labels of the path of one word."""
        tree, (spans, high, number, ends) = self.tree, self.one
        last, begin = [0], [0]
        for end in range(1, len(word) + 1):
            node, state, start = 0, 0, 0
            for at in range(end - 1, -1, -1):
                node = tree.get(node * SYMBOLS + ord(word[at]), -1)
                if node < 0:
                    break
                token = ends[node]
                if token < 0:
                    continue
                if at:
                    x, y = last[at], number[token]
                    k = bisect_right(spans, x << 17 | y) - 1
                    if k >= 0 and spans[k] >> 17 == x and y < high[k]:
                        continue
                state, start = token, at
            last.append(state)
            begin.append(start)
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at = begin[at]
        return path[::-1]

    def _paths(self, words: list[str], wide: int) -> list[list[int]]:
        """Labels of the path of each word; the words are sorted and not empty."""
        n = len(words)
        rows = np.arange(n)
        size = np.fromiter(map(len, words), np.int64, n)
        symbol = np.frombuffer("".join([w.ljust(wide, "\0") for w in words]).encode("utf-16-le"), np.uint16).reshape(n, wide)
        shared = np.zeros(n, np.int64)  # symbols in common with the word before
        if n > 1:
            differ = symbol[1:] != symbol[:-1]
            shared[1:] = np.where(differ.any(1), differ.argmax(1), wide)
        last = np.zeros((wide + 1, n), np.int32)  # state after each prefix
        begin = np.zeros((wide + 1, n), np.int32)  # where its last label begins
        for end in range(1, wide + 1):
            own = (shared < end) & (size >= end)
            mine = np.flatnonzero(own)
            if not len(mine):
                break
            state, start = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
            who, node = np.arange(len(mine)), np.zeros(len(mine), np.int64)
            for at in range(end - 1, -1, -1):
                key = node * SYMBOLS + symbol[mine[who], at]
                k = np.searchsorted(self.edges, key)
                k[k == len(self.edges)] = 0
                on = self.edges[k] == key
                who, node = who[on], self.next[k[on]]
                if not len(who):
                    break
                token = self.ends[node]
                t = np.flatnonzero(token >= 0)
                if at and len(t):
                    t = t[self.step(last[at, mine[who[t]]].astype(np.int64), token[t])]
                state[who[t]], start[who[t]] = token[t], at
            # a word that shares the prefix has it from the first word that spells it
            first = np.maximum.accumulate(np.where(own, rows, 0))
            place = np.zeros(n, np.int64)
            place[mine] = np.arange(len(mine))
            last[end], begin[end] = state[place[first]], start[place[first]]
        path, at = [], size.copy()
        while (live := at > 0).any():
            path.append(np.where(live, last[at, rows], -1))
            at = np.where(live, begin[at, rows], 0)
        flat = np.stack(path[::-1], axis=1) if path else np.zeros((n, 0), np.int64)
        keep = flat >= 0
        ends = np.cumsum(keep.sum(1)).tolist()
        ids = flat[keep].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class WordBpe:
    """The whole tokenizer of ``word_bpe_49k.json``-like files: special tokens,
    normaliser, splitter, automaton, and the label-joining decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.automaton = MergeAutomaton(model["vocab"], model["merges"], suffix)
        self.labels = dict(enumerate(self.automaton.label)) | {i: s for s, i in self.special.items()}
        self.split_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.latin_words = re.compile(LATIN_SPLIT).findall
        self.beyond_latin = re.compile(BEYOND_LATIN).search
        self.symbols = byte_symbols()

    def pieces(self, text: str) -> list[str]:
        """Pre-split words of a text in order; special tokens stay whole."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.split_special.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return unicode_words()(text) if self.beyond_latin(text) else self.latin_words(text)

    def spelled(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece  # printable ASCII stands for itself
        s = self.symbols
        return "".join([s[b] for b in piece.encode("utf-8", "surrogatepass")])

    def ids_of_all(self, pieces):
        """``(piece, ids)`` of distinct pieces."""
        plain = [w for w in pieces if w not in self.special]
        yield from zip(plain, self.automaton.words(map(self.spelled, plain)))
        yield from ((w, [self.special[w]]) for w in pieces if w in self.special)

    def encode(self, text: str | None) -> list[int]:
        pieces = self.pieces(text or "")
        known = dict(self.ids_of_all(set(pieces)))
        return [i for w in pieces for i in known[w]]

    def decode(self, ids) -> str:
        """Emit the arc labels, joined by one space as a tokenizer without decoder does."""
        return " ".join([self.labels[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One automaton per Python worker and vocabulary file."""
    return WordBpe(path)


class WordTable(dict):
    """word -> ``make(ids)``, filled for a batch of texts at a time and kept from task
    to task; emptied when its entries take more than ``TABLE_BYTES``."""

    def __init__(self, path: str, make):
        super().__init__()
        self.bpe, self.make, self.size = load(path), make, 0

    def rows(self, texts: list[str | None], chars: int = 4_000_000):
        """For each text the list of its words' entries; distinct words are encoded
        once for every ``chars`` characters of text at most."""
        pieces, make, entry = self.bpe.pieces, self.make, self.__getitem__
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < chars:
                group.append(pieces(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            if self.size > TABLE_BYTES:
                self.clear()
                self.size = 0
            for w, ids in self.bpe.ids_of_all(set().union(*group).difference(self)):
                made = self[w] = make(ids)
                self.size += 160 + len(w) + self.weight(made)
            for words in group:
                yield list(map(entry, words))

    @staticmethod
    def weight(made) -> int:
        return len(made) if isinstance(made, bytes) else 180 + len(made[1]) + len(made[2])


@functools.lru_cache(maxsize=2)
def _digests(path: str) -> WordTable:
    decode = load(path).decode
    return WordTable(path, lambda ids: (len(ids), " ".join(map(str, ids)), decode(ids)))


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids and decoded text per row: ``(id, ids array<int>, decoded string)``.

    A null text is an empty one (no ids, empty decoded text); a null id stays
    null; repeated rows stay repeated; other columns are not read.
    """

    def run(batches):
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInPandas(
        run, f"id {kind}, ids array<int>, decoded string"
    )


def digest_table(docs: DataFrame, path: str) -> DataFrame:
    """Per document: token count and SHA-256 of the ids and of the decoded text.

    Null text: empty; a null id stays null; repeated rows stay repeated; an empty
    table gives no rows; further columns are not read; a text of any length is one
    row.  No shuffle; each task holds one Arrow batch and a bounded table of words, so
    a lost executor costs its running tasks only.
    """

    @quiet
    def run(batches):
        table, sha = _digests(path), hashlib.sha256
        for b in batches:
            for start, stop in slices(b.column(1)):
                part = b.slice(start, stop - start)
                count, ids_sha, decoded_sha = [], [], []
                for got in table.rows(part.column(1).to_pylist()):
                    count.append(sum([g[0] for g in got]))
                    ids_sha.append(sha(" ".join([g[1] for g in got]).encode()).hexdigest())
                    decoded_sha.append(sha(" ".join([g[2] for g in got]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, DIGEST_SCHEMA)


def vocabulary() -> str:
    """Place of the public vocabulary used by the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return digest_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())

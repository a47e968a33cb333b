"""Quality: nearest-neighbour voting over latent-semantic vectors.

Terms are hashed words, and how a text is written: the shape of each word (case, digits
and signs, runs drawn together), pairs of neighbouring shapes, and words that repeat
their predecessor.  A truncated singular value decomposition of the weighted terms
of all labelled rows gives the projection.  Up to ``MOST`` rows of a label vote
themselves; beyond, so many vectors of them, each the mean direction of the labelled rows
that are nearest to it.  These (under 2 MB) and the projection are broadcast; every
document is compared with all of them, in blocks, by exact cosine products, and its
nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.graph import shelve
from strataq.llm.labelled import HELD_OUT, by_shard, fold, summed, training_rows
from strataq.llm.workers import quiet

SHAPES, PAIRS, WORDS = 2048, 4096, 8192
TERMS = SHAPES + PAIRS + WORDS + 2  # the last two: a repeated word, a new word
WORD_WEIGHT = 0.25  # of the words' terms, which are many, against the others'
MOST = {0: 2000, 1: 2000}  # vectors that vote, by class
TURNS = 3  # of the subspace over the shards
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 4  # power of the similarity in a vote
THRESHOLD = 0.5
BLOCK = 256  # documents compared together
SHAPE_LENGTH = 6  # kinds in one term of a shape; longer shapes are several terms

# Shapes of most words without a look at each character.
_lower, _title = re.compile("[a-z]+").fullmatch, re.compile("[A-Z][a-z]+").fullmatch


def shape(word: str) -> str:
    """'A' upper case, 'a' lower case, '0' digit, 'x' other letters, signs as they
    are; a run of one kind counts once."""
    if _lower(word):
        return "a"
    if _title(word):
        return "Aa"
    out, last = [], ""
    for ch in word:
        c = ch
        if ch.isalpha():
            c = "A" if ch.isupper() else "a" if ch.islower() else "x"
        elif ch.isdigit():
            c = "0"
        if c != last:
            out.append(c)
            last = c
    return "".join(out)


@functools.lru_cache(maxsize=100_000)
def shape_id(form: str) -> int:
    return zlib.crc32(form.encode("utf-8", "surrogatepass")) % SHAPES


LONG = 1 << 40  # marks a word whose shape has further terms


class _Words(dict):
    """word -> number of its shape's first term, plus its own number << 16, plus LONG if
    ``further`` has more terms of its shape; emptied when large."""

    def __init__(self):
        super().__init__()
        self.further: dict[str, list[int]] = {}
        self.chars = 0

    def __missing__(self, w: str) -> int:
        self.chars += len(w) + 150
        if self.chars > 20_000_000:
            self.clear()
            self.further.clear()
            self.chars = len(w) + 150
        form = shape(w)
        out = shape_id(form[:SHAPE_LENGTH]) | SHAPES + PAIRS + zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS << 16
        if len(form) > SHAPE_LENGTH:
            out |= LONG
            self.further[w] = [shape_id(form[k : k + SHAPE_LENGTH]) for k in range(SHAPE_LENGTH, len(form), SHAPE_LENGTH)]
        self[w] = out
        return out

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Shapes and numbers of some words, and further terms of their shapes."""
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        further: list[int] = []
        for k in np.flatnonzero(found & LONG).tolist():
            if words[k] not in self.further:
                self.__missing__(words[k])  # the table was emptied on the way
            further += self.further[words[k]]
        return found & 0xFFFF, found >> 16 & 0xFFFF, further


_words = _Words()


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text and their counts; none for a null or empty text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    ids, own, further = _words.of(words)
    pairs = SHAPES + (ids[:-1] * 31 + ids[1:] * 17) % PAIRS
    repeated = sum(map(str.__eq__, words, words[1:]))
    tally = np.bincount(np.concatenate([ids, pairs, own, np.array(further, np.int64)]), minlength=TERMS).astype(float)
    tally[TERMS - 2], tally[TERMS - 1] = repeated, len(words) - repeated
    terms = np.flatnonzero(tally)
    return terms, tally[terms]


@dataclass
class Neighbours:
    weight: np.ndarray  # per term
    projection: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    prior: float  # share of label 1, the score where nothing is similar

    def project(self, texts) -> np.ndarray:
        """Unit vectors of texts; zero where a text has no known term."""
        out = np.zeros((len(texts), self.projection.shape[1]))
        for i, t in enumerate(texts):
            terms, n = counts(t)
            if len(terms):
                # share of the text, square root, term weight
                out[i] = (np.sqrt(n / n.sum()) * self.weight[terms]) @ self.projection[terms]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)

    def score(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            mine = self.project(texts[at : at + BLOCK])
            near = mine @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(near, top, 1), 0, 1) ** SHARPNESS
            total = w.sum(1)
            votes = (w * self.labels[top]).sum(1)
            out[at : at + BLOCK] = np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0.0, 1.0)


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 3) -> Neighbours:
    """Latent-semantic vectors of the labelled texts by randomised subspace iteration."""
    labels = np.asarray(labels, float)
    n = len(texts)
    rows = [counts(t) for t in texts]
    df = np.zeros(TERMS)
    for terms, _ in rows:
        df[terms] += 1
    weight = np.where(df > 0, np.log((n + 1) / (df + 0.5)) + 0.3, 0.0)
    weight[SHAPES + PAIRS : TERMS - 2] *= WORD_WEIGHT
    rank = max(1, min(RANK, n))
    used = np.flatnonzero(df)
    if not n or not len(used):
        return Neighbours(weight, np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), prior)
    place = np.zeros(TERMS, np.int64)
    place[used] = np.arange(len(used))
    matrix = np.zeros((n, len(used)), np.float32)  # the largest array: 4 bytes a row and term
    for i, (terms, tally) in enumerate(rows):
        if len(terms):
            matrix[i, place[terms]] = np.sqrt(tally / tally.sum()) * weight[terms]
    del rows

    def spanned(x: np.ndarray) -> np.ndarray:
        return np.linalg.qr((matrix.T @ x.astype(np.float32)).astype(float))[0]

    basis = spanned(np.random.default_rng(seed).normal(size=(n, min(rank + 8, n))))
    for _ in range(4):
        basis = spanned(matrix @ basis.astype(np.float32))
    _, _, vt = np.linalg.svd((matrix @ basis.astype(np.float32)).astype(float), full_matrices=False)
    del matrix
    projection = np.zeros((TERMS, min(rank, vt.shape[0])))
    projection[used] = (basis @ vt.T)[:, :rank]
    model = Neighbours(weight, projection, np.zeros((0, 1)), labels, prior)
    model.vectors = model.project(texts)
    return model


def _counted(rows: DataFrame) -> DataFrame:
    """Labelled rows with their terms and counts, packed, in place of their texts."""

    @quiet
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = [counts(t) for t in part.column(2).to_pylist()]
                body = pa.array([terms.astype("<u4").tobytes() + n.astype("<f4").tobytes() for terms, n in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], body, part.column(3)], names=["doc_id", "y", "text", "shard"])

    rows = rows.select("doc_id", "y", "text", "shard")
    schema = rows.select("doc_id", "y").schema.add("text", "binary").add("shard", rows.schema["shard"].dataType)
    return shelve(rows.mapInArrow(run, schema))


def _weighed(body: bytes, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a packed row and their weights in it."""
    k = len(body) // 8
    terms, n = np.frombuffer(body, "<u4", k).astype(np.int64), np.frombuffer(body, "<f4", k, 4 * k).astype(float)
    return terms, np.sqrt(n / n.sum()) * weight[terms] if k else n


def _vectors(bodies: list[bytes], weight: np.ndarray, projection: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bodies), projection.shape[1]))
    for i, body in enumerate(bodies):
        terms, x = _weighed(body, weight)
        out[i] = x @ projection[terms]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)


def _fit_shards(rows: DataFrame, shards: int, prior: float, seed: int = 3) -> Neighbours:
    """What ``train`` does, over shards of any number of labelled rows: sums of their
    products turn the subspace, and every row moves the voting vector next to it."""
    rows = _counted(rows)

    def over(make) -> np.ndarray:
        return summed(by_shard(rows, shards, lambda t: make(t.column("text").to_pylist(), t.column("y").to_numpy())), shards)

    def documents(bodies, y) -> np.ndarray:
        df = np.zeros(TERMS + 1)
        for body in bodies:
            df[np.frombuffer(body, "<u4", len(body) // 8)] += 1
        df[TERMS] = len(bodies)
        return df

    total = over(documents)
    df, n = total[:TERMS], total[TERMS]
    weight = np.where(df > 0, np.log((n + 1) / (df + 0.5)) + 0.3, 0.0)
    weight[SHAPES + PAIRS : TERMS - 2] *= WORD_WEIGHT
    basis = np.random.default_rng(seed).normal(size=(TERMS, RANK + 8))

    def turned(bodies, y) -> np.ndarray:
        out = np.zeros_like(basis)
        for body in bodies:
            terms, x = _weighed(body, weight)
            out[terms] += np.outer(x, x @ basis[terms])
        return out.ravel()

    def products(bodies, y) -> np.ndarray:
        out = np.zeros((basis.shape[1], basis.shape[1]))
        for body in bodies:
            terms, x = _weighed(body, weight)
            mine = x @ basis[terms]
            out += np.outer(mine, mine)
        return out.ravel()

    for _ in range(TURNS):
        basis = np.linalg.qr(over(turned).reshape(basis.shape))[0]
    axes = np.linalg.eigh(over(products).reshape(basis.shape[1], -1))[1][:, ::-1]
    projection = (basis @ axes)[:, :RANK]
    ids = [rows.filter(F.col("y") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for y, k in MOST.items()]
    picks = sorted(rows.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("doc_id", "text", "y").dropDuplicates(["doc_id"]).collect())
    labels, start = np.array([r["y"] for r in picks], float), _vectors([bytes(r["text"]) for r in picks], weight, projection)

    def moved(bodies, y) -> np.ndarray:
        out = np.zeros_like(start)
        for at in range(0, len(bodies), BLOCK):
            mine, own = _vectors(bodies[at : at + BLOCK], weight, projection), y[at : at + BLOCK]
            near = np.where(own[:, None] == labels, mine @ start.T, -2.0).argmax(1)
            np.add.at(out, near, mine)
        return out.ravel()

    vectors = over(moved).reshape(start.shape)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(norm > 1e-9, vectors / np.maximum(norm, 1e-9), start)
    return Neighbours(weight, projection, vectors, labels, prior)


def fit(docs: DataFrame, labels: DataFrame) -> Neighbours:
    """Train on all labelled rows outside the held-out fold; the prior counts all
    training labels."""
    rows, shards = training_rows(docs, labels, "quality")
    share = labels.filter((fold() != HELD_OUT) & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    prior = 0.5 if share is None else float(share)
    many = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if shards > 1 or any(many.get(y, 0) > k for y, k in MOST.items()):
        return _fit_shards(rows, shards, prior)
    all_rows = sorted(rows.select("doc_id", "text", "y").collect())
    return train([r["text"] for r in all_rows], np.array([r["y"] for r in all_rows]), prior)


def score_table(docs: DataFrame, model: Neighbours, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns, score and predicted (1 at THRESHOLD or more).

    Null and empty texts, like any text without a known term, get the share of label
    1 among the training labels; repeated rows stay repeated; an empty table gives
    no rows; other columns are left alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = rows.select(*keep).schema.add("score", "double").add("predicted", "integer")

    @quiet
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = shared.value.score(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                    names=[*keep, "score", "predicted"],
                )

    return rows.mapInArrow(run, schema)


def good(docs: DataFrame, model: Neighbours) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, with all their columns.

    Null and empty texts, and texts without a known term, score the share of label 1
    among the training labels, and stay if that is THRESHOLD or more.  Null ids, repeated
    rows and further columns pass as they are; an empty table gives no rows."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    @quiet
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield part.filter(pa.array(shared.value.score(part.column(text).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_table(docs, fit(docs, labels)).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", "predicted")

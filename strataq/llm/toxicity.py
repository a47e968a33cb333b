"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and its first characters; filters
of several widths run over the words of the whole text, the maximum over all
positions is kept for each filter, and a logistic layer makes the score.  Training
takes all labelled rows: every shard of them goes on from the same model in a task of
its own, and the shards' models are averaged by rows, some rounds long.  The model is
a few MB, whatever the corpus, and is broadcast.  Scores don't see labels, lang, source
or ids; a threshold for each language is calibrated on every fifth labelled row, by a
hash of the id, and reported beside the score; the other four train.
"""

from __future__ import annotations

import copy
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.labelled import HELD_OUT, by_shard, fold, summed, training_rows
from strataq.llm.workers import quiet

BUCKETS = 1 << 15
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 8
PREFIXES = (4, 5, 6)
FEATURES = 1 + len(PREFIXES)
EPOCHS, BATCH, RATE = 6, 64, 0.05
ROUNDS, PASSES = 2, 2  # averages of several shards, and passes over a shard before each
LIMITS = np.round(np.arange(0.5, 0.91, 0.05), 2)  # thresholds that a language may have
THRESHOLD = 0.7
CHUNK_CHARS = 2_000_000  # characters scored together

words_of = re.compile(r"\w+").findall


def word_features(words) -> np.ndarray:
    """Bucket ids of each word and of its prefixes; bucket 0 pads."""
    crc, out = zlib.crc32, []
    for w in words:
        out.append(crc(w.encode("utf-8", "surrogatepass")))
        for n in PREFIXES:
            out.append(crc(("^" + w[:n]).encode("utf-8", "surrogatepass")) if len(w) > n else 0)
    ids = np.array(out, np.int64).reshape(-1, FEATURES)
    return np.where(ids == 0, 0, ids % (BUCKETS - 1) + 1).astype(np.int32)


def index_texts(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of distinct words, word number of each position, first position of
    each text).  Row 0 of the features is padding; each text ends with as many pads
    as the widest filter has words."""
    known: dict[str, int] = {}
    put, pad = known.setdefault, [0] * max(WIDTHS)
    flat, starts = [], []
    for t in texts:
        starts.append(len(flat))
        flat += [put(w, len(known) + 1) for w in words_of((t or "").lower())]
        flat += pad
    features = np.vstack([np.zeros((1, FEATURES), np.int32), word_features(known)]) if known else np.zeros((1, FEATURES), np.int32)
    return features, np.array(flat, np.int32), np.array(starts, np.int64)


@dataclass
class Cnn:
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, features, flat, starts, arg=False):
        """Largest response of every filter over each text, and where it was."""
        vectors = self.embed[features].sum(1)
        ends = np.append(starts[1:], len(flat))
        best, where = [], []
        for w in WIDTHS:
            n = len(flat) - w + 1
            total = None
            for k in range(w):
                part = (vectors @ self.filters[w][k])[flat[k : n + k]]
                total = part if total is None else total + part
            for k in range(1, w):  # a window must not reach into the next text
                over = ends - k
                total[over[over < n]] = -np.inf
            best.append(np.maximum.reduceat(total, starts, axis=0))
            if arg:
                where.append(np.stack([total[s : min(e, n)].argmax(0) + s for s, e in zip(starts, ends)]))
        return np.hstack(best), (np.hstack(where) if arg else None)

    def score(self, texts) -> np.ndarray:
        """Probability of label 1 of each text; null and empty texts see pads alone."""
        scores, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < CHUNK_CHARS:
                size += len(texts[end] or "")
                end += 1
            best, _ = self.pooled(*index_texts(texts[at:end]))
            z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
            scores[at:end] = 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))
            at = end
        return scores


def arrays(model: Cnn) -> list[np.ndarray]:
    return [model.embed, *[model.filters[w] for w in WIDTHS], model.bias, model.out]


def packed(model: Cnn) -> np.ndarray:
    """All parameters in one row of numbers."""
    return np.concatenate([*[a.ravel() for a in arrays(model)], [model.out_bias]]).astype(np.float64)


def unpacked(model: Cnn, numbers: np.ndarray) -> None:
    """Put parameters back that ``packed`` has laid out."""
    at = 0
    for a in arrays(model):
        a[...] = numbers[at : at + a.size].reshape(a.shape)
        at += a.size
    model.out_bias = float(numbers[at])


def seen_in(texts, labels) -> np.ndarray:
    """Texts of each label (row) that have each bucket (column)."""
    seen = np.zeros((2, BUCKETS))
    for at in range(0, len(texts), 1024):
        features, flat, starts = index_texts(texts[at : at + 1024])
        for s, e, y in zip(starts, np.append(starts[1:], len(flat)), labels[at : at + 1024]):
            seen[int(y), np.unique(features[np.unique(flat[s:e])])] += 1
    return seen


def initial(seen: np.ndarray, totals: np.ndarray, rng) -> Cnn:
    """The model before training on so many rows of label 0 and 1: the first embedding
    component starts at a feature's log odds, read by one filter of width 1; all else
    starts small.  Without rows of both labels it scores the share of label 1."""
    n_filters = FILTERS * len(WIDTHS)
    embed = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    embed[0] = 0
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    model = Cnn(embed, filters, np.zeros(n_filters, np.float32), rng.normal(0, 0.1, n_filters).astype(np.float32), 0.0)
    if not totals.all():
        model.out[:] = 0
        model.out_bias = float(2 * (totals[1] / totals.sum() if totals.any() else 0.5) - 1)
        return model
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    odds[seen.sum(0) == 0] = 0
    odds[0] = 0
    embed[:, 0] = np.clip(odds / 3, 0, 2)
    filters[1][0][:, 0] = 0
    filters[1][0][0, 0] = 1.0
    model.out[0], model.bias[0], model.out_bias = 2.0, -0.7, -1.0
    return model


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Cnn:
    """A model of rows that are all here."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()])
    model = initial(seen_in(texts, labels), totals, rng)
    return descend(model, texts, labels, totals, max(EPOCHS, min(40, 6000 // max(1, len(texts)))), rng) if totals.all() else model


def descend(model: Cnn, texts: list[str], labels: np.ndarray, totals: np.ndarray, epochs: int, rng) -> Cnn:
    """Adagrad on the logistic loss, weighted so that the two labels' ``totals`` weigh
    the same; the model's own arrays change."""
    n_filters, filters = FILTERS * len(WIDTHS), model.filters
    features, flat, starts = index_texts(texts)
    ends = np.append(starts[1:], len(flat))
    weight = (totals.sum() / 2 / totals)[labels.astype(int)].astype(np.float32)
    memory = {"embed": np.full(model.embed.shape, 1e-2, np.float32), "out": np.full(n_filters, 1e-2), "bias": np.full(n_filters, 1e-2), "ob": 1e-2}
    memory |= {w: np.full(filters[w].shape, 1e-2, np.float32) for w in WIDTHS}
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            docs = order[b : b + BATCH]
            part = np.concatenate([flat[starts[i] : ends[i]] for i in docs])
            sizes = ends[docs] - starts[docs]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            words, local = np.unique(part, return_inverse=True)
            local = local.astype(np.int32)
            best, where = model.pooled(features[words], local, first, arg=True)
            act = np.maximum(best + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.out_bias, -30, 30)))
            g = (p - labels[docs]) * weight[docs] / len(docs)
            g_act = g[:, None] * model.out * (act > 0)
            steps = {"out": act.T @ g, "bias": g_act.sum(0), "ob": g.sum()}
            vectors = model.embed[features[words]].sum(1)
            g_vec: dict = {}
            rows, grads = [], []
            for x, w in enumerate(WIDTHS):
                cols = slice(x * FILTERS, (x + 1) * FILTERS)
                gw = np.zeros_like(filters[w])
                for k in range(w):
                    at = local[np.minimum(where[:, cols] + k, len(local) - 1)]  # (docs, filters)
                    gw[k] = np.einsum("df,dfe->ef", g_act[:, cols], vectors[at])
                    rows.append(words[at].ravel())
                    grads.append((g_act[:, cols, None] * filters[w][k].T[None]).reshape(-1, DIM))
                steps[w] = gw
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            on = np.abs(grads).sum(1) > 0
            buckets = features[rows[on]]
            uniq, inv = np.unique(buckets.ravel(), return_inverse=True)
            g_embed = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(g_embed, inv, np.repeat(grads[on], FEATURES, axis=0))
            g_embed[uniq == 0] = 0
            memory["embed"][uniq] += g_embed**2
            model.embed[uniq] -= RATE * g_embed / np.sqrt(memory["embed"][uniq])
            for w in WIDTHS:
                memory[w] += steps[w] ** 2
                filters[w] -= RATE * steps[w] / np.sqrt(memory[w])
            for name, array in (("out", model.out), ("bias", model.bias)):
                memory[name] += steps[name] ** 2
                array -= RATE * (steps[name] / np.sqrt(memory[name])).astype(np.float32)
            memory["ob"] += steps["ob"] ** 2
            model.out_bias -= float(RATE * steps["ob"] / np.sqrt(memory["ob"]))
    return model


def calibrate(counts: list[tuple]) -> dict[str, float]:
    """For each language the threshold of LIMITS with the best F1, nearest to THRESHOLD
    among equals; under ten rows of label 1, none.  ``counts``: (lang, label, number of
    LIMITS that the score reaches, rows)."""
    out: dict[str, float] = {}
    for lang in sorted({x[0] for x in counts if x[0] is not None}):
        tally = np.zeros((2, len(LIMITS) + 1), np.int64)
        for other, y, reached, n in counts:
            if other == lang:
                tally[y, reached] += n
        if tally[1].sum() < 10:
            continue
        above = tally[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # rows at each threshold or more
        f1 = np.round(2 * above[1] / np.maximum(1, above.sum(0) + tally[1].sum()), 6)
        out[lang] = float(max(zip(f1, LIMITS), key=lambda x: (x[0], -abs(x[1] - THRESHOLD)))[1])
    return out


def _reached(rows: DataFrame, model: Cnn) -> list[tuple]:
    """(lang, label, number of LIMITS that the score reaches, rows) of labelled rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @quiet
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = shared.value.score(part.column(0).to_pylist())
                reached = (s[:, None] >= LIMITS).sum(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(reached)], names=["lang", "y", "reached"])

    scored = rows.select("text", F.col("lang").cast("string").alias("lang"), "y").mapInArrow(run, "lang string, y int, reached int")
    return [tuple(r) for r in scored.groupBy("lang", "y", "reached").count().collect()]


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Cnn:
    """Train on all labelled rows outside the held-out fold but every fifth, which
    calibrate.  What fits one shard is trained on at once, as ``train`` does."""
    extra = ["lang"] if "lang" in docs.columns else []
    rows, shards = training_rows(docs, labels, "toxic", extra)
    check = F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(5)) == 4
    learn = rows.filter(~check)
    count = {r["y"]: r["count"] for r in learn.groupBy("y").count().collect()}
    totals = np.array([count.get(0, 0), count.get(1, 0)])
    rng = np.random.default_rng(seed)
    if not totals.all():
        return initial(np.zeros((2, BUCKETS)), totals, rng)

    def both(table) -> tuple[list[str], np.ndarray]:
        return table.column("text").to_pylist(), table.column("y").to_numpy()

    seen = summed(by_shard(learn, shards, lambda t: seen_in(*both(t)).ravel()), shards)
    model = initial(seen.reshape(2, BUCKETS), totals, rng)
    for k in range(ROUNDS if shards > 1 else 1):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        epochs = PASSES if shards > 1 else max(EPOCHS, min(40, 6000 // int(totals.sum())))

        def trained(table) -> np.ndarray:
            texts, y = both(table)
            mine = copy.deepcopy(shared.value)
            descend(mine, texts, y, totals, epochs, np.random.default_rng(seed + k))
            return np.append(packed(mine), 1.0) * len(texts)

        total = summed(by_shard(learn, shards, trained), shards)
        model = copy.deepcopy(model)
        unpacked(model, total[:-1] / total[-1])
    if extra:
        model.thresholds = calibrate(_reached(rows.filter(check), model))
    return model


def score_table(docs: DataFrame, model: Cnn, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns, score, predicted (at THRESHOLD), and the threshold of the
    row's language with the decision at it.

    Null and empty texts get the score of a text without words; rows of a null or
    unknown language the threshold THRESHOLD; repeated rows stay repeated; an empty
    table gives no rows; other columns are left alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"), lang.alias("__lang"))
    schema = rows.select(*keep).schema.add("score", "double").add("predicted", "integer").add("lang_threshold", "double").add("rejected", "boolean")

    @quiet
    def run(batches):
        import pyarrow as pa

        cnn = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = cnn.score(part.column(len(keep)).to_pylist())
                limit = np.array([cnn.thresholds.get(x, THRESHOLD) for x in part.column(len(keep) + 1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(limit), pa.array(s >= limit)],
                    names=[*keep, "score", "predicted", "lang_threshold", "rejected"],
                )

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Cnn) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject at the threshold of
    their language, with all their columns; a score at the threshold is rejected.

    Null and empty texts score as a text without words; a null or unknown language, or no
    such column, has the threshold THRESHOLD.  Null ids, repeated rows and further
    columns pass as they are; an empty table gives no rows."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    @quiet
    def run(batches):
        cnn = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                limit = THRESHOLD
                if lang is not None:
                    limit = np.array([cnn.thresholds.get(x, THRESHOLD) for x in part.column(lang).to_pylist()])
                yield part.filter(pa.array(cnn.score(part.column(text).to_pylist()) < limit))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_table(docs, fit(docs, labels))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", "predicted", "lang_threshold", "rejected")

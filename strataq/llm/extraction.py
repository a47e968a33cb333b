"""Main-text extraction with a tree-structured graphical model.

Every element and every text of a page is a variable that is 1 if it is, or holds,
main text.  Node potentials are log-linear in features of the node (tags, words of
class, id and role, text and link density, place); edge potentials are a table for
parent and child.  The graph is the DOM tree, so sum-product message passing, once
upward and once downward, yields exact marginals; a text with a marginal above one
half is kept.  The weights are trained on labelled pages by gradient ascent on the
likelihood, whose gradient is observed minus expected counts, with the same messages.

The model is a few hundred numbers and is trained on the driver from labelled pages
(made by rule, ``pages_made``); pages are scored where they are read.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import pages_made
from strataq.llm.dom import Page
from strataq.llm.workers import quiet

FEATURES = 1 << 14
TRAINING_PAGES = 600
EPOCHS = 8
RATE = 0.15
DECAY = 1e-4

LANDMARKS = {t: 1 << i for i, t in enumerate(("article", "main", "nav", "footer", "header", "aside", "form"))}

_split = re.compile(r"[^a-z0-9]+").split


@functools.lru_cache(maxsize=200_000)
def element_features(tag: str, names: str, parent: str, over: int, above: str) -> tuple[int, ...]:
    """Buckets of an element's tag, its parent's tag and names, its own names, and
    the landmarks it stands under (``over``: bits by LANDMARKS)."""
    out = [f"t:{tag}", f"t:{parent}>{tag}", f"o:{over}", f"ot:{over},{tag}"]
    out += [f"p:{w}" for name in above.replace("data-drop", "").split() for w in _split(name) if w]
    for name in names.replace("data-drop", "").split():
        out.append(f"n:{name}")
        out += [f"w:{w}" for w in _split(name) if w]
    return tuple(sorted({zlib.crc32(x.encode()) % FEATURES for x in out}))


@functools.lru_cache(maxsize=50_000)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def features(page: Page) -> list[tuple[int, ...]]:
    """Active features of each node."""
    tag, names, parent, text = page.tag, page.names, page.parent, page.text
    n = len(tag)
    chars, linked, ends, in_link, over = [0] * n, [0] * n, [0] * n, [False] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        in_link[i] = in_link[p] or tag[i] == "a"
        over[i] = over[p] | LANDMARKS.get(tag[p], 0)
        if not tag[i]:
            chars[i] = len(text[i])
            linked[i] = chars[i] if in_link[i] else 0
            ends[i] = sum(map(text[i].count, ".!?"))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
    out: list[tuple[int, ...]] = [()]
    for i in range(1, n):
        size = min(9, int(math.log2(chars[i] + 1)))
        share = int(4 * linked[i] / chars[i]) if chars[i] else 5
        stops = min(3, ends[i])
        kind = tag[i] or "#"
        if tag[i]:
            more = (_bucket(f"s:{size}"), _bucket(f"l:{share}"), _bucket(f"e:{stops}"), _bucket(f"sl:{size // 2},{share},{stops > 0}"))
            out.append(element_features(tag[i], names[i], tag[parent[i]], over[i], names[parent[i]]) + more)
        else:
            out.append((_bucket(f"x:{tag[parent[i]]}"), _bucket(f"xs:{size},{stops > 0}"), _bucket(f"xl:{in_link[i]},{size // 2}"), _bucket(kind)))
    return out


def marginals(parent: list[int], unary: list[float], edge: tuple[float, float, float, float]):
    """P(node = 1), and for each node P(parent = a, node = b) at 2a + b.

    ``unary`` is the log potential of 1 against 0.  Upward messages are kept as the
    log ratio of a subtree's evidence for its parent's states."""
    n = len(parent)
    e = [math.exp(x) for x in edge]
    up = list(unary)  # log ratio of the evidence in the subtree, state 1 against 0
    message = [0.0] * n  # to the parent: log of (value at 1 / value at 0)
    odds = [0.0] * n
    exp, log = math.exp, math.log
    for i in range(n - 1, 0, -1):
        o = odds[i] = exp(min(60.0, max(-60.0, up[i])))
        message[i] = log((e[2] + e[3] * o) / (e[0] + e[1] * o))
        up[parent[i]] += message[i]
    top = exp(min(60.0, max(-60.0, up[0])))
    p = [0.0] * n
    p[0] = top / (1 + top)
    both: list[tuple] = [()] * n
    for i in range(1, n):
        # downward: the parent's belief times the child's conditional given it, which
        # depends on the subtree of the child alone
        q, o = p[parent[i]], odds[i]
        given0 = e[1] * o / (e[0] + e[1] * o)
        given1 = e[3] * o / (e[2] + e[3] * o)
        p[i] = (1 - q) * given0 + q * given1
        both[i] = ((1 - q) * (1 - given0), (1 - q) * given0, q * (1 - given1), q * given1)
    return p, both


class Model:
    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def keep(self, page: Page) -> list[float]:
        w = self.weights
        unary = [math.fsum(w[k] for k in f) for f in features(page)]
        return marginals(page.parent, unary, tuple(self.edge))[0]

    def text(self, source: str | None) -> str:
        """Main text of a page; empty for a null, empty or textless page."""
        page = Page(source)
        p = self.keep(page)
        blocks: list[list[str]] = []
        last = None
        for i in range(1, len(p)):
            if page.tag[i]:
                continue
            if page.text[i] == " ":
                if last == page.block[i]:
                    blocks[-1].append(" ")
                continue
            if p[i] <= 0.5:
                last = None
                continue
            if last != page.block[i]:
                blocks.append([])
                last = page.block[i]
            blocks[-1].append(page.text[i])
        return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Adagrad on the log likelihood of labelled pages."""
    w, edge = np.zeros(FEATURES), np.array([1.0, -1.0, 0.0, 0.0])
    w_memory, e_memory = np.full(FEATURES, 1e-2), np.full(4, 1e-2)
    ready = []
    for source in pages:
        page = Page(source, labelled=True)
        ready.append((page.parent, features(page), page.labels()))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(ready)):
            parent, active, label = ready[k]
            values = w.tolist() if len(parent) > 400 else w
            p, both = marginals(parent, [math.fsum(values[f] for f in a) for a in active], tuple(edge))
            at, step, e_step = [], [], np.zeros(4)
            for i in range(1, len(parent)):
                g = label[i] - p[i]
                at += active[i]
                step += [g] * len(active[i])
                e_step[2 * label[parent[i]] + label[i]] += 1
                e_step -= both[i]
            at, inverse = np.unique(np.array(at), return_inverse=True)
            g = np.bincount(inverse, np.array(step)) - DECAY * w[at]
            w_memory[at] += g * g
            w[at] += RATE * g / np.sqrt(w_memory[at])
            e_memory += e_step**2
            edge += RATE * e_step / np.sqrt(e_memory)
    return Model(w, edge)


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    """Trained on TRAINING_PAGES pages made by rule; the same on every run."""
    return train([pages_made.page(i) for i in range(TRAINING_PAGES)])


def extract(pages: DataFrame, model: Model, keep: list[str] = ["page_id", "url"], html_col: str = "html") -> DataFrame:
    """``keep`` columns, text and n_chars of every row.

    Null, empty and textless pages: an empty text of 0 characters.  Null ids and
    urls stay; repeated rows stay repeated; an empty table gives no rows; other
    columns are left alone.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = rows.select(*keep).schema.add("text", "string").add("n_chars", "long")

    @quiet
    def run(batches):
        m = Model(shared.value.weights.tolist(), shared.value.edge)
        for b in batches:
            texts = [m.text(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return rows.mapInArrow(run, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_model())

"""Substring dedup: passages of 50 words that start in an earlier document go.

Count-min prefilter: every window has an anchor, the smallest hash among the 8-word
grams inside it; equal windows have equal anchors, and an anchor is counted once per
document, so its count overestimates in how many documents a window occurs, at a
twentieth of the keys.  A task's sketch is the cells its anchors touch, of a row of
``ranges * 2**32`` cells, with a mark for two documents in one cell; the owner of a
range of cells merges the sketches of all tasks (``ranges``) and tells each document
which of its anchors may be in another one.  Cells grow in number with the corpus and
a collision only lets more through.

The second pass exactly groups only the windows of such anchors; none that repeats is
lost.  Windows are compared by some 100 bits of two independent hashes.  A window goes
to its owner once for each batch of a task, whatever the number of documents that
repeat it: all but the smallest id of a batch are known at once to be later ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.ranges import SENT, Sender, answered, named_by, ranges_for, unpacked
from strataq.llm.wordbatch import Words, mix, slices, sliding_min, windows
from strataq.llm.workers import quiet

WINDOW, GRAM = 50, 8
WORD_CHARS = 6.5  # characters of a word with its space, about
PER_WORD = 2 / 44  # about 2 in 44 grams are some window's anchor


def _second(words: Words | np.ndarray) -> np.ndarray:
    """A hash of every window that is independent of the first one."""
    values = words.values if isinstance(words, Words) else words
    return windows(mix(values ^ np.uint64(0xA0761D6478BD642F)), WINDOW)


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with one anchor: (first window, text, anchor),
    with a last run of text -1 where the windows end."""
    owner = words.owner(WINDOW)
    if not len(owner):
        return np.zeros(1, np.int64), np.full(1, -1), np.zeros(1, np.uint64)
    anchor = sliding_min(mix(windows(words.values, GRAM)), WINDOW - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    return np.append(first, len(owner)), np.append(owner[first], -1), np.append(anchor[first], np.uint64(0))


def _anchor_answers(named: DataFrame, ranges: int) -> DataFrame:
    """(item, names) of documents: their anchors that may be in another document."""

    @quiet
    def run(batches):
        mine = Sender(ranges)
        for b in batches:
            for start, stop in slices(b.column(1)):
                _, owner, anchor = _anchors(Words(b.column(1)[start:stop]))
                own = owner >= 0
                mine.add(b.column(0)[start:stop].to_numpy()[owner[own]], anchor[own])
                if mine.full():
                    yield mine.batch()
        if mine.size:
            yield mine.batch()

    return answered(named.mapInArrow(run, SENT), ranges)


def _later(rows: DataFrame) -> DataFrame:
    """(doc_id, hs): packed hashes of the windows of a document that start in an
    earlier one."""
    named = rows.filter("doc_id IS NOT NULL")
    spark = rows.sparkSession
    n_words = (named.agg(F.sum(F.length("text"))).first()[0] or 0) / WORD_CHARS
    cells, owners = ranges_for(n_words * PER_WORD, spark), ranges_for(n_words, spark)
    suspects = _anchor_answers(named, cells).withColumnRenamed("item", "doc_id")

    @quiet
    def run(batches):
        mine = Sender(owners, strong=True)
        for b in batches:
            for start, stop in slices(b.column(1)):
                words = Words(b.column(1)[start:stop])
                first, owner, anchor = _anchors(words)
                listed = [unpacked(x) for x in b.column(2)[start:stop].to_pylist()]
                known = np.concatenate(listed), np.repeat(np.arange(len(listed), dtype=np.uint64), [len(x) for x in listed])
                on = (owner >= 0) & np.isin(mix(named_by(anchor, cells) + mix(owner.astype(np.uint64))), mix(known[0] + mix(known[1])))
                length = np.diff(first, append=first[-1])
                place = np.flatnonzero(np.repeat(on, length))
                if len(place):
                    ids = b.column(0)[start:stop].to_numpy()[np.repeat(owner, length)[place]]
                    mine.add(ids, windows(words.values, WINDOW)[place], _second(words)[place])
                    if mine.full():
                        yield mine.batch()
        if mine.size:
            yield mine.batch()

    sent = named.join(suspects, "doc_id").select("doc_id", "text", "names").mapInArrow(run, SENT)
    return answered(sent, owners, strong=True, later=True).toDF("doc_id", "hs")


def _without(texts: pa.Array, hs: pa.Array):
    """(words, removed words, kept words joined by a space) of every text."""
    for start, stop in slices(texts):
        words = Words(texts[start:stop])
        n = np.diff(words.edges)
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(words.edges.astype(np.int32)), words.flat), " ").to_pylist()
        gone = np.zeros(len(n), np.int64)
        mine = hs[start:stop]
        for i in np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False) & (n >= WINDOW)).tolist():
            values = words.values[words.edges[i] : words.edges[i + 1]]
            hit = np.isin(_second(values), unpacked(mine[i].as_py()))
            edge = np.zeros(len(values) + 1, np.int32)
            edge[: len(hit)] += hit
            edge[WINDOW : WINDOW + len(hit)] -= hit
            stays = np.cumsum(edge[:-1]) == 0
            gone[i] = len(values) - stays.sum()
            kept[i] = " ".join(words.of(i).filter(pa.array(stays)).to_pylist())
        yield from zip(n.tolist(), gone.tolist(), kept)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _with_later(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """``frame`` with ``hs`` by doc_id; rows of a null id stay out of the join, where
    they would meet in one task."""
    met = frame.filter("doc_id IS NOT NULL").join(_later(rows), "doc_id", "left")
    return met.unionByName(frame.filter("doc_id IS NULL").withColumn("hs", F.lit(None).cast("binary")))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words.

    Null text: no words.  Fewer than 50 words: nothing is removed.  A null id is
    smaller than none and larger than none: such rows are kept whole and remove
    nothing.  Rows that share an id are one document for the comparison and stay
    separate rows; an empty table gives no rows; further columns are not read.
    """
    rows = _rows(docs)

    @quiet
    def run(batches):
        for b in batches:
            n, gone, kept = (list(x) for x in zip(*_without(b.column(1), b.column(2)))) if b.num_rows else ([], [], [])
            shas = [hashlib.sha256(k.encode()).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    both = _with_later(rows, rows).select("doc_id", "text", "hs")
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages: texts that lose words are their kept
    words joined by one space, other texts stay as they are; ``n_chars``, if there,
    follows the text.  No row goes: a text that loses all its words becomes empty.
    Null and empty texts, null ids, repeated rows and ids, texts under 50 words and an
    empty table as in ``dedup``; columns of any name pass through."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

    @quiet
    def run(batches):
        for b in batches:
            columns = b.column(0).flatten()
            before = columns[at].to_pylist()
            after = [k if gone else t for t, (_, gone, k) in zip(before, _without(columns[at], b.column(1)))]
            columns[at] = pa.array(after, pa.string())
            if size is not None:
                columns[size] = pa.array([o if t is s else len(t) for o, s, t in zip(columns[size].to_pylist(), before, after)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_later(rows, _rows(docs)).select("row", "hs").mapInArrow(run, docs.schema)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of every whole text of ``documents``."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_sql() -> str:
    """The same in DuckDB SQL, comparing every window as a string."""
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
h AS (SELECT doc_id, i, md5(array_to_string(words[i : i + {WINDOW - 1}], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
g AS (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM h JOIN f USING (h) WHERE first < doc_id),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, w.words, CASE WHEN gone IS NULL THEN w.words
        ELSE list_filter(w.words, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(kept) AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""

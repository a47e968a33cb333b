"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a weighted set: its terms are pairs of neighbouring words (the last
word stands alone) and a term's weight is its count.  For sample ``j`` a term ``k``
of weight ``w`` draws from a hash of ``(k, j)``

    r, c ~ Gamma(2, 1),  b ~ Uniform(0, 1)
    t = floor(ln w / r + b),   ln a = ln c - r * (t - b + 1)

and the sample is the smallest ``ln a`` of the document, a value that is settled by
the winning ``(k, t)``.  Two documents share a sample with the probability of their
generalised Jaccard similarity.  ``r`` and ``ln c`` are read from small quantile
tables made from the Gamma(2, 1) distribution function, that of ``ln c`` fine where
it decides, at the low end, so that no logarithm is taken per term and sample.

The successor of a document by ascending id comes from ranges of ids: ranges are
dealt to tasks whole, each with a copy of the next range's first document behind
its last row, so one shuffle of the texts serves everything that follows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = 32
R_CELLS, OCTAVES, PARTS = 16, 25, 8
RANGE_ROWS = 256  # documents in a range of ids
MOST_RANGES = 16_384  # literal starts of ranges in the plan; ranges grow beyond
TASK_ROWS = 2_000  # documents in a task
MOST_TASKS = 50_000
NULL_KEY = -(2**63)
SPACE = r"[\\x20\\x09-\\x0D]+"


def gamma2_quantiles(p: np.ndarray) -> np.ndarray:
    """Inverse of ``1 - (1 + x) exp(-x)`` by bisection on ln x."""
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 5.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        x = np.exp(mid)
        below = np.where(x < 1e-4, x * x / 2 - x**3 / 3, 1 - (1 + x) * np.exp(-x)) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.exp((lo + hi) / 2)


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """r at the middle of R_CELLS equal shares; ln c at the middle of PARTS parts of
    each octave of its distribution function, the highest octave first."""
    r = gamma2_quantiles((np.arange(R_CELLS) + 0.5) / R_CELLS)
    octave = 0.5 ** np.arange(1, OCTAVES + 1)
    c = gamma2_quantiles(np.ravel(octave[:, None] * (1 + (np.arange(PARTS) + 0.5) / PARTS)))
    return r.round(5), np.log(c).round(5)


def _sample(j: int, literals, h: str = "h", ln_w: str = "ln_w"):
    """``ln a`` of sample ``j``; null for a null term.  ``literals``: the tables.

    Two samples share a 64-bit hash, 32 bits each: 12 for the octave of c (trailing
    zeros, going on in the other half's 12), 3 for its part, 4 for r, 13 for b.
    """
    r_table, c_table = literals
    x = F.xxhash64(F.col(h), F.lit(j // 2))
    at = 32 * (j % 2)

    def bits(first: int, mask: int):
        return (F.shiftright(x, first) if first else x).bitwiseAND(mask)

    y = bits(at, 4095).bitwiseOR(F.shiftleft(bits(32 - at, 4095), 12)).bitwiseOR(1 << (OCTAVES - 1))
    octave = F.bit_count(y.bitwiseAND(-y) - 1)
    ln_c = F.get(c_table, octave * PARTS + bits(at + 12, PARTS - 1).cast("int"))
    r = F.get(r_table, bits(at + 15, R_CELLS - 1).cast("int"))
    b = (bits(at + 19, 8191).cast("double") + 0.5) / 8192.0
    # a weight of 1 has ln w = 0, hence t = 0
    t = F.when(F.col(ln_w) == 0, F.lit(0.0)).otherwise(F.floor(F.col(ln_w) / r + b).cast("double"))
    return F.when(F.col(h).isNotNull(), ln_c - r * (t - b + 1.0))


def range_of(key, starts: list[int]):
    """Position of the last of the ascending ``starts`` that is not above ``key``,
    by two searches among about sqrt(len(starts)) values."""
    step = max(1, math.isqrt(len(starts)))
    groups = [np.array(starts[i : i + step], np.int64) for i in range(0, len(starts), step)]
    # the number of firsts of groups not above the key, then the place in that group
    coarse = F.greatest(F.size(F.filter(F.lit(np.array([g[0] for g in groups])), lambda s: s <= key)), F.lit(1)) - 1
    fine = F.get(F.array(*[F.lit(g) for g in groups]), coarse)
    return (coarse * step + F.greatest(F.size(F.filter(fine, lambda s: s <= key)), F.lit(1)) - 1).cast("int")


def _starts(rows: DataFrame, n: int) -> list[int]:
    """First key of each range that holds rows; at most MOST_RANGES numbers."""
    wanted = min(MOST_RANGES, max(1, n // RANGE_ROWS))
    if wanted == 1:
        first = rows.agg(F.min("key")).first()[0]
        return [] if first is None else [first]
    marks = rows.agg(
        F.percentile_approx("key", [i / wanted for i in range(wanted)], 10 * wanted).alias("m")
    ).first()["m"]
    marks = sorted(set(marks))
    found = rows.groupBy(range_of(F.col("key"), marks).alias("r")).agg(F.min("key").alias("k")).collect()
    return sorted(x["k"] for x in found)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness.

    Null text: empty.  Empty texts have the fingerprint of no term, alike to each
    other (1.0) and to nothing else (0.0).  Null ids come first in the order; rows
    of one id are ordered by text; repeated rows give a row each; an empty table
    gives no rows; a lone document is its own successor; further columns are not
    read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    n = rows.count()
    starts = _starts(rows.select("key"), n) or [0]
    tasks = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // TASK_ROWS))
    at = range_of(F.col("key"), starts)
    firsts = (
        rows.filter(F.col("key").isin(starts))
        .groupBy("key")
        .agg(F.min("text").alias("text"))
        .select(F.pmod(range_of(F.col("key"), starts) - 1, F.lit(len(starts))).cast("int").alias("part"), F.lit(True).alias("extra"), "key", "text")
    )
    dealt = rows.select(at.alias("part"), F.lit(False).alias("extra"), "key", "text").unionByName(firsts).repartition(tasks, "part")
    order = Window.partitionBy("part").orderBy("extra", "key", "text")
    n_chars = F.length("text")
    cut = (F.floor(n_chars / 4)).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n_chars - cut), F.substring(F.col("next_text"), F.lit(1), cut)
    )
    placed = (
        dealt.withColumn("rn", F.row_number().over(order))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("edited", F.when(~F.col("extra"), edited))
    )
    about = placed.filter(~F.col("extra")).select(
        "part",
        "rn",
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"),
        n_chars.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
    )
    texts = placed.selectExpr(
        "part",
        "rn",
        "explode(if(extra, array(named_struct('v', 0, 'body', text)), array(named_struct('v', 0, 'body', text), named_struct('v', 1, 'body', edited)))) AS e",
    ).selectExpr("part", "rn", "e.v AS v", f"split(e.body, '{SPACE}') AS w")
    terms = texts.selectExpr("part", "rn", "v", "inline(arrays_zip(w, slice(w, 2, size(w)))) AS (a, b)").selectExpr(
        "part", "rn", "v", "if(a = '', null, xxhash64(a, nullif(b, ''))) AS h"
    )
    counted = terms.groupBy("part", "rn", "v", "h").agg(F.count("*").alias("n"))
    weighed = counted.select("part", "rn", "v", "h", F.when(F.col("h").isNotNull(), F.log(F.col("n").cast("double"))).alias("ln_w"))
    literals = [F.lit(t) for t in tables()]
    signed = weighed.groupBy("part", "rn", "v").agg(*[F.min(_sample(j, literals)).alias(f"s{j}") for j in range(samples)])
    # A sample is kept as 32 bits of a hash of its value; no term: null.
    kept = signed.select(
        "part",
        "rn",
        "v",
        F.array(*[F.when(F.col(f"s{j}").isNotNull(), F.xxhash64(F.col(f"s{j}")).bitwiseAND(0xFFFFFFFF)) for j in range(samples)]).alias("sig"),
    )
    follow = Window.partitionBy("part").orderBy("rn", "v")
    both = kept.select(
        "part", "rn", "v", "sig", F.lead("sig", 1).over(follow).alias("sig_edited"), F.lead("sig", 2).over(follow).alias("sig_next")
    ).filter("v = 0")

    def alike(a: str, b: str):
        same = sum((F.get(F.col(a), F.lit(j)).eqNullSafe(F.get(F.col(b), F.lit(j)))).cast("int") for j in range(samples))
        return same.cast("double") / float(samples)

    def text_of(sig: str):
        return F.concat(*[F.coalesce(F.lpad(F.lower(F.hex(F.get(F.col(sig), F.lit(j)))), 8, "0"), F.lit("--------")) for j in range(samples)])

    return about.join(both, ["part", "rn"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of("sig").alias("fingerprint"),
        text_of("sig_edited").alias("edited_fingerprint"),
        alike("sig", "sig_edited").alias("near_edited"),
        alike("sig", "sig_next").alias("near_next"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents``."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""N-gram Jaccard join by PartEnum signatures.

A document's set are the hashes of its distinct 5-word shingles; documents of equal
sets are one node.  Sets fall into bands of size (a band's upper end is twice its
lower).  A band partitions the shingle domain by hash into groups of three parts and
enumerates the subsets of two parts of each group: a signature is the hash of a set's
shingles in two parts of a group, and is left out where both are empty.  Two sets that
link differ in at most (|A| + |B|) / 9 shingles, hence in at most that many parts; a
group keeps a signature as long as one of its parts differs at most, and groups are so
many that linked sets always share one.  A set also enumerates the band of sets a
quarter larger.  Sets up to SMALL have one part for each shingle.  Should some set
still have too few parts, all sets are signed again with more of them, so that no link
is lost.

The same bound says how many signatures ``g`` a set shares with any set it links with.
The owners of ranges of signatures (``ranges``) tell each set which of its signatures
other sets have; with fewer than ``g`` of them (a document that only shares a passage)
it links with nothing and is done.

The texts of the others are read once more, and their shingles themselves go to owners of
ranges.  Two sets that link share 80 % of the shingles of either, so a set of ``n``
shingles of which ``c`` are shared links with nothing if ``c < 0.8 n``, and else keeps the
``c - 0.8 n + 1`` rarest of them, by the power of two of the number of sets that have
them.  The order is the same everywhere, so linked sets keep a common shingle.  Passages
that many sets have come last in it and join no sets that don't link.  All this prunes
exactly.

Sets that are connected by kept shingles form a cluster.  No pairs are spelled out: a
cluster is split into blocks of bounded size, a task looks up the shingles of each set
among those of a block, and sends the edges of a forest.  First every block meets itself,
twice, dealt differently.  Then, in clusters that are still in several pieces, the sets
outside the largest piece visit the blocks that hold a set with a kept shingle of theirs.
Rows sent grow with these visits; very many sets of which each shares 80 % of its shingles
with others, none of them rare, and that don't link are the worst case, since then every
set visits most blocks.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.graph import components, cut, join_spread, shelve
from strataq.llm.ranges import SENT, Sender, answered, named_by, ranges_for, unpacked
from strataq.llm.wordbatch import Words, mix, slices, windows
from strataq.llm.workers import quiet

SHINGLE = 5
SMALL = 16  # sets up to this size have one part for each shingle
SUBSETS = ((0, 1), (1, 2), (0, 2))  # of the three parts of a group, any two
SIGNATURES = 0.75  # of a set for each of its shingles, about
BLOCK = 200_000  # shingles of a cluster in one block
NO_ID = -(2**63)  # stands for a null id in row keys
THIN = -(2**63)  # the item that is told of sets with too few parts


def groups_of(band: int, finer: int = 1) -> int:
    """Groups of parts of a band: at its upper end a part has 2 to 2.4 shingles."""
    upper = SMALL << band
    return -(-upper * finer // (6 if upper <= 128 else 7))


def sets_of(texts: pa.Array):
    """For each text the sorted distinct 64-bit hashes of its 5-word shingles, with
    A-Z in lower case; of the whole sequence if it has fewer words; none without."""
    for start, stop in slices(texts):
        words = Words(texts[start:stop], lower=True)
        hashed = mix(windows(words.values, SHINGLE))
        edges = words.edges.tolist()
        for a, b in zip(edges, edges[1:]):
            if b - a >= SHINGLE:
                s = np.sort(hashed[a : b - SHINGLE + 1])
                new = s[1:] != s[:-1]
                yield s if new.all() else np.concatenate([s[:1], s[1:][new]])
            else:
                yield mix(windows(words.values[a:b], b - a) + np.uint64(b - a)) if b > a else words.values[:0]


def node_of(s: np.ndarray, seed: int = 0) -> int:
    """Signed 64-bit name of a set; another one for another seed."""
    both = np.array([mix(s ^ np.uint64(seed * 0xA0761D6478BD642F % 2**64)).sum(dtype=np.uint64) ^ np.uint64(len(s) * 0x9E3779B97F4A7C15 % 2**64)], np.uint64)
    return int(mix(both).view(np.int64)[0])


def band_of(size: int) -> int:
    return (size - 1).bit_length() - SMALL.bit_length() + 1 if size > SMALL else 0


def signatures(s: np.ndarray, finer: int = 1) -> tuple[np.ndarray, int, bool]:
    """(signatures, least number of them shared with a set this one links with,
    whether that number is above 0 for the set as the larger one of a pair)."""
    n = len(s)
    out, enough, least = [], True, n
    for band in sorted({band_of(n), band_of(n + n // 4)}):
        h = mix(s ^ np.uint64((band + 1) * 0xD6E8FEB86659FD93 % 2**64))
        had = kinds = triples = 0
        if band:
            groups = groups_of(band, finer)
            # the part is the upper half of the hash, scaled
            part = ((h >> np.uint64(32)) * np.uint64(3 * groups)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part, h = part[order], h[order]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            filled = np.zeros(3 * groups, bool)
            filled[part[edges]] = True
            total = np.zeros(3 * groups, np.uint64)
            total[part[edges]] = np.add.reduceat(h, edges)
            filled, total = filled.reshape(-1, 3), total.reshape(-1, 3)
            number = np.arange(groups, dtype=np.uint64) << np.uint64(40)
            h = np.concatenate([mix((total[:, i] + np.uint64(k) ^ number) + total[:, j])[filled[:, i] | filled[:, j]] for k, (i, j) in enumerate(SUBSETS, 1)])
            had, count = len(h), filled.sum(1)
            kinds, triples = int((count > 0).sum()), int((count > 1).sum())
        out.append(h)

        def shared(differ: int) -> int:
            """Signatures left when so many parts differ: a group's first takes two of
            its three signatures at most, its second the third."""
            if not band:
                return n - differ
            return had - 2 * min(differ, kinds) - min(max(differ - kinds, 0), triples)

        # as the larger set of a pair it differs in 2n/9 parts at most, as the
        # smaller in n/4
        if band == band_of(n):
            enough = shared(2 * n // 9) > 0
        least = min(least, shared(n // 4))
    return np.concatenate(out) if len(out) > 1 else out[0], max(1, least), enough


def _sent(rows: DataFrame, ranges: int, finer: int) -> DataFrame:
    """Signatures of every set on their way to the owners of their ranges, and for each
    set the least number it shares; a set that has too few parts tells the item THIN."""

    @quiet
    def run(batches):
        mine, seen = Sender(ranges), set()
        for b in batches:
            for s in sets_of(b.column(0)):
                if len(s) and (names := (node_of(s), node_of(s, 1))) not in seen:  # copies in one task send once
                    seen.add(names)
                    sigs, least, enough = signatures(s, finer)
                    mine.add(names[0], sigs)
                    mine.tell(names[0], least)
                    if not enough:
                        mine.tell(THIN, 0)
                    if mine.full():
                        yield mine.batch()
        if mine.size:
            yield mine.batch()

    return rows.select("text").mapInArrow(run, SENT)


def _able(answers: DataFrame) -> DataFrame:
    """(node,) of the sets that share the ``g`` signatures that they need to link at all."""

    def run(batches):
        for b in batches:
            on = []
            for packed in b.column(1).to_pylist():
                names = unpacked(packed)
                k = np.searchsorted(names, np.uint64(1 << 63))
                on.append(k >= (int(names[k:].min() - np.uint64(1 << 63)) if k < len(names) else 1))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(on, pa.bool_()))], names=["node"])

    return answers.filter(F.col("item") != THIN).mapInArrow(run, "node long")


def _sent_shingles(sets: DataFrame, ranges: int) -> DataFrame:
    """Shingles of (node, set) on their way to the owners of their ranges, and for each
    set the least number it shares with a set it links with."""

    @quiet
    def run(batches):
        mine = Sender(ranges, counted=True)
        for b in batches:
            for node, s in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(s, np.uint64)
                mine.add(node, s)
                same = len(s) - len(np.unique(named_by(s, ranges)))  # shingles that get one name count once
                mine.tell(node, max(1, -(-80 * len(s) // 100) - same))
                if mine.full():
                    yield mine.batch()
        if mine.size:
            yield mine.batch()

    return sets.select("node", "set").mapInArrow(run, SENT)


def _kept(answers: DataFrame) -> DataFrame:
    """(sig, node): of a node's ``c`` shared shingles the first ``c - g + 1``, if it
    has the ``g`` that it needs to link at all.  Shingles are in the order of their
    counted names everywhere, so linked sets keep one that both have."""

    def run(batches):
        for b in batches:
            out = []
            for node, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names = unpacked(packed)
                k = np.searchsorted(names, np.uint64(1 << 63))
                least = int(names[k:].min() - np.uint64(1 << 63)) if k < len(names) else 1
                if k >= least:
                    out.append((names[: k - least + 1], node))
            if out:
                sigs, nodes = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs]))], names=["sig", "node"]
                )

    return answers.mapInArrow(run, "sig long, node long")


def _described(rows: DataFrame) -> DataFrame:
    """(doc_id, columns behind the text, n_shingles, node, check) of every row; node and
    check, two 64-bit names of the set, are null for an empty one."""
    keep = rows.columns[2:]

    @quiet
    def run(batches):
        for b in batches:
            for start, stop in slices(b.column(1)):
                part = b.slice(start, stop - start)
                out = [(len(s), node_of(s), node_of(s, 1)) if len(s) else (0, None, None) for s in sets_of(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], *[pa.array(list(c), pa.int64()) for c in zip(*out)]],
                    names=["doc_id", *keep, "n_shingles", "node", "check"],
                )

    schema = rows.select("doc_id", *keep).schema.add("n_shingles", "long").add("node", "long").add("check", "long")
    return rows.mapInArrow(run, schema)


class Block:
    """Sets held in a task, looked up by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def linked(self, s: np.ndarray, percent: int = 80) -> np.ndarray:
        """Places of the sets that ``s`` links with."""
        low, high = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        count = high - low
        on = count > 0
        low, count = low[on], count[on]
        if not len(low):
            return np.zeros(0, np.int64)
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        same = np.bincount(self.owner[at], minlength=len(self.size))
        return np.flatnonzero((same > 0) & (100 * same >= percent * (len(s) + self.size - same)))


class Met:
    """Links in one block, as the edges of a forest: first the block's own sets are put
    in, then guests come one at a time and leave the edges that join something."""

    def __init__(self):
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.block: Block | None = None
        self.root: list[int] = []

    def _join(self, x: int, y: int) -> bool:
        p, q = self._find(x), self._find(y)
        self.root[q] = p
        return p != q

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def close(self, meet: bool):
        """All own sets are in; ``meet``: they are compared with each other."""
        if not self.sets:
            return
        self.block, self.root = Block(self.sets), list(range(len(self.sets)))
        if meet:
            for x, s in enumerate(self.sets):
                for y in self.block.linked(s).tolist():
                    if x != y and self._join(x, y):
                        yield self.nodes[x], self.nodes[y]
        self.sets = []

    def guest(self, node: int, s: np.ndarray):
        if self.block is None:
            return
        found = self.block.linked(s).tolist()
        for k, y in enumerate(found):
            if not k or self._join(found[0], y):
                yield node, self.nodes[y]


def _met(rows: DataFrame) -> DataFrame:
    """(a, b): forests of the links found in each (cluster, side).  Rows come sorted,
    the sets that live in a block (``at_home``) before its guests.  Blocks without
    guests are compared with themselves."""

    def run(batches):
        name, met, opened = None, Met(), True
        for batch in batches:
            out: list[tuple[int, int]] = []
            for cluster, side, guest, node, s in zip(*(c.to_pylist() for c in batch.columns)):
                if (cluster, side) != name:
                    if opened:
                        out += met.close(True)
                    name, met, opened = (cluster, side), Met(), True
                s = np.frombuffer(s, np.uint64)
                if not guest:
                    met.nodes.append(node)
                    met.sets.append(s)
                    continue
                if opened:
                    out += met.close(False)
                    opened = False
                out += met.guest(node, s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["a", "b"])
        if opened and (out := list(met.close(True))):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _compare(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the blocks of ``placed`` (cluster, side, guest, node)."""
    return cut(
        _met(
            placed.join(sets, "node")
            .select("cluster", "side", "guest", "node", "set")
            .repartition("cluster", "side")
            .sortWithinPartitions("cluster", "side", "guest")
        )
    )


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, size, set) of some sets, from one row of each: ``wanted`` has (k, h, node),
    the id and a hash of the text of that row."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64("text").alias("h"), "text")
    rows = rows.join(wanted, ["k", "h"]).select("node", "text")

    @quiet
    def run(batches):
        for b in batches:
            for start, stop in slices(b.column(1)):
                part = b.slice(start, stop - start)
                sets = list(sets_of(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "size", "set"],
                )

    return rows.mapInArrow(run, "node long, size long, set binary").dropDuplicates(["node"])


def links(kept: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root): components of the join graph, for sets that link.  ``kept`` has
    (sig, node), ``sets`` (node, size, set)."""
    hub = kept.groupBy("sig").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    clusters = components(kept.join(hub, "sig").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    placed = cut(sets.select("node", "size").join(clusters, "node").withColumnRenamed("root", "cluster"))
    size = placed.groupBy("cluster").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    wide = size.filter("blocks > 1")  # a cluster of several blocks holds BLOCK shingles, so these are few
    placed = placed.select("node", "cluster").join(wide, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sets = sets.select("node", "set")

    def side(salt: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int")

    def pieces(classes: DataFrame) -> DataFrame:
        """Nodes of clusters of several blocks that are still in several pieces;
        ``outside`` are those that aren't in the largest piece."""
        some = placed.filter("blocks > 1").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # a key of its own, lest the sums be made where the join dealt a whole cluster
        count = some.groupBy(F.struct("cluster", "root").alias("k")).agg(F.count("*").alias("n")).select("k.*", "n")
        main = count.groupBy("cluster").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("pieces")).filter("pieces > 1")
        return some.join(main, "cluster").select("cluster", "node", "blocks", (F.col("root") != F.col("main")).alias("outside"))

    at_home, guest = F.lit(False).alias("guest"), F.lit(True).alias("guest")
    found = _compare(placed.select("cluster", side(0).alias("side"), at_home, "node"), sets)
    classes = components(found)
    if wide.isEmpty():
        return classes  # every cluster has met in one block
    # other blocks join the large pieces of the first ones
    again = pieces(classes).select("cluster", side(1).alias("side"), at_home, "node")
    found = cut(found.unionByName(_compare(again, sets)))
    classes = components(found)
    # a set outside visits the blocks that hold a set with a kept shingle of its own
    rest = cut(pieces(classes).withColumn("side", side(0)))
    signed = kept.join(rest, "node").select("sig", "cluster", "side", "node", "outside")
    there = signed.groupBy("sig", "cluster").agg(F.collect_set("side").alias("sides"))  # blocks, not sets
    visits = signed.filter("outside").join(there, ["sig", "cluster"]).groupBy("cluster", "node", "side").agg(F.collect_set("sides").alias("sides"))
    visits = visits.select("cluster", "node", F.explode(F.array_remove(F.array_distinct(F.flatten("sides")), F.col("side"))).alias("side"))
    visits = cut(visits)
    hosts = visits.select("cluster", "side").distinct()
    homes = rest.join(hosts, ["cluster", "side"]).select("cluster", "side", at_home, "node")
    more = _compare(homes.unionByName(visits.select("cluster", "side", guest, "node")), sets)
    return classes if more.isEmpty() else components(found.unionByName(more))


def _named(described: DataFrame) -> DataFrame:
    """(node, check, name, copies, least, k, h) of each different set: its smallest id,
    and the id and text hash of the row that stands for it.  Should two sets share a
    node, the one of the larger check gets a name made of both."""
    row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "h")
    one = described.filter("node IS NOT NULL").groupBy("node", "check").agg(F.min(row).alias("row"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    first = one.groupBy("node").agg(F.min("check").alias("c"))
    name = F.when(F.col("check") == F.col("c"), F.col("node")).otherwise(F.xxhash64("node", "check"))
    return one.join(first, "node").select("node", "check", name.alias("name"), "copies", "least", "row.k", "row.h")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n_shingles, node, check), the last two null for an empty set, and
    sets (node, check, copies, least, k, h, class)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = ranges_for(chars / 6.5 * SIGNATURES, rows.sparkSession)
    finer = 1
    while True:
        answers = shelve(answered(_sent(rows, ranges, finer), ranges))
        if answers.filter(F.col("item") == THIN).isEmpty():
            break
        finer *= 2  # some set had too few parts: all are signed again with twice as many
    able = _able(answers)
    described = shelve(_described(rows.withColumn("h", F.xxhash64("text"))))
    sets = shelve(_named(described))
    held = shelve(_sets(rows, sets.join(able, "node").select("k", "h", F.col("name").alias("node"))))
    ranges = ranges_for(held.agg(F.sum("size")).first()[0] or 0, rows.sparkSession)
    kept = cut(_kept(answered(_sent_shingles(held, ranges), ranges, counted=True)))
    classes = links(kept, held).withColumnRenamed("node", "name")
    return described, sets.join(classes, "name", "left").withColumn("class", F.coalesce("root", "name")).drop("name", "root")


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    described, sets = _classes(docs)
    sets = shelve(sets.select("node", "check", "copies", "least", "class"))
    least = sets.groupBy("class").agg(F.min("least").alias("root"))
    named = sets.join(least, "class").select("node", "check", "copies", "root")
    return join_spread(described, named, ["node", "check"], "copies").withColumn("component_id", F.coalesce("root", "doc_id"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links).

    Null text and texts without words: an empty set, linked with nothing.  Rows with
    a null id get a null component if alone and never name one; repeated rows stay
    repeated; an empty table gives no rows; further columns are not read.
    """
    return _placed(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: of the rows of the smallest
    id the one whose text has the smallest hash.

    Rows without words and rows with a null id stay.  Ids may repeat: a component is
    settled by the text alone, so id and text name its row, and of rows that share
    both one stays.
    """
    text = F.col("text").cast("string")
    apart = F.col("doc_id").isNull() | ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named, h = docs.filter(~apart), F.xxhash64(text).alias("h")
    rows = named.select(F.col("doc_id").cast("long").alias("k"), h, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = _classes(named)[1].groupBy("class").agg(F.min(F.struct("k", "h")).alias("m")).select("m.*")
    return rows.join(first, ["k", "h"]).dropDuplicates(["k", "h"]).select("row.*").unionByName(docs.filter(apart))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate texts of ``documents``."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_sql() -> str:
    """The same in DuckDB SQL: shared shingles of every pair, then reachability."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {SHINGLE} THEN list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: md5(array_to_string(words[i : i + {SHINGLE - 1}], ' ')))
        WHEN len(words) > 0 THEN [md5(array_to_string(words, ' '))] ELSE [] END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v WHERE r.root < e.b),
c AS (SELECT v, min(root) AS root FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.root AS BIGINT) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.v = d.doc_id"""

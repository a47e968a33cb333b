import random
import re

import numpy as np
import pytest
from helpers import words
from oracle import DATA, assert_same

from strataq.llm import embeddings, jaccard, ranges, registry, substrings
from strataq.llm.graph import components, join_spread

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(registry.queries()[name](spark, f"{DATA}/{SF}"), registry.oracle_sql()[name], SF)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(pairs, ids):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def near_copies(rng):
    texts = []
    for size in (6, 12, 40, 66, 80, 130, 200, 400):
        base = words(rng, size)
        texts += [base, base, base.upper(), base + " one two"]
        texts += [edited(rng, base, k) for k in (1, 2, 3, 5, 9) for _ in range(2)]
        texts.append(" ".join(base.split()[: int(size * 0.85)]))
    passage = words(rng, 30)
    texts += [words(rng, 20) + " " + passage + " " + words(rng, 150) for _ in range(12)]  # a shared passage links nothing
    return texts + ["", None, "one", "One", "one two three four", "\x1cone\x1c", "  \t", "ÉTÉ a b c d", "été a b c d"]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, docs, seed):
    rng = random.Random(seed)
    texts = near_copies(rng)
    rng.shuffle(texts)
    rows = [(3 * i + 7, t) for i, t in enumerate(texts)]
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = brute_components(pairs, ids)
    got = {r["doc_id"]: r for r in jaccard.join(docs(rows)).collect()}
    assert {i: got[i]["n_shingles"] for i in ids} == {i: len(sets[i]) for i in ids}
    assert {i: got[i]["component_id"] for i in ids} == want
    kept = [r["doc_id"] for r in jaccard.representatives(docs(rows)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_jaccard_edges(spark, docs):
    assert jaccard.join(docs([])).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, None)]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.join(docs(rows)).collect())
    assert got == [("5", "5"), ("5", "5"), ("9", "5"), ("None", "5"), ("None", "None")]
    kept = [r["doc_id"] for r in jaccard.representatives(docs(rows)).collect()]
    assert sorted(kept, key=str) == [5, None, None]


def test_representatives_of_repeated_ids(spark, docs):
    """Unlinked texts of one id both stay; a near copy goes whatever other ids do."""
    rng = random.Random(11)
    long = [words(rng, 40) for _ in range(4)]
    near = long[2] + " tail"  # a copy of 12's text under the id of another component
    rows = [(5, long[0]), (5, long[1]), (9, long[1]), (12, long[2]), (20, near), (20, long[3]), (30, ""), (30, " \t"), (30, None)]
    want = sorted([(5, long[0]), (5, long[1]), (12, long[2]), (20, long[3]), (30, ""), (30, " \t"), (30, None)], key=str)
    for some, left in ((rows, want), (rows[3:], [r for r in want if r[0] != 5])):
        got = [(r["doc_id"], r["text"]) for r in jaccard.representatives(docs(some)).collect()]
        assert sorted(got, key=str) == left


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for n in (5, 16, 17, 24, 31, 32, 33, 40, 64, 65, 100, 128, 129, 300, 1000):
        for _ in range(40):
            base = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            a = np.unique(base[:n])
            for extra in range(0, n // 4 + 1, max(1, n // 20)):
                drop = int(rng.integers(0, extra + 1))
                b = np.unique(np.concatenate([base[drop:n], base[n : n + extra - drop]]))
                if len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                    for finer in (1, 2):
                        x, least_a, ok_a = jaccard.signatures(a, finer)
                        y, least_b, ok_b = jaccard.signatures(b, finer)
                        both = len(np.intersect1d(x, y))
                        assert ok_a and ok_b and both >= max(1, least_a, least_b)


def test_most_signatures_take_two_parts():
    s = np.unique(np.random.default_rng(3).integers(0, 2**64, 512, dtype=np.uint64))
    sigs, _, _ = jaccard.signatures(s)
    parts = 3 * jaccard.groups_of(jaccard.band_of(512))
    assert 0.95 * parts < len(np.unique(sigs)) <= 2 * 2 * parts  # a subset each, in one or two bands
    one = np.random.default_rng(5).permutation(s)[1:]
    lost = len(sigs) - len(np.intersect1d(sigs, jaccard.signatures(np.sort(one))[0]))
    assert 1 <= lost <= 4  # the part that lost a shingle is in two subsets


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("strong", [False, True])
def test_owners_of_ranges_against_brute_force(spark, strong, later):
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    second = rng.integers(0, 2**63, len(base)).astype(np.uint64)
    held, rows = {}, []
    for _ in range(6):  # tasks
        sender = ranges.Sender(5, strong)
        for _ in range(40):
            item, at = int(rng.integers(-20, 200)), np.unique(np.append(rng.choice(len(base), 30), 0))  # key 0 is hot
            sender.add(item, base[at], second[at])
            for k in at.tolist():
                held.setdefault(k, set()).add(item)
        sender.tell(3, 44)
        rows += list(zip(*(c.to_pylist() for c in sender.batch().columns)))
    sent = spark.createDataFrame([(p, bytearray(x)) for p, x in rows], ranges.SENT)
    got = set()
    answers = ranges.answered(sent, 5, strong, later).collect()
    assert len({r["item"] for r in answers}) == len(answers)  # one row for each item
    for r in answers:
        got |= {(r["item"], n) for n in ranges.unpacked(r["names"]).tolist()}
    name = [int(second[k]) if strong else ((int(x) >> 32) * 5 >> 32) << 32 | int(x) & 0xFFFFFFFF for k, x in enumerate(base.tolist())]
    want = {(i, name[k]) for k, items in held.items() for i in items if (i > min(items) if later else len(items) > 1)}
    assert got == want | {(3, 44 | 1 << 63)}
    hot = [x for p, x in rows if p >= 0 and p == int(base[0]) * 5 >> 64]
    assert len(hot) == 6  # one row, with one entry of the hot key, from each task


def test_counted_names_start_with_the_rarest(spark):
    """Every set hears of its shared keys with the power of two of the sets that have
    them, a hot one within a task and between tasks."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**64, 600, dtype=np.uint64))
    held, rows = {}, []
    for task in range(4):
        sender = ranges.Sender(3, counted=True)
        for item in range(task * 20, task * 20 + 20):
            at = np.unique(np.append(rng.choice(len(base), 30), 0))  # key 0 is hot
            sender.add(item, base[at])
            for k in at.tolist():
                held.setdefault(k, set()).add(item)
        rows += list(zip(*(c.to_pylist() for c in sender.batch().columns)))
    sent = spark.createDataFrame([(p, bytearray(x)) for p, x in rows], ranges.SENT)
    got = {(r["item"], n) for r in ranges.answered(sent, 3, counted=True).collect() for n in ranges.unpacked(r["names"]).tolist()}
    name = [len(held.get(k, ())).bit_length() << 57 | ((int(x) >> 32) * 3 >> 32) << 32 | int(x) & 0xFFFFFFFF for k, x in enumerate(base.tolist())]
    assert got == {(i, name[k]) for k, items in held.items() for i in items if len(items) > 1}
    assert len(held[0]) == 80


def test_shared_passages_make_no_cluster(spark, docs, monkeypatch):
    """Pairs of near copies that share passages with others: what the blocks are sent
    follows the sets, not the sets times the blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    sent, compare = [], jaccard._compare
    monkeypatch.setattr(jaccard, "_compare", lambda placed, sets: sent.append(placed.count()) or compare(placed, sets))
    rng = random.Random(17)
    passages = [words(rng, 40) for _ in range(20)]
    rows = []
    for i in range(60):
        text = f"{words(rng, 40)} {' '.join(rng.sample(passages, 2))}"
        rows += [(2 * i, text), (2 * i + 1, text + " end")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
    assert sum(sent) <= 2 * len(rows)


@pytest.mark.parametrize("linked", [True, False])
def test_a_cluster_of_many_blocks(spark, docs, monkeypatch, linked):
    """Documents of one template: either all link in chains, or they share signatures
    and never link.  What is sent to the blocks follows the sets that visit."""
    monkeypatch.setattr(jaccard, "BLOCK", 1500)
    rng = random.Random(13)
    base = words(rng, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(1 if linked else 9):
            w[(i * (1 if linked else 17) + k * 16) % 150] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(pairs, sorted(sets))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(rows)).collect()} == want
    assert len(set(want.values())) == (1 if linked else len(rows)) or not linked


def test_two_sets_of_one_name(spark):
    rows = [(1, 10, 7, 100), (2, 11, 7, 100), (3, 12, 7, 200), (4, 13, 8, 300), (None, 14, 8, 300), (5, 15, None, None)]
    named = jaccard._named(spark.createDataFrame(rows, "doc_id long, h long, node long, check long")).collect()
    by = {(r["node"], r["check"]): r for r in named}
    assert set(by) == {(7, 100), (7, 200), (8, 300)} and len({r["name"] for r in named}) == 3
    assert by[7, 100]["name"] == 7 and (by[7, 100]["copies"], by[7, 100]["least"]) == (2, 1)
    assert (by[8, 300]["least"], by[8, 300]["copies"]) == (4, 2)


def test_a_hot_key_is_spread(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id < 3000, 0, IF(id = 4000, NULL, id)) AS k", "1 AS c")
    named = rows.filter("k IS NOT NULL").groupBy("k", "c").count().selectExpr("k", "c", "count AS copies", "k * 10 AS v")
    got = {r["id"]: r["v"] for r in join_spread(rows, named, ["k", "c"], "copies").collect()}
    assert got == {i: 0 if i < 3000 else None if i == 4000 else i * 10 for i in range(5000)}


def brute_substrings(rows):
    words_ = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words_):
        w = words_[i]
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = {}
    for i, w in words_.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings_against_brute_force(spark, docs):
    rng = random.Random(8)
    a, b, c = words(rng, 50), words(rng, 75), words(rng, 49)
    rows = [words(rng, 30) + " " + rng.choice([a, b, c]) + "\n" + words(rng, 20) + "\t" + rng.choice([a, b, c, ""]) for _ in range(40)]
    rows += [a, a + " tail", "x " * 200, "x " * 120, "", None, c, c, b.replace(" ", "\x0b"), "\xa0".join(["z"] * 60)]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(rows)]
    want = brute_substrings(rows)
    import hashlib

    got = {r["doc_id"]: r for r in substrings.dedup(docs(rows)).collect()}
    for i, (n, gone, kept) in want.items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    frame = docs(rows, extra=False).selectExpr("doc_id", "text", "'en' AS lang", "CAST(length(text) AS LONG) AS n_chars")
    clean = {r["doc_id"]: r for r in substrings.cleaned(frame).collect()}
    for i, t in rows:
        text = want[i][2] if want[i][1] else t
        assert clean[i]["text"] == text and clean[i]["n_chars"] == (None if text is None else len(text))


def test_substrings_edges(spark, docs):
    assert substrings.dedup(docs([])).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (4, long), (4, long), (8, long)]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.dedup(docs(rows)).collect())
    assert got == [("4", 0), ("4", 0), ("8", 60), ("None", 0)]


def brute_embeddings(rows):
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.array(v, np.float32).astype(float)
        if len(x) and np.linalg.norm(x):
            ok[i] = (x / np.linalg.norm(x), label)
    ids = sorted(ok)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.98]
    n = {r[0]: 0 for r in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return pairs, n, brute_components(pairs, [r[0] for r in rows])


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=32)
            for _ in range(9):
                v = base + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.14, 0.3])
                rows.append((len(rows), [float(x) for x in v.astype(np.float32)], label))
    rows += [(len(rows) + k, v, 0) for k, v in enumerate([None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 2.0], [1.0, 2.0], [float("inf")] * 32])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "'x' AS root", "2 AS n", "3 AS keys")
    pairs, n, root = brute_embeddings(rows)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    found, true = sum(r["n_links"] for r in got.values()), sum(n.values())
    assert true > 200 and 0.99 * true <= found <= true
    assert all(got[i]["n_links"] <= n[i] for i in n)
    if found == true:
        assert {i: r["component_id"] for i, r in got.items()} == root
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_bands_keep_their_promise():
    for size in (10, 10_000, 10**9):
        signs, n = embeddings.bands(size)
        agree = (1 - np.arccos(0.98) / np.pi) ** signs
        assert (1 - agree) ** n <= embeddings.MISS


@pytest.mark.parametrize("dim", [3, 32, 63, 256])
def test_codes_never_drop_a_link_and_drop_most_others(dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(40, dim))
    x = np.repeat(base, 10, 0) + 0.12 * rng.normal(size=(400, dim))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit @ unit.T >= embeddings.THRESHOLD
    assert (embeddings.linked(x, 3 * x) == want).all()
    code, about = embeddings.coded(unit, 3 * dim)
    assert code.shape == (400, -(-3 * dim // 8)) and about.shape[1] == 12 + -(-dim // 2)
    maybe = embeddings.undecided(dim, about, code, about)
    assert (maybe | ~want).all()
    if dim >= 63:
        assert maybe.mean() < 0.1


def test_estimates_have_no_bias():
    rng = np.random.default_rng(2)
    dim, found = 64, []
    for _ in range(300):
        x, y = rng.normal(size=(2, dim))
        y = 0.6 * x / np.linalg.norm(x) + 0.8 * (v := y - (y @ x) / (x @ x) * x) / np.linalg.norm(v)
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        turn = q * np.sign(np.diag(r))
        sign = np.where(turn @ y > 0, 1, -1) / np.sqrt(dim)
        found.append((turn @ (x / np.linalg.norm(x))) @ sign / ((turn @ y) @ sign))
    assert abs(np.mean(found) - 0.6) < 4 * np.std(found) / np.sqrt(300)


def test_embeddings_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    rows = [(k, [float(x) for x in base + 0.1 * rng.normal(size=24)], 1) for k in range(150)]
    rows += [(200 + k, rows[0][1], 1) for k in range(40)] + [(300 + k, rows[0][1], None) for k in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if label == 1}
    near = [(a, b) for a in ok for b in ok if a < b and ok[a] @ ok[b] >= 0.98]
    n = {r[0]: 0 for r in rows}
    for a, b in near:
        n[a] += 1
        n[b] += 1
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame).collect()}
    found, true = sum(r["n_links"] for r in got.values()), sum(n.values())
    assert 0.99 * true <= found <= true and true > 1000
    if found == true:
        assert {i: r["component_id"] for i, r in got.items()} == brute_components(near, list(n))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4100)] + [(7, 7)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    want = brute_components([p for p in pairs if p[0] != p[1]], ids)
    for local in (10**6, 40):  # one task; several, then rounds
        assert {r["node"]: r["root"] for r in components(frame, local=local).collect()} == want
    assert components(frame.limit(0)).count() == 0

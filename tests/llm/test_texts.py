import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from helpers import words
from oracle import DATA
from pyspark.sql import functions as F

from strataq.llm import bpe, extraction, fingerprint, jaccard, labelled, licenses, packing, pages_made, quality, substrings, toxicity
from strataq.llm.dom import Page
from strataq.llm.labelled import fold


def brute_edited(rows):
    rows = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows))
    out = []
    for k, (i, t) in enumerate(rows):
        q = len(t) // 4
        out.append((i, t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q]))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_fingerprints(spark, docs, monkeypatch, ranges):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", ranges)
    rng = random.Random(3)
    rows = [(rng.randrange(10**12), words(rng, rng.choice([1, 30, 300]))) for _ in range(60)]
    rows += [(5, "same text here"), (6, "same text here"), (7, ""), (8, None), (8, "tie"), (8, "tie"), (None, "no id"), (10**15, "  Zwölf 😀 boxes ")]
    got = fingerprint.fingerprints(docs(rows)).collect()
    assert len(got) == len(rows)
    mine = sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["edited_sha256"]) for r in got)
    assert mine == sorted((i, hashlib.sha256(e.encode()).hexdigest()) for i, e in brute_edited(rows))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] and by_id[5]["near_next"] == 1.0
    assert by_id[10**15]["n_chars"] == 16
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.fingerprints(docs([])).count() == 0
    alone = fingerprint.fingerprints(docs([(1, "only one text")])).first()
    assert alone["near_next"] == 1.0


def test_collisions_follow_generalised_jaccard(spark, docs):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    close, far = [], []
    for k in range(40):
        a = [rng.choice(base[:30]) for _ in range(300)]
        b = a[:220] + [rng.choice(base[60:]) for _ in range(80)]
        close.append((a, b))
    rows = [(2 * k + j, " ".join(x)) for k, pair in enumerate(close) for j, x in enumerate(pair)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(rows)).collect()}

    def likeness(a, b):
        from collections import Counter

        x, y = (Counter(zip(t, [*t[1:], None])) for t in (a, b))
        return sum(min(x[k], y[k]) for k in x) / sum(max(x[k], y[k]) for k in x.keys() | y.keys())

    want = np.mean([likeness(a, b) for a, b in close])
    found = np.mean([got[2 * k]["near_next"] for k in range(len(close))])
    assert abs(want - found) < 0.05


def test_gamma_quantiles():
    p = np.array([1e-6, 0.01, 0.5, 0.99])
    x = fingerprint.gamma2_quantiles(p)
    assert np.allclose(1 - (1 + x) * np.exp(-x), p, rtol=1e-4)


def test_licences(spark, docs):
    rows = [
        "Released UNDER the MIT License. Under the MIT licence no; under the mit license!", "Apache License, Version 2.0; CC-BY-NC 4.0 cc by nc cc by nc",
        "mit the under license", "commit license under the mit", "", None, "under the mit", "All rights reserved. GNU General Public License",
        "under the mit\x00license", "underé the mit license", "x " * 3000 + "under the mit license", "and software permission any",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 1, 10, "mit")
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["first_word"], got[1]["last_word"]) == (4, "apache-2,cc-by-nc", 0, 13)
    for i in (2, 3, 4, 5, 6, 9, 11):
        assert (got[i]["n_base"], got[i]["first_word"], got[i]["base_labels"]) == (0, None, "")
    assert got[7]["labels"] == "all-rights-reserved,gpl" and got[7]["score"] == 1.0 and got[7]["base_labels"] == ""
    assert got[8]["n_base"] == 1 and got[10]["first_word"] == 3000 and got[4]["n_words"] == 0
    assert licenses.scan(docs([])).count() == 0


def test_html_blocks():
    m = extraction.default_model()
    page = """<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><div class=cookie-notice>We use cookies. Agree?</div>
    <article><h1>A  title</h1><p>First &amp; foremost, it<b>al</b>ics are\n kept. So it goes.<p>Second&nbsp;block here. It ends.<br>After the break it goes on.
    <script>var x = "<p>no</p>";</script><!-- no --><div class="ad">Buy this now.</div><blockquote>Quoted words stand here.</blockquote></article>
    <section id="comments"><h3>Comments</h3><p>I disagree with all of it. Really.</p></section><aside class=sidebar><h3>Related</h3><a href=/r>Other</a></aside>
    <form class=newsletter><label>Mail</label><button>Go</button></form><footer>&copy; 2024 Site. All rights.</footer></body></html>"""
    assert m.text(page) == "A title First & foremost, italics are kept. So it goes. Second block here. It ends. After the break it goes on. Quoted words stand here."
    assert [m.text(x) for x in (None, "", "<p>", "<!--", "<script>x", "<div><div>")] == [""] * 6


def test_html_held_out():
    m = extraction.default_model()
    right = wrong = 0
    for i in range(20_000, 20_150):
        page = Page(pages_made.page(i), labelled=True)
        labels, p = page.labels(), m.keep(page)
        for k in range(1, len(p)):
            if not page.tag[k] and not page.text[k].isspace():
                ok = (p[k] > 0.5) == bool(labels[k])
                right, wrong = right + ok * len(page.text[k]), wrong + (not ok) * len(page.text[k])
    assert right / (right + wrong) > 0.96


def test_marginals_against_enumeration():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(1, 7)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edge = tuple(rng.uniform(-1, 1) for _ in range(4))
        total, each = 0.0, [0.0] * n
        for bits in range(1 << n):
            s = [bits >> i & 1 for i in range(n)]
            w = np.exp(sum(u for u, x in zip(unary, s) if x) + sum(edge[2 * s[parent[i]] + s[i]] for i in range(1, n)))
            total += w
            for i in range(n):
                each[i] += w * s[i]
        p, _ = extraction.marginals(parent, unary, edge)
        assert np.allclose(p, [x / total for x in each])


def test_html_table(spark):
    rows = [(1, "u", "<article><p>One sentence. Two sentences. And a third one here.</p></article>"), (2, None, None), (None, "u", ""), (1, "u", "<p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = extraction.extract(df, extraction.default_model()).collect()
    assert len(got) == 4 and got[0]["text"].startswith("One sentence.") and got[0]["n_chars"] == len(got[0]["text"])
    assert extraction.extract(df.limit(0), extraction.default_model()).count() == 0


def quality_rows(rng, n):
    rows = []
    for i in range(n):
        t, bad = words(rng, rng.randint(5, 80)), i % 4 == 0
        if bad:
            t = rng.choice([lambda: t.upper().replace(" ", "!! "), lambda: t.replace(" ", " | "), lambda: " ".join([t.split()[0]] * 40)])()
        rows.append((i, t, int(not bad)))
    return rows


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_fold(spark):
    got = spark.range(50).select("id", (fold("id") == 1).alias("h")).collect()
    assert all(r["h"] == is_held_out(r["id"]) for r in got)


def test_quality(spark, docs):
    rows = quality_rows(random.Random(4), 400)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (10**6, None, None)], "doc_id long, quality int, toxic int")
    frame = docs([(i, t) for i, t, _ in rows] + [(10**6, ""), (None, None), (10**6, "dup")])
    model = quality.fit(frame, labels)
    got = quality.score_table(frame, model).collect()
    assert len(got) == 403
    held = [(r["predicted"], y) for r in got for i, _, y in rows if r["doc_id"] == i and is_held_out(i)]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_table(docs([]), model).count() == 0
    assert quality.good(frame, model).columns == frame.columns
    none = quality.fit(docs([]), labels.limit(0))
    assert quality.score_table(docs(["x"]), none).first()["score"] == 0.5


def test_quality_learns_from_all_labelled_rows(spark, docs, monkeypatch):
    """Bad rows are long texts, and there are more rows than vectors that vote."""
    monkeypatch.setattr(labelled, "SHARD_ROWS", 80)
    monkeypatch.setattr(quality, "MOST", {0: 20, 1: 20})
    rows = [(i, t if y else f"{t} " * (20_001 // len(t) + 1), y) for i, t, y in quality_rows(random.Random(6), 300)]
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    frame = docs([(i, t) for i, t, _ in rows])
    model = quality.fit(frame, labels)
    assert sorted(model.labels.tolist()) == [0.0] * 20 + [1.0] * 20 and np.allclose(np.linalg.norm(model.vectors, axis=1), 1)
    got = {r["doc_id"]: r["predicted"] for r in quality.score_table(frame, model).collect()}
    held = [got[i] == y for i, _, y in rows if is_held_out(i)]
    assert sum(held) / len(held) > 0.95


def test_quality_votes_are_exact():
    rng = random.Random(1)
    rows = quality_rows(rng, 60)
    model = quality.train([t for _, t, _ in rows], np.array([y for _, _, y in rows]), 0.7)
    texts = ["Some words here. And there.", "", None, "SHOUT!! LOUD!!"]
    got = model.score(texts)
    for t, s in zip(texts, got):
        v = model.project([t])[0]
        near = model.vectors @ v
        top = np.argsort(-near, kind="stable")[: quality.NEIGHBOURS]
        w = np.clip(near[top], 0, 1) ** quality.SHARPNESS
        want = (w * model.labels[top]).sum() / w.sum() if w.sum() > 1e-9 else 0.7
        assert abs(want - s) < 1e-6


def test_toxicity(spark, docs):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        w = words(rng, rng.randint(5, 120)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewort", "scumling", "hatefulx" + str(rng.randrange(50))]))
        rows.append((i, " ".join(w), int(bad)))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    frame = docs([(i, t) for i, t, _ in rows] + [(10**6, ""), (None, None), (10**6, "x " * 30_000)]).selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN 'en' END AS lang")
    model = toxicity.fit(frame, labels)
    got = toxicity.score_table(frame, model).collect()
    assert len(got) == 603
    held = [(r["predicted"], y) for r in got for i, _, y in rows if r["doc_id"] == i and is_held_out(i)]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    left = toxicity.clean(frame, model)
    assert left.columns == frame.columns
    assert {r["doc_id"] for r in left.collect()} >= {r["doc_id"] for r in got if r["score"] < 0.5 and r["doc_id"] is not None}
    assert toxicity.score_table(frame.limit(0), model).count() == 0


@pytest.mark.parametrize("shard", [8000, 60])
def test_toxicity_learns_from_all_labelled_rows(spark, docs, monkeypatch, shard):
    """All toxic rows are long texts; one shard and several."""
    monkeypatch.setattr(labelled, "SHARD_ROWS", shard)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = words(rng, 3000 if i % 5 == 0 else rng.randint(5, 60)).split()
        if i % 5 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewort", "scumling"]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    assert min(len(t) for _, t, y in rows if y) > 20_000
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    frame = docs([(i, t) for i, t, _ in rows])
    kept, shards = labelled.training_rows(frame, labels, "toxic")
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if not is_held_out(i)}
    assert (shards > 1) == (shard < 300)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_table(frame, toxicity.fit(frame, labels)).collect()}
    held = [got[i] == y for i, _, y in rows if is_held_out(i)]
    assert sum(held) / len(held) > 0.95


def test_convolution_against_loops():
    rng = np.random.default_rng(0)
    texts = ["one two three four", "", None, "word", "a b c d e f g h"]
    model = toxicity.Cnn(
        rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32),
        {w: rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS},
        rng.normal(size=toxicity.FILTERS * 3).astype(np.float32), rng.normal(size=toxicity.FILTERS * 3).astype(np.float32), 0.3,
    )
    model.embed[0] = 0
    for t, s in zip(texts, model.score(texts)):
        ids = toxicity.word_features(toxicity.words_of((t or "").lower())) if t else np.zeros((0, toxicity.FEATURES), int)
        x = np.vstack([model.embed[ids].sum(1), np.zeros((3, toxicity.DIM))])
        best = []
        for w in toxicity.WIDTHS:
            r = [sum(x[i + k] @ model.filters[w][k] for k in range(w)) for i in range(len(x) - w + 1)]
            best.append(np.max(r, axis=0))
        z = np.maximum(np.hstack(best) + model.bias, 0) @ model.out + model.out_bias
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-3


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_queries_run(spark, sf):
    from strataq.llm import registry

    for name, query in registry.queries().items():
        assert query(spark, f"{DATA}/{sf}").count() > 0, name


def test_terms_see_whole_words():
    """No prefix: a change at the end of a long word changes terms and counts."""
    long = "ab" * 400 + "1-2-3-4"
    a, b = quality.counts(long), quality.counts(long + "-5")
    assert a[0].tolist() != b[0].tolist()
    assert quality.shape("Ab1-c.D2") == "Aa0-a.A0" and quality.shape("ÉTÉx日") == "Aax"
    terms, n = quality.counts("x1-x1-x1-x1- x1-x1-x1-x1- plain plain")
    assert n.sum() == 4 + 3 + 4 + 2 * 1 + 4  # first terms, pairs, words, further terms, repeated or new


def test_a_table_of_words_that_is_emptied_gives_the_same():
    words_ = [f"w{i}-{i % 7}.{i % 3}-{i}" for i in range(500)]
    text = " ".join(words_ * 3)
    want = quality.counts(text)
    quality._words.chars = 30_000_000
    got = quality.counts(text)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_very_long_texts(spark, docs):
    """Texts of some hundred thousand words, and a word of a million characters."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(150_000))
    rows = [(1, long), (2, long + " tail"), (3, "y" * 1_000_000), (4, "under the mit license " + long), (5, None)]
    frame = docs(rows)
    got = {r["doc_id"]: r for r in jaccard.join(frame).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5} and got[3]["n_shingles"] == 1
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.dedup(frame).collect()}
    assert cut == {1: (150_000, 0), 2: (150_001, 150_000), 3: (1, 0), 4: (150_004, 150_000), 5: (0, 0)}
    base = {r["doc_id"]: (r["n_words"], r["base_labels"], r["first_word"]) for r in licenses.scan(frame).collect()}
    assert base[4] == (150_004, "mit", 0) and base[1] == (150_000, "", None)
    pieces = packing.pack(frame, bpe.vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == 5 and all(r["n"] == r["t"] for r in pieces)
    sign = {r["doc_id"]: r for r in fingerprint.fingerprints(frame).collect()}
    assert sign[1]["n_chars"] == len(long) and sign[1]["near_next"] > 0.8 and sign[2]["near_next"] < 0.2
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    assert quality.score_table(frame, quality.fit(frame, labels)).count() == 5
    assert toxicity.score_table(frame, toxicity.fit(frame, labels)).count() == 5
    page = "<html><body><article>" + f"<p>{long[:900_000]}.</p>" + "</article></body></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert extraction.extract(pages, extraction.default_model()).first()["n_chars"] > 890_000


def article_by_rule(source):
    """What the tables' pages hold as article: all between its tags, blocks apart."""
    found = re.search(r"<article>(.*?)</article>", source or "", re.S)
    inside = re.sub(r"</?(?:b|i|em|a)\b[^>]*>|<!--.*?-->", "", found[1] if found else "", flags=re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def test_extraction_of_all_pages_against_a_rule(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in extraction.op8_html(spark, f"{DATA}/sf0.01").collect()}
    assert got == {i: article_by_rule(s) for i, s in source.items()}


def test_extraction_of_pages_it_was_not_trained_on():
    m, right, texts = extraction.default_model(), 0, 0
    for seed in range(100_000, 100_100):
        page = Page(pages_made.page(seed), labelled=True)
        for tag, text, p, y in zip(page.tag, page.text, m.keep(page), page.labels()):
            if not tag and not text.isspace():
                texts += 1
                right += (p > 0.5) == y
    assert right / texts > 0.98


def test_marks_of_labelled_pages_mean_nothing_elsewhere():
    source = "<div><p data-keep>One two three.</p></div>"
    assert sum(Page(source).labels()) == 0 and sum(Page(source, labelled=True).labels()) > 0
    assert "quiet" in " ".join(Page("<noscript><p>quiet</p></noscript><iframe>x</iframe>").text)


def brute_signature(text):
    """Smallest ln a of each sample over the weighted word pairs, term by term, with the
    hashes that the DataFrame functions stand for."""
    seeded = lambda data, seed: xxhash.xxh64_intdigest(data, seed % 2**64)
    r_table, c_table = fingerprint.tables()
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text) if x]
    weights = {}
    for a, b in zip(w, [*w[1:], None]):
        h = seeded(a.encode(), 42)
        weights[h if b is None else seeded(b.encode(), h)] = weights.get(h if b is None else seeded(b.encode(), h), 0) + 1
    out = []
    for j in range(fingerprint.SAMPLES):
        best = None
        for h, n in weights.items():
            x = seeded((j // 2).to_bytes(4, "little"), seeded(h.to_bytes(8, "little"), 42))
            at = 32 * (j % 2)
            y = (x >> at & 4095) | (x >> (32 - at if at else 32) & 4095) << 12 | 1 << (fingerprint.OCTAVES - 1)
            octave = (y & -y).bit_length() - 1
            ln_c = c_table[octave * fingerprint.PARTS + (x >> at + 12 & fingerprint.PARTS - 1)]
            r = r_table[x >> at + 15 & fingerprint.R_CELLS - 1]
            b = ((x >> at + 19 & 8191) + 0.5) / 8192
            t = 0.0 if n == 1 else math.floor(math.log(n) / r + b)
            ln_a = ln_c - r * (t - b + 1.0)
            best = ln_a if best is None else min(best, ln_a)
        out.append(best)
    return out


def test_signatures_against_brute_force(spark, docs):
    rng = random.Random(21)
    texts = [words(rng, n) for n in (1, 2, 40, 200)] + ["aa aa aa bb aa aa cc " * 9, ""]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(texts)).collect()}
    values = {i: brute_signature(t) for i, t in enumerate(texts)}
    flat = [(i, j, float(v)) for i, s in values.items() for j, v in enumerate(s) if v is not None]
    named = {(r["i"], r["j"]): r["h"] for r in spark.createDataFrame(flat, "i int, j int, v double").selectExpr("i", "j", "lpad(lower(hex(xxhash64(v) & 4294967295)), 8, '0') AS h").collect()}
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == "".join(named.get((i, j), "--------") for j in range(fingerprint.SAMPLES))
    for i in range(len(texts) - 1):
        same = sum(a == b for a, b in zip(values[i], values[i + 1]))
        assert got[i]["near_next"] == same / fingerprint.SAMPLES


def test_licence_scores_grow_with_agreement(spark, docs):
    whole = licenses.OWN[0][1]
    w = whole.split()
    rows = [whole, " ".join(w[:12] + ["x"] + w[13:]), " ".join(["y"] * 20 + w[20:]), "nothing of this kind", "the the software permission"]
    got = [r["score"] for r in sorted(licenses.scan(docs(rows)).collect(), key=lambda r: r["doc_id"])]
    assert got[0] == 1.0 and 1.0 > got[1] >= got[2] and got[3] == 0.0

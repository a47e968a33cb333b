import public_tokenizers
from oracle import DATA
from test_pairs import brute_components, brute_substrings, shingle_set
from tokenizers import Tokenizer

import corpus_pipeline
from strataq.llm import quality, toxicity

SF = f"{DATA}/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = out.collect()
        if k < 4:
            assert out.columns == columns
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
            bad = {i for i, r in rows.items() if model.score([r["text"]])[0] >= model.thresholds.get(r["lang"], toxicity.THRESHOLD)}
            assert bad and {r["doc_id"] for r in got} == set(rows) - bad
        elif name == "quality":
            model = quality.fit(docs, labels)
            assert {r["doc_id"] for r in got} == {i for i, r in rows.items() if model.score([r["text"]])[0] >= quality.THRESHOLD}
        elif name == "near_duplicates":
            sets = {i: shingle_set(r["text"]) for i, r in rows.items()}
            ids = sorted(sets)
            pairs = [
                (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            ]
            assert {r["doc_id"] for r in got} == set(brute_components(pairs, ids).values()) < set(ids)
        elif name == "substrings":
            want = brute_substrings([(i, r["text"]) for i, r in rows.items()])
            assert any(gone for _, gone, _ in want.values())
            assert {r["doc_id"]: r["text"] for r in got} == {i: kept if gone else rows[i]["text"] for i, (_, gone, kept) in want.items()}
        else:
            theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            pieces = {}
            for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
                pieces.setdefault(r["doc_id"], []).extend(r["ids"])
            assert pieces == {i: [*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 2] for i, r in rows.items()}
        if k < 4:
            docs = out
            rows = {r["doc_id"]: r for r in got}


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "source", "CAST(NULL AS LONG) AS n_chars").limit(2))
    for frame in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SF).count() <= 20

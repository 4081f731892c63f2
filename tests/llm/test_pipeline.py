import re

import corpus_pipeline as C
from folioscan.llm import byte_bpe, exact_dedup, minhash_dedup, mixing, toxicity

SF = "/root/testdata/sf0.01"  # the smallest table with enough labels for a vocabulary


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "mixing", "byte_bpe"]
    from folioscan.llm import common

    for name, stage in C.STAGES:
        before = docs
        docs = common.materialise(stage(spark, before, SF), f"test-{name}")
        counts.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in toxicity.score(before, model).collect() if not r["predicted"]}
        elif name == "exact_dedup":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in exact_dedup.decide(before).collect() if r["kept"]}
        elif name == "minhash_dedup":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in minhash_dedup.link(before, percent=C.NEAR_PERCENT).collect() if r["kept"]}
        elif name == "mixing":
            assert counts[-1] == sum(r["copies"] for r in mixing.decide(mixing._sizes(before)).collect())
        else:
            assert counts[-1] == counts[-2] and sorted(map(tuple, docs.collect())) == sorted(map(tuple, byte_bpe.encode(before, *byte_bpe.tokenizer(), with_ids=True).collect()))
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_the_pipeline_returns_token_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    path, pattern = byte_bpe.tokenizer()
    codec, texts = byte_bpe.codec(path, pattern), {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = C.encode(spark, docs, SF).collect()
    assert len(rows) == len(texts) and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert all(codec.decode(r["ids"]).decode() == texts[r["doc_id"]] for r in rows)


def test_near_copies_go_at_eighty_percent(spark):
    """The stage against brute force at 0.8; and the documents of the given table that stay at 0.85."""
    from .test_minhash_dedup import brute, family

    rows = [(1000 * (k + 1) + i, t) for k in range(4) for i, t in enumerate(family(k, 20, 60 + 50 * k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {d for d, (_, _, kept) in brute(rows, 80).items() if kept}
    assert {r["doc_id"] for r in C.drop_near_copies(spark, docs, SF).collect()} == kept
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert not {255, 770, 875, 944} & {r["doc_id"] for r in C.drop_near_copies(spark, given, SF).collect()}


def test_odd_and_empty_documents_pass_every_stage(spark, odd, empty):
    """Nulls, repeated rows, ties, very long texts, extra columns of clashing names, and no rows at all."""
    from folioscan.llm import common

    for given in (odd, empty):
        docs = given
        for name, stage in C.STAGES:
            before = docs.count()
            out = common.materialise(stage(spark, docs, SF), f"odd-{name}")
            if name != "byte_bpe":
                assert out.schema.simpleString() == given.schema.simpleString()
            if name == "exact_dedup":
                assert out.count() == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()})
            if name == "byte_bpe":
                assert out.count() == before
            docs = out
        assert (docs.count() > 0) == (given is odd)


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    """Tables of the stages are deleted, what is returned can be read."""
    import os

    from folioscan.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert C.run(spark, SF).count() > 0
    assert [n.startswith("pipeline-byte_bpe") for n in os.listdir(f"{tmp_path}/folioscan")] == [True]

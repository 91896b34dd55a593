"""The registered queries on whole tables, against plain versions of the same."""

import sys
import zlib

import numpy as np
import pyarrow as pa

sys.path.insert(0, "tests/llm")
import corpus_pipeline
from retinaspark.llm import common, decontaminate, queries, simhash, surrogates, toxicity
from test_llm import brute_simhash, plain_surrogates
from test_pipeline import components

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}


def test_op1(spark):
    from tokenizers import Tokenizer

    t, docs, start = Tokenizer.from_file(queries.tokenizer_path()), documents(spark), 0
    got = {r["doc_id"]: r for r in queries.op1_token_ids(spark, SF).collect()}
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = np.array(t.encode(docs[i] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op2(spark):
    docs = common.table(spark, SF, "documents")
    of = {(r["kind"], r["canonical"]): r["surrogate"] for r in surrogates.assign(surrogates.entities(docs), "surrogates").collect()}
    texts, got = documents(spark), {r["doc_id"]: r["text"] for r in queries.op2_surrogates(spark, SF).collect()}
    assert got == {i: t and plain_surrogates(t, of) for i, t in texts.items()} and sum(got[i] != texts[i] for i in got) > 5


def test_op3(spark):
    fp = {i: brute_simhash(t) for i, t in documents(spark).items()}
    root = dict(components(fp, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2))
    least = {}
    for i, r in root.items():
        least[r] = min(i, least.get(r, i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", least[root[i]]) for i in fp}


def test_op6(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_op6_tells_toxic_texts_apart(spark):
    big = SF.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, big, "labels").where("toxic is not null").collect()}
    docs = common.table(spark, big, "documents")
    model = toxicity.train(docs, common.table(spark, big, "labels"))
    held = [r for r in toxicity.classify(docs.where(toxicity.held_out(docs["doc_id"])).select("doc_id", "text"), model).collect() if r["doc_id"] in labels]
    a, b = (np.array([r["score"] for r in held if labels[r["doc_id"]] == k]) for k in (1, 0))
    assert np.mean(a[:, None] > b[None, :]) > 0.97 and np.mean(a >= 0.3) > 0.8 and np.mean(b < 0.3) > 0.98


def test_op8(spark):
    """Every item is aligned to the whole of every text that shares three of its words."""
    docs, bench = documents(spark), common.table(spark, SF, "benchmark").collect()
    words = [decontaminate._words(pa.array([r["text"]], pa.string()))[0] for r in bench]
    want = {}
    for d, t in docs.items():
        text = decontaminate._words(pa.array([t], pa.string()))[0]
        own = {text[k: k + 3].tobytes() for k in range(len(text) - 2)}
        for r, w in zip(bench, words):
            if any(w[k: k + 3].tobytes() in own for k in range(len(w) - 2)):
                score = decontaminate.align(w, text)[0] / (2 * len(w))
                if score >= 0.5:
                    want[d, r["item_id"]] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.op8_decontamination(spark, SF).collect()}
    assert got == want and len(got) >= 3


def test_pipeline_is_its_stages(spark):
    rows = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "stage")
    assert rows == sorted(tuple(r) for r in docs.collect()) and len(rows) > 100


def test_pipeline_of_an_empty_table(spark):
    docs = common.written(common.table(spark, SF, "documents").limit(0), "none")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "none")
        assert docs.count() == 0
    assert simhash.cluster(common.table(spark, SF, "documents").limit(0)).count() == 0


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    assert queries.op7_substrings(spark, SF).count() == 200
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["spans"]

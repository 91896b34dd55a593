"""The pipeline's stages, each against what it must do on its own input, and the small queries against SQL."""

import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, "tests")
import __spark_entry__ as entry
import corpus_pipeline
from retinaspark.llm import common, decontaminate, queries
from test_llm import brute_simhash
from test_near import shingles, similar
from test_oracle import norm

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = common.table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = common.written(stage(spark, docs, SF), "stage")
        after = docs.toPandas()
        seen.append(name)
        if name != "tokenize":
            assert docs.columns == columns
        if name == "toxicity":
            score = queries.op6_toxicity(spark, SF).toPandas().set_index("doc_id")["predicted"]
            assert set(after["doc_id"]) == {i for i in before["doc_id"] if score[i] == 0}
        if name == "simhash":
            fp = {i: brute_simhash(t) for i, t in zip(before["doc_id"], before["text"])}
            left = [fp[i] for i in after["doc_id"]]
            assert all((a ^ b).bit_count() > 2 for k, a in enumerate(left) for b in left[:k])
            words = {i: shingles(t) for i, t in zip(before["doc_id"], before["text"])}
            stay = [words[i] for i in after["doc_id"]]
            assert not any(similar(a, b) for k, a in enumerate(stay) for b in stay[:k])
            # one of each group that fingerprints or shingles link, and all that nothing links
            root = dict(components(fp, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2 or similar(words[i], words[j])))
            assert {root[i] for i in after["doc_id"]} == set(root.values())
        if name == "decontaminate":
            found = {r["doc_id"] for r in decontaminate.find(common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")).collect()}
            assert set(after["doc_id"]) == set(before["doc_id"]) - found
            bench = common.table(spark, SF, "benchmark").toPandas()["text"]
            assert not any(b in t for t in after["text"] for b in bench) and len(after) > 0.8 * len(before)
        if name == "mix":
            mixed = after
        if name == "tokenize":
            assert sorted(after["doc_id"]) == sorted(mixed["doc_id"])
            after = after.sort_values("start")
            assert (np.cumsum(after["n_tokens"]) - after["n_tokens"] == after["start"]).all()
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(queries.tokenizer_path())
            text = dict(zip(mixed["doc_id"], mixed["text"]))
            for r in after.itertuples():
                ids = t.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2]
                assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert seen == ["toxicity", "simhash", "decontaminate", "mix", "tokenize"]


def components(fp, linked):
    ids, root = sorted(fp), {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(i, j):
                root[find(i)] = find(j)
    return [(i, find(i)) for i in ids]


def test_rows_with_clashing_names_and_nulls(spark):
    rows = [(None, "a b c d", "en", None, 7, "x"), (None, "a b c d", "en", None, 7, "x"), (1, None, None, "s", None, "y"), (1, "", "en", "s", 0, "z"), (2, "e f g h i", "en", "s", 9, "w")]
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string"), "odd")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "odd")
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)


def test_entry(spark):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert entry.entry(spark).count() > 0

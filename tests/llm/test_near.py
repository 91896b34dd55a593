"""Near copies by shingles, against all pairs."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from retinaspark.llm import common, near

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a and b) and 9 * len(a & b) >= 4 * (len(a) + len(b))


@pytest.mark.parametrize("crowd", [1, 24])
def test_near_copies(spark, crowd):
    rng = np.random.default_rng(3)
    texts = ["", " ", "one", "One", "two words"]
    for _ in range(12):
        base = [f"w{i}" for i in rng.integers(0, 5000, rng.integers(4, 120))]
        texts.append(" ".join(base))
        for n in range(8):
            w = list(base)
            for k in rng.integers(0, len(w), n):
                w[k] = "edit"
            texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    rows = common.written(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "t")
    gone = [r["id"] for r in near.copies(rows, crowd=crowd).collect()]
    s = [shingles(t) for t in texts]
    links = {i: [j for j in range(len(s)) if j != i and similar(s[i], s[j])] for i in range(len(s))}
    stay = set(range(len(s))) - set(gone)
    assert len(gone) == len(set(gone)) > 12 and not any(j in stay for i in stay for j in links[i])
    reached, todo = set(stay), list(stay)
    while todo:
        for j in links[todo.pop()]:
            if j not in reached:
                reached.add(j)
                todo.append(j)
    assert reached == set(range(len(s)))


def test_no_near_copies_pass_the_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = common.written(stage(spark, docs, SF), name)
    s = [shingles(r["text"]) for r in docs.select("text").collect()]
    assert not any(similar(a, b) for i, a in enumerate(s) for b in s[:i])


def _watched(monkeypatch):
    """Rows of every table that is written from now on, by its name."""
    rows, write = {}, common.written

    def written(df, name, stays=False):
        out = write(df, name, stays)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(common, "written", written)
    return rows


def test_texts_with_many_shingles_of_their_own_are_not_compared(spark, monkeypatch):
    """Two texts each have 40 words in common, and 60 of their own: the candidates grew faster than the table."""
    texts = [(i, " ".join([f"w{i}-{k}" for k in range(60)] + [f"s{i // 2}-{k}" for k in range(40)])) for i in range(300)]
    table = common.written(spark.createDataFrame(texts, "id long, text string"), "t")
    rows = _watched(monkeypatch)
    assert near.copies(table).count() == 0
    assert sum(rows["near-candidates"]) == 0 and rows["near-sharing"] == [0]


def test_candidates_are_compared_in_parts(spark, monkeypatch):
    base = [[f"w{i}-{k}" for k in range(60)] for i in range(40)]
    texts = [(i, " ".join(base[i // 5][: 60 - i % 5])) for i in range(200)]
    table = common.written(spark.createDataFrame(texts, "id long, text string"), "t")
    whole = sorted(r["id"] for r in near.copies(table).collect())
    monkeypatch.setattr(near, "LEAST_PAIRS", 100)
    rows = _watched(monkeypatch)
    assert sorted(r["id"] for r in near.copies(table).collect()) == whole == [i for i in range(200) if i % 5]
    assert max(rows["near-candidates"]) == 400 and len(rows["near-compared"]) > 4


def test_shingles_are_counted_in_all_texts(spark, monkeypatch):
    """A line that 30 texts have, none of them in a sample by even ids, comes after what two of them have."""
    line = [f"line{k}" for k in range(60)]
    odd = [(2 * i + 1, " ".join([f"w{i // 2}-{k}" for k in range(40)] + line + ["end"] * (i % 2))) for i in range(30)]
    even = spark.range(0, 80_000, 2).selectExpr("id", "concat('f', id div 4) AS text")
    table = common.written(even.union(spark.createDataFrame(odd, "id long, text string")), "t")
    rows = _watched(monkeypatch)
    assert near.copies(table, crowd=1000).where("id % 2 = 1").count() == 15
    assert sum(rows["near-candidates"]) == 20_000 + 15


def test_a_large_group_of_near_copies_is_not_compared_in_pairs(spark, monkeypatch):
    """400 copies, each with three of 30 places edited, few of them near the smallest: the rest was compared in pairs."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(400):
        w = list(base)
        for k in rng.integers(0, 30, 3) * 5:
            w[k] = f"edit{k}-{rng.integers(0, 2)}"
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    table = common.written(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "t")
    rows = _watched(monkeypatch)
    gone = {r["id"] for r in near.copies(table).collect()}
    s = [shingles(t) for t in texts]
    least = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if least[i] != least[j] and similar(s[i], s[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    assert gone == {i for i in range(len(s)) if least[i] != i} and len(gone) > 390
    assert sum(rows["near-candidates"]) < 40 * len(s)

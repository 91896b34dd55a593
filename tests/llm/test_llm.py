"""The operators against brute force, on small tables with every awkward case."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from retinaspark.llm import common, decontaminate, hashing, mixing, ngrams, queries, simhash, substrings, surrogates, tokens, topk, toxicity, warc
from retinaspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghiéß"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1.0, "k") for i, t in zip(ids, texts)], SCHEMA)


def awkward():
    """Texts with nulls, empties, copies, long ones, odd signs."""
    base = [prose(80) for _ in range(12)]
    return [None, "", " \n\t ", "a", "A b", *base, base[0], base[1] + " " + base[2], base[3][:300] + " x " + base[4], prose(30_000), " x y z", base[0].upper(), "z " * 500]


# 1: token ids

@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZ'sd .,!?\n\t  éñß²½中я  \x1c\x85ſƀ<|endoftext>9")), max_size=60))
def test_encoder_is_the_library(text):
    assert encoded(text) == ENCODER.whole(text)


def test_encoder_on_odd_first_words():
    for text in ["'sa b", "-foo bar", "1abc.", "'tis. we're", "a.b, c", ".", "9th x", "é. ß,", "it's, don't! x:y z;"]:
        assert encoded(text) == ENCODER.whole(text)


def test_encoder_on_columns_and_long_texts(monkeypatch):
    texts = ["", None, "a b", "a  b", " a", "a\n b", "a \u00a0b c", "x <|endoftext|> y", prose(4000), "é" * 3000, " ".join("ab" for _ in range(3000))]
    monkeypatch.setattr(tokens, "CHUNK", 500)
    monkeypatch.setattr(tokens, "BLOCK", 7)
    monkeypatch.setattr(tokens, "CACHE", 30)
    row = 0
    for ids, sizes, lo, hi in ENCODER.chunked(pa.array(texts, pa.string())):
        assert lo == row
        for part in np.split(ids, np.cumsum(sizes)[:-1]):
            assert part.tolist() == ENCODER.whole(texts[row] or "")
            row += 1
    assert row == len(texts)


def encoded(text):
    (ids, sizes, *_), = ENCODER.encode(pa.array([text]))
    assert sizes.tolist() == [len(ids)]
    return ids.tolist()


ENCODER = tokens.Encoder(queries.tokenizer_path())


@pytest.mark.parametrize("ids", [None, "mixed"])
def test_token_files_round_trip(spark, ids):
    texts = awkward()
    ids = [None, None, 5, 5] + list(range(100, 96 + len(texts))) if ids else None
    docs, out = table(spark, texts, ids), common.fresh_dir(spark, "t")
    tokens.write(docs, out, queries.tokenizer_path())
    got = tokens.read(spark, out, ids=True).orderBy("start").collect()
    assert len(got) == len(texts) and [r["key"] is not None for r in got] == sorted(r["key"] is not None for r in got)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    if ids is None:
        for r, t in zip(got, texts):
            assert r["ids"][:-1] == ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids
    out = common.fresh_dir(spark, "t")
    tokens.write(docs.limit(0), out, queries.tokenizer_path(), width=4)
    assert tokens.read(spark, out).count() == 0


# 2: surrogates

def test_surrogates(spark):
    texts = ["Mr. John Smith wrote to Mrs. Anna Smith at a.b@x.org, A.B@X.ORG.", "card 4111 1111 1111 1111 or 4111111111111111", "+1 (743) 555-3824 and +17435553824; 10.0.0.1", None, "", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "nothing 12 here 3.14", "Госпожа Анна Петрова"]
    got = {r["doc_id"]: r for r in surrogates.replace(table(spark, texts)).collect()}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[6]["text"] == texts[6] and got[6]["n_entities"] == 0
    for i, gone in ((0, ["Smith", "a.b@x.org"]), (1, ["4111"]), (2, ["555", "10.0.0.1"]), (5, ["24be64439e3e49cf"]), (7, ["Анна"])):
        assert not any(g in got[i]["text"] for g in gone)
        assert len(got[i]["text"].split()) == len(texts[i].split())
    a, b = got[1]["text"].split(" or ")
    assert a.replace("card ", "").replace(" ", "") == b and spark.sql(f"select luhn_check('{b}')").first()[0]
    words = got[0]["text"].replace(",", "").rstrip(".").split()
    assert words[2] == words[7] and words[6].endswith("na") and words[9].upper() == words[10]
    phone, other = got[2]["text"].split(";")[0].split(" and ")
    assert "".join(c for c in phone if c.isdigit()) == other[1:]


def test_surrogates_collide_and_are_drawn_again(spark):
    # five entities for 223 * 254 * 65536 addresses don't collide; short local parts at one host do
    texts = [" ".join(f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz")]
    out = surrogates.replace(table(spark, texts)).first()["text"].split()
    assert len(set(out)) == 26
    table_ = surrogates.assign(surrogates.entities(table(spark, texts)), "k")
    assert table_.count() == 26 and table_.select("surrogate").distinct().count() == 26 and table_.where("attempt > 0").count() > 0


def test_surrogates_of_many_surnames(spark):
    # more than 16 ** 3 of a script; a name is the same family's after any title
    names = ["".join("abcdefghijklmnop"[i >> k & 15] for k in (0, 4, 8, 12)) for i in range(20_000)]
    texts = [" ".join(f"{title} {n.capitalize()}," for n in names) for title in ("Mr", "Ms")] + ["Mr Zzz alone"]
    found = surrogates.assign(surrogates.entities(table(spark, texts)), "k")
    assert found.count() == found.select("surrogate").distinct().count() == 20_001
    rows = surrogates.replace(table(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows[:2], texts):
        out = r["text"].replace(",", "").split()
        assert out[::2] == t.split()[::2] and len(set(out[1::2])) == 20_000 and r["n_entities"] == 20_000
    assert rows[0]["text"].replace("Mr ", "Ms ") == rows[1]["text"] and rows[2]["n_entities"] == 1


def plain_surrogates(text, of):
    """Brute force: each match replaced by what ``of`` has for its entities."""
    def one(m):
        m = m.group()
        if "@" in m:
            s = of["email", m.lower()]
            return s.upper() if m.isupper() else s
        if regex.fullmatch(r"[0-9a-fA-F]{32,}", m):
            s = of["secret", m.lower()]
            return s.upper() if m.isupper() else s
        if regex.fullmatch(r"[0-9.]+", m) and "." in m:
            return of["ip", m]
        for kind, shape, kept in (("iban", r"[A-Z]{2}\d\d.*", r"[0-9A-Z]"), ("phone", r"[+(].*", r"[0-9+]"), ("ssn", r"\d{3}-\d{2}-\d{4}", r"\d"), ("card", r"[\d -]{13,}", r"\d")):
            if regex.fullmatch(shape, m):
                s = iter(of[kind, "".join(regex.findall(kept, m))])
                return "".join(next(s) if regex.match(kept, c) else c for c in m)
        head = regex.match(r"\S+ (?:\p{Lu}\. ?){0,2}", m).group()
        names = m[len(head):].split(" ")
        title = regex.match(r"[^\s.]+", m).group().lower()
        woman = title in {"mrs", "ms", "miss", "frau", "señora", "sra", "madame", "mme", "госпожа"} or title in {"dr", "prof", "доктор"} and names[0].lower()[-1] in "aая"
        out = [of["family", names[-1].lower()]]
        if len(names) > 1:
            out.insert(0, of["given", ("f " if woman else "m ") + names[0].lower()][2:])
        return head + " ".join(s.upper() if n.isupper() else s.capitalize() for s, n in zip(out, names))

    return regex.sub(surrogates.PATTERN, one, text)


def test_surrogates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    people = ["Dr. Anna Jones", "Mrs Anna JONES", "MR. JOHN SMITH", "mr John Smith", "Mr. J. Smith", "Prof Jean-Luc O'Neil", "Frau Weiß", "Доктор Иван Петров", "MS Word"]
    ibans = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00370400440532013000"]
    others = ["a@b.org", "B@b.org", "C@B.ORG", "10.1.2.3", "192.168.0.1", "123-45-6789", "4111 1111 1111 1111", "+1 (743) 555-3824", "0123456789abcdef0123456789ABCDEF"]
    texts = [" ".join(rng.choice(people + ibans + others + [f"{c}@b.org" for c in "abcdefghijklmnopqrstuvwxyz"] + ["and", "the,"], 40)) for _ in range(12)] + ["clean", None, ""]
    docs = table(spark, texts)
    found = surrogates.assign(surrogates.entities(docs), "surrogates").collect()
    of = {(r["kind"], r["canonical"]): r["surrogate"] for r in found}
    assert len({(r["kind"], r["surrogate"]) for r in found}) == len(found) and not {(k, s) for (k, _), s in of.items()} & set(of)
    assert any(r["attempt"] for r in found)
    for r in surrogates.replace(docs).collect():
        t = texts[r["doc_id"]]
        assert r["text"] == (t and plain_surrogates(t, of)) and r["n_entities"] == len(regex.findall(surrogates.PATTERN, t or ""))
    for iban in ibans:
        c = iban.replace(" ", "")
        s = of["iban", c]
        valid = [int("".join(str(int(x, 36)) for x in n[4:] + n[:4])) % 97 == 1 for n in (c, s)]
        assert valid[0] == valid[1] and s[:2] == c[:2] and len(s) == len(c)


def test_surrogates_run_no_python(spark):
    plan = surrogates.replace(table(spark, ["a@b.org"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = surrogates.replace(table(spark, [" ".join(f"{c}@b.org" for c in "abcdefghijklmnopqrstuvwxyz")]))._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Python" not in plan and "Arrow" not in plan


def test_surrogates_of_odd_tables(spark):
    docs = table(spark, ["write to a@b.org", None]).withColumn("n_entities", F.lit("mine")).withColumn("Found_", F.lit(1))
    got = surrogates.replace(docs)
    assert got.columns == docs.columns + ["_n_entities"]
    rows = got.orderBy("doc_id").collect()
    assert [r["n_entities"] for r in rows] == ["mine", "mine"] and [r["_n_entities"] for r in rows] == [1, 0]
    assert surrogates.replace(docs.limit(0)).collect() == []
    long = "x " * 300_000 + "a@b.org"
    a, b = surrogates.replace(table(spark, [long, long])).collect()
    assert a["text"] == b["text"] != long and a["text"][:600_000] == long[:600_000]


# 3: simhash

def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowd", [48, 2])
def test_simhash_components(spark, crowd, monkeypatch):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes: links(nodes, crowd=crowd))
    long = [prose(900).split() for _ in range(3)]
    texts = awkward() + [" ".join(w[:i] + ["q"] + w[i:]) for w in long for i in range(0, 900, 60)]
    ids = list(range(len(texts)))
    ids[7] = ids[8] = 50
    got = simhash.cluster(table(spark, texts, ids)).toPandas()
    fp = [brute_simhash(t) for t in texts]
    assert sorted(got["fp"].to_numpy().view(np.uint64).tolist()) == sorted(fp)
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    want = {}
    for i, d in enumerate(ids):
        want[find(i)] = min(want.get(find(i), d), d)
    assert sorted(zip(got["doc_id"], got["component_id"])) == sorted((d, want[find(i)]) for i, d in enumerate(ids))
    assert len(want) < len(set(fp))


def test_simhash_empty_and_null_ids(spark):
    assert simhash.cluster(table(spark, ["a"]).limit(0)).count() == 0
    got = simhash.cluster(table(spark, ["", None, "x"], [None, 4, None])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["fp"] == 0 and r["doc_id"]) == [(4, 4)]


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(chain.union(spark.createDataFrame([(900, 901), (901, 900), (7, 7)], "a long, b long")))
    assert got.count() == 303 and {r["root"] for r in got.collect()} == {0, 900}


# 4: top-k

def test_topk_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6)).astype(np.float32)
    v[50:120] = v[0]
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(None, [1.0] * 6), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [1.0, 2.0]), (200, [9.0] * 6), (400, []), (500, [1e30] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    got = topk.search(df, df.where("vec_id % 100 = 0")).toPandas()
    ok = [(i, np.floor(1024 * np.array(r, np.float32).astype(float))) for i, r in data if i is not None and r is not None and None not in r and not np.isnan(r).any()]
    for q, qv in ((i, r) for i, r in ok if i in (0, 100, 300, 400)):
        want = sorted((-int(qv @ c), j) for j, c in ok if j != q and len(c) == len(qv) and abs(c).max(initial=0) < 1e9)
        mine = got[(got["query_id"] == q)].sort_values("rank")
        mine = [(s, i) for i, s in zip(mine["vec_id"], mine["score"]) if i != 500]
        assert [(-s, i) for s, i in mine] == want[: len(mine)] and len(mine) >= min(9, len(want))
    assert (got[got["query_id"] == 500]["score"] <= 2**63 - 1).all()
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


# 5: LM scores

def brute_lm(texts, order=2, min_count=2):
    from collections import Counter

    docs = [(t or "").encode().split() for t in texts]
    c = [Counter(tuple(d[i: i + k]) for d in docs for i in range(len(d) - k + 1)) for k in range(1, order + 1)]
    total = sum(c[0].values())
    for k in range(1, order):
        c[k] = Counter({g: n for g, n in c[k].items() if n >= min_count})
    out = []
    for d in docs:
        s = 0.0
        for i in range(len(d)):
            back = 0
            for k in range(min(order, i + 1), 1, -1):
                g = tuple(d[i - k + 1: i + 1])
                if c[k - 1][g]:
                    s += np.log10(c[k - 1][g] / c[k - 2][g[:-1]])
                    break
                back += 1
            else:
                s += np.log10(c[0][(d[i],)] / total)
            s += back * np.log10(0.4)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("order,min_count", [(1, 2), (2, 2), (3, 2), (3, 1), (4, 3)])
def test_lm_scores(spark, order, min_count):
    texts = awkward()
    got = {r["doc_id"]: r for r in ngrams.score(table(spark, texts), order=order, min_count=min_count).collect()}
    for i, (n, s) in enumerate(brute_lm(texts, order, min_count)):
        assert got[i]["n_words"] == n and got[i]["log10_score"] == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert (got[i]["mean_log10"] is None) == (n == 0)


def test_lm_of_many_chunks_and_ranges(spark, monkeypatch):
    texts = awkward() + [prose(200) for _ in range(40)]
    monkeypatch.setattr(ngrams, "CHUNK", 2000)
    monkeypatch.setattr(ngrams, "PER_RANGE", 3000)
    got = {r["doc_id"]: r for r in ngrams.score(table(spark, texts)).collect()}
    for i, (n, s) in enumerate(brute_lm(texts, 3)):
        assert got[i]["n_words"] == n and got[i]["log10_score"] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_lm_other_corpus_and_empty(spark):
    corpus, docs = table(spark, ["a b a b"]), table(spark, ["a b", "q"])
    got = {r["doc_id"]: r["log10_score"] for r in ngrams.score(docs, corpus).collect()}
    assert got[0] == pytest.approx(np.log10(2 / 4) + np.log10(2 / 2)) and got[1] == pytest.approx(np.log10(1 / 4))
    assert ngrams.score(docs.limit(0)).count() == 0


# 6: toxicity

def test_toxicity_learns_and_scores_whole_texts(spark):
    rng = np.random.default_rng(2)
    bad = ["snarfle", "grobnak"]
    texts, toxic = [], []
    for i in range(400):
        t = prose(60, rng).split()
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            t.insert(rng.integers(0, 60), bad[i % 2])
        texts.append(" ".join(t))
    texts += [None, "", prose(20_000, rng) + " snarfle", "grobnak " + prose(40, rng)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["s2"] for r in toxicity.classify(docs, model, score_col="s2").collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == bool(toxic[i]) for i in held]) > 0.97
    assert got[403] > 0.3 and got[400] == got[401] < 0.3
    # the last word of a long text counts as much as any
    short = toxicity.score(model, pa.array([texts[402].removesuffix(" snarfle")]))[0]
    logit = lambda p: np.log(p / (1 - p))
    assert logit(got[402]) - logit(short) > 1
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert [i for i in range(400) if flags[i]] == held
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(none, pa.array(["x", None])).max() < 1e-6


def test_long_and_odd_texts_score_alike(spark, monkeypatch):
    rng = np.random.default_rng(31)
    texts = [prose(40, rng) + (" awful nasty words" if i % 3 == 0 else "") for i in range(90)]
    model = toxicity.fit(pa.array(texts), np.array([float(i % 3 == 0) for i in range(90)]))
    long = prose(3000, rng) + " awful nasty words " + prose(3000, rng)
    whole = toxicity.score(model, pa.array([long, "", None]))
    monkeypatch.setattr(toxicity, "_CHUNK", 512)
    assert toxicity.score(model, pa.array([long, "", None])) == pytest.approx(whole)
    got = toxicity.classify(table(spark, [long, long, None]).withColumn("_SCORE", F.lit(1)), model)
    assert got.columns[-1] == "__score" and got.drop("n_chars").count() == 3
    a, b, c = [r["__score"] for r in got.orderBy("doc_id").collect()]
    assert a == b == pytest.approx(whole[0]) and c == pytest.approx(whole[1])
    assert toxicity.classify(table(spark, [long]).limit(0), model).count() == 0


# 7: substrings

def brute_substrings(ids, texts, window):
    docs = [(t or "").encode().split() for t in texts]
    first = {}
    for i, d in zip(ids, docs):
        for j in range(len(d) - window + 1):
            k = tuple(d[j: j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, d in zip(ids, docs):
        gone = [False] * len(d)
        for j in range(len(d) - window + 1):
            if first[tuple(d[j: j + window])] < i:
                gone[j: j + window] = [True] * window
        out.append((i, len(d), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 8])
def test_substrings(spark, window):
    rng = np.random.default_rng(window)
    passages = [prose(window + k, rng) for k in (0, 1, 5, 30)]
    texts = awkward()
    for _ in range(60):
        parts = [prose(rng.integers(1, 40), rng)]
        for _ in range(rng.integers(1, 4)):
            w = passages[rng.integers(4)].split()
            if rng.random() < 0.4:
                w[rng.integers(len(w))] = "edit"
            parts += [" ".join(w[rng.integers(0, 3):]), prose(rng.integers(0, 9), rng)]
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-2] + " tail", "r " * 300, "r " * 290]
    ids = [int(i) for i in rng.permutation(len(texts))]
    ids[3] = ids[40]
    got = substrings.dedup(table(spark, texts, ids), window=window).collect()
    assert sorted((r["key"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_substrings(ids, texts, window)
    for r in got:
        assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
    assert substrings.dedup(table(spark, texts).limit(0)).count() == 0


def test_anchors_are_minima():
    g = RNG.integers(0, 50, 200).astype(np.uint64)
    for span in (1, 2, 3, 7, 26, 300):
        n = max(1, len(g) - span + 1)
        assert substrings.anchors(g, span).tolist() == sorted({i + int(g[i: i + span].argmin()) for i in range(n)})


# 8: decontamination

def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    for _ in range(40):
        a, b = RNG.integers(0, 4, RNG.integers(1, 15)), RNG.integers(0, 4, RNG.integers(1, 25))
        score, start, end = decontaminate.align(a, b)
        assert score == brute_align(a, b) == brute_align(a, b[start:end])
        if score:
            # it starts and ends with words that agree; of equal alignments others may be shorter
            assert b[start] in a and b[end - 1] in a


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    items = [prose(25, rng).replace("ß", "s") for _ in range(6)] + [None, "", "two words"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, score string")
    edited = items[1].split()
    edited[6], edited[15] = "changed", "again"
    del edited[20]
    texts = [prose(100, rng), prose(50, rng) + " " + items[0].upper() + "! " + prose(50, rng), prose(10, rng) + " " + " ".join(edited), None, "", prose(9000, rng) + " " + items[2], items[3] + " " + items[3], "here are two, words."]
    got = decontaminate.find(table(spark, texts), bench, block=4).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
    assert set(found) == {(1, 0), (2, 1), (5, 2), (6, 3), (7, 8)} and len(got) == 5
    assert found[1, 0] == 1 and 0.6 < found[2, 1] < 1
    assert decontaminate.find(table(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.find(table(spark, texts), bench.limit(0)).count() == 0


def brute_find(ids, texts, items, threshold=0.5):
    """Every item against every text; items share a seed of three words with what they are found in."""
    words = lambda t: regex.sub(r"[!-/:-@\[-`{-~\x00-\x1f]", " ", (t or "").lower()).split()
    out = []
    for d, t in zip(ids, texts):
        t = words(t)
        seeds = {tuple(t[k: k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1)}
        for i, item in items:
            w = words(item)
            n = min(3, len(w))
            if w and any(tuple(w[k: k + n]) in seeds for k in range(len(w) - n + 1)):
                score = brute_align(w, t) / (2 * len(w))
                if score >= threshold:
                    out.append((d, i, score))
    return out


@pytest.mark.parametrize("pairs", [1 << 20, 5])
def test_decontamination_against_brute_force(spark, monkeypatch, pairs):
    rng = np.random.default_rng(21)
    items = [(f"item {i}", prose(int(rng.integers(1, 40)), rng).replace("ß", "s")) for i in range(12)]
    items += [("copy", items[0][1]), ("null", None), ("empty", " "), (None, items[1][1])]
    texts = [None, "", "one"]
    for _ in range(30):
        parts = [prose(int(rng.integers(0, 30)), rng)]
        for _ in range(rng.integers(0, 3)):
            w = items[int(rng.integers(12))][1].split()
            for _ in range(rng.integers(0, 1 + len(w) // 3)):
                k = int(rng.integers(len(w)))
                w[k: k + 1] = [["other"], [], [w[k], "more"]][rng.integers(3)]
            parts += [" ".join(w).upper() if rng.random() < 0.3 else ", ".join(w), prose(int(rng.integers(0, 30)), rng)]
        texts.append(" ".join(parts))
    ids = [*range(len(texts) - 1), 3]
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find(table(spark, texts, ids), bench, block=9).collect()
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted([(r["doc_id"], r["item_id"], r["score"]) for r in got], key=key) == sorted(brute_find(ids, texts, [x for x in items if x[0]] + [(None, items[1][1])]), key=key)
    assert len(got) > 20 and {type(r["item_id"]) for r in got} == {str, type(None)}
    none = decontaminate.find(table(spark, texts), bench.limit(0))
    assert none.count() == 0 and none.schema["item_id"].dataType.simpleString() == "string"


def test_decontamination_by_parts():
    rng = np.random.default_rng(2)
    texts = [prose(30, rng) for _ in range(20)]
    items = decontaminate.Items([t[: len(t) // 2] for t in texts], 3)
    hashes, first = decontaminate._words(pa.array(texts))
    whole = [*decontaminate._found(items, hashes, first, 0.5)]
    for pairs in (1, 7, 40):
        decontaminate.PAIRS, kept = pairs, decontaminate.PAIRS
        try:
            assert [*decontaminate._found(items, hashes, first, 0.5)] == whole
        finally:
            decontaminate.PAIRS = kept
    assert len(whole) >= 20


def test_decontamination_says_where(spark):
    item = " ".join(f"q{i}" for i in range(10))
    copy = item.replace("q5", "q5 x y").split()
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    r = decontaminate.find(table(spark, ["a b c d " + " ".join(copy) + " e f"]), bench).first()
    assert (r["first_word"], r["end_word"], r["item_id"]) == (4, 16, 7)


def test_decontamination_of_many_edited_copies(spark):
    rng = np.random.default_rng(8)
    item = [f"q{i}" for i in range(40)]
    edited = " ".join("other" if i % 4 == 3 else w for i, w in enumerate(item))
    texts = [prose(20, rng) + " " + edited for _ in range(260)] + [prose(60, rng) + " q0 q1 q2 " + prose(60, rng)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = decontaminate.find(table(spark, texts), bench).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(260)) and {r["score"] for r in got} == {51 / 80}


# 9: WARC

def test_warc(spark, tmp_path):
    big, other = "x" * 200, "é" * 60
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "n", big), (7, "u", other), (8, "v", other), (9, "w", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows + [(7, "u", other)], "page_id long, url string, html string").repartition(3)
    out = common.fresh_dir(spark, "w")
    warc.archive(pages, out)
    got = warc.read(spark, out).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r["key"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"]))
    assert kinds[1] == [("response", None, 200)] and kinds[2] == [("revisit", 1, 200)] and kinds[3] == [("revisit", 1, 200)] and kinds[None] == [("revisit", 1, 200)]
    assert kinds[4][0][0] == kinds[5][0][0] == "response" and kinds[6] == [("response", None, 0)]
    assert sorted(kinds[7], key=str) == [("response", None, 120), ("revisit", 7, 120)] and kinds[8] == [("revisit", 7, 120)]
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r["payload_digest"] == hashlib.sha256(payload[r["key"]]).hexdigest() for r in got)
    # archives with copies are resolved and written again
    again = common.fresh_dir(spark, "w")
    warc.archive(warc.records(spark, out), again)
    back = {(r["page_id"], bytes(r["html"])) for r in warc.records(spark, again).collect()}
    assert back == {(k, v) for k, v in payload.items()}
    empty = common.fresh_dir(spark, "w")
    warc.archive(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_of_others(spark, tmp_path):
    import base64
    import gzip

    def made(kind, url, block, *more, type_="application/http; msgtype=response"):
        head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Target-URI", url), ("Content-Type", type_), *more, ("Content-Length", len(block))])
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"

    body, http = b"y" * 300, b"HTTP/1.1 200 OK\r\nX: z\r\n\r\n"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    text = b"plain " * 40
    plain = made("warcinfo", "i", b"software: q", type_="application/warc-fields") + made("response", "a", http + body, ("WARC-Payload-Digest", sha1)) + made("request", "a", b"GET / HTTP/1.1\r\n\r\n")
    packed = [made("revisit", "b", http, ("WARC-Payload-Digest", sha1)), made("response", "c", http + body, ("WARC-Payload-Digest", sha1)), made("resource", "d", text, type_="text/plain"), made("revisit", "e", http, ("WARC-Payload-Digest", "sha1:" + "A" * 32)), made("response", "f", http, ("WARC-Payload-Digest", "md5:00"))]
    (tmp_path / "one.warc").write_bytes(plain)
    (tmp_path / "two.warc.gz").write_bytes(b"".join(map(gzip.compress, packed)))
    got = {r["url"]: r for r in warc.read(spark, f"file://{tmp_path}", payloads=True).collect()}
    assert set(got) == set("abcdef") and all(r["key"] is None for r in got.values())
    assert [got[u]["record_type"] for u in "abcdef"] == ["response", "revisit", "response", "response", "revisit", "response"]
    assert bytes(got["b"]["payload"]) == body and got["b"]["payload_digest"] == hashlib.sha256(body).hexdigest() and got["b"]["payload_bytes"] == 300
    assert bytes(got["d"]["payload"]) == text and got["f"]["payload_bytes"] == 0
    assert got["e"]["payload"] is None and got["e"]["payload_digest"] == "00" * 20
    (tmp_path / "bad.warc").write_bytes(made("response", "a", http + b"other", ("WARC-Payload-Digest", sha1)))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_warc_keys_of_any_text(spark):
    pages = spark.createDataFrame([("None", "u", "x" * 200), ("a", "u", "x" * 200), (None, "u", "y")], "page_id string, url string, html string")
    out = common.fresh_dir(spark, "w")
    warc.archive(pages, out)
    got = {r["key"]: (r["record_type"], r["refers_to"]) for r in warc.read(spark, out, key_type="string").collect()}
    assert got == {"None": ("response", None), "a": ("revisit", "None"), None: ("response", None)}


# 10: mixing

def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1], 24, 2) == pytest.approx([15, 6, 3])
    assert mixing.targets([1, 10, 10], [5, 2, 1], 24, 2) == pytest.approx([2, 14 + 2 / 3, 7 + 1 / 3])
    assert sum(mixing.targets([1, 1, 1], [5, 2, 1], 100, 2)) == 6 and mixing.targets([0, 4], [1, 1], 6, 2) == [0, 6]


def test_mixing(spark):
    texts = [prose(int(n)) for n in RNG.integers(1, 200, 600)] + [None, "", " "]
    docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    got = mixing.plan(docs).toPandas()
    assert got["size"].tolist() is not None and (got["taken"] <= 2 * got["size"]).all() and len(got) == len(texts)
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), told=("source_size", "first"))
    assert (by["size"] == by["told"]).all() and by["target"].sum() == pytest.approx(1.5 * by["size"].sum())
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"]).all()
    again = mixing.plan(docs.repartition(7), bucket_rows=50).toPandas().sort_values("key")
    assert (again["taken"].to_numpy() == got.sort_values("key")["taken"].to_numpy()).all()
    placed = mixing.placed(docs)
    assert placed.columns == docs.columns and placed.count() == got["copies"].sum()
    assert mixing.plan(docs.limit(0)).count() == 0
    plan = mixing.plan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_weighed_sources_are_the_steps(spark):
    rng = np.random.default_rng(12)
    for share, most in ((1.5, 2.0), (0.4, 1.0), (3.0, 2.0), (1.9, 2.0)):
        sizes = {name: int(n) for name, n in zip([f"s{i}" for i in range(40)] + [None, "", "é", "z"], rng.choice([0, 1, 5, 40, 1000, 30_000], 44))}
        rows = spark.createDataFrame(list(sizes.items()), "source string, n long")
        got = mixing.weighed(rows, (5.0, 2.0, 1.0), share, most).orderBy("sid").collect()
        names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
        assert [r["source"] for r in got] == names and [r["sid"] for r in got] == list(range(44))
        want = mixing.targets([sizes[n] for n in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(44)], share * sum(sizes.values()), most)
        assert [r["target"] for r in got] == pytest.approx(want)


def brute_mix(rows, target, most=2):
    """Copies of one source's rows (h, key, size), as the module says."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    total = sum(r[2] for r in rows)
    whole = int(target // total) if total else 0
    rest, before, front, across = target - whole * total, 0, [], None
    if whole >= most:
        return [(r[1], whole) for r in rows]
    for i, (_, _, n) in enumerate(rows):
        if before + n <= rest:
            front.append(i)
        elif before < rest:
            across = i
        before += n
    gap, filled, filler = rest - sum(rows[i][2] for i in front), 0, []
    for i, (_, _, n) in enumerate(rows):
        if i not in set(front) and i != across and n <= gap / 8:
            if filled + n / 2 < gap:
                filler.append(i)
            filled += n
    by_across = abs(gap - (rows[across][2] if across is not None else 0)) < abs(gap - sum(rows[i][2] for i in filler))
    extra = set(front) | ({across} - {None} if by_across else set(filler))
    return [(r[1], whole + (i in extra)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("bucket_rows", [2000, 20])
def test_mixing_against_brute_force(spark, bucket_rows):
    rng = np.random.default_rng(bucket_rows)
    texts = [prose(int(n), rng) for n in rng.integers(1, 120, 500)] + [None, "", " "]
    docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 11 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    got = mixing.plan(docs, bucket_rows=bucket_rows).toPandas()
    for source, rows in got.groupby("source", dropna=False):
        want = brute_mix(list(zip(rows["h"], rows["key"], rows["size"])), rows["target"].iloc[0])
        assert dict(want) == dict(zip(rows["key"], rows["copies"]))
        assert (rows["positions"].map(len) == rows["copies"]).all()


def test_positions_invert_the_schedule(spark):
    for schedule in mixing.SCHEDULES:
        for asked in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
            t = spark.range(1).select(mixing._time(F.lit(asked), schedule)).first()[0]
            grid = np.linspace(0, t, 20_001)
            full = np.linspace(0, 1, 20_001)
            f = lambda x: np.interp(x, *zip(*schedule))
            assert np.trapezoid(f(grid), grid) / np.trapezoid(f(full), full) == pytest.approx(asked, abs=1e-6)


# helpers

def test_word_hashes_are_words():
    texts = awkward()
    hashes, first, starts, ends, data = hashing.batch_words(pa.array(texts))
    words = [w for t in texts for w in (t or "").encode().split()]
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == words
    assert np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    for n in (1, 2, 8, 9, 25):
        g = hashing.grams(hashes, n)
        seen = {}
        for i in range(0, len(g), 3):
            assert seen.setdefault(tuple(words[i: i + n]), g[i]) == g[i]
        assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = pa.array(awkward())
    whole, grams = hashing.batch_words(texts)[0], hashing.grams(hashing.batch_words(texts)[0], 25)
    monkeypatch.setattr(hashing, "_PIECE", 64)
    assert (hashing.batch_words(texts)[0] == whole).all() and (hashing.grams(whole, 25) == grams).all()

"""Brute-force checks of the ten operators on small tables, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from reachlight.llm import bpe, decontaminate, licenses, line_dedup, minhash, pii, queries, sharding, topk, toxicity, url_filter

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_chars long, score string, id int, a int, hits int"
LONG = " ".join(f"word{i} thing{i * 7 % 101}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, None), (1, ""), (2, "Released under the MIT License. 4539 1488 0343 6467 x"), (3, "mit license mit license"), (4, LONG), (5, LONG), (6, LONG + " tail"), (7, "<|endoftext|> café \U0001f600  a　b\x1c"), (8, "one"), (8, "one"), (9, "z" * 3000)]
    return spark.createDataFrame([(i, t, "en", None, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def test_bpe(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(bpe.default_path()))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.encode_decode(docs).collect()
    assert len(got) == 11
    for r in got:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, LONG[:200]), (2, None), (3, ""), (4, "nothing like this stands anywhere in these texts")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).collect()} == {(4, 1, 0), (5, 1, 0), (6, 1, 0)}
    item = decontaminate.normal(LONG[:200])
    assert decontaminate.Index([(1, item)]).find("xx " + item[:90] + "q" + item[92:] + " yy")[0][3] <= 2
    assert decontaminate.drop_leaks(docs, bench).count() == 8


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (4, 2, 0, 2, "mit")
    assert got[0].n_words == 0 and got[0].labels == "" and got[0].first_word is None
    assert got[2].labels == "mit" and 0 < got[2].score < 1


def test_line_dedup(spark, docs):
    same = spark.createDataFrame([(1, f"Own first line here.\n{LONG}\nlast"), (2, f"Another begin line.\n{LONG}\nother end"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(same).collect()}
    assert LONG in got[1] and LONG not in got[2] and "Another begin" in got[2] and got[3] is None
    assert {r.doc_id for r in line_dedup.dedup_lines(docs).collect()} == {0, 1, 2, 3, 4, 6, 7, 8, 9}


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"{D}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(d, labels)
    assert model.score("you idiot, you worthless clown") > 0.5 > model.score("") and toxicity.score(d, model).count() == d.count()
    assert toxicity.train(d.limit(0), labels).score("idiot") > 0.5


def test_pii(docs):
    a = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", a[2].text)
    assert card and "4539 1488" not in a[2].text and a[0].text is None and a[4].text == LONG and a[2].kinds == "card"


def test_feistel_is_a_permutation(spark):
    got = [r[0] for r in spark.range(1000).selectExpr("lpad(id, 3, '0') as s").select(pii.permute_digits(pii.F.col("s"), "k", "t")).collect()]
    assert sorted(got) == [f"{i:03d}" for i in range(1000)]


def test_minhash(spark):
    rng, base = random.Random(3), [f"w{i}" for i in range(80)]
    texts = [None, "", "one two", "One  two"] + [" ".join(base[:k] + [str(rng.random())] + base[k:] if k % 3 else base) for k in range(12)] + [" ".join(rng.choices("abcdefgh", k=40)) for _ in range(10)]
    got = {r.doc_id: r for r in minhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    root[i] = min(root[i], root[j])
    assert [got[i].component_id for i in range(len(texts))] == root and [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_sharding(docs):
    got = sharding.shard(docs).collect()
    assert len(got) == 11 and all(r.grown_shard in (r.shard, 8) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    m = sharding.rebalanced(sharding.slot_map(4), {0: 100, 4: 100, 8: 100, 1: 10})
    assert m["version"] == 2 and m["slots"] != sharding.slot_map(4)["slots"]


def test_urls(spark):
    rows = [(1, "http://A.example.NET/en/x?y"), (2, "http://example.net/e"), (3, None), (4, "x"), (5, "https://q.org/fr/"), (6, "http://net?z"), (7, "http://a.example.com/de/1#f")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: ("example.com/de/", "block")}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for n in ("embeddings", "pages"):
        con.sql(f"create view {n} as select * from '{D}/{n}.parquet'")
    want = con.sql(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, D).toPandas()[want.columns]
    rows = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_topk_edges(spark):
    rows = [(0, [1.0, -0.5]), (1, [1.0, float("nan")]), (2, None), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [None, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 3, 16384), (0, 2, 3, 16384)]


def test_empty(docs):
    none = docs.limit(0)
    assert bpe.encode_decode(none).count() == licenses.scan(none).count() == minhash.near_components(none).count() == sharding.shard(none).count() == line_dedup.dedup_lines(none).count() == 0

"""Operators against brute force: pairs, recall, spans, groups that hold much of a table, and cases that are easy to get wrong."""

import random
import re
import zlib
from collections import Counter

import pytest

from reachlight.llm import bpe, decontaminate, license_rules, licenses, line_dedup, minhash, pii, sharding, topk, toxicity, url_filter

D = "/root/testdata/sf0.01"
TEXT = "doc_id long, text string, lang string, n_chars long, root string, rep int, a int, b int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, "r", 1, 2, 3) for i, t in rows], TEXT)


def shingle_set(t, k):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(texts, k, num, den):
    """Component (least index) of each text by all pairs."""
    sets, root = [shingle_set(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [find(i) for i in range(len(texts))]


def test_near_groups(spark):
    """A hot group of copies with more and more words changed, and a family of few words whose members mostly do not link."""
    rng, base = random.Random(8), [f"w{k}" for k in range(120)]
    texts = [None, "", "one"]
    for _ in range(220):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(120)] = f"x{rng.randrange(1 << 30)}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choices("abcd", k=60)) for _ in range(120)] + texts[3:40]
    got = {r.doc_id: r for r in minhash.near_components(frame(spark, enumerate(texts))).collect()}
    assert [got[i].component_id for i in range(len(texts))] == linked(texts, 3, 85, 100)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingle_set(t, 3)) for t in texts]


def test_near_ids(spark):
    """Texts that share an id are told apart, null ids link, one row of each component stays."""
    a, b = (" ".join(f"{s}{k}" for k in range(60)) for s in "ab")
    rows = [(5, a), (5, b), (7, a + " end"), (9, b + " end"), (9, b + " end"), (None, a), (None, "alone here"), (3, None)]
    got = [tuple(r) for r in minhash.near_components(frame(spark, rows)).select("doc_id", "component_id", "kept").collect()]
    assert Counter(got) == Counter([(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False), (None, 5, False), (None, None, False), (3, 3, True)])
    kept = Counter((r.doc_id, r.text) for r in minhash.keep_one(frame(spark, rows)).collect())
    assert kept == Counter([(5, a), (5, b), (None, "alone here"), (3, None)])


def test_lines_by_rows(spark):
    block = lambda s: "\n".join(f"{s} line {k} has just six words." for k in range(8))
    x, y = block("x"), block("y")
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, [(1, x), (5, x), (5, y), (5, y), (None, f"own\n{x}"), (None, None)])).collect())
    assert got == Counter([(1, x), (5, y), (5, y), (None, "own\n"), (None, None)])


def test_lines_against_pairs(spark):
    """Shared passages among many documents, every other line of one first seen elsewhere: no run of 30 shared words stays."""
    rng = random.Random(5)
    passages = [[f"p{p} l{k} with five more words here." for k in range(7)] for p in range(4)]
    rows = [(1, "\n".join(passages[0][::2])), (2, "\n".join(passages[0])), (3, "mine here.\n" + "\n".join(passages[0]))]
    for i in range(4, 40):
        own = [f"d{i} {k} is only in this one." for k in range(6)]
        at = rng.randrange(7)
        rows.append((i, "\n".join(own[:at] + rng.choice(passages) + own[at:])))
    rows.append((40, " ".join(f"w{k}" for k in range(30_000)) + ".\n" + "\n".join(passages[1])))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[3].strip() == "mine here."
    seen, first = set(), set()
    for i, t in rows:
        for p, lines in enumerate(passages):
            whole = "\n".join(lines) in t
            if whole and p in first:
                assert not any(x in got.get(i, "") for x in lines)
            elif whole:
                assert all(x in got[i] for x in lines)
                first.add(p)
        seen.update(t.split("\n"))
        assert all(x in got.get(i, "") for x in t.split("\n") if x.startswith((f"d{i} ", "w0 ")))


def test_leaks(spark):
    """Recall of items with up to 11.8 % edits, starts, several regions, short items."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 30)))) for k in range(40)]
    rows, want = [], {}
    for d in range(120):
        i, t = rng.choice(items)
        edits, s = int(rng.random() * 0.118 * len(t)), list(t)
        for _ in range(edits):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], [rng.choice("klmn")], [s[p], rng.choice("klmn")]])
        head = " ".join(word() for _ in range(rng.randrange(0, 60)))
        text = f"{head} {''.join(s)} {word()}"
        rows.append((d, text))
        want[d] = (i, len(decontaminate.normal(head)) + bool(head), edits)
    rows += [(500, " ".join(f"{word()}" for _ in range(20_000))), (501, None), (502, ""), (None, items[3][1]), (503, f"{items[0][1]} x {items[0][1]}"), (504, "To be, or not"), (505, "so be or not")]
    bench = spark.createDataFrame([*items, (90, "to BE, or"), (91, None), (92, "?!"), (93, items[3][1])], "item_id long, text string")
    got = decontaminate.leaks(frame(spark, rows), bench).collect()
    by = {(r.doc_id, r.item_id): r for r in got}
    assert all((d, i) in by and abs(by[d, i].start - at) <= n + 1 and by[d, i].edits <= n + 2 for d, (i, at, n) in want.items())
    assert {(r.doc_id, r.item_id) for r in got} == {(d, x[0]) for d, x in want.items()} | {(d, 93) for d, x in want.items() if x[0] == 3} | {(None, 3), (None, 93), (503, 0), (504, 90)}
    assert sum(r.doc_id == 503 for r in got) == 2 and decontaminate.align("abcdefgh", "xxxxxxabcXdefgh", 2) == (6, 15, 1)
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0 and decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_license_base(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(400)
    extra = frame(spark, [(-1, "Licensed under the Apache License, Version 2.0, not the MIT license " * 3000), (-2, None), (-3, "mit license")]).select("doc_id", "text")
    rows = docs.select("doc_id", "text").union(extra)
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in licenses.scan(rows).collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[r.doc_id]))
        hits = [(i, v) for i in range(len(w)) for p, v in phrases.items() if tuple(w[i : i + len(p)]) == p]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({v for _, v in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        spans = [(d.s, d.e) for d in r.detections] if len(r.detections) < 300 else []
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] and a[1] - a[0] < 20 for a in spans for b in spans if a[0] == b[0] and a[1] == b[1] and a is not b and a != b)


def samples(seq, full):
    """Texts of a parsed pattern, optional parts left out or taken."""
    out = [""]
    for op, x in seq:
        if str(op) == "LITERAL":
            more = [chr(x)]
        elif str(op) == "IN":
            more = [chr(x[0][1] if str(x[0][0]) == "LITERAL" else x[0][1][0])]
        elif str(op) == "SUBPATTERN":
            more = samples(x[3], full)
        elif str(op) == "BRANCH":
            more = [t for b in x[1] for t in samples(b, full)]
        else:
            more = samples(x[2], full) if x[0] or full else [""]
        out = [a + b for a in out for b in more]
    return out


def test_license_rules(spark):
    """A sample of every branch of every rule holds its keyword, and is found under its label or a rule of higher rank that covers it."""
    from re import _parser

    rows = []
    for label, word, rank, pattern in license_rules.RULES:
        for t in {x for full in (False, True) for x in samples(_parser.parse(pattern), full)}:
            assert f" {word} " in f" {t} " and t == " ".join(t.split()) and re.fullmatch(pattern, t)
            rows.append((len(rows), label, rank, t))
    cover = {k: {lb for lb, _, r, p in license_rules.RULES if r >= rank and re.search(f" (?:{p})(?= )", f" {t} ")} for k, _, rank, t in rows}
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [(k, f"Before, {t.upper()}; after.") for k, _, _, t in rows])).collect()}
    for k, label, _, t in rows:
        assert set(got[k].labels.split(",")) & cover[k] and label in cover[k], t
    own = [(0, "permit a disc, commonly general terms of service under our server"), (1, "The MIT License (MIT)"), (2, "licensed under the Apache License, Version 2.0"), (3, "GNU Lesser General Public License v2.1")]
    assert {r.doc_id: r.labels for r in licenses.scan(frame(spark, own)).collect()} == {0: "", 1: "mit", 2: "apache,apache-2.0", 3: "gpl,lgpl-2.1"}


def test_toxicity_by_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    caught, wrong = Counter(), 0
    for r in toxicity.score(docs, model).where("held_out").collect():
        assert zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        if r.doc_id in truth:
            caught[lang[r.doc_id], truth[r.doc_id], r.predicted] += 1
    for x in ("en", "de", "fr", "es"):
        hit, miss, alarm, clean = (caught[x, y, p] for y, p in ((1, 1), (1, 0), (0, 1), (0, 0)))
        assert hit > 3 * miss and alarm * 20 <= clean
    odd = [(None, "you idiot"), (1, None), (2, ""), (3, "idiot " * 20_000), (3, "!!!! shut up")]
    got = toxicity.score(frame(spark, odd), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.drop_toxic(frame(spark, []), labels.limit(0)).count() == 0


def test_pii_kinds(spark):
    """Recall by kind on formats that are valid, none on those that are not; equal values stay equal, different ones differ."""
    rng = random.Random(3)

    def card():
        d = [rng.randrange(1, 10)] + [rng.randrange(10) for _ in range(14)]
        s = sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d))
        return "".join(map(str, d)) + str(-s % 10)

    kinds = {
        "card": card, "date": lambda: f"{rng.randrange(1900, 2079)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", "ssn": lambda: f"{rng.randrange(1, 600):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "email": lambda: f"a{rng.randrange(10**6)}@h{rng.randrange(9)}.org", "phone": lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(200, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}",
    }
    rows = [(k, kind, make()) for k, (kind, make) in enumerate((kind, make) for kind, make in kinds.items() for _ in range(60))]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, [(k, f"see {v} now") for k, _, v in rows]), "k").collect()}
    for kind in kinds:
        mine = [(v, got[k].text[4:-4]) for k, x, v in rows if x == kind]
        assert all(got[k].kinds == kind for k, x, _ in rows if x == kind) and sum(a == b for a, b in mine) <= 1 and len({b for _, b in mine}) == len({a for a, _ in mine})
        if kind != "email":
            assert all(re.sub(r"\d+" if kind == "ip" else r"\d", "0", a) == re.sub(r"\d+" if kind == "ip" else r"\d", "0", b) for a, b in mine)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", got[k].text[4:-4]) for k, x, _ in rows if x == "ssn")
    plain = ["000-12-3456", "2079-06-07", "2023-02-30", "300.1.1.1", "x" * 90_000, "", None]
    out = {r.doc_id: r for r in pii.pseudonymise(frame(spark, enumerate(plain)), "k").collect()}
    assert [out[k].text for k in range(len(plain))] == plain and pii.pseudonymise(frame(spark, []), "k").count() == 0


def test_slot_maps(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, "x" * int(rng.paretovariate(1.1) * 50)) for k in range(2000)] + [(None, None), (7, None), (7, ""), (7, "same"), (7, "same")]
    path = str(tmp_path / "maps")
    got = sharding.shard(frame(spark, rows), 8, "bytes", path).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert sum(load.values()) == sum(len(t or "") + 1 for _, t in rows) and max(load.values()) - min(load.values()) <= max(200, max(len(t or "") + 1 for _, t in rows) - 2 * min(load.values()))
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    first, last = sharding.load_map(spark, path, 1), sharding.load_map(spark, path)
    assert first["slots"] == sharding.slot_map(8)["slots"] and last["version"] == 2 and {r.shard for r in got} <= set(last["slots"])
    assert all(last["slots"][r.virtual_slot] == r.shard for r in got)
    sharding.save_map(spark, last, path)
    assert spark.read.parquet(path).count() == 2 * sharding.VIRTUAL
    key = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(frame(spark, rows), 8, "key").collect()}
    assert all(g in (s, 8) for s, g in key.values()) and any(g == 8 for _, g in key.values())


def test_longest_rule(spark):
    rules = [("block", "a.b.org", "/"), ("allow", "org", "/long/path/"), ("block", "x.y", "/"), ("allow", "x.y", "/")]
    rows = [(1, "http://a.b.org/long/path/z"), (2, "http://a.b.org/else"), (3, "http://x.y/"), (None, "http://q.x.y/"), (4, "http://xx.y/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: ("org/long/path/", "allow"), 2: ("a.b.org/", "block"), 3: ("x.y/", "block"), None: ("x.y/", "block"), 4: (None, "allow")}
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_topk_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k % 300, [rng.choice([-1.0, 0.25, 0.5]) for _ in range(6 if k % 9 else 4)]) for k in range(700)] + [(50, [0.5] * 6)] * 3 + [(None, [1.0]), (100, [])]
    import math

    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e]
    want = []
    for n, (i, e) in enumerate(v):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f)), j) for m, (j, f) in enumerate(v) if m != n and len(f) == len(e))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    for size in (4_000_000, 300):
        monkeypatch.setattr(topk, "BLOCK_BYTES", size)
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_long_pieces():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(str(bpe.default_path())), bpe.load(str(bpe.default_path()))
    rng = random.Random(9)
    for text in ["ab" * 40_000, "".join(rng.choices("abcdeé \n", k=50_000)), " " * 3000, "\U0001f600" * 500]:
        import numpy as np

        ids = b.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids and b.decode(ids) == text


def test_pipeline(spark, tmp_path):
    """Each stage by brute force on planted documents: what goes, and why."""
    import corpus_pipeline as P

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 9)))
    line = lambda n=12: " ".join(word() for _ in range(n)) + "."
    clean = {k: "\n".join(line() for _ in range(8)) for k in range(60)}
    toxic = {k: f"{line()} you worthless idiot scum {line()} pathetic moron trash" for k in range(100, 160)}
    passage = [line() for _ in range(6)]
    item = line(20)
    # A long line of its own, so that line dedup leaves the near copy whole but for nothing.
    long = line(150)
    near = long.replace(long.split()[70], "changed", 1)
    docs = clean | toxic | {200: "\n".join([line(), *passage]), 201: "\n".join([line(), *passage, line()]), 210: long, 211: near, 220: f"{line()}\n{item}", 230: clean[0]}
    frame(spark, sorted(docs.items())).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in held.select("doc_id").collect()})
        assert k == 4 or held.columns == TEXT.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        if k == 1:
            text = {r.doc_id: r.text for r in held.collect()}
            assert all(x in text[200] and x not in text[201] for x in passage) and all(text[d] == docs[d] for d in [*clean, 210, 211, 220])
    everything = set(docs) - set(toxic)
    assert kept == [everything, everything - {230}, everything - {230, 211}, everything - {230, 211, 220}, everything - {230, 211, 220}]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == kept[-1]


@pytest.mark.parametrize("stage", range(5))
def test_empty_stage(spark, tmp_path, stage):
    import corpus_pipeline as P

    none = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    none = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert P.STAGES[stage][1](spark, none, D).count() == 0

"""Small cases with the result stated: nulls, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import html
import json
import math
import struct
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import parse, stats
from lexmill.functions import text as T
from lexmill.operators import curation, firstwins, ledger, ordered, search, substrings, topk
from lexmill.plans import features
from lexmill.plans import search as search_plans
from lexmill.sources import files


def _values(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text_functions(spark):
    assert _values(spark, T.normalized_text, [" a \r\n\r\n\r\n\r\nb\t c ", None, ""]) == ["a\n\nb c", None, ""]
    assert _values(spark, T.years, ["1499 1500 2099 12100 1999-2001 1999"]) == [["1500", "2099", "1999", "2001"]]
    assert _values(spark, T.sample_sizes, ["n = 1,284 and N=96, gain = 5"]) == [[1284, 96]]
    assert _values(spark, T.percentages, ["95% CI 3-4, 12.5 % and 7%, 120%"]) == [[12.5, 7.0]]
    assert _values(spark, T.answer_key, ["The  Answer, a B!", "", None]) == ["answer b", "", None]
    assert _values(spark, T.number, ["1,200.", "x1", "", None, "-.5"]) == [1200.0, None, None, None, -0.5]
    assert _values(spark, T.identifier, ["https://d.example/10.1234/AbC", "https://w.example/W4000012", "http://p.example/PM/30000946/", None, "x"]) == ["doi:10.1234/abc", "work:w4000012", "paper:30000946", None, None]


def test_junk_reasons(spark):
    long = "word " * 60
    rows = ["abc", "1 2 3 4 5 6 " * 40, "same\n" * 3 + "other line here\n" + long.replace(" ", "\nx", 2) * 1, long, None]
    assert _values(spark, T.junk_reason, rows)[0] == "too_short"
    assert _values(spark, T.junk_reason, rows)[1] == "low_alpha"
    assert _values(spark, T.junk_reason, ["menu item\n" * 40]) == ["boilerplate"]
    assert _values(spark, T.junk_reason, rows)[3:] == [None, "too_short"]
    assert _values(spark, T.junk_reason, ["a" * 100_001]) == ["too_long"]


DOCS = "ord long, doc_id string, url string, title string, text string, category string"


def test_exclusion_precedence_and_empty(spark):
    body = "x" * 250
    new = spark.createDataFrame([(1, "a", "http://x/10.1234/q", "T", body, None), (2, "b", None, "Own", None, None), (3, "c", None, "t!", "z", None)], DOCS)
    old = spark.createDataFrame([(9, "a", None, "t", body, None)], DOCS)
    assert {(r.ord, r.reason) for r in curation.excluded(new, old).collect()} == {(1, "doc_id"), (3, "title")}
    assert curation.excluded(new.limit(0), old).count() == 0
    assert curation.excluded(new, old.limit(0)).count() == 0


def test_fold_covers_all_scripts(spark):
    def brute(text):
        text = unicodedata.normalize("NFKD", html.unescape(text))
        return "".join(x for ch in text if not unicodedata.combining(ch) for x in ch.casefold() if x.isalnum())

    plain = ["Стабильный Ёж 2018", "نشت حافظه 2018", "मस्तिष्क 2018", "東京の地震 2018", "ｶﾞｽ", "한국어", "Straße İzmir ŉ ᾳ", "&#x3b1;-Helix &amp; x", ""]
    keys = _values(spark, T.fold_key, [*plain, None])
    assert keys == [*map(brute, plain), None] and len(set(keys)) == len(keys)
    assert _values(spark, T.fold_key, ["i Citrus bergamia /i", "<i>Citrus</i> bergamia", "Citrus Bérgamia"]) == ["citrusbergamia"] * 3
    text = "Изменение климата и лес. " * 20
    new = spark.createDataFrame([(1, "a", None, "Новое 2018", text.upper(), None), (2, "b", None, "東京 2018", "z", None), (3, "c", None, "ЛЕС 2018", "z", None)], DOCS)
    old = spark.createDataFrame([(9, "x", None, "Лес 2018", "z", None), (8, "y", None, "نشت 2018", text, None)], DOCS)
    assert {(r.ord, r.reason) for r in curation.excluded(new, old).collect()} == {(1, "abstract"), (3, "title")}


def test_exclusion_by_edges(spark):
    start, end = ("Über den Wald und das Wasser " * 9)[:250], ("в конце этого текста " * 15)[:250]
    middle = [f"only in {w} " * 12 for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")]
    old = [
        (90, "o1", None, "Held 1", start + middle[0], None), (91, "o2", None, "Held 2", middle[1] * 2 + end, None), (92, "o2", None, "Held 2", middle[1] * 2 + end, None),
        (93, "o3", None, "Held 3", "common opening " * 20 + middle[2], None), (94, "o4", None, "Held 4", "common opening " * 20 + middle[3], None),
        (95, "o5", None, "Held 5", "Held 5\n\n" + middle[6] * 3, None),
    ]
    new = [
        (1, "n1", None, "New 1", start + middle[4], None), (2, "o1", None, "Held 1", start + middle[0], None),  # 2 goes by its id, so 1 alone has the opening
        (3, "n3", None, "New 3", middle[5] * 2 + end, None), (4, "n4", None, "New 4", "common opening " * 20 + middle[7], None),
        (5, "n5", None, "New 5", "New 5\n\n" + middle[6] * 3, None), (6, "n6", None, "New 6", "z", None),
    ]
    new, old = spark.createDataFrame(new, DOCS), spark.createDataFrame(old, DOCS)
    gone = curation.excluded(new, old)
    assert {(r.ord, r.reason) for r in gone.collect()} == {(1, "abstract_start"), (2, "doc_id"), (3, "abstract_end"), (5, "abstract")}
    assert {tuple(r) for r in curation.unique_edges(new, old).collect()} == {("start", 1, 90), ("end", 3, 91)}
    assert curation.survivors(new.join(gone, "ord", "left_anti"), new, old).count() == 0
    assert {(r.ord, r.reason) for r in curation.survivors(new.where("ord < 4"), new, old).collect()} == {(1, "abstract_start"), (2, "doc_id"), (3, "abstract_end")}


def test_chunks_of_paragraphs(spark, tmp_path):
    a, b, c, monster = "a" * 2000, "б" * 1499, "c" * 1500, "m" * 8000
    texts = {1: f"{a}\n\n{b}", 2: f"{a}\n{b}x\n{c}", 3: f"{a}\n{monster}\n \n{c}", 4: " \n", 5: "", 6: "short", 7: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in sorted(features.text_chunks(spark, str(tmp_path)).collect()):
        assert r.place == len(found.setdefault(r.doc_id, []))
        found[r.doc_id].append(r.chunk)
    # a line end counts with each line, so 2000 and 1499 do not fit
    assert found == {1: [a, b], 2: [a, f"{b}x\n{c}"], 3: [a, "m" * 3500, "m" * 3500, "m" * 1000, c], 4: [" \n"], 5: [""], 6: ["short"]}


def test_search_ties_masks_and_pruning(spark):
    corpus = spark.createDataFrame([("b", "", "alpha beta"), ("a", "", "alpha beta"), ("c", "", "gamma"), ("d", "", "delta"), ("e", "", ""), ("f", "", "eps")], "doc_id string, title string, text string")
    asked = spark.createDataFrame([(1, "alpha?"), (2, "zeta"), (3, "")], "qid int, query string")
    hits = [(r.qid, r.doc_id, r["rank"]) for r in search.bm25(corpus, asked, 5).orderBy("qid", "rank").collect()]
    assert hits == [(1, "a", 1), (1, "b", 2)]
    masks = spark.createDataFrame([(1, "a")], "qid int, doc_id string")
    assert [r.doc_id for r in search.bm25(corpus, asked, 1, masks).collect()] == ["b"]
    assert search.bm25(corpus.limit(0), asked, 5).count() == 0


def test_best_documents_without_scoring_all(monkeypatch):
    rng, cells = np.random.default_rng(7), []
    place = topk._Best._add
    monkeypatch.setattr(topk._Best, "_add", lambda self, rows, docs: (cells.append(len(rows) * len(docs)), place(self, rows, docs))[1])
    documents, topics, k = 4_000, 40, 5
    topic = rng.integers(0, topics, documents)
    held = [np.unique(np.append(topics * 3 + rng.integers(0, 60, 25), 3 * t + np.arange(3))) for t in topic]
    doc, term = np.repeat(np.arange(documents), [len(x) for x in held]), np.concatenate(held)
    value = rng.random(len(doc)) + 0.5
    asked = [np.concatenate([3 * t + np.arange(3), np.sort(3 * topics + rng.choice(60, 5, replace=False))]) for t in rng.integers(0, topics, 300)]
    starts, own = np.arange(0, 301 * 8, 8), np.concatenate(asked)
    weight = np.where(own < 3 * topics, 3.5, 1.0)
    hidden = rng.integers(0, 300, 500), rng.integers(0, documents, 500)
    table = np.zeros((documents, 3 * topics + 60))
    table[doc, term] = value
    for held, least in ((10_000_000, 1_000), (300_000, 1_000), (100, 1_000)):  # one block, several, and matrices made from the hits
        monkeypatch.setattr(topk, "_HELD", held)
        cells.clear()
        got = {(int(q), int(d)): s for part in topk.best(doc, term, value, documents, table.shape[1], (starts, own, weight), k, hidden) for q, d, s in zip(*part)}
        for q in range(300):
            scores = np.round(sum(w * table[:, t] for w, t in zip(weight[8 * q : 8 * q + 8], asked[q])), 6)
            scores[hidden[1][hidden[0] == q]] = 0
            best = sorted(range(documents), key=lambda d: (-scores[d], d))[:k]
            assert {(q, d): got.get((q, d)) for d in best} == {(q, d): scores[d] for d in best}
        assert len(got) == 300 * k and sum(cells) < 0.1 * 300 * documents


def test_best_documents_of_long_queries():
    rng, documents, terms, k = np.random.default_rng(11), 500, 400, 5
    table = np.where(rng.random((documents, terms)) < 0.1, rng.random((documents, terms)) + 0.5, 0)
    table[7] = table[3]  # a tie
    doc, term = np.nonzero(table)
    asked = [np.sort(rng.choice(terms, n, replace=False)) for n in (3, 32, 33, 1, 127, 129, 300, 0, 400, 20)]
    starts, own = np.append(0, np.cumsum([len(x) for x in asked])), np.concatenate(asked)
    weight = rng.random(len(own)) + 0.5
    hidden = rng.integers(0, len(asked), 900), rng.integers(0, documents, 900)
    got = {(int(q), int(d)): s for part in topk.best(doc, term, table[doc, term], documents, terms, (starts, own, weight), k, hidden) for q, d, s in zip(*part)}
    want = {}
    for q, some in enumerate(asked):
        scores = np.round(sum((w * table[:, t] for w, t in zip(weight[starts[q] :], some)), np.zeros(documents)), 6)
        scores[hidden[1][hidden[0] == q]] = 0
        want |= {(q, d): scores[d] for d in sorted(range(documents), key=lambda d: (-scores[d], d))[:k] if scores[d] > 0}
    assert got == want


def test_search_counts_all_terms_of_long_questions(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    texts = {f"d{i:02}": [f"w{int(x)}" for x in 400 * rng.random(30)] for i in range(60)} | {"z": ["last"]}
    asked = {n: [f"w{int(x)}" for x in 400 * rng.random(n)] for n in (5, 32, 33, 150, 600)} | {50: ["nowhere"] * 49 + ["last"]}
    spark.createDataFrame([(i, d, "", " ".join(w), "", "") for i, (d, w) in enumerate(texts.items())], "ord long, doc_id string, title string, text string, url string, category string").write.parquet(f"{tmp_path}/docs.parquet")
    spark.createDataFrame([(str(n), " ".join(q)) for n, q in asked.items()], "task_id string, question string").write.parquet(f"{tmp_path}/tasks.parquet")
    df = {w: sum(w in t for t in texts.values()) for q in asked.values() for w in q}
    average, want = sum(map(len, texts.values())) / len(texts), {}
    for n, q in asked.items():
        scores = {d: round(sum(max(math.log((61 - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in q), 6) for d, t in texts.items()}
        best = sorted((-s, d) for d, s in scores.items() if s > 0)[:10]
        want |= {(str(n), d): (r, pytest.approx(-s, abs=2e-6)) for r, (s, d) in enumerate(best, 1)}
    assert max(df.values()) <= 15 and ("50", "z") in want  # no term is too common
    assert {(r.qid, r.doc_id): (r["rank"], r.score) for r in search_plans.search_bm25_top10(spark, str(tmp_path)).collect()} == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)  # blocks by the number of terms
    assert {(r.qid, r.doc_id): (r["rank"], r.score) for r in search_plans.search_bm25_top10(spark, str(tmp_path)).collect()} == want


def test_search_shards_and_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [(f"d{i:03}", "", " ".join(f"w{int(x)}" for x in 60 * rng.random(12) ** 2)) for i in range(300)]
    corpus = spark.createDataFrame(texts, "doc_id string, title string, text string")
    asked = spark.createDataFrame([(i, f"w{i % 60} w{i % 7} w{i % 11}-w{i % 5}") for i in range(50)], "qid int, query string")
    masks = spark.createDataFrame([(i, f"d{j:03}") for i in range(50) for j in range(i, 300, 9)], "qid int, doc_id string")
    want = sorted(search.bm25(corpus, asked, 4, masks).collect())
    monkeypatch.setattr(search, "SHARD", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    assert want and sorted(search.bm25(corpus, asked, 4, masks).collect()) == want


def test_documents_that_hold_all_terms(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = {i: {f"w{int(x)}" for x in 30 * rng.random(8) ** 2} | {"common"} for i in range(120)}
    corpus = spark.createDataFrame([(f"d{i}", "common", " ".join(sorted(t)) + " common") for i, t in texts.items()], "doc_id string, title string, text string")
    sets = {i: [f"w{int(x)}" for x in 30 * rng.random(1 + i % 3) ** 2] + ["common"] * (i % 2) for i in range(60)} | {60: ["unknown", "common"], 61: ["common"], 62: ["common", "common"]}
    wanted = spark.createDataFrame([(i, t) for i, terms in sets.items() for t in terms], "set_id int, term string")
    brute = {i: sum(set(terms) <= t for t in texts.values()) for i, terms in sets.items()}
    monkeypatch.setattr(search, "_MERGED", 50)
    monkeypatch.setattr(search, "QUERY_BLOCK", 25)
    assert dict(search.containing_all(corpus, wanted).collect()) == {i: n for i, n in brute.items() if n}
    assert search.containing_all(corpus, wanted.limit(0)).count() == 0


def test_overlay_scores_all_terms(spark):
    base = spark.createDataFrame([("base", "", "alpha rare"), *((f"z{i}", "", f"other{i}") for i in range(4))], "doc_id string, title string, text string")
    texts = {"d1": ("Alphabet", "alpha alphas\nBETA"), "d2": ("x", "beta-gamma gamma"), "d3": ("", "none"), "d4": ("", "ααα 東京東京"), "d5": ("x", "beta-gamma gamma"), **{f"m{i:02}": ("", "aaa " * (i % 4)) for i in range(30)}}
    docs = spark.createDataFrame([(i, *t) for i, t in texts.items()], "doc_id string, title string, text string").repartition(3)
    queries = {1: 'Alpha "beta" of one more gamma', 2: "東京 αα", 3: "", 4: "aa aa alpha", 5: "beta"}
    masks = [(5, "d2"), (5, "nowhere")]
    frame = search.overlay(base, docs, spark.createDataFrame(list(queries.items()), "qid int, query string"), 5, spark.createDataFrame(masks, "qid int, doc_id string"))
    got = {q: [(r.doc_id, r.score) for r in frame.where(F.col("qid") == q).orderBy("rank").collect()] for q in queries}
    known = {q: [x for x in hits if x[0] == "base"] for q, hits in got.items()}
    for q, query in queries.items():
        terms = [t.strip('"').lower() for t in query.split()]
        brute = [(i, float(sum(f"{a}\n{b}".lower().count(t) for t in terms))) for i, (a, b) in texts.items() if (q, i) not in masks]
        assert got[q] == sorted([x for x in brute if x[1]] + known[q], key=lambda x: (-x[1], x[0]))[:5]
    assert known[1] and got[1][0] == ("d1", 4.0)


def test_substring_counts_look_into_few_documents(monkeypatch):
    rng = np.random.default_rng(11)
    sizes = (20 * rng.pareto(2, 4_000) + 5).astype(int)
    texts = [" ".join(f"W{int(x)}" for x in 40 * rng.random(n) ** 2) for n in sizes]
    bags = [{f"w{int(x)}": int(n) for x, n in zip(40 * rng.random(q % 9) ** 2, rng.integers(1, 3, 9))} for q in range(120)]
    terms = sorted({t for bag in bags for t in bag})
    asked = np.append(0, np.cumsum([len(b) for b in bags])), np.array([terms.index(t) for b in bags for t in b]), np.array([n for b in bags for n in b.values()])
    hidden = np.repeat(np.arange(120), 500), rng.integers(0, 4_000, 60_000)
    table = np.array([[t.lower().count(x) for x in terms] for t in texts])
    counts, cells, sums = substrings.Counts(terms), [], substrings._Part.sums
    longest = np.argsort(-sizes)[:200]
    place = {d: i for i, d in enumerate(longest.tolist())}
    near = np.array([(q, place[d]) for q, d in zip(*map(np.ndarray.tolist, hidden)) if d in place]).T
    floor = substrings.Best(len(terms), asked, 5).floors(counts.of([texts[d] for d in longest]), 200, tuple(near))
    monkeypatch.setattr(substrings._Part, "sums", lambda part, level, at, weight, rows, cols: (cells.append(len(rows) * (substrings._BLOCK if level == 2 else 0)), sums(part, level, at, weight, rows, cols))[1])
    for held, waiting in ((4_000_000, 1_000_000), (20_000, 10)):  # one part and several
        monkeypatch.setattr(substrings, "_CELLS", held)
        monkeypatch.setattr(substrings, "_WAITING", waiting)
        cells.clear()
        best = substrings.Best(len(terms), asked, 5, floor)
        for low in (0, 2_000):
            there = (hidden[1] >= low) & (hidden[1] < low + 2_000)
            best.meet(counts.of(texts[low : low + 2_000]), 2_000, (hidden[0][there], hidden[1][there] - low))
        got = {(q, d): s for q, d, s in zip(*map(np.ndarray.tolist, best.result()))}
        for q, bag in enumerate(bags):
            scores = table @ np.array([bag.get(t, 0) for t in terms])
            scores[hidden[1][hidden[0] == q]] = 0
            order = [d for d in sorted(range(4_000), key=lambda d: (-scores[d], d))[:5] if scores[d] > 0]
            assert {d: s for (p, d), s in got.items() if p == q} == {d: scores[d] for d in order}
        assert sum(cells) < 0.25 * 120 * 4_000


def test_overlay_in_blocks_searches_the_base_where_it_can_matter(spark, monkeypatch):
    base = spark.createDataFrame([(f"b{i}", "", f"rare{i} a") for i in range(30)], "doc_id string, title string, text string")
    docs = spark.createDataFrame([(f"d{i:02}", "", "a common word " * (i % 7 + 9)) for i in range(40)], "doc_id string, title string, text string").repartition(3)
    queries = spark.createDataFrame([(i, "a common word of" if i % 3 else f"rare{i}") for i in range(12)], "qid int, query string")
    want, asked, bm25 = sorted(search.overlay(base, docs, queries, 4).collect()), [], search.bm25
    monkeypatch.setattr(search, "bm25", lambda corpus, some, *more: (asked.append({r.qid for r in some.collect()}), bm25(corpus, some, *more))[1])
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    assert sorted(search.overlay(base, docs, queries, 4).collect()) == want
    assert asked == [{0, 3, 6, 9}]
    assert [r.doc_id for r in sorted(want, key=lambda r: (r.qid, r["rank"])) if r.qid == 1] == ["d06", "d13", "d20", "d27"]
    assert {r.qid: r.doc_id for r in want if r.qid % 3 == 0} == {i: f"b{i}" for i in (0, 3, 6, 9)}


def test_ordered_operators(spark):
    df = spark.createDataFrame([("k", 5, 1, "first"), ("k", 5, 2, "tie"), ("k", 4, 0, "old"), ("n", None, 3, "null")], "key string, v int, seq int, name string")
    assert [(r.key, r.name) for r in ordered.latest(df, ["key"], "v", "seq").collect()] == [("k", "first")]
    runs = spark.createDataFrame([("h", 1, "A"), ("h", 2, "A"), ("h", 3, None), ("h", 4, None), ("h", 5, "A")], "p string, o int, v string")
    assert [(r.first, r["last"], r.v) for r in ordered.islands(runs, "p", ["o"], "v").orderBy("first").collect()] == [(1, 2, "A"), (3, 4, None), (5, 5, "A")]
    series = spark.createDataFrame([("m", i, float(i % 3)) for i in range(30)], "k string, o int, v double")
    held = 0.0
    for i in range(1, 30):
        held = 2 / 11 * (i % 3) + 9 / 11 * held
    assert ordered.moving_average(series, "k", "o", "v", 10).first().average == pytest.approx(held)
    values = spark.createDataFrame([("a", float(i)) for i in range(1, 31)] + [("few", 1.0), ("few", None)], "k string, v double")
    got = ordered.quantiles(values, "k", "v", 0.95, 20).collect()
    assert [(r.k, r.nearest) for r in got] == [("a", 29.0)] and got[0].exclusive == pytest.approx(29.45)
    many = spark.range(30_000).selectExpr("'k' as k", "cast((id * 7919) % 30011 as double) as v")
    order = sorted((i * 7919) % 30011 for i in range(30_000))
    r = ordered.quantiles(many, "k", "v", 0.95, 20).first()
    at = 0.95 * 30_001
    assert r.nearest == order[round(0.95 * 29_999)] and r.exclusive == pytest.approx(order[int(at) - 1] + (order[int(at)] - order[int(at) - 1]) * (at - int(at)))


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(n, b) for n, b in enumerate((1, 5, 6, 10, 11, 90, 5000, 50_000))], "seq int, block long")
    right = spark.createDataFrame([(5, 1), (5, 2), (10, 3), (80, 4), (7, None)], "block long, round int")
    got = {r.block: r["round"] for r in ordered.as_of(left, right, "block", "round", 10).collect()}
    assert got == {1: None, 5: None, 6: 2, 10: 2, 11: 3, 90: 4, 5000: 4, 50_000: 4}


def test_ranks_and_newest_over_buckets(spark):
    rows = [(i, (i * 37) % 101 if i % 13 else None, f"n{i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, block long, name string").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    got = {r.seq: r["rank"] for r in ordered.ranked(df, "block", ["name", "seq"], 10).collect()}
    assert got == {r[0]: k for k, r in enumerate(order)}
    assert ordered.ranked(df.limit(0), "block", ["seq"], 10).count() == 0
    times = spark.createDataFrame([(i, (i * 53) % 97) for i in range(300)] + [(None, 5)], "o long, t long").repartition(4)
    want, held = {}, None
    for i in range(300):
        want[i] = held
        held = max((i * 53) % 97, -1 if held is None else held)
    assert {r.o: r.newest for r in ordered.newest_before(times, "o", "t", 16).collect()} == want


def test_pairs_in_blocks(spark):
    from lexmill.operators import pairs

    entries = [(i, "hot") for i in range(40)] + [(i, f"k{i % 9}") for i in range(30)] + [(1, None), (None, "hot")]
    df = spark.createDataFrame(entries, "id long, key string").repartition(6)
    want = {(a, b) for a, k in entries for b, m in entries if k is not None and k == m and a is not None and b is not None and a < b}
    for block in (3, 7, 1_000):
        assert {tuple(r) for r in pairs.sharing(df, block).collect()} == want
    assert pairs.sharing(df.limit(0)).count() == 0


def test_seeded_draw_is_the_generators(spark):
    from lexmill.plans import records
    from tests.conftest import DATA

    wide = DATA.replace("sf0.001", "sf0.01")
    got = {r.task_id: r.turn for r in records.task_seeded_draw(spark, wide).collect()}
    ids = sorted({r.task_id for r in spark.read.parquet(f"{wide}/tasks.parquet").select("task_id").collect()}, key=lambda t: (int(hashlib.md5(t.encode()).hexdigest()[:4], 16), t))
    drawn = np.random.default_rng(stats.seed_of("public", "1")).choice(len(ids), records.DRAWN, replace=False)
    assert got == {ids[x]: i for i, x in enumerate(drawn)}


def test_cleaning_of_odd_fields(spark, tmp_path):
    from lexmill.plans import cleaning

    titles = ["<i>A</i>  &lt;b&gt; &amp; c", None, "", "ﬁeld|`x`\u200b <y>", "The  Cells in <sub>a", "An apple", "A" * 300]
    spark.createDataFrame([(i, f"d{i}", None, t, "x", None) for i, t in enumerate(titles)], "ord long, doc_id string, url string, title string, text string, extra string").write.parquet(str(tmp_path / "docs.parquet"))
    clean = {r.ord: r.title for r in cleaning.text_clean_markup(spark, str(tmp_path)).collect()}
    assert clean == {0: "A <b> & c", 2: "", 3: "ﬁeld|`x`\u200b", 4: "The Cells in a", 5: "An apple", 6: "A" * 300}
    fields = {r.ord: r.field for r in cleaning.text_sanitized_fields(spark, str(tmp_path)).collect()}
    assert fields[3] == "fieldx y" and fields[2] == "" and len(fields[6]) == 200 and 1 not in fields
    assert {r.ord: r.lowered for r in cleaning.text_articles(spark, str(tmp_path)).collect()} == {4: "the  Cells in <sub>a", 5: "an apple"}
    keys = {(r.kind, r.key): r.papers for r in cleaning.curate_exclusion_keys(spark, str(tmp_path)).collect()}
    assert keys["doc_id", "d0"] == 1 and keys["title", "anapple"] == 1 and not any(kind == "abstract" for kind, _ in keys)


def test_rolled_digests(spark):
    rows = spark.createDataFrame([("a", i, f"t{i}") for i in range(50)] + [("b", 1, ""), ("c", 1, None)], "k string, o int, t string").repartition(7)
    lines = {r.k: (r.digest, r.n) for r in ordered.rolled(rows, "k", "o", "t", "lines").collect()}
    assert lines == {"a": (hashlib.sha256("\n".join(f"t{i}" for i in range(50)).encode()).hexdigest(), 50), "b": (hashlib.sha256(b"").hexdigest(), 1)}
    held = "0" * 64
    for i in range(50):
        held = hashlib.sha256((held + hashlib.sha256(f"t{i}".encode()).hexdigest()).encode()).hexdigest()
    assert {r.k: r.digest for r in ordered.rolled(rows, "k", "o", "t", "chain").collect()}["a"] == held


def test_wire_grammar(spark):
    good = "sha256:" + "a" * 64
    rows = [(1, "h", 1, f"v1|3|{good}|ACCEPT|-5"), (2, "h", 1, f"v1|+3|{good}|ACCEPT|5"), (3, "h", 1, f"v1|03|{good}|ACCEPT|5"), (4, "h", 1, f"v1|0|{good}|ACCEPT|5"), (5, "h", 1, f"v1|1|{good}|accept|5"),
            (6, "h", 1, f"e1|{good}"), (7, "h", 1, "e1|sha256:xyz|r"), (8, None, 1, f"e1|{good}|r"), (9, "h", 1, None), (10, "h", 1, "zz|1"), (11, "h", 1, "r1|1|2|")]
    parsed = ledger.parsed(spark.createDataFrame(rows, "seq long, hotkey string, block long, payload string"))
    assert [r.reason for r in parsed.orderBy("seq").collect()] == [None, "integer", "integer", "range", "decision", "fields", "digest", "no_hotkey", "empty", "unknown_version", "fields"]


def test_first_wins_is_not_components(spark):
    words = [f"w{i}" for i in range(120)]
    a, b = " ".join(words), " ".join(words[:110] + [f"x{i}" for i in range(8)])
    c = " ".join(words[:100] + [f"x{i}" for i in range(20)] + words[112:])
    rows = spark.createDataFrame([(1, a), (2, b), (3, c), (4, b), (5, None), (6, "")], "id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in ((1, a), (2, b), (3, c))}
    similar = lambda x, y: len(sets[x] & sets[y]) >= 0.85 * len(sets[x] | sets[y])
    want = {}
    for i in (2, 3):
        kept = [j for j in range(1, i) if j not in want and similar(j, i)]
        if kept:
            want[i] = kept[0]
    got = {r.id: r.kept for r in firstwins.near_duplicates(rows, "id", "text").collect()}
    assert got.pop(4) == want.get(2, 2) and got == want


def test_first_wins_misses_no_alike_pair(spark):
    texts = [[f"w{i}x{j}" for j in range(100)] for i in range(80)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join([*t[:50], "other", *t[51:]])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string")
    # 91 of 101 shingles are shared, so a pair is missed with a probability of 4e-8
    assert sorted(firstwins.near_duplicates(df, "id", "text").collect()) == [(100 + i, i) for i in range(80)]


def test_statistics():
    assert stats.seed_of("a", "b") == stats.seed_of("ab") < 1 << 64
    assert stats.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'
    assert stats.lower_bound(np.full(50, 0.25), 1) == 0.25
    diffs = np.array([1, 0, -1, 1, 1, 0, 0, 1, -1, 0] * 20, float)
    assert -0.1 < stats.lower_bound(diffs, 7) == stats.lower_bound(diffs, 7) < 0.2
    with pytest.raises(ValueError):
        stats.lower_bound(np.array([]), 1)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u", "title": "t", "text": "x"}\n\nnot json\n{"url": "u"}\n')
    assert sorted(r.status for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == ["invalid_json", "missing_fields", "ok"]
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "b.md").write_text("\n# Heading\nbody")
    (folder / "c.rst").write_text("ignored")
    assert [(r.title, r.url) for r in files.read_text_folder(spark, str(folder)).collect()] == [("Heading", "local://b.md")]
    (folder / "sub").mkdir()
    (folder / "sub" / "b.md").write_text("other")
    assert {r.url for r in files.read_text_folder(spark, str(folder)).collect()} == {"local://b.md", "local://sub/b.md"}
    assert files.listing(spark, str(folder)).count() == 3
    header = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "bad": {"data_offsets": [4, 99]}}).encode()
    weights = tmp_path / "weights"
    weights.mkdir()
    (weights / "m.bin").write_bytes(struct.pack("<Q", len(header)) + header + b"\0" * 8)
    (weights / "broken.bin").write_bytes(b"\1")
    assert [(r.name, r.shape) for r in files.tensor_headers(spark, str(weights)).collect()] == [("w", [2])]


def test_grammars(spark):
    call = '<tool_call>{"name": "search", "arguments": {"q": "a"}}</tool_call>'
    turns = {"<think>x</think>" + call + "<tool_call>{bad</tool_call>": ("search", '{"q":"a"}'), call + "<answer> 7 ": ("answer", "7"), "<think><answer>no</answer></think>": None, "": None, None: None,
             '<tool_call>{"name": 5}</tool_call>' + call + '<tool_call>{"name": "n"}</tool_call>': ("n", "{}"), "<answer></answer>" + call: ("search", '{"q":"a"}')}
    made = spark.createDataFrame([(t,) for t in turns], "t string").select("t", parse.turn(F.col("t")).alias("r")).collect()
    assert {r.t: tuple(r.r) if r.r else None for r in made} == turns
    assert parse.expansions("the bone mineral density (BMD) and unrelated words (XYZ)") == ["BMD=bone mineral density"]
    assert parse.expansions(None) == []
    raw = "'''Bold''' {{box|{{x}}}}[[Page|label]]<ref>no</ref>\n== Head ==\n{| a\n| [[b|c]]\n|}end <!-- x -->"
    assert parse.wiki_text(raw) == "Bold label\nHead\nend"
    assert parse.wiki_text("") == "" and parse.wiki_text(None) is None and parse.wiki_text("{{open") == ""
    assert parse.snippet("a b c naïve d e", "Naive", 2) == "…c naïve…" and parse.snippet("", "x") == "" and parse.snippet(None, "x") is None

"""Near duplicates, format copies and history against brute force, on made and on given records."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import history, neardup, radix
from lexmill.llm import shingles as S
from tests.conftest import DATA

WORD = re.compile(r"[^\W_]+")


def brute_set(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_pairs(rows, threshold):
    sets = [(i, brute_set(t)) for i, t in rows]
    sets = [(i, s) for i, s in sets if s]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if len(x & y) >= threshold * len(x | y) - 1e-12}


def made_records(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 80]))] if not rows or rng.random() < 0.5 else rng.choice(rows)[1].split()
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(base)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "..!"), (n + 3, rows[0][1]), (n + 4, rows[0][1].upper() + "!")]


def test_shingles_match_brute_force():
    texts = [t for _, t in made_records()] + ["İstanbul ß 𝟘 x̄ १२ 中文。字", "a" * 300_000, "w " * 50_000]
    flat, offsets = S.shingle_sets(texts)
    assert np.diff(offsets).tolist() == [len(brute_set(t)) for t in texts]


def test_dart_min_hash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1 << 55, 300).astype(np.uint64)
    w1, w2 = rng.uniform(0.2, 4, 300), rng.uniform(0.2, 4, 300)
    sig = S.dart_min_hash(np.concatenate([ids, ids]), np.array([0, 300, 600]), 2048, np.concatenate([w1, w2]))
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


@pytest.mark.parametrize("block", [neardup.BLOCK, 2])
def test_pairs_and_groups(spark, monkeypatch, block):
    monkeypatch.setattr(neardup.candidate_pairs, "__defaults__", (block,))
    rows = made_records()
    df = spark.createDataFrame(rows, "ord long, text string").selectExpr("*", "'x' as id", "1 as rep")
    got = [(r.a, r.b) for r in neardup.near_duplicate_pairs(df, "ord", "text").collect()]
    want = brute_pairs(rows, 0.7)
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.id: r.group_id for r in neardup.near_duplicate_groups(df, "ord", "text", 0.7).collect()}
    label = {i: i for i in groups}
    for _ in rows:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert groups == label
    assert neardup.near_duplicate_pairs(df.limit(0), "ord", "text").count() == 0


def test_copies_of_a_hot_text(spark):
    df = spark.range(600).select(F.col("id").alias("ord"), F.when(F.col("id") < 200, "one two three four five six").otherwise(F.concat(F.lit("row "), "id")).alias("text"))
    links, members = neardup.near_duplicate_links(df, "ord", "text")
    assert members.count() == 200 and links.count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (("T one", "Hello,  World"), ("t ONE.", "hello world!"), True),
        (("t", "rate 5.6"), ("t", "rate 56"), False),
        (("t", "reached -5"), ("t", "reached 5"), False),
        (("t", "CI 9.1-2.3"), ("t", "CI 9.1 2.3"), True),
        (("t", "p < 3"), ("t", "p > 3"), False),
        (("t", "Place: A\nYear: 1\nNote: x"), ("t", "Note: x | Year: 1 | Place: A"), True),
        (("t", "Place: A\nYear: 1\nNote: x"), ("t", '{"Note": "x", "Place": "A", "Year": "1"}'), True),
        ((None, "x"), ("", "X"), True),
        (("u", "x"), ("t", "x"), False),
    ],
)
def test_canonical_form(a, b, same):
    assert (radix.canonical(*a) == radix.canonical(*b)) is same


def test_radix_splits_and_counts(spark):
    rng = random.Random(5)
    rows = [(i, "same head", "common start " * 20 + str(rng.randrange(40))) for i in range(300)] + [(i, "same head", "Hot copy!") for i in range(300, 450)]
    rows += [(500, None, None), (501, None, " "), (502, None, "y" * 200_000), (503, "", "Y" * 200_000)]
    df = spark.createDataFrame(rows, "ord long, title string, text string").selectExpr("*", "1 as id", "'z' as bytes")
    groups, _ = radix.format_copies(df, "ord", "title", "text", bucket_rows=3)
    want = {}
    for i, title, text in rows:
        if text and text.strip():
            want.setdefault(radix.canonical(title, text), []).append(i)
    assert {(r.kept, r.copies) for r in groups.collect()} == {(min(v), len(v)) for v in want.values() if len(v) > 1}
    pairs = {(r.kept, r.copy) for r in radix.copy_pairs(df, "ord", "title", "text").collect()}
    assert pairs == {(min(v), i) for v in want.values() for i in v if i != min(v)}
    assert radix.copy_pairs(df.limit(0), "ord", "title", "text").count() == 0


def test_radix_buckets_fit_whatever_they_share(spark):
    """Texts that share hundreds of bytes, one that ends where others go on, and a value that fills more than a bucket."""
    rows = [(i, "same title", "the same long beginning " * 30 + f"{i % 40:03} end") for i in range(400)] + [(1000 + i, "same title", "the same long beginning " * 30) for i in range(9)]
    df = spark.createDataFrame(rows, "ord long, title string, text string").repartition(8)
    values = spark.createDataFrame([(bytearray(f"{x:06}".encode() * 2 if x else b"0000"), i, bytearray(f"{x}".encode()), 1) for i, x in enumerate(list(range(50)) + [7] * 30)], "bytes binary, id long, digest binary, n long")
    placed = radix._buckets(values, 5).collect()
    sizes = {}
    for r in placed:
        sizes.setdefault(bytes(r.bucket), []).append(bytes(r.digest))
    assert len(placed) == 80 and all(len(v) <= 5 or len(set(v)) == 1 for v in sizes.values())
    groups, _ = radix.format_copies(df, "ord", "title", "text", bucket_rows=4)
    assert sorted((r.kept, r.copies) for r in groups.collect()) == [(i, 10) for i in range(40)] + [(1000, 9)]


def test_two_labelled_fields_may_change_places():
    assert radix.canonical(None, "A: 1; B: 2") == radix.canonical(None, "B: 2; A: 1")
    assert radix.canonical(None, "word " * 30 + "A: 1") != radix.canonical(None, "A: 1" + " word" * 30)


def test_trie_terminals():
    rng, trie, want = random.Random(2), radix.Trie(4), {}
    for i in range(2_000):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(30)))
        trie.add(data, i, 1, data)
        want.setdefault(data, []).append(i)
    assert {x[3]: (x[1], x[2]) for x in trie.terminals()} == {k: (min(v), len(v)) for k, v in want.items()}


def test_url_identities(spark):
    same = [["https://doi.example/10.99507/jrn.1", "doi:10.99507/JRN.1", "https://doi.example/10.99507%2Fjrn.1#x"], ["https://works.example/W4000010776", "http://api.works.example/works/w4000010776/"],
            ["https://papers.example/pm/30006483/", "http://mirror.example/abstract/PM/30006483"], ["https://www.x.example:443/a/b/?utm_source=f#t", "HTTP://X.example/a/b"]]
    other = ["https://x.example/A/b", "https://x.example/a/b?id=1", "https://x.example/a/b?id=2"]
    flat = [u for group in same for u in group] + other
    got = [r.u for r in spark.createDataFrame(list(enumerate(flat)), "i int, url string").orderBy("i").select(history.url_identity(F.col("url")).alias("u")).collect()]
    keys = iter(got)
    assert all(len({next(keys) for _ in group}) == 1 for group in same) and len(set(got)) == len(same) + len(other)
    assert spark.createDataFrame([(None,), (" ",)], "url string").where(history.url_identity(F.col("url")).isNotNull()).count() == 0


def brute_refused(rows):
    sets, accepted, urls, out = {}, [], {}, {}
    for i, batch, url, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        sets[i] = brute_set(text)
        hits = [j for j in accepted if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) - 1e-12]
        if url in urls:
            hits.append(urls[url])
        if batch > 0 and hits:
            out[i] = min(hits)
            continue
        accepted.append(i)
        if url:
            urls.setdefault(url, i)
    return out


@pytest.mark.parametrize(("ordered_rows", "block"), [(history.ORDERED_ROWS, neardup.BLOCK), (0, neardup.BLOCK), (history.ORDERED_ROWS, 2)])
def test_history_against_brute_force(spark, monkeypatch, ordered_rows, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(history, "ORDERED_ROWS", ordered_rows)
    if not ordered_rows:  # the way for large batches, with hot keys cut into blocks
        monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(8)
    rows = [(i, min(i // 25, 3), f"https://a.example/{rng.randrange(60)}" if rng.random() < 0.5 else None, t) for i, t in made_records(95, 8)] + [(900, None, None, "x")]
    df = spark.createDataFrame(rows, "ord long, batch int, url string, text string").selectExpr("*", "1 as id", "2 as kind")
    got = {r.id: r.kept for r in history.refused_records(df, "ord", "batch", "url", "text").collect()}
    assert got == brute_refused(rows)
    assert history.refused_records(df.limit(0), "ord", "batch", "url", "text").count() == 0


def test_given_records(spark):
    df = spark.read.parquet(f"{DATA}/docs.parquet")
    rows = [(r.ord, r.text) for r in df.select("ord", "text").collect()]
    assert {(r.a, r.b) for r in neardup.near_duplicate_pairs(df, "ord", "text").collect()} == brute_pairs(rows, 0.7)


def test_history_runs_are_not_shuffled(spark):
    index = history.HistoryIndex(spark, None)
    kinds = "kind int, key long, check long, id long"
    index._write(spark.createDataFrame([(0, 7, 0, 1), (1, 7, 5, 2), (2, 7, 5, 3), (1, 7, -(2**63), 4), (0, 8, 0, 5)], kinds))
    found = index.windows(spark.createDataFrame([(0, 7, 0, 10), (1, 7, 5, 11), (1, 7, 2**63 - 1, 12), (2, 9, 5, 13)], kinds))
    try:
        assert sorted(map(tuple, found.collect())) == [(0, 10, 1), (1, 11, 2)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        run = [line for line in plan.splitlines() if "run_" in line and "FileScan" in line]
        assert run and all("Bucketed: true" in line for line in run)
    finally:
        index.drop()

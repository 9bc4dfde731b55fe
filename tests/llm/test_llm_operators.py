"""Sharding, mixing, URL filter, license scan, decontamination and nearest neighbours against brute force and SQL."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from rosterlens.llm import queries
from rosterlens.llm.decontamination import drop_leaks, find_leaks, largest_loss, leaks_sql
from rosterlens.llm.hnsw import nearest_neighbours
from rosterlens.llm.licenses import find_licenses
from rosterlens.llm.mixing import mix_documents, mix_plan
from rosterlens.llm.sharding import jump_hash, shard_documents, with_shards, write_shards
from rosterlens.llm.url_filter import judge_urls
from verify import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(queries.SQL[name])
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def slow_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_loop_and_moves_only_into_the_new_shard():
    keys = np.concatenate([np.arange(-50, 3000), np.array([2**62, -(2**62)])])
    assert jump_hash(keys, 40).tolist() == [slow_jump(int(k), 40) for k in keys]
    old, new = jump_hash(keys, 40), jump_hash(keys, 41)
    assert set(new[new != old]) == {40}
    assert abs((new != old).mean() - 1 / 41) < 0.02


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = shard_documents(docs).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()), "key")
        assert (r.shard, r.grown_shard) == (slow_jump(r.doc_id, 40), slow_jump(r.doc_id, 41))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(None, None, 1), (7, "é", 2), (7, "é", 3), (8, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = shard_documents(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -9, r.size, r.text_crc32) for r in got) == [(-9, 16, 0), (7, 18, zlib.crc32("é".encode())), (7, 18, zlib.crc32("é".encode())), (8, 16, 0)]
    assert {r.shard for r in got if r.doc_id is None} == {slow_jump(-1, 40)}
    assert sorted(r.slot for r in got if r.doc_id == 7) in ([0, 1], [0, 2], [1, 2])
    assert shard_documents(df.limit(0)).count() == 0
    write_shards(df.drop("slot"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, with_shards(df.drop("slot")).select("doc_id", "text", "shard").collect()))


def test_mix_takes_documents_by_their_rates(spark):
    rows = [(i, "w " * (i % 5), "abcd"[i % 4]) for i in range(400)] + [(None, "x y", None), (900, None, "a"), (901, " ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    plan = mix_plan(docs).collect()
    assert len(plan) == len(rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    targets = {r.source: (r.source_size, r.target) for r in plan}
    assert math.isclose(sum(t for _, t in targets.values()), total)
    assert all(t <= 3 * s + 1e-9 for s, t in targets.values())
    for r in plan:
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.floor(rate) + 1 and r.taken == r.size * r.copies <= 3 * r.size
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in plan if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert sorted(map(tuple, mix_plan(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, plan), key=str)
    assert mix_plan(docs.limit(0)).count() == 0 and mix_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("folder", "within"), [("sf0.1", 0.01), ("sf0.01", 0.03)])
def test_mix_comes_near_its_targets(spark, folder, within):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = mix_plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
    assert all(abs(r.taken / r.target - 1) < within for r in rows) and math.isclose(sum(r.target for r in rows), sum(r["size"] for r in rows))


def test_mix_coins_follow_the_fraction(spark):
    """Over many seeds every document of a stratum gets its extra copy equally often."""
    docs = spark.createDataFrame([(i, "w " * (20 + i % 3), "a") for i in range(30)] + [(100 + i, "w " * 40, "b") for i in range(30)], "doc_id long, text string, source string")
    extra = np.zeros(30)
    for seed in range(8):
        plan = {r.doc_id: r for r in mix_plan(docs, seed=f"s{seed}").collect()}
        rate = plan[100].target / plan[100].source_size
        extra += [plan[100 + i].copies - math.floor(rate) for i in range(30)]
    share = (rate - math.floor(rate)) * 8
    assert abs(extra.mean() - share) < 0.5 and (extra > 0).sum() > 15 and (extra < 8).sum() > 15


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("no scheme casino", "", "", None, "block"), ("http://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/1", "example.net", "/de/1", "net/", "block"), ("http://xexample.com/de/", "xexample.com", "/de/", None, "allow"),
    ("http://example.com/de/#x", "example.com", "/de/", "example.com/de/", "block"), ("http://w.org/fr/casino", "w.org", "/fr/casino", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, "allow"), ("http://free-bets.com/", "free-bets.com", "/", None, "block"), ("http://free-free.com/", "free-free.com", "/", None, "allow"),
    ("http://freebets.com/", "freebets.com", "/", None, "allow"), ("http://ADULT.com/a", "adult.com", "/a", None, "block"), ("x?u=http://h.net/p://q", "h.net", "/p://q", "net/", "block"),
])
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, verdict string")
    r = judge_urls(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_table_without_rows(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_licenses_of_odd_rows(spark):
    long = "filler " * 30_000
    rows = [(1, None), (2, " "), (3, "All rights reserved."), (4, "ALL RIGHTS"), (5, f"{long}Released under the MIT License. {long}"), (6, "released\tunder\nTHE mit license."),
            (7, "This work is licensed under the GNU General Public License, release 3."), (8, "This work licensed under a General License, 3."), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = {(r.doc_id, r.license): (r.windows, r.first_word, r.containment) for r in find_licenses(df).collect()}
    assert got == {(3, "proprietary"): (1, 0, 1.0), (5, "MIT"): (1, 30_000, 1.0), (6, "MIT"): (1, 0, 1.0), (None, "CC-BY-NC-4.0"): (1, 0, 1.0)}
    assert find_licenses(df.limit(0)).count() == 0


def test_leaks_of_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(40))
    edited = item.replace("q20 ", "other ")
    half = " ".join(f"q{i}" for i in range(20))
    far = " ".join(f"z{i}" for i in range(5000))
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, f"{far} {item.upper()} {far}"), (4, edited), (5, half), (6, far), (None, f"a {item}"), (7, "x tiny item y"), (8, "tiny y item")], "doc_id long, text string"
    ).withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(10, item), (11, None), (12, " "), (13, "tiny item"), (14, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert got == {(d, i) for d in (3, 4, None) for i in (10, 14)} | {(7, 13)}
    assert {r.doc_id for r in drop_leaks(docs, items).collect()} == {1, 2, 5, 6, 8}
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
    assert drop_leaks(docs, items.limit(0)).count() == 9


def test_leaks_whose_pieces_stand_apart_match_sql(spark):
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(40)]
    items = [(i, " ".join(rng.permutation([*common[:6], *(f"i{i}w{k}" for k in range(n - 6))]))) for i, n in enumerate([28, 30, 33, 58, 70, 200])]
    far = " ".join(rng.choice(common, 200))
    docs = []
    for _, text in items:
        w = text.split()
        for cut in range(0, len(w), 2):
            docs.append(f"{' '.join(w[:cut])} {far} {' '.join(w[cut:])}")
        for pieces in (3, 5, 8):
            docs.append(f" {far} ".join(" ".join(x) for x in reversed(np.array_split(w, pieces))))
        edge = (len(w) - 4) // 5
        docs += [" ".join(w[edge:]), " ".join(w[edge + 1 :]), " ".join(w[:-edge])]
    docs = list(enumerate(docs))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    cursor = con.execute(leaks_sql())
    wanted = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(df, benchmark).drop("score")
    assert len(docs) // 2 < len(wanted[1])
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == wanted


def test_largest_loss_of_a_leak():
    rng = np.random.default_rng(5)
    for words in (9, 10, 14, 16, 19):
        weights, shingles = rng.random((2, words)), words - 4
        best = np.zeros(2)
        for missing in range(2**shingles):
            if missing.bit_count() <= shingles // 5:
                gone = [all(missing >> s & 1 for s in range(max(0, p - 4), min(p, shingles - 1) + 1)) for p in range(words)]
                best = np.maximum(best, weights[:, gone].sum(axis=1))
        assert np.allclose(largest_loss(weights), best)


def nearest(vectors, query, k):
    own = dict(vectors)[query]
    return sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, own))), i) for i, v in vectors if i != query)[:k]


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in df.collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0, shard_size=1500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 100 == 0]:
        distance = np.sqrt(((matrix - matrix[ids == q][0]) ** 2).sum(axis=1))
        best = [int(ids[j]) for j in np.lexsort((ids, distance)) if ids[j] != q][:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - distance[ids == i][0]) < 1e-9 for _, i, s in mine)
        hits += len(set(best) & {i for _, i, _ in mine})
    assert hits >= 0.95 * 10 * (ids % 100 == 0).sum()


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100 * i, [1.0, 0.0]) for i in range(30)] + [(1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0])]
    rows.append((6, [2.0, 0.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {100 * i for i in range(30)}
    assert all(v == [100 * i for i in range(12) if 100 * i != q][:10] for q, v in got.items())
    few = [(0, [1.0, 1.0]), (1, [1.0, 3.0]), (2, [1.0, -1.0])]
    small = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in nearest_neighbours(small, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 2.0), (2, 2, 2.0)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_rows_take_no_place_of_other_ids(spark):
    rows = [(0, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(1, 13)] + [(50, [1.0, 1.0])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id").isin(0, 12)).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(i, 0.0) for i in range(1, 11)], 12: [(i, 0.0) for i in range(10)]}

"""Near-duplicate components against brute force."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from rosterlens.llm.near_dedup import Settings, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size=3, percent=85):
    """Components over all pairs that share a shingle; rows are (doc_id, text) with distinct ids."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                x, y = root(i), root(j)
                if x != y:
                    parent[x] = y
        for g in s:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)], least[root(i)] == d) for i, (d, _) in enumerate(rows)}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("settings", [Settings(), Settings(chunk_members=3, pivots=1)])
def test_documents_match_brute_force(spark, settings):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs, settings=settings)) == brute(rows)


def test_chain_larger_than_a_chunk(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(100 - k, " ".join([*words[k:], *(f"x{i}" for i in range(k))])) for k in range(12)]
    rows += [(1000 + k, " ".join(words[:50] + [f"y{k}"] * 10)) for k in range(9)]
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings=Settings(chunk_members=4, pivots=1)))
    assert got == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "One word", 9), (5, "one\tWORD", 9), (6, "alone", 9), (7, "a b c d", 9), (7, "a b c d", 9), (None, "a b c d", 9)]
    df = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept int"))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 2, 7, True), (7, 2, 7, True), (None, 2, None, True)],
        key=str,
    )


def test_one_id_with_several_texts_is_one_document(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (3, "p q r s t"), (4, "z")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_five_words_and_four_fifths(spark):
    """The rule of the pipeline's stage, on the given documents and on copies with words appended around the threshold."""
    import random

    draw = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in range(60):
        words = [f"w{draw.randrange(500)}" for _ in range(100)]
        rows += [(10_000 + 3 * k, " ".join(words)), (10_001 + 3 * k, " ".join(words + [f"v{k}x{i}" for i in range(15 + k % 15)])), (10_002 + 3 * k, " ".join(words[:50] + ["odd"] + words[51:]))]
    settings = corpus_pipeline.NEAR_DUPLICATES
    assert (settings.size, settings.percent) == (5, 80) and (1 - 0.8**settings.rows) ** settings.bands < 3e-7
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings=settings)) == brute(rows, 5, 80)


def test_one_id_in_very_many_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    many = spark.range(100_000).selectExpr("7L AS doc_id", f"'{text}' AS text")
    few = spark.createDataFrame([(8, text + " end"), (9, "start " + text), (10, "something else altogether")], "doc_id long, text string")
    got = near_duplicates(many.unionByName(few)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(7, 7, True, 100_000), (8, 7, False, 1), (9, 7, False, 1), (10, 10, True, 1)}


@pytest.mark.parametrize("chunk", [4096, 40])
def test_half_similar_texts_and_a_large_group_of_near_copies(spark, chunk):
    """A long shared notice puts very many texts into common buckets; few of them are linked."""
    import random

    draw = random.Random(8)
    notice = " ".join(f"n{i}" for i in range(60))
    rows = [(i, notice + " " + " ".join(f"t{draw.randrange(3000)}" for _ in range(40))) for i in range(300)]
    base = [f"c{i}" for i in range(120)]
    for i in range(200):
        words = list(base)
        words[draw.randrange(120)] = f"e{i}"
        rows.append((1000 + i, " ".join(words)))
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings=Settings(bucket_chunk=chunk)))
    assert got == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

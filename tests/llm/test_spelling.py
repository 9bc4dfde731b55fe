"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from rosterlens.llm import queries
from rosterlens.llm.spelling import Settings, group_spellings, near_words

FOLDER = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counted(rows, least_length=6, least_count=5):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least_length and n >= least_count}


def near(v, w):
    """Exactly one inserted, deleted or replaced letter, by the plain table of edit distances."""
    if abs(len(v) - len(w)) > 1 or v == w:
        return False
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w)) == 1
    short, long = sorted((v, w), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    words = counted(rows)
    variants = {w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for w in words}
    holders = {}
    for w, own in variants.items():
        for x in own:
            holders.setdefault(x, []).append(w)
    close = {w: [v for v in {v for x in own for v in holders[x]} if near(v, w)] for w, own in variants.items()}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(close[w]), words[form[w]] if w in form else None))
    return out


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, folder):
    folder = f"/root/testdata/{folder}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert result(queries.QUERIES["op13_spelling_variants"](spark, folder)) == want
    assert any(form for _, form, *_ in want)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_every_pair_once(seed):
    draw = random.Random(seed)
    alphabet = ["ab", "abcéÿ", "abcdefghijklmnopqrstuvwxyz", "a"][seed]
    words = sorted({"".join(draw.choices(alphabet, k=draw.randint(6, 9))) for _ in range(300)} | {"a" * 400, "a" * 401, "a" * 200 + "b" + "a" * 199})
    got = [(words[w], words[v]) for first in (True, False) for a, b in near_words(words, words, first, block=37) for w, v in zip(a, b)]
    want = {(w, v) for w in words for v in words if near(v, w)}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_first_letters_are_split(spark):
    draw = random.Random(5)
    words = {"con" + "".join(draw.choices("abcd", k=draw.randint(3, 5))) for _ in range(500)} | {"".join(draw.choices("abc", k=6)) for _ in range(60)}
    rows = [(i, " ".join([w] * (5 + 40 * (i % 3 == 0)))) for i, w in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(group_spellings(df, settings=Settings(shard=40, block=64))) == brute(rows)


def test_forms_chain_to_a_root_and_ties_go_to_the_smaller_word(spark):
    rows = [(1, "Planets " * 900), (2, "planet " * 100), (3, "planeét " * 20), (4, "marble " * 50), (5, "marbla " * 50), (6, "marblx " * 10), (7, "lonely " * 5), (8, "rarely " * 4)]
    got = {r.word: r for r in group_spellings(spark.createDataFrame(rows, "doc_id long, text string"), settings=Settings(typo_every=0)).collect()}
    assert got["planeét"].root == "planets" and got["planet"].form == "planets" and got["planets"].form is None
    assert got["marblx"].form == "marbla" and got["marblx"].n_near == 2 and got["marbla"].form is None
    assert got["lonely"].root == "lonely" and got["lonely"].n_near == 0 and got["lonely"].form_n is None and "rarely" not in got


def test_edge_cases(spark):
    schema = "doc_id long, text string, word string, n long"
    assert result(group_spellings(spark.createDataFrame([], schema))) == set()
    assert result(group_spellings(spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "12 Āā", "x", 1)], schema))) == set()
    rows = [(None, "wonder Wonder"), (1, "wonder"), (1, "wonder"), (2, "WONDER wanderÉ " + "x" * 5000), (3, "×÷×÷×÷ " * 5)]
    assert result(group_spellings(spark.createDataFrame([(*r, "a", 7) for r in rows], schema))) == brute(rows)

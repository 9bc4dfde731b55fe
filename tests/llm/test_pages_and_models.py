"""HTML extraction, secret scan, quality classifier and the pipeline."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rosterlens.llm import html_extract
from rosterlens.llm.html_extract import RUN, extract_text, kept_blocks, parse_page, repeated_prefixes
from rosterlens.llm.quality import document_grade, keep_good, score_quality, train_quality
from rosterlens.llm.secrets import scan_secrets
from rosterlens.llm.wordhash import PIECE, shingle_hashes, word_groups

FOLDER = "/root/testdata/sf0.001"


def text_of(html):
    return "\n".join(parse_page(html).main())


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>cut off <b", "cut off"), ("a < b", "a < b"),
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>m</a></li></ul></nav>"
     "<!-- ad --><div class=\"ad\">Buy</div><article><h1>Head &eacute;</h1><p><b>One\n two<br>three<br><p>Four &lt;x&gt; &#65;</p></article><footer>&copy; f</footer>", "Head é\nOne two three\nFour <x> A"),
    ("<body><header><p>site</p></header><main><header><h1>Title</h1></header><p>x</p><aside>s</aside><form><input value='q'>go</form><div class='reader comments'><p>c</p></div></main>", "Title\nx"),
    ("<div id='cookieNotice'>n</div><div role='main'><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><p>y&nbsp;z</p></div><div class='sidebar'>s</div>", "1\n2\na\nb\ny z"),
    ("<p title=it's>a&am<b>p; b</b> <i x='1'>c</i></p><p>d", "a&amp; b c\nd"), ("<p " + "a='b\"" * 5000, ""),
    ("<article><p>a</article><article class='comment'><p>no</article>after", "a"), ("<article><p>x <span>in</span>line<a href=\"a>b\">z</a></p><script>1", "x inlinez"),
])
def test_blocks_of_a_page(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ('<article><p>a</p><div class="notice-board"><p>b</p></div><p class="form-of-address">c</p><div class="ad-box"><p>d</p></div><div id="related-posts">e</div></article>', "a\nb\nc"),
    ('<main><div class="commentList">x</div><p class="comment-culture">y</p><div class="share">z</div></main><div class="notice-board">w</div>', "y"),
])
def test_a_part_of_a_class_name_removes_nothing_from_an_article(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize("broken", [
    "<a " * 350_000, "<div>" * 100_000 + "</b>" * 100_000, "<b>" + "<div>" * 100_000 + "</b>" * 100_000, "<head>" * 160_000, "<p a='b\"" * 130_000,
    '<a ">' * 200_000, "<!-- " * 200_000, "<" * 1_000_000, "<span>" * 80_000 + "</i>" * 120_000,
])
def test_broken_pages_of_a_megabyte_are_parsed_in_linear_time(broken):
    start = time.perf_counter()
    assert text_of("<article><p>first</p></article>" + broken) == "first"
    assert time.perf_counter() - start < 5


def test_suffix_array_groups_equal_runs():
    rng = np.random.default_rng(5)
    stream = rng.integers(0, 3, 300).astype(np.uint64)
    page = np.repeat(np.arange(6), 50)
    order, heads = repeated_prefixes(stream, page)
    runs = [tuple(stream[s : s + RUN]) for s in order]
    assert sorted(order) == [i for i in range(300 - RUN + 1) if page[i] == page[i + RUN - 1]]
    assert runs == sorted(runs)
    assert all((runs[i] == runs[j]) == (heads[i] == heads[j]) for i in range(len(runs)) for j in range(0, len(runs), 17))


def brute_text(pages, host_of):
    """Unmarked pages: blocks that runs on pages of other identity of the host cover go. Identity: block of most words per page that holds it."""
    parsed = [(host_of(u), h, parse_page(h)) for _, u, h in pages]
    words = lambda b: tuple(w.lower() for w in b.split())
    spread, holders = {}, {}
    for host, h, p in parsed:
        for t, _ in p.blocks if not p.marked else ():
            spread.setdefault((host, words(t)), set()).add(h)
    for host, _, p in parsed:
        if not p.marked and p.blocks:
            identity = max((words(t) for t, _ in p.blocks), key=lambda w: (len(w) / len(spread[host, w]), len(w), w))
            stream = [w for t, _ in p.blocks for w in words(t)]
            for i in range(len(stream) - RUN + 1):
                holders.setdefault((host, *stream[i : i + RUN]), set()).add(identity)
    out = []
    for host, _, p in parsed:
        stream = [w for t, _ in p.blocks for w in words(t)]
        starts = [i for i in range(len(stream) - RUN + 1) if len(holders.get((host, *stream[i : i + RUN]), ())) > 1]
        out.append("\n".join(p.main() if p.marked else kept_blocks(p.main(), starts)))
    return out


def test_unmarked_pages_lose_what_the_host_repeats(spark):
    foot = "all pages of this site end with these very words"
    story = " ".join(f"s{i}" for i in range(30))
    pages = [(i, "http://h.com/x", f"<div>welcome to the site of plain old pages</div><div>{' '.join(f'u{i}_{k}' for k in range(20))}</div><div>{foot}</div>") for i in range(5)]
    pages += [(10 + i, "http://h.com/copy", f"<div>{story}</div><div>{foot}</div>") for i in range(3)]
    pages += [(20, "http://other.com/", f"<div>{foot}</div>"), (21, None, None), (21, None, None), (22, "http://h.com/", f"<article>{foot}</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()}
    texts = brute_text(pages, lambda u: re.sub(r".*?://([^/]*).*", r"\1", u) if u else "")
    assert got == {(p[0], t, len(t)) for p, t in zip(pages, texts)}
    assert (0, " ".join(f"u0_{k}" for k in range(20))) in {g[:2] for g in got} and (10, story) in {g[:2] for g in got} and (22, foot) in {g[:2] for g in got}
    assert extract_text(df.limit(0)).count() == 0


def test_short_articles_under_a_long_shared_notice(spark):
    notice = " ".join(f"n{i}" for i in range(180))
    article = lambda i: " ".join(f"a{i}_{k}" for k in range(40))
    story = " ".join(f"s{i}" for i in range(300))
    pages = [(i, "http://h.com/x", f"<div>{notice}</div><div>{article(i)}</div>") for i in range(6)]
    pages += [(10 + i, "http://h.com/c", f"<div>{notice}</div><div>from reader number {i} of many</div><div>{story}</div>") for i in range(3)]
    pages += [(30, "http://h.com/y", f"<div>{notice} and more</div>"), (31, "http://one.com/", f"<div>{notice}</div><div>{article(1)}</div>")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {p[0]: t for p, t in zip(pages, brute_text(pages, lambda u: u.split("/")[2]))}
    assert all(got[i] == article(i) for i in range(6))
    assert all(story in got[10 + i] and "n0" not in got[10 + i] for i in range(3))
    assert got[31] == f"{notice}\n{article(1)}"


@pytest.mark.parametrize("piece", [200_000, 300])
def test_marked_articles_lose_what_most_pages_of_the_host_repeat(spark, monkeypatch, piece):
    monkeypatch.setattr(html_extract, "PIECE_TOKENS", piece)
    notice = "all stories of this paper are also read aloud on the radio"
    quote = "a passage that some of the stories quote word by word from another one"
    story = " ".join(f"s{i}" for i in range(40))
    own = lambda i: " ".join(f"u{i}_{k}" for k in range(30))
    article = lambda *blocks: "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    pages = [(i, "http://h.com/x", article(own(i), quote if i < 12 else f"without quote {i}", notice)) for i in range(25)]
    pages += [(30 + i, "http://h.com/x", article(own(0), quote, notice) + f"<nav>{i}</nav>") for i in range(40)]  # copies count once
    pages += [(100 + i, "http://copies.com/x", article(f"copy {i}", story)) for i in range(20)]
    pages += [(200 + i, "http://few.com/x", article(own(i), notice)) for i in range(9)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {i: f"{own(i)}\n{quote if i < 12 else f'without quote {i}'}" for i in range(25)} | {30 + i: f"{own(0)}\n{quote}" for i in range(40)}
    want |= {100 + i: f"copy {i}\n{story}" for i in range(20)} | {200 + i: f"{own(i)}\n{notice}" for i in range(9)}
    assert got == want


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for r in pages.join(extract_text(pages).select("page_id", "text"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert re.sub(r"\s+", "", r.text) == re.sub(r"\s+", "", __import__("html").unescape(re.sub(r"<[^>]*>", "", inner)))


def test_long_texts_are_cut_at_white_space():
    text = "Ab cd\t" * (PIECE // 2)
    ((row, counts, words),) = word_groups(pa.array([text]))
    assert (row, counts.tolist()) == (0, [PIECE]) and len(set(words.tolist())) == 2
    shingles, per_row = shingle_hashes(words, counts, 5)
    assert per_row.tolist() == [PIECE - 4] and len(np.unique(shingles)) == 2


def test_secrets_of_labelled_documents(spark):
    key = lambda i: "AKIA" + hashlib.md5(str(i).encode()).hexdigest().upper()[:16]
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(3 * i, f"words and {key(i)} more", "src") for i in range(60)] + [(3 * i + 1, f'api_key = "{secret(i)}" here', "src") for i in range(60)]
    rows += [(3 * i + 2, f"card {4000000000000000 + i * 7919} and averyverylongwordofprose{'abcdefghij'[i % 10] * 3} end", "docs/test") for i in range(60)]
    rows += [(None, f"token: {secret(999)}", None), (500, None, "src"), (501, "", "src"), (502, "x " * 40_000 + f"password={secret(7)}", "src")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"length": F.lit("clash"), "score": F.lit("clash")})
    found = scan_secrets(df).collect()
    good = {r.doc_id for r in found if r.is_secret}
    assert good == {3 * i for i in range(60)} | {3 * i + 1 for i in range(60)} | {None, 502}
    assert {r.doc_id for r in found if not r.is_secret} == {3 * i + 2 for i in range(60)}
    assert next(r.start for r in found if r.doc_id == 502) == 80_000
    assert scan_secrets(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, train_quality(docs, labels.where("doc_id % 3 > 0"), document_grade())


def test_quality_on_held_out_ratings(model):
    docs, labels, fitted = model
    held = labels.where("doc_id % 3 = 0").select("doc_id", document_grade().alias("grade"))
    rows = score_quality(docs, fitted).join(held, "doc_id").collect()
    share = lambda grade, keep: np.mean([r.keep == keep for r in rows if r.grade == grade])
    assert share(2, True) > 0.99 and share(0, False) > 0.95 and share(1, False) > 0.7
    assert all(0 <= r.tail <= 1 and r.tail <= r.expected_grade <= 2 for r in rows)
    kept = keep_good(docs, fitted)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in score_quality(docs, fitted).where("keep").collect()}


def test_quality_of_odd_rows(spark, model):
    _, _, fitted = model
    df = spark.createDataFrame([(None, None), (1, ""), (2, "the " * 100_000), (2, "the " * 100_000)], "doc_id long, text string").withColumn("tail", F.lit("clash"))
    rows = score_quality(df, fitted).collect()
    assert len(rows) == 4 and len({r.tail for r in rows if r.doc_id == 2}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert train_quality(df, none, document_grade()) is None
    assert score_quality(df, None).where("keep").count() == 4 and keep_good(df, None).count() == 4
    assert score_quality(df.limit(0), fitted).count() == 0


def test_pipeline_stages(spark, tmp_path):
    from rosterlens.llm.decontamination import find_leaks
    from rosterlens.llm.mixing import mix_plan
    from rosterlens.llm.near_dedup import near_duplicates
    from test_near_dedup import brute

    documents = docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sharding":
            assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name == "near_dedup":
            assert ids[name] == sorted(d for d, (_, _, kept) in brute(rows, 5, 80).items() if kept)
        if name == "decontamination":
            gone = {r.doc_id for r in find_leaks(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
            assert set(ids[name]) == {d for d, _ in rows} - gone
        if name == "mixing":
            assert ids[name] == sorted(r.doc_id for r in mix_plan(before).collect() for _ in range(r.copies))
        if name == "sharding":
            assert ids[name] == ids["mixing"] and {"shard", "slot", "law", "size"} <= set(docs.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]


def test_training_takes_one_text_of_an_id_and_a_bounded_number_of_features(spark):
    good, bad = "clear words about calm rivers and quiet hills", "buy buy now now cheap $$$ !!! click"
    rows = spark.range(30_000).selectExpr("1L AS doc_id", f"'{good}' AS text").unionByName(spark.createDataFrame([(i, good if i % 2 else bad) for i in range(2, 60)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    fitted = train_quality(rows, labels, document_grade())
    again = train_quality(rows.distinct(), labels, document_grade())
    assert np.array_equal(fitted.weights, again.weights) and np.array_equal(fitted.thresholds, again.thresholds)
    kept = {r.doc_id for r in score_quality(rows.distinct(), fitted).where("keep").collect()}
    assert kept == {i for i in range(1, 60) if i % 2}
    assert train_quality(rows, labels, document_grade(), train_features=1) is None


def test_stages_on_an_empty_table_with_more_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({"size": F.lit("a"), "shard": F.lit("b"), "kept": F.lit(1)})
    empty = spark.createDataFrame([], docs.schema)
    odd = spark.createDataFrame([(None,) * len(docs.columns), (1, None, "en", "s", 0, "a", "b", 1), (1, None, "en", "s", 0, "a", "b", 1)], T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
        assert set(docs.columns) <= set(stage(spark, odd, FOLDER).columns)
        stage(spark, odd, FOLDER).count()

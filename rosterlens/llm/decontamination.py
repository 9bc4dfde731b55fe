"""Benchmark decontamination: a BM25 index of test items, searched by every document.

An item's score in a document is the sum of its impacts over the words that the document holds, wherever they stand; the
impacts of an item sum to 1. An item is retrieved at ``threshold``, or at its bound if that is lower. The bound is the least
score that a document with a leak can have: ``largest_loss`` gives the most that the words of the shingles that may be missing
can weigh. So retrieval misses no leak. It goes by block-max WAND in three steps:

* an item can only reach its threshold if the document has one of its essential terms, the strongest terms without which
  the rest falls short, so only their lists are opened;
* a block of items is skipped when the sum of its largest impacts (as shares of the thresholds) over the document's terms
  stays below 1;
* the items of the blocks that are left are scored in full.

Retrieved items are then verified: the document has at least 0.8 of the item's five-word shingles (its whole word
sequence, if shorter), and half of those of its question (the first two thirds) and of its answer (the rest).

The index is broadcast in blocks of at most ``BLOCK_WORDS`` words of items, one scan of the documents per block, so what is
sent does not grow with the benchmark. Documents are read in place: nothing is shuffled.

Edge cases. Null and blank texts or items match nothing. Items with equal texts are all reported. A row with a null id is
reported with that null; repeated rows are reported repeatedly. Empty tables give an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.shared import WORD
from rosterlens.llm.wordhash import shingle_hashes, word_groups

BLOCK_ITEMS = 8
BLOCK_WORDS = 2_000_000
SHINGLE = 5
THRESHOLD = 0.7
K1, B = 1.2, 0.75
DP_WORDS = 512  # longer items get a bound by their heaviest words
CELLS = 1 << 20  # of one numpy step
EPSILON = 1e-9


@dataclass
class ItemIndex:
    """Inverted index of one block of items as flat arrays; impacts are shares of the score that retrieves the item."""

    items: list  # ids
    lengths: list[int]  # in words
    shingles: list[np.ndarray]  # of each item, in text order
    least: np.ndarray  # score of each item that retrieves it
    terms: np.ndarray  # sorted word hashes
    essential: np.ndarray  # term numbers that open a list
    list_starts: np.ndarray
    list_blocks: np.ndarray  # blocks where the term is essential for some item
    block_starts: np.ndarray
    block_terms: np.ndarray
    block_max: np.ndarray
    item_starts: np.ndarray
    item_terms: np.ndarray
    impacts: np.ndarray


def largest_loss(weights: np.ndarray) -> np.ndarray:
    """The most that words outside all found shingles can weigh in a leak, for items (rows) of one length.

    A leak has 0.8 of the shingles. A word may be absent if all shingles over it are missing, so the choice of the missing
    shingles goes along the words, by the length of the current run of missing ones and the number missing so far.
    """
    items, words = weights.shape
    shingles = words - SHINGLE + 1
    most = shingles // 5
    if most < 1:
        return np.zeros(items)
    if words > DP_WORDS:
        return np.sort(weights, axis=1)[:, -most:].sum(axis=1)
    best = np.full((items, SHINGLE + 1, most + 1), -1.0)  # run (capped), missing so far; below 0 is out of reach
    best[:, SHINGLE - 1, 0] = 0.0  # no shingle stands before the first or after the last
    for p in range(words):
        new = np.full_like(best, -1.0)
        missing = best if p >= shingles else np.concatenate([np.full((items, SHINGLE + 1, 1), -1.0), best[:, :, :-1]], axis=2)
        new[:, 1:] = missing[:, :-1]
        new[:, SHINGLE] = np.maximum(new[:, SHINGLE], missing[:, SHINGLE])
        new[:, SHINGLE] = np.where(new[:, SHINGLE] >= 0, new[:, SHINGLE] + weights[:, p, None], -1.0)
        if p < shingles:
            new[:, 0] = best.max(axis=1)
        best = new
    return best.max(axis=(1, 2))


def least_scores(weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bound of each item; ``weights`` are those of all words of all items in order."""
    starts = np.cumsum(lengths) - lengths
    out = np.ones(len(lengths))
    for length in np.unique(lengths[lengths > SHINGLE]):
        same = np.flatnonzero(lengths == length)
        step = max(1, CELLS // (int(length) * (SHINGLE + 1)))
        for at in range(0, len(same), step):
            part = same[at : at + step]
            out[part] = 1 - largest_loss(weights[starts[part][:, None] + np.arange(length)])
    return out


def build_index(items: list, words: list[np.ndarray], threshold: float) -> ItemIndex:
    """BM25 over the items; every item's impacts sum to 1 before they are divided by the score that retrieves it."""
    shingles = [shingle_hashes(w, np.array([len(w)]), SHINGLE)[0] for w in words]
    if not words:
        none, start = np.zeros(0, np.int64), np.zeros(1, np.int64)
        return ItemIndex(items, [], shingles, none, np.zeros(0, np.uint64), none, start, none, start, none, none, start, none, none)
    length = np.array([len(w) for w in words])
    number = np.repeat(np.arange(len(words)), length)
    terms, term = np.unique(np.concatenate(words), return_inverse=True)
    keys, place, tf = np.unique(number * len(terms) + term, return_inverse=True, return_counts=True)
    item, term = keys // len(terms), keys % len(terms)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((len(words) - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / length.mean())[item]))
    impact /= np.bincount(item, impact)[item]
    least = np.minimum(threshold, least_scores((impact / tf)[place], length))
    impact /= least[item]
    # Essential: from the weakest term up, those with which the sum reaches 1, and all stronger ones.
    order = np.lexsort((term, impact, item))
    below = np.cumsum(impact[order])
    first = np.concatenate([[0], np.flatnonzero(np.diff(item[order])) + 1])
    below -= np.repeat(np.concatenate([[0.0], below[first[1:] - 1]]), np.diff(np.append(first, len(order))))
    strong = order[below >= 1 - EPSILON]
    block = item // BLOCK_ITEMS
    blocks = int(block.max()) + 1
    opened = np.unique(term[strong] * blocks + block[strong])
    essential, starts = np.unique(opened // blocks, return_index=True)
    block_keys, where = np.unique(block * len(terms) + term, return_inverse=True)
    block_max = np.zeros(len(block_keys))
    np.maximum.at(block_max, where, impact)
    return ItemIndex(
        items, length.tolist(), shingles, least, terms, essential, np.append(starts, len(opened)), opened % blocks,
        np.searchsorted(block_keys, np.arange(blocks + 1) * len(terms)), block_keys % len(terms), block_max,
        np.searchsorted(item, np.arange(len(words) + 1)), term, impact,
    )


def _found(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def _sums(held: np.ndarray, n_terms: int, row: np.ndarray, unit: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each pair of row and unit (item or block) the sum of the unit's weights over the terms that the row holds."""
    out = np.zeros(len(row))
    ends = np.cumsum(starts[unit + 1] - starts[unit])
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS, side="right")))
        size = (starts[unit + 1] - starts[unit])[low:high]
        entry = np.repeat(starts[unit[low:high]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        _, own = _found(held, np.repeat(row[low:high], size) * n_terms + terms[entry])
        out[low:high] = np.bincount(np.repeat(np.arange(high - low), size), weights[entry] * own, minlength=high - low)
        low = high
    return out


def retrieve(index: ItemIndex, words: np.ndarray, row_of_word: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, item, score) of all pairs that reach the item's threshold, in the order of rows."""
    if not len(index.terms) or not len(words):
        return []
    n_terms = len(index.terms)
    at, known = _found(index.terms, words)
    held = np.unique(row_of_word[known] * n_terms + at[known])  # each term of a row counts once
    if not len(held):
        return []
    where, opens = _found(index.essential, held % n_terms)
    lists, row = where[opens], (held // n_terms)[opens]
    lengths = index.list_starts[lists + 1] - index.list_starts[lists]
    entry = np.repeat(index.list_starts[lists] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    blocks = len(index.block_starts) - 1
    candidates = np.unique(np.repeat(row, lengths) * blocks + index.list_blocks[entry])
    row, block = candidates // blocks, candidates % blocks
    left = _sums(held, n_terms, row, block, index.block_starts, index.block_terms, index.block_max) >= 1 - EPSILON
    item = (block[left][:, None] * BLOCK_ITEMS + np.arange(BLOCK_ITEMS)).ravel()
    row = np.repeat(row[left], BLOCK_ITEMS)[item < len(index.items)]
    item = item[item < len(index.items)]
    scores = _sums(held, n_terms, row, item, index.item_starts, index.item_terms, index.impacts)
    reached = np.flatnonzero(scores >= 1 - EPSILON)
    return list(zip(row[reached].tolist(), item[reached].tolist(), (scores * index.least[item])[reached].tolist()))


def overlap(item: np.ndarray, document: np.ndarray) -> tuple[int, int, int, int, bool]:
    """Shingles of question and answer, those found in the document (sorted shingles), and whether they make a leak."""
    found = _found(document, item)[1] if len(document) else np.zeros(len(item), bool)
    cut = -(-2 * len(item) // 3) if len(item) > 1 else 1
    question, answer = found[:cut], found[cut:] if len(item) > 1 else found
    leak = 10 * found.sum() >= 8 * len(item) and 2 * question.sum() >= len(question) and 2 * answer.sum() >= len(answer)
    return len(item), int(found.sum()), int(question.sum()), int(answer.sum()), bool(leak)


def _document_shingles(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted hashes of a document's five-word shingles, or of its runs of ``length`` words for an item shorter than that."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    if length >= SHINGLE:
        return np.sort(shingle_hashes(words, np.array([len(words)]), SHINGLE)[0])
    runs = np.lib.stride_tricks.sliding_window_view(words, length)
    return np.sort(shingle_hashes(runs.ravel(), np.full(len(runs), length), SHINGLE)[0])


def leaks_of(index: ItemIndex, texts: pa.Array) -> Iterator[tuple]:
    """(row, item, score, shingles, found, found in question, found in answer) of each verified leak of a column of texts."""
    for first, counts, words in word_groups(texts):
        ends = np.cumsum(counts)
        rows = np.repeat(np.arange(len(counts)), counts)
        held, at = {}, None  # by the length of the runs
        for row, item, score in retrieve(index, words, rows):
            if row != at:
                held, at = {}, row
            size = min(SHINGLE, index.lengths[item])
            if size not in held:
                held[size] = _document_shingles(words[ends[row] - counts[row] : ends[row]], size)
            total, found, question, answer, leak = overlap(index.shingles[item], held[size])
            if leak:
                yield first + row, index.items[item], score, total, found, question, answer


def item_indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> Iterator[ItemIndex]:
    """The index in blocks of items; each holds about ``block_words`` words and is all that the driver holds at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks = -(-size // block_words)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        words, ids = [], []
        numbers = rows["item_id"].to_pylist()
        column = rows["text"].combine_chunks()
        for first, counts, found in word_groups(column):
            for i, w in enumerate(np.split(found, np.cumsum(counts)[:-1])):
                if len(w):
                    words.append(w)
                    ids.append(numbers[first + i])
        if words:
            yield build_index(ids, words, threshold)


_FOUND = "doc_id long, item_id long, score double, shingles long, found long, found_question long, found_answer long"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and leaked item: BM25 score, shingles of the item and those found in the document."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    result = spark.createDataFrame([], _FOUND)
    for index in item_indexes(benchmark, item_id, item_text, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(leaks_of(shared.value, batch.column(1)))
                columns = list(zip(*rows)) if rows else [()] * 7
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                rest = [pa.array(c, pa.float64() if k == 1 else pa.int64()) for k, c in enumerate(columns[1:])]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=[f.split()[0] for f in _FOUND.split(", ")])

        result = result.unionByName(texts.mapInArrow(run, _FOUND))
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that hold a test item; columns unchanged, no shuffle."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    for index in item_indexes(benchmark, item_id, item_text, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for leak in leaks_of(shared.value, batch.column(at)):
                    clean[leak[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def leaks_sql() -> str:
    """The verified pairs from the documents and benchmark tables, without an index (no score)."""
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
        WITH items AS (SELECT item_id, {words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
        runs AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS size, greatest(len(w) - {SHINGLE - 1}, 1) AS n FROM items WHERE len(w) > 0),
        shingles AS (SELECT item_id, size, n, s, array_to_string(w[s:s + size - 1], ' ') AS g
                     FROM (SELECT item_id, w, size, n, unnest(range(1, n + 1)) AS s FROM runs)),
        docs AS (SELECT doc_id, {words("text")} AS w FROM documents WHERE text IS NOT NULL),
        grams AS (SELECT DISTINCT doc_id, size, array_to_string(w[p:p + size - 1], ' ') AS g
                  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
                        FROM docs CROSS JOIN (SELECT DISTINCT size FROM runs))),
        hits AS (SELECT doc_id, item_id, n, count(*) AS found, count(*) FILTER (s <= q) AS found_question,
                        CASE WHEN n > 1 THEN count(*) FILTER (s > q) ELSE count(*) END AS found_answer, q
                 FROM (SELECT *, CASE WHEN n > 1 THEN (2 * n + 2) // 3 ELSE 1 END AS q FROM shingles) JOIN grams USING (size, g)
                 GROUP BY doc_id, item_id, n, q)
        SELECT doc_id, item_id, CAST(n AS BIGINT) AS shingles, found, found_question, found_answer
        FROM hits
        WHERE 10 * found >= 8 * n AND 2 * found_question >= q AND 2 * found_answer >= CASE WHEN n > 1 THEN n - q ELSE 1 END"""

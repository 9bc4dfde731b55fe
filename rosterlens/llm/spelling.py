"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found with FM-indexes of the vocabulary.

Words are counted in generated code. One error leaves one half of a word whole: the left half at the start of its neighbour or
the right half at its end. So the vocabulary is dealt to shards twice, by the first and by the last letters (as many as the
shorter half of the shortest word has), and a word and its neighbour meet in a shard of one of the two. A shard holds an index of its
words, each between delimiters: for last letters over the words as they are, for first letters over the reversed words, the two
directions of a bidirectional search. All words of a shard are searched together: the shared half exactly, letter by letter as an
interval of suffix ranks, then the other half with exactly one error. The index is one sorted array of (letter before the
suffix, rank), in which a step of the backward search is a binary search. Letters that very many words share are split: the
words to be found go to several shards by a hash, and the words searched for to each of them, so that no shard grows with them.

Edge cases. A null or empty text has no words; a null id counts as empty in the hash that deletes letters. Every row is a text, repeated rows
too. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.shared import LETTERS
from rosterlens.session import written_table

RUN = "[A-Za-z\\u00C0-\\u00FF]+"


@dataclass(frozen=True)
class Settings:
    least_length: int = 6
    least_count: int = 5
    ratio: int = 5  # a form must be so many times as frequent as its variant
    typo_every: int = 199  # runs whose hash this divides lose a letter; 0: none
    shard: int = 20_000  # words in a shard's index, about
    block: int = 4_096  # words searched at a time

    @property
    def key_length(self) -> int:
        return self.least_length // 2


def vocabulary(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """word and n over all texts; counts are combined before the shuffle."""
    known = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text, *LETTERS), F.lit(RUN), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if s.typo_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        gone = F.pmod(h, F.length("run")).cast("int")
        word = F.when(h % s.typo_every == 0, F.concat(F.expr("substring(run, 1, gone)"), F.expr("substring(run, gone + 2)"))).otherwise(word)
        known = known.where(F.length("run") >= s.least_length).withColumn("gone", gone)
    return known.select(word.alias("word")).where(F.length("word") >= s.least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= s.least_count)


class Index:
    """FM-index of distinct words. ``words`` are lists of letter codes from 1; a search goes from a word's end to its start."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        count = len(lengths)
        ends = np.cumsum(lengths + 1)
        size = int(ends[-1])
        text = np.zeros(size, np.int64)  # 0 is the delimiter after each word
        inside = np.ones(size, bool)
        inside[ends - 1] = False
        text[inside] = letters
        # Ranks of suffixes by doubling. Delimiters differ by word, so a suffix never depends on the next word.
        rank = np.where(inside, text + count, 0)
        rank[ends - 1] = np.arange(count)
        order, step = np.argsort(rank, kind="stable"), 1
        while True:
            later = np.concatenate([rank[step:], np.full(min(step, size), -1)])[:size]
            order = np.lexsort((later, rank))
            fresh = np.concatenate([[0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(later[order]) != 0))])
            rank = np.empty(size, np.int64)
            rank[order] = fresh
            if fresh[-1] == size - 1:
                break
            step *= 2
        before = np.concatenate([[0], text[:-1]])[order]  # the letter before each suffix, 0 at the start of a word
        self.size, self.count = size, count
        self.before = before
        self.keys = np.sort(before * size + np.arange(size))
        starts = np.flatnonzero(before == 0)
        self.word_at = (np.searchsorted(ends, order[starts], side="right")).astype(np.int64)  # word of each start, by rank
        self.letters = np.unique(letters)

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with ``letter`` and go on as those of [low, high)."""
        return np.searchsorted(self.keys, letter * self.size + low), np.searchsorted(self.keys, letter * self.size + high)

    def whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, word) for the intervals that hold a whole word."""
        a, b = np.searchsorted(self.keys, low), np.searchsorted(self.keys, high)
        hit = np.flatnonzero(b > a)
        return hit, self.word_at[a[hit]]

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All (interval, letter, low, high) one letter further: by the rows of small intervals, by the alphabet for large ones."""
        width = high - low
        small, large = np.flatnonzero(width <= len(self.letters)), np.flatnonzero(width > len(self.letters))
        owner = np.repeat(small, width[small])
        row = np.arange(len(owner)) - np.repeat(np.cumsum(width[small]) - width[small], width[small]) + low[owner]
        pairs = np.unique(owner * (1 << 32) + self.before[row])  # a letter once per interval
        owner, letter = pairs >> 32, pairs & 0xFFFFFFFF
        owner = np.concatenate([owner, np.repeat(large, len(self.letters))])
        letter = np.concatenate([letter, np.tile(self.letters, len(large))])
        some = letter > 0
        owner, letter = owner[some], letter[some]
        a, b = self.step(letter, low[owner], high[owner])
        there = b > a
        return owner[there], letter[there], a[there], b[there]

    def one_error(self, words: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word searched for, word found) for all indexed words at one error that share the last ``exact`` letters.

        ``words`` holds a word per row from its last letter on, filled up with 0.
        """
        ask = np.arange(len(words))
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.count)
        # States with one error: (word, next letter, interval).
        wrong = [np.zeros(0, np.int64)] * 4
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(words.shape[1] + 1):
            # Errors at this place, for the words whose exact part is done.
            free = (exact[ask] <= at) & (at <= lengths[ask])
            if free.any():
                who, lo, hi = ask[free], low[free], high[free]
                owner, letter, a, b = self.children(lo, hi)
                inserted = who[owner], np.full(len(owner), at), a, b
                more = at < lengths[who]
                other = more[owner] & (letter != words[who[owner], min(at, words.shape[1] - 1)])
                replaced = who[owner][other], np.full(int(other.sum()), at + 1), a[other], b[other]
                deleted = who[more], np.full(int(more.sum()), at + 1), lo[more], hi[more]
                wrong = [np.concatenate(x) for x in zip(wrong, inserted, replaced, deleted)]
            # One letter on, with and without an error behind.
            if len(wrong[0]):
                who, place, lo, hi = wrong
                over = place == lengths[who]
                hit, word = self.whole(lo[over], hi[over])
                found.append((who[over][hit], word))
                now = ~over & (place == at)
                a, b = self.step(words[who[now], min(at, words.shape[1] - 1)], lo[now], hi[now])
                on = b > a
                wait = ~over & ~now
                wrong = [np.concatenate([x[wait], y[on]]) for x, y in zip(wrong, (who[now], place[now] + 1, a, b))]
            go = at < lengths[ask]
            ask, low, high = ask[go], low[go], high[go]
            if len(ask):
                low, high = self.step(words[ask, at], low, high)
                on = high > low
                ask, low, high = ask[on], low[on], high[on]
        # What reached its last letter in the last step.
        who, place, lo, hi = wrong
        hit, word = self.whole(lo, hi)
        found.append((who[hit], word))
        pairs = np.unique(np.concatenate([a * self.count + b for a, b in found]))
        return pairs // self.count, pairs % self.count


def _codes(words: list[str], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words in one array (their code points) and the lengths of the words."""
    lengths = np.array([len(w) for w in words], np.int64)
    joined = "".join(w[::-1] if backwards else w for w in words)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64), lengths


def _matrix(words: list[str], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """A row per word, from the end at which the search begins."""
    flat, lengths = _codes(words, backwards)
    out = np.zeros((len(words), int(lengths.max(initial=1))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def near_words(indexed: list[str], asked: list[str], first: bool, block: int = 4_096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position in asked, position in indexed) of the pairs at one error that share the left (``first``) or the right half.

    The left half of a word has half of its letters, rounded down. A pair that shares both is left to the side ``first``.
    """
    # A search runs backwards, so it needs the words as they are to begin with their last letters.
    index = Index(*_codes(indexed, first))
    by_length = sorted(range(len(asked)), key=lambda i: len(asked[i]))
    for at in range(0, len(by_length), block):
        part = by_length[at : at + block]
        words, lengths = _matrix([asked[i] for i in part], not first)
        left = lengths // 2
        who, what = index.one_error(words, lengths, left if first else lengths - left)
        who = np.array(part)[who]
        if not first:
            keep = np.array([not indexed[v].startswith(asked[w][: len(asked[w]) // 2]) for w, v in zip(who, what)], bool)
            who, what = who[keep], what[keep]
        yield who, what


def _near_batches(block: int):
    """Rows of a shard follow each other; each shard has a bounded number of indexed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts).combine_chunks()
            held = rows.filter(rows["held"])
            asked = rows.filter(pa.compute.invert(rows["held"]))["word"].to_pylist()
            if not held.num_rows or not asked:
                return
            counts, words = held["n"].to_numpy(), held["word"].to_pylist()
            for who, what in near_words(words, asked, parts[0].column("first")[0].as_py(), block):
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in who]), pa.array([words[i] for i in what]), pa.array(counts[what])], names=["word", "near", "near_n"])

        held, key = [], None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if shards[a] != key and held:
                        yield from done(held)
                        held = []
                    key = shards[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from done(held)

    return run


def near_pairs(words: DataFrame, s: Settings) -> DataFrame:
    """word, near, near_n: all ordered pairs of words (word, n) at one error, each once."""
    size = F.lit(s.key_length)
    sides = words.select(
        "word", "n", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.left("word", size).alias("key")), F.struct(F.lit(False).alias("first"), F.right("word", size).alias("key")))).alias("side")
    ).select("word", "n", "side.*")
    # One row per side and run of key_length letters; frequent ones get more shards.
    keys = sides.groupBy("first", "key").agg(F.ceil(F.count("*") / F.lit(s.shard)).cast("int").alias("parts"))
    total = max(1, -(-words.count() // s.shard))
    # Shards of one side have even numbers, those of the other odd ones.
    shard = lambda part: F.pmod(F.xxhash64("key", part), F.lit(total)) * 2 + F.col("first").cast("long")
    dealt = sides.join(keys, ["first", "key"])
    held = dealt.select(shard(F.pmod(F.xxhash64("word"), "parts").cast("int")).alias("shard"), F.lit(True).alias("held"), "first", "word", "n")
    asked = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(shard(F.col("part")).alias("shard"), F.lit(False).alias("held"), "first", "word", "n")
    # Two parts of a key may fall into one shard, which then gets the words to search for twice.
    rows = held.unionByName(asked.distinct()).repartition(2 * total, "shard").sortWithinPartitions("shard")
    return rows.mapInArrow(_near_batches(s.block), "word string, near string, near_n long")


def group_spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near and form_n per word of the vocabulary.

    A word's form is its near word of largest n (ties: smallest) if that is at least ``ratio`` times the word's own; root is
    where the forms lead.
    """
    s = settings
    words = written_table(vocabulary(docs, doc_id, text, s), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best")
    near = near_pairs(words, s).groupBy("word").agg(F.count("*").alias("n_near"), best)
    frequent = -F.col("best.less") >= s.ratio * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")
    )
    table = written_table(table, "forms")
    # Counts grow by the ratio along forms, so a chain is short; each round doubles the way followed.
    up = written_table(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if up.join(step, "root", "left_semi").isEmpty():
            break
        up = written_table(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return table.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

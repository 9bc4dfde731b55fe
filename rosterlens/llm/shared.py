"""Helpers that several training-data operators use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.session import written_table

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being the smallest node in reach.

    ``edges`` has two columns of one orderable type. Each round hooks every node to its smallest neighbour, follows the
    pointers one step further and contracts the edges, so the number of rounds grows with the logarithm of the longest
    path. The minima are combined before the shuffle and rounds are cut by written tables. Edges with a null end and
    loops are ignored; nodes without another edge do not appear.
    """
    a, b = edges.columns[:2]
    live = written_table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select("v", "u"))
        hook = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("up"))
        hook = written_table(hook, "hooks")
        next_up = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = written_table(hook.join(next_up, "up").select("node", F.col("top").alias("up")), "hooks")
        rounds.append(jumped)
        left = jumped.select(F.col("node").alias("u"), F.col("up").alias("p"))
        right = jumped.select(F.col("node").alias("v"), F.col("up").alias("q"))
        live = written_table(
            live.join(left, "u").join(right, "v").where("p <> q")
            .select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct(),
            "edges",
        )
    if not rounds:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = rounds[0].select("node", F.col("up").alias("component"))
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("component"), "up")
        label = label.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return label


def consecutive(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the columns ``names``, over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for name in names:
            column = batch.column(name)
            if batch.num_rows > 1:
                new[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(batch.column(name)[start].as_py() for name in names)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held, last = [*held, batch.slice(start, stop - start)], key
    if held:
        yield pa.Table.from_batches(held)


def in_tiles(rows: DataFrame, by: list[str], chunk: int, key: str) -> DataFrame:
    """The rows with columns i, j (the tile) and later (its second side): every two rows of a group meet in one tile.

    Groups of up to ``chunk`` rows are one tile; larger ones are dealt to chunks by a hash, and every two chunks are a tile.
    """
    large = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk)
    # Written, so that the join goes by its size: broadcast where it is small, and then the rows move once.
    large = written_table(large.select(*(F.col(c).alias(f"_{c}") for c in by), F.ceil(F.col("_n") / F.lit(chunk)).cast("int").alias("_chunks")), "large")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    placed = rows.join(large, same, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64(key), "_chunks").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    tiles = placed.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "later": F.col("_own") > F.col("_other")})
    return tiles.select(*rows.columns, "i", "j", "later").repartition(*by, "i", "j").sortWithinPartitions(*by, "i", "j")


def tile_sides(tile: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The two sides of a tile; the same one twice on the diagonal."""
    if tile["i"][0] == tile["j"][0]:
        return tile, tile, True
    later = tile["later"]
    return tile.filter(pa.compute.invert(later)), tile.filter(later), False


class Groups:
    """Links among the members of a tile as one star per group."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, i: int, js: np.ndarray) -> None:
        found = np.unique(np.append(self.label[js], self.label[i]))
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        away = np.flatnonzero(self.label != np.arange(len(self.label)))
        return away, self.label[away]

"""MinHash near-duplicate removal with b-bit signatures.

One pass over the texts gives each document the digest of its shingle set, band keys from full minima and the low bits
of all minima packed in a signature. Documents with equal sets form a class. In the band buckets the collision-corrected
b-bit similarity selects the pairs that may be linked; pairs that are connected already are skipped, so a bucket of copies costs
little. What is connected through such pairs is a family; inside a family the full shingle sets are compared. Nothing is sampled
or capped: a bucket larger than one task's share is dealt out in chunks of which every two meet, a larger family in chunks that
are joined through common pivots, and what the pivots leave apart is compared with every chunk.

Edge cases. Null or blank texts have an empty set and link with nothing. Rows with a null id link with nothing, have a
null component and are kept. Rows that repeat an id are one document: they share its component, and stay or go together.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rosterlens.llm.shared import Groups, components, consecutive, in_tiles, tile_sides
from rosterlens.llm.wordhash import mix, shingle_hashes, word_groups
from rosterlens.session import written_table


@dataclass(frozen=True)
class Settings:
    """A pair at the threshold is missed by every band with probability (1 - 0.85 ** rows) ** bands, below 3e-7."""

    size: int = 3  # words in a shingle
    percent: int = 85  # links need 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 6
    bits: int = 4  # low bits kept of each minimum
    slack: float = 5.0  # standard errors below the threshold that a signature may show
    chunk_members: int = 800
    chunk_shingles: int = 1_000_000
    pivots: int = 64
    bucket_chunk: int = 4_096

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        s = self.percent / 100
        return s - self.slack * (s * (1 - s) / self.hashes) ** 0.5


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> np.uint64(32)).astype(np.uint32)


def minima(shingles: np.ndarray, per_row: np.ndarray, k: int) -> np.ndarray:
    """The k minima of each row's shingles (rows with none must be left out before)."""
    multiply, flip = _permutations(k)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty((len(per_row), k), np.uint32)
    row = 0
    while row < len(per_row):
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + 32_768, side="right")) - 1)
        block, at = short[starts[row] : starts[stop]], starts[row:stop] - starts[row]
        for i in range(k):
            out[row:stop, i] = np.minimum.reduceat((block ^ flip[i]) * multiply[i], at)
        row = stop
    return out


def band_keys(low: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit bucket key per row and band, different between bands."""
    parts = low.reshape(len(low), s.bands, s.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(s.rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def packed_bits(low: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each minimum, packed into 64-bit words."""
    per_word = 64 // bits
    width = -(-low.shape[1] // per_word) * per_word
    cut = np.zeros((len(low), width), np.uint64)
    cut[:, : low.shape[1]] = low & np.uint32((1 << bits) - 1)
    shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_or.reduce(cut.reshape(len(low), width // per_word, per_word) << shifts, axis=2)


def estimated(one: np.ndarray, many: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Similarity from the share of equal b-bit values, corrected for the values that agree by chance."""
    differ = one ^ many
    step = 1
    while step < bits:
        differ |= differ >> np.uint64(step)
        step *= 2
    ones = np.uint64(sum(1 << (i * bits) for i in range(64 // bits)))
    unequal = np.bitwise_count(differ & ones).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-bits
    return ((1 - unequal / k) - chance) / (1 - chance)


def _distinct(shingles: np.ndarray, per_row: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x) for x in np.split(shingles, np.cumsum(per_row)[:-1])] if len(per_row) else []


def _digest_batches(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts, words in word_groups(batch.column(1)):
                shingles, per_row = shingle_hashes(words, counts, s.size)
                sets = _distinct(shingles, per_row)
                full = np.flatnonzero(per_row)
                n, h1, h2 = np.zeros((3, len(counts)), np.uint64)
                for i in full:
                    n[i] = len(sets[i])
                    h1[i] = mix(sets[i]).sum(dtype=np.uint64)
                    h2[i] = mix(sets[i] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                low = minima(np.concatenate([sets[i] for i in full]), n[full].astype(np.int64), s.hashes) if len(full) else np.zeros((0, s.hashes), np.uint32)
                lengths = np.where(per_row > 0, s.bands, 0)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(offsets, band_keys(low, s).ravel().view(np.int64))
                signatures = [b""] * len(counts)
                for i, bits in zip(full, packed_bits(low, s.bits)):
                    signatures[i] = bits.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(counts)), *(pa.array(x.view(np.int64)) for x in (n, h1, h2)), bands, pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "signature"],
                )

    return run


def _bucket_links(s: Settings):
    """Links that connect the members of a bucket whose estimated similarity allows the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in consecutive(batches, ["bucket", "i", "j"]):
            a, b, same = tile_sides(tile)
            if not a.num_rows or not b.num_rows or tile.num_rows < 2:
                continue
            whole, split = (a, 0) if same else (pa.concat_tables([a, b]), a.num_rows)
            reps, sizes = whole["rep"].to_numpy(), whole["n_shingles"].to_numpy()
            bits = np.frombuffer(b"".join(whole["signature"].to_pylist()), np.uint64).reshape(len(reps), -1)
            groups = Groups(len(reps))
            for i in range(a.num_rows):
                from_ = i + 1 if same else split
                rest = from_ + np.flatnonzero(groups.label[from_:] != groups.label[i])
                rest = rest[100 * np.minimum(sizes[i], sizes[rest]) >= s.percent * np.maximum(sizes[i], sizes[rest])]
                if len(rest):
                    near = rest[estimated(bits[i], bits[rest], s.hashes, s.bits) >= s.least_estimate]
                    if len(near):
                        groups.link(i, near)
            members, roots = groups.stars()
            if len(members):
                yield pa.RecordBatch.from_arrays([pa.array(reps[members]), pa.array(reps[roots])], names=["rep", "low"])

    return run


def _confirm(reps: np.ndarray, groups: list, texts: pa.Array, s: Settings) -> list[tuple[int, int]]:
    """Confirmed links among the documents of one tile that connect all that are linked there."""
    sets, lows = [], []
    for _, counts, words in word_groups(texts):
        shingles, per_row = shingle_hashes(words, counts, s.size)
        own = _distinct(shingles, per_row)
        lows.append(minima(np.concatenate(own), np.array([len(x) for x in own]), s.hashes))
        sets += own
    low = np.concatenate(lows)
    bands, packed = band_keys(low, s), packed_bits(low, s.bits)
    sizes = np.array([len(x) for x in sets])
    parent = list(range(len(reps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    known: dict = {}
    for i, g in enumerate(groups):
        if g is not None:
            parent[i] = root(known.setdefault(g, i))
    links = []
    for i in range(len(reps) - 1):
        rest = slice(i + 1, None)
        fits = 100 * np.minimum(sizes[i], sizes[rest]) >= s.percent * np.maximum(sizes[i], sizes[rest])
        fits &= (bands[i] == bands[rest]).any(axis=1)
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        score = estimated(packed[i], packed[i + 1 + near], s.hashes, s.bits)
        for j in i + 1 + near[score >= s.least_estimate][np.argsort(-score[score >= s.least_estimate], kind="stable")]:
            x, y = root(i), root(int(j))
            if x == y:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= s.percent * (sizes[i] + sizes[j] - both):
                parent[max(x, y)] = min(x, y)
                links.append((int(reps[i]), int(reps[j])))
    return links


def _tile_batches(s: Settings):
    """Rows arrive ordered by tile; each tile has a bounded number of members and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            tile = pa.Table.from_batches(parts)
            if tile.num_rows < 2:
                return None
            links = _confirm(tile["rep"].to_numpy(), tile["grp"].to_pylist(), tile["text"], s)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held, key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j"))))
            start = 0
            for at in range(len(keys)):
                if keys[at] != key:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    if held and (out := done(held)) is not None:
                        yield out
                    held, key, start = [], keys[at], at
            if len(keys) > start:
                held.append(batch.slice(start))
        if held and (out := done(held)) is not None:
            yield out

    return run


def _links(tiles: DataFrame, s: Settings) -> DataFrame:
    dealt = tiles.select("family", "i", "j", "rep", "grp", "text").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(_tile_batches(s), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id = component_id) per row."""
    s = settings
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    digests = written_table(texts.mapInArrow(_digest_batches(s), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, signature binary"), "digests")
    usable = digests.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = usable.withColumnRenamed("doc_id", "rep").join(classes, ["h1", "h2", "rep"], "left_semi").dropDuplicates(["rep", "h1", "h2"])

    # Candidate families: classes that share a band bucket and whose signatures are close enough.
    banded = written_table(reps.select("rep", "n_shingles", F.explode("bands").alias("bucket")), "banded")
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket")
    together = written_table(banded.join(shared, "bucket", "left_semi"), "together")
    signed = together.join(reps.select(F.col("rep").alias("_rep"), "signature"), F.col("rep") == F.col("_rep")).select("bucket", "rep", "n_shingles", "signature")
    stars = in_tiles(signed, ["bucket"], s.bucket_chunk, "rep").mapInArrow(_bucket_links(s), "rep long, low long").distinct()
    families = written_table(components(stars), "families")

    # Members with their texts, in chunks that one task can hold.
    lengths = banded.groupBy("rep").agg(F.sum("n_shingles").alias("w"))
    sized = families.join(lengths.withColumnRenamed("rep", "node"), "node")
    shares = sized.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(s.chunk_members)), F.ceil(F.sum("w") / F.lit(s.bands * s.chunk_shingles))).alias("chunks")
    )
    placed = families.join(shares, "component").select(
        F.col("node").alias("rep"), F.col("component").alias("family"), "chunks", F.pmod(F.xxhash64("node"), "chunks").alias("chunk")
    )
    # Repeated rows are one member; they are combined before the shuffle.
    members = written_table(texts.join(placed, texts.doc_id == placed.rep).where("text IS NOT NULL").select("family", "chunks", "chunk", "rep", "text").distinct(), "members")
    of_family = Window.partitionBy("family").orderBy(F.xxhash64("rep"), "rep")
    pivots = members.where("chunks > 1").withColumn("rank", F.row_number().over(of_family)).where(F.col("rank") <= s.pivots)
    pivots = pivots.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("i <> chunk")
    none = F.lit(None).cast("long")
    first = members.withColumn("i", F.col("chunk")).unionByName(pivots.drop("rank")).select("family", "i", F.lit(0).alias("j"), "rep", none.alias("grp"), "text")
    # One document with several texts links the classes of its texts.
    own = usable.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    repeated = own.join(several, "doc_id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    links = written_table(_links(first, s).unionByName(repeated), "links")

    # Large families that the pivots leave in several parts: what is outside the largest part meets every chunk.
    large = members.where("chunks > 1")
    if not large.isEmpty():
        found = written_table(components(links), "parts")
        parts = written_table(
            large.join(found, large.rep == found.node, "left").select("family", "chunks", "chunk", "rep", F.coalesce("component", "rep").alias("grp"), "text"),
            "parts",
        )
        counts = parts.groupBy("family", "grp").agg(F.count("*").alias("n"))
        main = counts.groupBy("family").agg(F.max_by("grp", F.struct("n", "grp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        apart = main.where("`all` > most").select("family", "main", F.ceil((F.col("all") - F.col("most")) / F.lit(s.chunk_members)).alias("outer"))
        parts = parts.join(apart, "family")
        outer_chunk = F.pmod(F.xxhash64("rep", F.lit(1)), "outer")
        outside = parts.where("grp <> main").select("family", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), outer_chunk.alias("j"), "chunk", "rep", "grp", "text")
        every = parts.select("family", F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("j"), "rep", "grp", "text", (F.col("grp") != F.col("main")).alias("out"), outer_chunk.alias("oc"))
        tiles = outside.select("family", "i", "j", "rep", "grp", "text").unionByName(
            every.where("NOT (out AND oc = j)").select("family", "i", "j", "rep", "grp", "text")
        )
        links = links.unionByName(written_table(_links(tiles, s), "links"))
    linked = written_table(components(links), "components")

    named = usable.select("h1", "h2", "doc_id", "n_shingles").join(classes, ["h1", "h2"]).join(linked, F.col("rep") == linked.node, "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    others = digests.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(others).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

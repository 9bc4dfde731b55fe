"""Near-duplicate vectors: binary codes under a random rotation pick the pairs whose cosine is computed.

Rows of one label with equal vectors form a class. Each class gets the signs of its randomly rotated unit vector as a
code, with two factors: the code's inner product with the vector, which corrects the estimate, and the spread of what the code
leaves out, which bounds its error. ``<code of a, rotated b> / <code of a, a>`` is an unbiased estimate of the cosine of a and b; for a pair
at the threshold its standard error is at most ``sqrt(1 - cosine ** 2) * spread``, and a pair is given up only when the estimate stays
``errors`` of these below the threshold.

Candidates come from buckets of random hyperplanes, with as many tables as the chance of a miss asks for. A row of a bucket
carries code, factors and the rotated vector in single bytes, never the vector. Inside a bucket the estimates link what may be
near, and the components of these links are families; only members of families meet as vectors, where the pairs that the estimate
does not rule out get their exact cosine, each pair in one place. Buckets and families beyond one task's share are dealt out in
chunks, of which every two meet in a tile. Neither candidates nor partners are capped, and tiles emit at most one link a member,
plus the members' numbers of links. A pair at the threshold is missed with probability below 1e-6.

Edge cases. Vectors that are null, empty, all zero or hold null or non-finite components, and rows with a null label or a null id,
link with nothing; their component is their own id. Rows that repeat id, label and vector are one vector and come back each; an id
with several vectors is as many vectors, and component_id is the smallest id in reach of each. Vectors of different length are not
compared. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.shared import Groups, components, consecutive, in_tiles, tile_sides
from rosterlens.session import written_table


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.93
    miss: float = 1e-7  # chance that a pair at the threshold shares no bucket
    errors: float = 5.3  # standard errors below the threshold at which a pair is given up
    least_bits: int = 64  # rotations are stacked until a code has so many
    bucket: int = 512  # unrelated members of a bucket, about
    chunk: int = 2_048  # members of a tile's side
    seed: int = 12

    def bands(self, largest_label: int) -> tuple[int, int]:
        """Hyperplanes per table and number of tables."""
        width = max(2, math.ceil(math.log2(max(largest_label, 1) / self.bucket))) if largest_label > self.bucket else 2
        share = (1 - math.acos(self.cosine) / math.pi) ** width
        return width, math.ceil(math.log(self.miss) / math.log(1 - share))


def rotations(dim: int, s: Settings) -> np.ndarray:
    """Random rotations one under the other, (bits, dim)."""
    draw = np.random.default_rng([s.seed, dim])
    parts = []
    for _ in range(-(-s.least_bits // dim)):
        q, r = np.linalg.qr(draw.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts)


def hyperplanes(dim: int, number: int, s: Settings) -> np.ndarray:
    return np.random.default_rng([s.seed, dim, 1]).standard_normal((number, dim))


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two (which rounds nothing), so that the squares of their components stay in range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


@dataclass
class Codes:
    """Signs of the rotated unit vectors, the two factors, and the rotated vectors in single bytes times ``scale``."""

    signs: np.ndarray  # +-1, (rows, bits)
    factor: np.ndarray  # sum over the rotations of <code, vector>
    spread: np.ndarray  # standard error of the estimate for a pair of cosine 0
    rotated: np.ndarray
    scale: np.ndarray
    dim: int

    FIELDS = "code binary, factor float, spread float, rotated binary, scale float"

    @classmethod
    def of(cls, vectors: np.ndarray, turn: np.ndarray) -> Codes:
        dim = turn.shape[1]
        seen = (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))) @ turn.T
        # A rotation's code explains the share f of the vector; the rest, of length sqrt(1 - f * f), points anywhere in dim - 1 directions.
        f = np.minimum(np.abs(seen).reshape(len(seen), -1, dim).sum(axis=2) / math.sqrt(dim), 1)
        factor = f.sum(axis=1)
        spread = np.sqrt((1 - f * f).sum(axis=1) / max(dim - 1, 1)) / factor
        scale = np.abs(seen).max(axis=1) / 127
        return cls(np.where(seen >= 0, 1, -1).astype(np.float32), factor, spread, np.rint(seen / scale[:, None]).astype(np.int8), scale, dim)

    def columns(self) -> list[pa.Array]:
        packed, number = np.packbits(self.signs > 0, axis=1), lambda x: pa.array(x, pa.float32())
        return [pa.array([r.tobytes() for r in packed], pa.binary()), number(self.factor), number(self.spread), pa.array([r.tobytes() for r in self.rotated], pa.binary()), number(self.scale)]

    @classmethod
    def read(cls, rows: pa.Table, dim: int) -> Codes:
        flat = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind).reshape(rows.num_rows, -1)
        rotated = flat("rotated", np.int8)
        signs = np.unpackbits(flat("code", np.uint8), axis=1)[:, : rotated.shape[1]].astype(np.float32) * 2 - 1
        return cls(signs, *(rows[c].to_numpy().astype(np.float64) for c in ("factor", "spread")), rotated, rows["scale"].to_numpy().astype(np.float64), dim)

    def estimates(self, mine: slice, other: Codes) -> np.ndarray:
        """Unbiased estimates of the cosines of the rows ``mine``, by their codes, with all rows of ``other``."""
        dots = self.signs[mine] @ (other.rotated.astype(np.float32) * other.scale[:, None].astype(np.float32)).T
        return dots / (math.sqrt(self.dim) * self.factor[mine])[:, None]

    def least(self, s: Settings, largest_scale: float) -> np.ndarray:
        """The least estimate of a pair that may be at the threshold: sampling error of the code and rounding to bytes."""
        rounding = 6 * math.sqrt(self.signs.shape[1] / 12) * largest_scale / (math.sqrt(self.dim) * self.factor)
        return s.cosine - s.errors * math.sqrt(1 - s.cosine**2) * self.spread - rounding


def possible(a: Codes, b: Codes, same: bool, s: Settings, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(row of a, rows of b) that one of the two estimates does not rule out; within one side each pair once."""
    least_a, least_b = a.least(s, b.scale.max(initial=0)), b.least(s, a.scale.max(initial=0))
    for at in range(0, len(a.factor), rows):
        mine = slice(at, min(at + rows, len(a.factor)))
        part = Codes(a.signs[mine], a.factor[mine], a.spread[mine], a.rotated[mine], a.scale[mine], a.dim)
        near = (a.estimates(mine, b) >= least_a[mine, None]) | (b.estimates(slice(None), part).T >= least_b)
        for i in np.flatnonzero(near.any(axis=1)):
            js = np.flatnonzero(near[i])
            js = js[js > at + i] if same else js
            if len(js):
                yield at + int(i), js


def _coded(width: int, tables: int, s: Settings):
    powers = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column("vector")).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                vectors = in_range(rows.column("vector").flatten().to_numpy().reshape(rows.num_rows, dim))
                sides = (vectors @ hyperplanes(dim, width * tables, s).T >= 0).reshape(rows.num_rows, tables, width)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1) * tables, pa.int32()), pa.array((sides @ powers).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("cid"), rows.column("label"), pa.array(np.full(rows.num_rows, dim), pa.int32()), *Codes.of(vectors, rotations(dim, s)).columns(), keys],
                    names=["cid", "label", "dim", "code", "factor", "spread", "rotated", "scale", "keys"],
                )

    return run


_LINKS = "a long, b long, n long"


def _linked(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.zeros(len(a)) if n is None else n, pa.int64())], names=["a", "b", "n"])


def _bucket_links(s: Settings):
    """Links between members of a bucket whose estimate allows the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in consecutive(batches, ["label", "dim", "bucket", "key", "i", "j"]):
            a, b, same = tile_sides(tile)
            if not a.num_rows or not b.num_rows or tile.num_rows < 2:
                continue
            dim, shift = tile["dim"][0].as_py(), 0 if same else a.num_rows
            ids = a["cid"].to_numpy() if same else np.concatenate([a["cid"].to_numpy(), b["cid"].to_numpy()])
            one = Codes.read(a, dim)
            groups = Groups(len(ids))
            for i, js in possible(one, one if same else Codes.read(b, dim), same, s):
                groups.link(i, js + shift)
            members, roots = groups.stars()
            if len(members):
                yield _linked(ids[members], ids[roots])

    return run


def _family_links(s: Settings):
    """Exact links within families: per member the number of vectors linked with it, and a star per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in consecutive(batches, ["family", "i", "j"]):
            a, b, same = tile_sides(tile)
            if not a.num_rows or not b.num_rows or tile.num_rows < 2:
                continue
            whole = a if same else pa.concat_tables([a, b])
            ids, copies, split = whole["cid"].to_numpy(), whole["copies"].to_numpy(), 0 if same else a.num_rows
            vectors = in_range(whole["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
            lengths = np.sqrt((vectors * vectors).sum(axis=1))
            turn = rotations(vectors.shape[1], s)
            first = Codes.of(vectors[: a.num_rows], turn)
            groups, found = Groups(len(ids)), np.zeros(len(ids), np.int64)
            for i, js in possible(first, first if same else Codes.of(vectors[split:], turn), same, s):
                js = js + split
                js = js[vectors[js] @ vectors[i] / (lengths[js] * lengths[i]) >= s.cosine]
                if len(js):
                    found[i] += copies[js].sum()
                    found[js] += copies[i]
                    groups.link(i, js)
            members, roots = groups.stars()
            yield _linked(ids[members], ids[roots])
            some = np.flatnonzero(found)
            yield _linked(ids[some], ids[some], found[some])

    return run


def near_vectors(
    embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", settings: Settings = Settings()
) -> DataFrame:
    """vec_id, n_links, component_id and kept per row: links join rows of one label with a cosine of at least ``settings.cosine``."""
    s = settings
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    classes = rows.where(usable).groupBy("label", "vector", "vec_id").agg(F.lit(1).alias("one")).groupBy("label", "vector")
    classes = written_table(classes.agg(F.sum("one").alias("copies"), F.min("vec_id").alias("least_id")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    width, tables = s.bands(largest)
    kind = classes.schema["label"].dataType.simpleString()
    schema = f"cid long, label {kind}, dim int, {Codes.FIELDS}, keys array<long>"
    coded = written_table(classes.select("cid", "label", "vector").mapInArrow(_coded(width, tables, s), schema), "codes")
    payload = ["cid", "label", "dim", *(f.split()[0] for f in Codes.FIELDS.split(", "))]
    buckets = coded.select(*payload, F.posexplode("keys").alias("bucket", "key"))
    near = in_tiles(buckets, ["label", "dim", "bucket", "key"], s.chunk, "cid").mapInArrow(_bucket_links(s), _LINKS)
    families = written_table(components(near.select("a", "b")), "families")

    members = families.select(F.col("node").alias("cid"), F.col("component").alias("family")).join(classes.select("cid", "vector", "copies"), "cid")
    links = written_table(in_tiles(members, ["family"], s.chunk, "cid").mapInArrow(_family_links(s), _LINKS), "links")
    parts = written_table(components(links.where("a <> b").select("a", "b")), "parts")
    counts = links.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    known = classes.join(counts, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("label", "vector", "least_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component")
    least = known.where("component IS NOT NULL").groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(least, "component", "left").select("label", "vector", "n_links", F.coalesce("component_id", "least_id").alias("component_id"))
    linked = rows.where(usable).join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    others = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

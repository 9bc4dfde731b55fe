"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, the weights share out the total with a limit per source, and every document is emitted
floor(rate) times, plus one copy more with the probability of the rate's fraction. The coins of these copies are thrown
together, so that a source's words come out near its target: documents of about one size (four strata an octave) share out
a whole number of copies, which go to the smallest hashes of seed and id among them. Each stratum's number is what the
fraction asks for plus what the strata of larger documents left over or overdrew, rounded at a hash-seeded point; a stratum
whose documents have more than a hundredth of the target's words each is rounded to nearest. Reruns agree.

Edge cases. A null or blank text has size 0 and takes nothing. The null source is a source like any other and comes
last. A null id takes its coin from the text; rows that repeat an id share one coin, and copies whose coin is that of the last
document taken are taken too. Where all sizes are 0 all targets are 0. An empty table gives an empty result. New columns
replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.shared import WORD
from rosterlens.operators.ranking import same_keys, value_positions
from rosterlens.session import written_table

WEIGHTS = (5, 2, 1)
REPEAT = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_index(df: DataFrame, *order: Column) -> DataFrame:
    """Column _index: positions from 0 in the given order, counted per range of the data and offset by the ranges before."""
    ranged = written_table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # One row per range, at most as many as shuffle partitions.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(starts, "_range").withColumn("_index", F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """source, source_size and target from one row per source (source, source_size).

    The weights are dealt to the sources in code-point order, null last. A target above ``repeat`` times its source's
    size stops there and the excess is shared again by weight, until none is above. Comparisons are exact.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_index"), F.lit(len(weights))) + 1).cast("int"))
    table = written_table(global_index(sizes, F.col("source").asc_nulls_last()).withColumn("weight", weight).drop("_index"), "sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, over, stopped = int(total), None, -1
    while True:
        above = F.lit(False) if over is None else over
        free = F.sum(F.when(~above, F.col("weight")))
        taken = F.sum(F.when(above, F.col("source_size"))).cast("decimal(38,0)")
        count, weight_left, size = table.agg(F.count_if(above), free, taken).first()
        if count == stopped:
            break
        stopped, share, left = count, int(total) - repeat * int(size or 0), int(weight_left or 1)
        over = exact(F.col("weight")) * F.lit(share).cast("decimal(20,0)") > exact(F.col("source_size")) * F.lit(repeat * left).cast("decimal(18,0)")
    shared = (F.col("weight") * F.lit(share).cast("long")).cast("double") / F.lit(float(left))
    return table.select("source", "source_size", F.when(over, (F.col("source_size") * repeat).cast("double")).otherwise(shared).alias("target"))


def coin(doc_id: Column, digest: Column, seed: str = SEED) -> Column:
    """A whole number from 0 to 2**32 - 1 by document; ``digest`` stands in for a null id."""
    known = F.coalesce(doc_id.cast("string"), digest, F.lit(""))
    return _hash32(F.concat(F.lit(f"{seed}:"), known))


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def stratum(size: Column) -> Column:
    """Sizes that agree in their number of bits and in the next two bits."""
    bits = F.length(F.bin(size))
    top = F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0)))
    return F.when(size > 0, bits * 8 + top).otherwise(0).cast("int")


def coin_limits(sized: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """_source, _stratum, source_size, target, whole (copies of every document) and last (the largest coin that gets one more).

    ``sized`` has source, size, stratum and coin per document. One row per source and stratum, a few hundred per source at most.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    strata = sized.groupBy("source", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    strata = same_keys(strata, targets, ["source"]).withColumns({"whole": F.floor(rate), "fraction": rate - F.floor(rate), "mean": F.col("words") / F.col("n")})
    draw = _hash32(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")), F.lit(":"), F.col("stratum").cast("string"))) / F.lit(4294967296.0)
    strata = strata.withColumn("point", F.when(F.col("mean") * 100 <= F.col("target"), draw).otherwise(F.lit(0.5)))

    def step(state: Column, x: Column) -> Column:
        due = state["due"] + x["fraction"] * x["words"]
        number = F.when(x["words"] > 0, F.least(x["n"], F.greatest(F.lit(0).cast("long"), F.floor(due / x["mean"] + x["point"])))).otherwise(F.lit(0).cast("long"))
        taken = F.struct(x["stratum"].alias("stratum"), x["n"].alias("n"), number.alias("number"))
        return F.struct((due - number * x["mean"]).alias("due"), F.concat(state["out"], F.array(taken)).alias("out"))

    # From the stratum of the largest documents down; the array has one entry per stratum of a source.
    entry = F.struct((-F.col("stratum")).alias("order"), "stratum", "n", "words", "mean", "fraction", "point")
    start = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<struct<stratum:int,n:bigint,number:bigint>>").alias("out"))
    folded = strata.groupBy("source", "source_size", "target", "whole").agg(F.array_sort(F.collect_list(entry)).alias("strata"))
    plan = folded.select("source", "source_size", "target", "whole", F.explode(F.aggregate("strata", start, step)["out"]).alias("x")).select("source", "source_size", "target", "whole", "x.*")
    plan = written_table(plan, "strata")
    # The coin of the last document that a stratum takes, read off the positions of the coins.
    some = same_keys(sized.select("source", "stratum", "coin"), plan.where("number > 0 AND number < n").select("source", "stratum"), ["source", "stratum"])
    placed = same_keys(value_positions(some, ["source", "stratum"], "coin"), plan.select("source", "stratum", "number"), ["source", "stratum"])
    last = placed.where("before < number AND before + ties >= number").select("source", "stratum", F.col("coin").alias("last"))
    limits = same_keys(plan, last, ["source", "stratum"], "left")
    limit = F.when(F.col("number") == 0, F.lit(-1)).when(F.col("number") == F.col("n"), F.lit(1 << 32)).otherwise(F.col("last"))
    return written_table(limits.select(F.col("source").alias("_source"), F.col("stratum").alias("_stratum"), "source_size", "target", "whole", limit.cast("long").alias("last")), "limits")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                        coin(F.col(doc_id), F.when(F.col(doc_id).isNull(), F.md5(text)), seed).alias("coin"))
    return written_table(known.withColumn("stratum", stratum(F.col("size"))), "sizes")


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken (words that the mix takes)."""
    sized = _sized(docs, doc_id, text, source, seed)
    targets = written_table(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    # The limits are joined by the optimizer's choice: broadcast where the written table is small, else a shuffle with skew splitting.
    limits = coin_limits(sized, targets, seed)
    joined = sized.join(limits, F.col("source").eqNullSafe(F.col("_source")) & (F.col("stratum") == F.col("_stratum")))
    number = (F.col("whole") + F.when(F.col("coin") <= F.col("last"), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", number).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The documents of the mix with their own columns, each row repeated as often as it is taken."""
    sized = _sized(docs, doc_id, text, source, seed)
    targets = written_table(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    limits = coin_limits(sized, targets, seed).select("_source", "_stratum", F.col("whole").alias("_whole"), F.col("last").alias("_last"))
    marked = docs.withColumn("_size", word_count(docs[text])).withColumn("_coin", coin(docs[doc_id], F.when(docs[doc_id].isNull(), F.md5(docs[text])), seed))
    joined = marked.join(limits, marked[source].eqNullSafe(limits._source) & (stratum(F.col("_size")) == limits._stratum))
    number = F.col("_whole") + F.when(F.col("_coin") <= F.col("_last"), 1).otherwise(0)
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), number.cast("int")))).select(*docs.columns)


def mix_sql() -> str:
    """The same rows as mix_plan over table documents."""
    hashed = lambda x: f"CAST('0x' || substr(md5('{SEED}:' || {x}), 1, 8) AS BIGINT)"
    return f"""
        WITH RECURSIVE sized AS MATERIALIZED (
            SELECT *, CASE WHEN size > 0 THEN length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) ELSE 0 END AS stratum
            FROM (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                         {hashed("coalesce(CAST(doc_id AS VARCHAR), md5(text), '')")} AS coin FROM documents)),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source),
        weighted AS (SELECT source, source_size, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
        ordered AS (SELECT *, row_number() OVER o AS k,
                           CAST(sum(source_size) OVER () AS HUGEINT) - 3 * CAST(coalesce(sum(source_size) OVER p, 0) AS HUGEINT) AS share,
                           CAST(sum(weight) OVER () AS HUGEINT) - CAST(coalesce(sum(weight) OVER p, 0) AS HUGEINT) AS left_weight
                    FROM weighted
                    WINDOW o AS (ORDER BY source_size * (10 // weight), source NULLS LAST),
                           p AS (ORDER BY source_size * (10 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT share, left_weight, k FROM ordered WHERE 3 * source_size * left_weight >= weight * share ORDER BY k LIMIT 1),
        targets AS (SELECT o.source, o.source_size,
                           CASE WHEN o.k < l.k THEN CAST(3 * o.source_size AS DOUBLE)
                                ELSE CAST(o.weight * l.share AS DOUBLE) / CAST(l.left_weight AS DOUBLE) END AS target
                    FROM ordered o CROSS JOIN level l),
        rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate FROM targets),
        strata AS MATERIALIZED (
            SELECT s.source, s.stratum, count(*) AS n, CAST(sum(s.size) AS BIGINT) AS words, CAST(sum(s.size) AS DOUBLE) / count(*) AS mean,
                   r.rate - floor(r.rate) AS fraction, row_number() OVER (PARTITION BY s.source ORDER BY s.stratum DESC) AS i,
                   CASE WHEN (CAST(sum(s.size) AS DOUBLE) / count(*)) * 100 <= r.target
                        THEN {hashed("coalesce(s.source, '') || ':' || CAST(s.stratum AS VARCHAR)")} / 4294967296e0 ELSE 0.5e0 END AS point
            FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source GROUP BY s.source, s.stratum, r.rate, r.target),
        fold AS (
            SELECT source, CAST(0 AS BIGINT) AS i, CAST(0 AS INT) AS stratum, 0e0 AS due, CAST(0 AS BIGINT) AS number FROM targets
            UNION ALL
            SELECT source, i, stratum, due - number * mean, number
            FROM (SELECT *, CASE WHEN words > 0 THEN least(n, greatest(0, CAST(floor(due / mean + point) AS BIGINT))) ELSE 0 END AS number
                  FROM (SELECT t.source, t.i, CAST(t.stratum AS INT) AS stratum, f.due + t.fraction * t.words AS due, t.n, t.words, t.mean, t.point
                        FROM fold f JOIN strata t ON f.source IS NOT DISTINCT FROM t.source AND t.i = f.i + 1))),
        placed AS (SELECT *, rank() OVER (PARTITION BY source, stratum ORDER BY coin) AS place FROM sized)
        SELECT p.doc_id, p.source, p.size, r.source_size, r.target,
               CAST(floor(r.rate) AS BIGINT) + CASE WHEN p.place <= f.number THEN 1 ELSE 0 END AS copies,
               p.size * (CAST(floor(r.rate) AS BIGINT) + CASE WHEN p.place <= f.number THEN 1 ELSE 0 END) AS taken
        FROM placed p JOIN rated r ON p.source IS NOT DISTINCT FROM r.source
        JOIN fold f ON p.source IS NOT DISTINCT FROM f.source AND p.stratum = f.stratum AND f.i > 0"""

"""Reporting lines: depth, chains, reachability, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.numeric import round_half_up
from rosterlens.operators.reshape import union_all
from rosterlens.session import cut_lineage

ARROW = " → "
HEAVY = 50_000  # rows that point to one node


def ancestor_paths(df: DataFrame, node: str, parent: str, label: str, max_depth: int | None = None) -> DataFrame:
    """Root-to-node id and label paths for every node that reaches a root (within max_depth steps, if given).

    A root has no parent or is its own parent. Each round doubles the distance covered by
    the pointer of an unfinished node, so a tree of depth d needs about log2(d) joins. Only
    unfinished nodes are joined again; nodes on or below a cycle and below an orphan have no root
    and are left out. Each round checkpoints only the nodes it moved.
    """
    parent_id = F.when(F.col(parent) == F.col(node), F.lit(None)).otherwise(F.col(parent))
    start = df.select(
        F.col(node).alias("id"), parent_id.alias("up"),
        F.array(F.col(node)).alias("ids"), F.array(F.col(label)).alias("labels"),
    )
    latest = cut_lineage(start)
    done, open_nodes = [latest.where(F.col("up").isNull())], latest.where(F.col("up").isNotNull())
    rounds = 0
    while (max_depth is None or 2**rounds <= max_depth) and not open_nodes.isEmpty():
        rounds += 1
        above = union_all([*done, open_nodes]).select(
            F.col("id").alias("up"), F.col("up").alias("__up"), F.col("ids").alias("__ids"), F.col("labels").alias("__labels")
        )
        moved = _join_above(open_nodes, above).select(
            "id", F.col("__up").alias("up"),
            F.concat("__ids", "ids").alias("ids"), F.concat("__labels", "labels").alias("labels"),
        )
        # A path that meets a node twice runs into a cycle: its node has no root.
        latest = cut_lineage(moved.where(F.size(F.array_distinct("ids")) == F.size("ids")))
        done.append(latest.where(F.col("up").isNull()))
        open_nodes = latest.where(F.col("up").isNotNull())
    reached = union_all(done)
    return (reached if max_depth is None else reached.where(F.size("ids") <= max_depth + 1)).select("id", "ids", "labels")


def _join_above(open_nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Open nodes with the one row of `above` that they point to.

    Doubled pointers meet in the few nodes near the top. Nodes that more than HEAVY rows point to are at most one in HEAVY rows; they
    are broadcast, so that the rows below them stay where they are instead of meeting in one task.
    """
    heavy = cut_lineage(open_nodes.groupBy("up").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select("up"))
    if heavy.isEmpty():
        return open_nodes.join(above, "up")
    tops = F.broadcast(above.join(F.broadcast(heavy), "up"))
    light = open_nodes.join(F.broadcast(heavy), "up", "left_anti").join(above, "up")
    return light.unionByName(open_nodes.join(tops, "up"))


def org_hierarchy(df: DataFrame, node: str = "employee_id", parent: str = "manager_id", label: str = "employee_name",
                  max_depth: int = 10) -> DataFrame:
    """Depth and reporting chain 'A → B → C' of every reachable employee."""
    paths = ancestor_paths(df, node, parent, label, max_depth)
    return paths.select(
        F.col("id").alias(node),
        (F.size("ids") - 1).cast("bigint").alias("org_depth"),
        F.array_join("labels", ARROW).alias("reporting_chain"),
    )


def org_reachability(df: DataFrame, node: str = "employee_id", parent: str = "manager_id", max_depth: int = 15) -> DataFrame:
    """One row: deepest level, nodes reached, nodes unreached (cycles, orphans)."""
    paths = ancestor_paths(df, node, parent, node, max_depth)
    total = df.select(F.count(F.lit(1))).scalar()
    return paths.agg(
        F.max(F.size("ids") - 1).cast("bigint").alias("max_org_depth"), F.count(F.lit(1)).alias("employees_reached")
    ).withColumn("employees_unreached", total - F.col("employees_reached"))


def ancestor_closure(df: DataFrame, node: str = "employee_id", parent: str = "manager_id", max_depth: int | None = None) -> DataFrame:
    """One row per node and ancestor with their distance (1 = direct manager)."""
    paths = ancestor_paths(df, node, parent, node, max_depth)
    above = F.slice(F.reverse("ids"), F.lit(2), F.size("ids"))
    steps = paths.select(F.col("id").alias(node), F.posexplode(above).alias("distance", "ancestor"))
    return steps.select(node, "ancestor", (F.col("distance") + 1).cast("bigint").alias("distance"))


def _pointers(df: DataFrame, node: str, parent: str) -> DataFrame:
    """id and up; up is null at the top (no parent, or its own)."""
    up = F.when(F.col(parent) == F.col(node), F.lit(None)).otherwise(F.col(parent))
    return df.select(F.col(node).alias("id"), up.alias("up"))


def _with_ends(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """kind and top of the nodes whose line ends with themselves: at a root, or at a parent that does not exist."""
    known = ids.select(F.col("id").alias("up"), F.lit(True).alias("__known"))
    orphan = F.col("up").isNotNull() & F.col("__known").isNull()
    marked = nodes.join(known, "up", "left").withColumns({
        "kind": F.when(F.col("up").isNull(), ROOT).when(orphan, ORPHAN), "top": F.when(F.col("up").isNull(), F.col("id")).when(orphan, F.col("up")),
    })
    return marked.withColumn("up", F.when(orphan, F.lit(None)).otherwise(F.col("up"))).drop("__known")


def _below(kind) -> Column:
    """Kind of a node whose pointer has arrived at a node of the given kind."""
    return F.when(kind.isin(ROOT, REACHED), REACHED).when(kind.isin(ORPHAN, BELOW_ORPHAN), BELOW_ORPHAN)


# How a node's line of managers ends.
ROOT, REACHED, ORPHAN, BELOW_ORPHAN, ON_CYCLE, BELOW_CYCLE = "root", "reached", "orphan", "below an orphan", "on a cycle", "below a cycle"


def line_ends(df: DataFrame, node: str = "employee_id", parent: str = "manager_id") -> DataFrame:
    """How the line of managers of every node ends: node, kind and top.

    kind is root, reached (below a root), orphan (its manager does not exist), below an orphan, on a cycle or below a cycle;
    top is the root, the missing manager or the smallest id of the cycle. No depth limit.

    Each round doubles the distance of the pointers of the open nodes. The nodes that are pointed to become fewer until only
    cycles are left: when a round keeps their number, doubled steps permute them, so each is on a cycle and every open
    node leads to one. On the cycles, minima over doubled stretches give the smallest id.
    """
    ids = _pointers(df, node, parent)
    state = cut_lineage(_with_ends(ids, ids))
    done, open_nodes, pointed = [state.where("kind IS NOT NULL")], state.where("kind IS NULL"), -1
    while (now := open_nodes.agg(F.count_distinct("up")).first()[0]) not in (0, pointed):
        pointed = now
        ahead = union_all([*done, open_nodes]).select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("kind").alias("__kind"), F.col("top").alias("__top"))
        moved = open_nodes.select("id", "up").join(ahead, "up").select("id", F.col("__up").alias("up"), _below(F.col("__kind")).alias("kind"), F.col("__top").alias("top"))
        moved = cut_lineage(moved)
        done.append(moved.where("kind IS NOT NULL"))
        open_nodes = moved.where("kind IS NULL")
    out = union_all(done).select(F.col("id").alias(node), "kind", "top")
    if not now:
        return out
    on = open_nodes.select("up").distinct().withColumnRenamed("up", "id")
    cycles = cut_lineage(ids.join(on, "id").select("id", F.col("up").alias("next"), F.col("id").alias("low")))
    while True:
        ahead = cycles.select(F.col("id").alias("next"), F.col("next").alias("__next"), F.col("low").alias("__low"))
        cycles = cut_lineage(cycles.join(ahead, "next").select("id", F.col("__next").alias("next"), F.least("low", "__low").alias("low"), (F.col("low") != F.col("__low")).alias("open")))
        if cycles.where("open").isEmpty():  # the stretches go once around
            break
    named = open_nodes.join(cycles.select(F.col("id").alias("up"), F.col("low").alias("__low")), "up").join(on.withColumn("__on", F.lit(True)), "id", "left")
    kind = F.when(F.col("__on"), ON_CYCLE).otherwise(BELOW_CYCLE)
    return out.unionByName(named.select(F.col("id").alias(node), kind.alias("kind"), F.col("__low").alias("top")))


def rollup_counts(df: DataFrame, node: str = "employee_id", parent: str = "manager_id") -> DataFrame:
    """Direct reports, total organisation size and their ratio per manager whose line reaches a root; no depth limit.

    The tree is contracted, never multiplied out: nodes without reports fold into their managers as a count, and the lines of
    managers are halved by pointers of doubled distance that carry sums. After k rounds a manager's total covers the managers
    less than 2 ** k levels below; the next adds the totals of those whose pointer has come to it. So the cost is the nodes once
    and the managers log2(depth) times. Nodes on or below a cycle or a missing manager are left out.
    """
    ids = _pointers(df, node, parent)
    direct = ids.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("direct"))
    managers = ids.join(direct, "id").withColumn("total", F.col("direct").cast("decimal(38,0)"))
    managers = cut_lineage(managers)
    state, pointed = cut_lineage(_with_ends(managers, managers).drop("top")), -1
    while (now := state.agg(F.count_distinct("up")).first()[0]) not in (0, pointed):
        pointed = now
        gain = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("total").cast("decimal(38,0)").alias("__gain"))
        ahead = state.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("kind").alias("__kind"))
        moved = state.join(gain, "id", "left").join(ahead, "up", "left")
        state = cut_lineage(moved.select(
            "id", F.col("__up").alias("up"), "direct", (F.col("total") + F.coalesce("__gain", F.lit(0))).cast("decimal(38,0)").alias("total"),
            F.coalesce("kind", _below(F.col("__kind"))).alias("kind"),
        ))
    total = F.col("total").cast("bigint")
    return state.where(F.col("kind").isin(ROOT, REACHED)).select(
        F.col("id").alias(node), F.col("direct").alias("direct_report_count"), total.alias("total_org_size"),
        round_half_up(F.col("direct") / total, 4).alias("span_of_control_ratio"),
    )


def department_path(df: DataFrame, node: str, parent: str, label: str, separator: str = "/") -> DataFrame:
    """Materialised path of each unit and its level (1 = top)."""
    paths = ancestor_paths(df, node, parent, label)
    return paths.select(
        F.col("id").alias(node),
        F.size("ids").cast("bigint").alias("hierarchy_level"),
        F.array_join("labels", separator).alias("hierarchy_path"),
    )

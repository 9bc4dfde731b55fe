"""Reporting-line queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import emp, with_
from rosterlens.operators import hierarchy

CHAIN = """chain AS (
SELECT employee_id, manager_id, CAST(0 AS BIGINT) AS org_depth, employee_name AS reporting_chain FROM employee WHERE manager_id IS NULL OR manager_id = employee_id
UNION ALL
SELECT e.employee_id, e.manager_id, c.org_depth + 1, c.reporting_chain || ' → ' || e.employee_name
FROM employee e JOIN chain c ON e.manager_id = c.employee_id WHERE e.manager_id <> e.employee_id AND c.org_depth < 15)"""


@query("h01_org_hierarchy", emp("SELECT employee_id, org_depth, reporting_chain FROM chain", CHAIN))
def org_hierarchy(t):
    return hierarchy.org_hierarchy(t.employee.select("employee_id", "manager_id", "employee_name"))


@query("h02_org_reachability", emp("""
SELECT max(org_depth) AS max_org_depth, count(*) AS employees_reached, (SELECT count(*) FROM employee) - count(*) AS employees_unreached FROM chain""", CHAIN))
def org_reachability(t):
    return hierarchy.org_reachability(t.employee.select("employee_id", "manager_id"))


CLOSURE = """closure AS (
SELECT employee_id, manager_id AS ancestor, 0 AS distance FROM employee WHERE manager_id IS NOT NULL
UNION ALL
SELECT c.employee_id, e.manager_id, c.distance + 1 FROM closure c JOIN employee e ON c.ancestor = e.employee_id WHERE e.manager_id IS NOT NULL)"""


@query("j09_recursive_join", emp("SELECT employee_id, ancestor, CAST(distance + 1 AS BIGINT) AS distance FROM closure", CLOSURE))
def recursive_join(t):
    return hierarchy.ancestor_closure(t.employee.select("employee_id", "manager_id"))


@query("h03_rollup_counts", emp("""
SELECT ancestor AS employee_id, count(*) FILTER (WHERE distance = 0) AS direct_report_count, count(*) AS total_org_size,
 round(CAST(count(*) FILTER (WHERE distance = 0) AS DOUBLE) / count(*), 4) AS span_of_control_ratio FROM closure GROUP BY 1""", CLOSURE))
def rollup_counts(t):
    return hierarchy.rollup_counts(t.employee.select("employee_id", "manager_id"))


@query("h04_department_path", """
SELECT 'R' || r_regionkey AS unit_id, CAST(1 AS BIGINT) AS hierarchy_level, r_name AS hierarchy_path FROM region
UNION ALL SELECT 'N' || n_nationkey, 2, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'C' || c_custkey, 3, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def department_path(t):
    def unit(df, prefix, key, parent_prefix, parent, name):
        up = F.lit(None).cast("string") if parent is None else F.concat(F.lit(parent_prefix), F.col(parent).cast("string"))
        return df.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("unit_id"), up.alias("parent_id"), F.col(name).alias("unit_name")
        )

    units = (
        unit(t.region, "R", "r_regionkey", None, None, "r_name")
        .unionByName(unit(t.nation, "N", "n_nationkey", "R", "n_regionkey", "n_name"))
        .unionByName(unit(t.customer, "C", "c_custkey", "N", "c_nationkey", "c_name"))
    )
    return hierarchy.department_path(units, "unit_id", "parent_id", "unit_name")


# Customers refer to each other in cycles and to a missing parent; only the chains that reach a root come out.
BROKEN = """nodes AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 50 = 7 THEN c_custkey + 1
 WHEN c_custkey % 50 = 8 THEN c_custkey - 1 WHEN c_custkey % 50 = 9 THEN -1 ELSE CAST(floor(c_custkey / 3.0) AS BIGINT) END AS parent FROM customer),
walk AS (SELECT id, CAST(0 AS BIGINT) AS depth FROM nodes WHERE parent IS NULL OR parent = id
 UNION ALL SELECT n.id, w.depth + 1 FROM nodes n JOIN walk w ON n.parent = w.id WHERE n.parent <> n.id AND w.depth < 15)"""


def broken_nodes(t):
    key = F.col("c_custkey")
    parent = (
        F.when(key == 0, F.lit(None)).when(key % 50 == 7, key + 1).when(key % 50 == 8, key - 1).when(key % 50 == 9, F.lit(-1))
        .otherwise(F.floor(key / F.lit(3.0)))
    )
    return t.customer.select(key.alias("id"), parent.cast("bigint").alias("parent"))


@query("h02_reachability_with_cycles", with_(BROKEN, then="""
SELECT max(depth) AS max_org_depth, count(*) AS employees_reached, (SELECT count(*) FROM nodes) - count(*) AS employees_unreached FROM walk"""))
def reachability_with_cycles(t):
    return hierarchy.org_reachability(broken_nodes(t), "id", "parent")


# All (node, ancestor) pairs; UNION ends the walk on cycles.
ABOVE = """above AS (SELECT id, parent AS anc FROM nodes WHERE parent IS NOT NULL AND parent <> id
 UNION SELECT a.id, n.parent FROM above a JOIN nodes n ON a.anc = n.id WHERE n.parent IS NOT NULL AND n.parent <> n.id),
cycle_of AS (SELECT a.id, min(b.anc) AS low FROM above a JOIN above b ON a.id = b.id AND a.anc = a.id GROUP BY 1),
missing AS (SELECT a.id, a.anc FROM above a LEFT JOIN nodes n ON a.anc = n.id WHERE n.id IS NULL),
tops AS (SELECT a.id, min(n.id) AS root FROM above a JOIN nodes n ON a.anc = n.id WHERE n.parent IS NULL OR n.parent = n.id GROUP BY 1)"""


@query("h02_line_ends", with_(BROKEN, ABOVE, then="""
SELECT n.id, CASE WHEN n.parent IS NULL OR n.parent = n.id THEN 'root' WHEN c.id IS NOT NULL THEN 'on a cycle' WHEN m.anc = n.parent THEN 'orphan'
 WHEN m.id IS NOT NULL THEN 'below an orphan' WHEN r.id IS NOT NULL THEN 'reached' ELSE 'below a cycle' END AS kind,
 CASE WHEN n.parent IS NULL OR n.parent = n.id THEN n.id ELSE coalesce(c.low, m.anc, r.root,
  (SELECT min(o.low) FROM above a JOIN cycle_of o ON a.anc = o.id WHERE a.id = n.id)) END AS top
FROM nodes n LEFT JOIN cycle_of c USING (id) LEFT JOIN missing m USING (id) LEFT JOIN tops r USING (id)"""))
def line_ends(t):
    """Every node with the kind of its line's end; the cycle's smallest id names the cycle."""
    return hierarchy.line_ends(broken_nodes(t), "id", "parent")


@query("h03_rollup_of_broken_lines", with_(BROKEN, """closure AS (SELECT n.id, n.parent AS anc, 0 AS distance FROM nodes n JOIN walk USING (id) WHERE n.parent IS NOT NULL AND n.parent <> n.id
 UNION ALL SELECT c.id, n.parent, c.distance + 1 FROM closure c JOIN nodes n ON c.anc = n.id WHERE n.parent IS NOT NULL AND n.parent <> n.id)""", then="""
SELECT anc AS id, count(*) FILTER (WHERE distance = 0) AS direct_report_count, count(*) AS total_org_size,
 round(CAST(count(*) FILTER (WHERE distance = 0) AS DOUBLE) / count(*), 4) AS span_of_control_ratio FROM closure GROUP BY 1"""))
def rollup_of_broken_lines(t):
    return hierarchy.rollup_counts(broken_nodes(t), "id", "parent")

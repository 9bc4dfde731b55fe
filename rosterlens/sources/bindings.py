"""The workforce model bound to the star-schema parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlens.sources import seeds

AS_OF = "2001-12-31"

# How each employee attribute is derived from an order and its customer.
EMPLOYEE_COLUMNS = {
    "employee_id": "CAST(o_orderkey AS BIGINT)",
    "employee_name": "concat('Emp ', CAST(o_orderkey AS STRING))",
    "age": "CAST(18 + (o_orderkey * 7) % 50 AS INT)",
    "gender": "CASE WHEN o_orderkey % 20 < 10 THEN 'Male' WHEN o_orderkey % 20 < 19 THEN 'Female' ELSE 'Non-binary' END",
    "department": "c_mktsegment",
    "job_level": "concat('L', CAST(7 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS STRING))",
    "manager_id": "CASE WHEN o_orderkey <> 0 THEN CAST(floor(o_orderkey / 8.0D) AS BIGINT) END",
    "location": "n_name",
    "region": "r_name",
    "work_mode": "CASE o_orderkey % 3 WHEN 0 THEN 'On-site' WHEN 1 THEN 'Hybrid' ELSE 'Remote' END",
    "hire_date": "CAST(o_orderdate AS DATE)",
    "years_at_company": f"CAST(datediff(DATE'{AS_OF}', CAST(o_orderdate AS DATE)) / 365.25D AS DECIMAL(5,2))",
    "salary": "CAST(30000 + floor(o_totalprice) AS INT)",
    "bonus": "CAST(floor(o_totalprice * ((o_orderkey % 4) / 20.0D)) AS INT)",
    "recruitment_source_id": "CAST(o_custkey % 8 AS INT)",
    "performance_rating": "CASE WHEN (o_orderkey * 37) % 100 < 3 THEN 1 WHEN (o_orderkey * 37) % 100 < 15 THEN 2 "
    "WHEN (o_orderkey * 37) % 100 < 68 THEN 3 WHEN (o_orderkey * 37) % 100 < 94 THEN 4 ELSE 5 END",
    "attendance_pct": "CAST((7000 + (o_orderkey * 13) % 3001) / 100.0D AS DECIMAL(5,2))",
    "training_hours": "CAST((o_orderkey * 17) % 1201 / 10.0D AS DECIMAL(6,2))",
    "engagement_score": "CAST((2000 + (o_orderkey * 101) % 8001) / 100.0D AS DECIMAL(6,2))",
    "satisfaction_score": "CAST((1000 + (o_orderkey * 211) % 9001) / 100.0D AS DECIMAL(6,2))",
    "promotions": "CAST((o_orderkey * 3) % 5 AS INT)",
    "leave_count": "CAST((o_orderkey * 5) % 31 AS INT)",
    "attrition": "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END",
    "exit_reason": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 "
    "THEN concat('Reason ', CAST(o_orderkey % 6 AS STRING)) END",
}


def employee_from_orders(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """One employee per order.

    nation and region are fixed lists (25 and 5 rows) and are broadcast; customer grows
    with the data, so its join is left to the optimizer.
    """
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.selectExpr(*[f"{expression} AS {name}" for name, expression in EMPLOYEE_COLUMNS.items()])


_SCHEMAS: dict[tuple, StructType] = {}


class Tables:
    """Lazily opened tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """Open a table; its footer schema is looked up once per state of the files, not once per query."""
        path = f"{self.folder}/{name}.parquet"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        status = files.getFileStatus(place)
        key = (self.spark.sparkContext.applicationId, path, status.getModificationTime(), status.getLen())
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    @cached_property
    def region(self) -> DataFrame:
        return self.read("region")

    @cached_property
    def nation(self) -> DataFrame:
        return self.read("nation")

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def employee(self) -> DataFrame:
        return employee_from_orders(self.orders, self.customer, self.nation, self.region)

    # Fixed lists of 5 to 8 rows. Shuffled by their keys, the employees would meet in as many tasks.
    @cached_property
    def job_levels(self) -> DataFrame:
        return F.broadcast(seeds.job_levels(self.spark))

    @cached_property
    def recruitment_sources(self) -> DataFrame:
        return F.broadcast(seeds.recruitment_sources(self.spark))

    @cached_property
    def ratings(self) -> DataFrame:
        return F.broadcast(seeds.ratings(self.spark))

    @cached_property
    def employee_with_source(self) -> DataFrame:
        """Employees with the recruitment source name (8 fixed rows, broadcast)."""
        return self.employee.join(F.broadcast(self.recruitment_sources), "recruitment_source_id")

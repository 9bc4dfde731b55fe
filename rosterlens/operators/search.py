"""Name search through a posting table of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.operators.filters import name_search
from rosterlens.plans.storing import write_clustered
from rosterlens.session import written_table

LENGTH = 3
ROWS_PER_FILE = 1_000_000  # what one task sorts
HITS_PER_TASK = 100_000


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none for shorter texts."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= LENGTH, F.sequence(F.lit(1), F.length(low) - (LENGTH - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(LENGTH))))


def build_name_index(df: DataFrame, key: str, name: str, path: str, files: int | None = None) -> None:
    """Write the index: postings (gram, key) ordered by gram, the number of names per gram, and the names ordered by key.

    The files are clustered, so a search reads only the row groups whose statistics admit its grams and keys. Null names are
    not indexed. Without a number of files there are as many as the rows need, so a task sorts as much on larger tables as on small ones.
    """
    spark = df.sparkSession
    # Written before they are sorted, since the number of files, their bounds and the postings are all read off them.
    names = written_table(df.where(F.col(name).isNotNull()).select(key, name), "names")
    postings = names.select(F.explode(trigrams(F.col(name))).alias("gram"), key)
    write_clustered(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("names")), f"{path}/grams", sort_by=["gram"], files=1)
    rows = spark.read.parquet(f"{path}/grams").agg(F.sum("names")).first()[0] or 0
    write_clustered(postings, f"{path}/postings", sort_by=["gram", key], files=files or 1 + rows // ROWS_PER_FILE)
    write_clustered(names, f"{path}/names", sort_by=[key], files=files or 1 + names.count() // ROWS_PER_FILE)


def indexed_name_search(spark: SparkSession, path: str, key: str, name: str, text: str, grams: int = 3) -> DataFrame:
    """key and name of all names that contain `text` (any case), as filters.name_search gives them.

    The rarest `grams` trigrams of the text bring the candidates, which are then tested exactly. A text of less than three characters has none;
    then all names are tested.
    """
    names = spark.read.parquet(f"{path}/names")
    low = text.lower()
    wanted = sorted({low[i : i + LENGTH] for i in range(len(low) - LENGTH + 1)})
    if not wanted:
        return name_search(names, name, text)
    known = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted)).collect()  # one row per trigram of the text
    if len(known) < len(wanted):  # some trigram stands in no name
        return names.where("false")
    chosen = sorted(known, key=lambda r: (r["names"], r["gram"]))[:grams]
    rare = [r["gram"] for r in chosen]
    hits = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(rare))
    # Keys in order pack so well that tasks dealt by bytes would get more of them on larger tables.
    hits = hits.repartition(1 + sum(r["names"] for r in chosen) // HITS_PER_TASK, key)
    candidates = hits.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(rare)).select(key)
    return name_search(names.join(candidates, key, "left_semi"), name, text)

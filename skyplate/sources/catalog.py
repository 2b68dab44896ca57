"""The chart catalog: XML records, the JSON edition feed, relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "chartseq string, chart_code string, chart_name string, useraction string, pdf_name string, faanfd18 string, copter string"
AIRPORT = f"_ID string, _apt_ident string, _military string, record array<struct<{RECORD}>>"
CITY = f"_ID string, _volume string, airport_name array<struct<{AIRPORT}>>"
STATE = f"_ID string, city_name array<struct<{CITY}>>"
CATALOG = f"_cycle string, _from_edate string, _to_edate string, state_code array<struct<{STATE}>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the catalog's records. One state element is one row of the scan, so that states are read in parallel."""
    return flatten_states(spark.read.format("xml").option("rowTag", "state_code").schema(STATE).load(path))


def parse_catalog(df: DataFrame, xml: str, *keep: str) -> DataFrame:
    """The same of whole catalog documents in a column, with the catalog's cycle and dates."""
    doc = df.select(*keep, F.from_xml(F.col(xml), F.lit(CATALOG)).alias("_c"))
    states = doc.select(*keep, F.col("_c._cycle").alias("tpp_cycle"), F.col("_c._from_edate").alias("from_date"), F.col("_c._to_edate").alias("to_date"), F.explode("_c.state_code").alias("_s")).select("*", "_s.*").drop("_s")
    return flatten_states(states, *keep, "tpp_cycle", "from_date", "to_date")


def flatten_states(states: DataFrame, *keep: str) -> DataFrame:
    """state > city > airport > record, with the attributes of all ancestors on each record. A record without a name is kept with nulls."""
    c = states.select(*keep, F.col("_ID").alias("state_id"), F.explode("city_name").alias("c"))
    a = c.select(*keep, "state_id", F.col("c._volume").alias("tpp_volume"), F.explode("c.airport_name").alias("a"))
    r = a.select(*keep, "state_id", "tpp_volume", F.col("a._apt_ident").alias("faa_code"), F.col("a._military").alias("military_use"), F.explode("a.record").alias("r"))
    names = {"chartseq": "chart_seq", "chart_code": "chart_code", "chart_name": "chart_name", "useraction": "user_action", "pdf_name": "pdf_name", "faanfd18": "faanfd18_code", "copter": "copter_use"}
    out = r.select(*keep, "tpp_volume", "faa_code", *(F.col(f"r.{x}").alias(n) for x, n in names.items()), "military_use", "state_id")
    return out.withColumn("faanfd18_code", F.regexp_replace("faanfd18_code", r"\s+", ""))


def download_list(catalog: DataFrame) -> DataFrame:
    """Path airport/pdf of each chart that is not deleted."""
    return catalog.where(~F.col("pdf_name").ilike("%DELETED%")).select("faa_code", "pdf_name", F.concat_ws("/", "faa_code", "pdf_name").alias("path"))


def read_feed(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """Archive addresses of an edition feed."""
    schema = "edition array<struct<product: struct<url: string>>>"
    return df.select(*keep, F.posexplode(F.from_json(F.col(json), schema)["edition"]).alias("position", "_e")).select(*keep, "position", F.col("_e.product.url").alias("url"))


def read_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A relational table over JDBC; with partition (column, lower, upper, number) in parallel reads. Filters and columns are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.load()


def attach(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Names for frames of several databases, so that one SQL statement can join them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def append_rows(df: DataFrame, table: str) -> None:
    """Append by column name; a failed job leaves the table as it was."""
    df.write.mode("append").saveAsTable(table)


def replace_table(df: DataFrame, table: str) -> None:
    """Full refresh: the new rows take the table's place once they are all written."""
    df.write.mode("overwrite").saveAsTable(table)

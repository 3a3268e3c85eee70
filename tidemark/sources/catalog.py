"""External tables over the zones, derived from the contracts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.schemas import GOLD_CONTRACT, SILVER_CONTRACT

DATABASE = "medallion"

# Catalog type of each contract type.
CATALOG_TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "DOUBLE",
    "datetime": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def split_columns(contract: dict, aliases: dict[str, str] | None = None) -> tuple[list, list]:
    """Data columns and partition keys of a contract; keys are strings.

    ``aliases`` maps a partition key onto the contract field it renames.
    """
    aliases = aliases or {}
    hive = contract["hive"]
    hidden = set(hive) | set(aliases.values())
    data = [(f["name"], CATALOG_TYPES.get(f["type"], "STRING")) for f in contract["fields"] if f["name"] not in hidden]
    return data, [(name, "STRING") for name in hive]


def _qualified(spark: SparkSession, location: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(location)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return _qualified(spark, rows[0]["data_type"])


def create_table(
    spark: SparkSession, contract: dict, location: str, aliases: dict[str, str] | None = None, database: str = DATABASE
) -> str:
    """Create the external table, or point it at the location, and load the partitions found there."""
    data, parts = split_columns(contract, aliases)
    columns = ", ".join(f"`{n}` {t}" for n, t in data + parts)
    keys = ", ".join(f"`{n}`" for n, _ in parts)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    name = f"{database}.{contract['name']}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({keys}) "
        f"LOCATION '{location}'"
    )
    if _location(spark, name) != _qualified(spark, location):
        for row in spark.sql(f"SHOW PARTITIONS {name}").collect():  # names of a table's partitions
            spec = ", ".join("{}='{}'".format(*part.split("=", 1)) for part in row[0].split("/"))
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
    spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return name


def register(spark: SparkSession, silver_path: str, gold_path: str, database: str = DATABASE) -> list[str]:
    return [
        create_table(spark, SILVER_CONTRACT, silver_path, database=database),
        create_table(spark, GOLD_CONTRACT, gold_path, {"metric": "event_type"}, database=database),
    ]

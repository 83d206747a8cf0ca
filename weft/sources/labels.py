"""Keyed label stores: load, upsert, and save as a map and as a list.

A store is a :class:`KeyedTable` of one instance (a struct) a key. ``save`` writes what a
version holds in two forms that other tools read, as JSON lines so that files split and
grow with their tasks: ``data`` has one object ``{key: instance}`` a line, ``instances`` one
instance a line. ``load`` takes the instances of a saved map into the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.sources.versions import KeyedTable


class LabelStore:
    """Instances of the type ``instance`` (DDL of a struct's fields) by a string key, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, instance: str):
        self.spark = spark
        self.instance = T.StructType.fromDDL(instance)
        schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("instance", self.instance)])
        self.table = KeyedTable(spark, root, schema, ["key"])

    def rows(self, version: int | None = None) -> DataFrame:
        """(key, instance) of the latest version, or of the given one."""
        return self.table.load(version)

    def upsert(self, new: DataFrame, key: str) -> int:
        """Commit the rows of ``new`` (unique in ``key``); each replaces the instance of its key."""
        return self.table.upsert(new.select(F.col(key).cast("string").alias("key"), F.struct(*self.instance.names).alias("instance")))

    def save(self, folder: str, version: int | None = None) -> None:
        """Write one version as ``folder/data`` and ``folder/instances``. Null fields stay in both."""
        self.rows(version).select(F.to_json(F.create_map("key", "instance"), {"ignoreNullFields": "false"})).write.mode("overwrite").text(f"{folder}/data")
        self.rows(version).select(F.to_json("instance", {"ignoreNullFields": "false"})).write.mode("overwrite").text(f"{folder}/instances")

    def load(self, folder: str) -> int | None:
        """Take a saved map into the store; a folder that doesn't exist changes nothing."""
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
        if not data.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(data):
            return None
        lines = self.spark.read.text(f"{folder}/data")
        parsed = F.from_json("value", T.MapType(T.StringType(), self.instance))
        return self.table.upsert(lines.select(F.explode(parsed).alias("key", "instance")))

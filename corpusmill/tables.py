"""The tables of a data folder, read lazily: `Tables(spark, folder).documents`.

A session that sets spark.corpusmill.deal, as the local one of `session` does, has tables in fewer files
than it has cores dealt over them; otherwise tables are read in the pieces they have, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._deal = spark.conf.get("spark.corpusmill.deal", "false") == "true"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        cores = self._spark.sparkContext.defaultParallelism
        return table.repartition(cores) if self._deal and len(table.inputFiles()) < cores else table

"""The corpus as DataFrames: the driver's tables under their names, and the views operators work on."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweh.functions import paths
from fernweh.runtime import read

NOW = 1_706_745_600_000  # 2024-02-01T00:00:00Z in ms, the fixed present of queries
HOME = "/home/u"


@dataclass(frozen=True)
class Corpus:
    """Tables of one folder, read lazily."""

    spark: SparkSession
    folder: str
    home: str = HOME
    now: int = NOW
    postings: str = ""  # a folder of stored postings; they are made anew where there is none

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    @cached_property
    def files(self) -> DataFrame:
        return self.table("files")

    @cached_property
    def catalog(self) -> DataFrame:
        """files with display, the path relative to home."""
        return self.files.withColumn("display", paths.display(F.col("path"), self.home))

    @cached_property
    def content(self) -> DataFrame:
        """(id, data): the text of each file; texts are stored once and shared."""
        return self.table("content_map").select("id", "text").join(self.table("texts").select(F.col("id").alias("text"), "data"), "text").select("id", "data")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

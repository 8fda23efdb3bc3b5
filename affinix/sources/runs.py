"""The folder of a run: manifest, results per query, aggregate, report, and the registry of all runs.

Everything is written through Spark, so a root may be any store.  Parts that exist are never written again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Run:
    """A run below root; begin() refuses one that is there."""

    spark: SparkSession
    root: str
    run_id: str

    @property
    def folder(self) -> str:
        return f"{self.root.rstrip('/')}/{self.run_id}"

    def _text(self, name: str, text: str, mode: str = "error") -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{self.folder}/{name}")

    def begin(self, manifest: dict) -> Run:
        """Writes the manifest (one JSON object): what the run read, and with which parameters."""
        self._text("manifest.json", json.dumps({"run_id": self.run_id} | manifest, ensure_ascii=False, sort_keys=True))
        return self

    def per_query(self, rows: DataFrame) -> None:
        """Results of each query, as CSV parts with a header."""
        rows.write.mode("error").option("header", True).option("encoding", "UTF-8").csv(f"{self.folder}/per_query.csv")

    def read_per_query(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("header", True).csv(f"{self.folder}/per_query.csv")

    def aggregate(self, rows: DataFrame) -> None:
        """Aggregated results, one JSON object a row."""
        rows.write.mode("error").json(f"{self.folder}/aggregate.json")

    def report(self, text: str, day: str, decision: str | None = None) -> None:
        """A Markdown report; below its first heading stand the run, the day and the decision, unless they do already."""
        head = [f"> **run**: `{self.run_id}` · **day**: {day}", *([f"> **decision**: {decision}"] if decision else [])]
        lines = text.split("\n")
        at = next((i for i, x in enumerate(lines) if x.startswith("# ")), None)
        if at is not None and not any(x.startswith("> **run**") for x in lines[at + 1 : at + 4]):
            lines[at + 1 : at + 1] = ["", *head]
        self._text("report.md", "\n".join(lines))

    def register(self, summary: dict) -> None:
        """Adds the run to the registry of the root, one JSON object a line."""
        row = self.spark.createDataFrame([(json.dumps({"run_id": self.run_id} | summary, ensure_ascii=False, sort_keys=True),)], "value string")
        row.coalesce(1).write.mode("append").text(f"{self.root.rstrip('/')}/registry.jsonl")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, manifest) of all runs below root, the manifest as JSON text."""
    return spark.read.option("pathGlobFilter", "part-*").text(f"{root.rstrip('/')}/*/manifest.json").select(F.get_json_object("value", "$.run_id").alias("run_id"), F.col("value").alias("manifest"))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The registered summaries of all runs, as JSON text."""
    return spark.read.text(f"{root.rstrip('/')}/registry.jsonl").select(F.get_json_object("value", "$.run_id").alias("run_id"), F.col("value").alias("summary"))


def means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, n, mean, low, high): of each metric column of per-query rows, over its non-null finite values."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*by, "x.*")
    kept = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return kept.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))

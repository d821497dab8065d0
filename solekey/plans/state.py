"""What a search knows after each level, kept in the shared folder so that a new driver can go on."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from solekey.session import delete, file_system, shared_dir


class SearchState:
    """Facts and frames of finished levels under a name.

    A level is there as soon as its facts are, which are written last; older levels are deleted
    then. `table` describes table and options: a state of another search is an error.
    """

    def __init__(self, spark: SparkSession, name: str, table: dict[str, Any]):
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not a name for a search: {name!r}")
        self.spark, self.table = spark, json.loads(json.dumps(table))
        self.folder = f"{shared_dir(spark).rstrip('/')}/solekey-search-{name}"

    def _levels(self) -> list[int]:
        fs, folder = file_system(self.spark, self.folder)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [n for n in names if n.startswith("level-") and fs.exists(file_system(self.spark, f"{self.folder}/{n}/facts/_SUCCESS")[1])]
        return sorted(int(n.removeprefix("level-")) for n in done)

    def read(self) -> tuple[dict[str, Any], dict[str, DataFrame]] | None:
        """Facts and frames of the last finished level."""
        levels = self._levels()
        if not levels:
            return None
        base = f"{self.folder}/level-{levels[-1]}"
        facts = json.loads("".join(r[0] for r in self.spark.read.text(f"{base}/facts", wholetext=True).collect()))
        if facts["table"] != self.table:
            raise ValueError(f"{self.folder} holds a search of another table or with other options")
        return facts, {name: self.spark.read.parquet(f"{base}/{name}") for name in facts["frames"]}

    def write(self, level: int, facts: dict[str, Any], frames: dict[str, DataFrame]) -> None:
        base = f"{self.folder}/level-{level}"
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{base}/{name}")
        text = json.dumps(facts | {"table": self.table, "frames": sorted(frames)})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/facts")
        for old in self._levels()[:-1]:
            delete(self.spark, f"{self.folder}/level-{old}")

    def clear(self) -> None:
        delete(self.spark, self.folder)

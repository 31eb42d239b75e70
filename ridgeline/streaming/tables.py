"""Tables in parts: a write replaces the parts it names and leaves the files of all others as they are.

A version is a manifest that names, for each part, the folder that holds it, and notes such as the bookmark. Data
come first, the manifest last, under its final name in one step; a job that dies in between leaves the last version in use.
Folders that the latest manifests do not name are removed by tidy().
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

BUCKETS = 64


def bucket(by: str = "athlete_id", n: int = BUCKETS) -> Column:
    """The part of an athlete's rows; one athlete is never in two."""
    return F.pmod(F.xxhash64(by), F.lit(n)).cast("long")


@dataclass
class Table:
    """Rows in parts, by `part` (a function that gives a column). `empty` is the schema before the first write."""

    spark: SparkSession
    path: str
    empty: str
    part: Callable[[], Column] = bucket
    versions_kept: int = 2
    notes: dict[str, str] = field(default_factory=dict)

    def numbers(self) -> list[int]:
        return sorted(int(name[:-5]) for name in files.names(self.spark, f"{self.path}/manifests") if name.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        known = self.numbers()
        if not known:
            return {"number": -1, "parts": {}, "notes": {}}
        return json.loads(files.read_text(self.spark, f"{self.path}/manifests/{known[-1] if number is None else number:012d}.json"))

    def current(self) -> dict[str, str]:
        """The notes of the last version and its number; nothing before the first."""
        now = self.manifest()
        return {} if now["number"] < 0 else now["notes"] | {"number": str(now["number"])}

    def read(self, parts: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        held = self.manifest()["parts"]
        folders = [f"{self.path}/{held[k]}" for k in (held if parts is None else map(str, sorted(parts))) if k in held]
        return self.spark.read.schema(self.empty).parquet(*folders) if folders else self.spark.createDataFrame([], self.empty)

    def parts_of(self, df: DataFrame) -> list[int]:
        """The parts that rows belong to: no more than there are parts."""
        return sorted(r[0] for r in df.select(self.part().alias("p")).distinct().collect())

    def write(self, df: DataFrame, parts: Iterable[int] | None = None, **notes: str) -> None:
        """The next version. parts: those that df holds whole (None: all); the others stay. Notes take the place of the last ones."""
        now = self.manifest()
        number = now["number"] + 1
        folder = f"data/v{number}"
        df.withColumn("_part", self.part()).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/{folder}")
        new = {name.removeprefix("_part="): f"{folder}/{name}" for name in files.names(self.spark, f"{self.path}/{folder}") if name.startswith("_part=")}
        replaced = set(now["parts"]) if parts is None else set(map(str, parts))
        if parts is not None and not set(new) <= replaced:
            raise ValueError(f"rows of parts that are not replaced: {sorted(set(new) - replaced)}")
        held = {k: v for k, v in now["parts"].items() if k not in replaced} | new
        self.publish(number, {"number": number, "parts": held, "notes": notes})
        self.tidy()

    def publish(self, number: int, manifest: dict) -> None:
        files.write_text(self.spark, f"{self.path}/manifests/{number:012d}.json", json.dumps(manifest))

    def tidy(self) -> None:
        """Removes manifests before the last few, and the parts that only these name."""
        known = self.numbers()
        old, kept = known[: -self.versions_kept], known[-self.versions_kept :]
        used = {folder for k in kept for folder in self.manifest(k)["parts"].values()}
        for k in old:
            for folder in set(self.manifest(k)["parts"].values()) - used:
                files.remove(self.spark, f"{self.path}/{folder}")
            files.remove(self.spark, f"{self.path}/manifests/{k:012d}.json")

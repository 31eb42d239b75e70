"""One file a route: a sink that shows all files at once or none.

    spark.dataSource.register(TextFiles)
    named(routes).select("file", "text").write.format("text_files").mode("append").save(folder)

Tasks write into a folder beside the target, which is renamed when all have ended; a failed job removes it. The target must
not exist yet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as afs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.parse import slug
from .landed import gpx, preview_page


@dataclass
class Written(WriterCommitMessage):
    files: int


class TextFiles(DataSource):
    """Rows of (file, text). Option: path."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"])


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.beside = f"{self.path}._writing-{uuid.uuid4().hex}"

    def place(self, address: str) -> tuple[afs.FileSystem, str]:
        return afs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (afs.LocalFileSystem(), address)

    def write(self, rows: Iterator[Row]) -> Written:
        files, folder = self.place(self.beside)
        files.create_dir(folder, recursive=True)
        n = 0
        for row in rows:
            if not row["file"] or "/" in row["file"]:
                raise ValueError(f"no file name: {row['file']!r}")
            with files.open_output_stream(f"{folder}/{row['file']}") as out:
                out.write((row["text"] or "").encode())
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        files, beside = self.place(self.beside)
        target = self.place(self.path)[1]
        if files.get_file_info(target).type != afs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(target)
        if not any(m and m.files for m in messages):
            files.create_dir(beside, recursive=True)
        files.move(beside, target)

    def abort(self, messages: list[Written | None]) -> None:
        files, beside = self.place(self.beside)
        if files.get_file_info(beside).type != afs.FileType.NotFound:
            files.delete_dir(beside)


def named(routes: DataFrame, kind: str = "gpx") -> DataFrame:
    """file and text of each route (id, name, surface, coords, time; for html also waypoints: array<struct<lat, lng, name, reason>>).

    Files are named by the slug of the name; of routes with one slug the least id has it, others add their id. Without a
    letter or digit the slug is `route`.
    """
    rows = routes.withColumn("_slug", F.coalesce(F.when(slug(F.col("name")) != "", slug(F.col("name"))), F.lit("route")))
    first = rows.groupBy("_slug").agg(F.min("id").alias("_first"))
    text = gpx(F.col("coords"), F.col("name"), F.col("surface"), F.col("time")) if kind == "gpx" else preview_page(F.col("name"), F.col("coords"), F.col("waypoints"))
    own = F.when(F.col("id") == F.col("_first"), F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), F.col("id").cast("string")))
    return rows.join(first, "_slug").select("id", F.concat(own, F.lit(f".{kind}")).alias("file"), text.alias("text"))

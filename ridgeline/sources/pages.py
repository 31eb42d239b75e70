"""Landed pages of a paged listing as a data source, in batches and as a stream.

A listing asks for rides after an epoch, page by page. Its pages are landed as `after=<epoch>/page-<n>.json`, an array of
rides each. A listing ends with its first page that is empty or has fewer rides than a page holds; pages beyond are
left over from another listing and not read. The epoch is the offset: a stream takes the listings that have ended, in order.
What is no ride comes as a row with its text in `_broken`.

    spark.dataSource.register(PagedRides)
    spark.read.format("paged_rides").load(folder)
    spark.readStream.format("paged_rides").option("after", 0).load(folder)
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs as afs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import schema

PAGE_ROWS = 50
SHAPE = T.StructType([*schema.RAW_RIDE.fields, T.StructField("after", T.LongType()), T.StructField("page", T.IntegerType()), T.StructField("_broken", T.StringType())])
#: What a value of a ride may be in JSON.
KINDS = {T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.StringType: str, T.BooleanType: bool}


class Listing(InputPartition):
    def __init__(self, after: int):
        super().__init__(after)
        self.after = after


class Pages:
    """A folder of listings, on any file system that its address names."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.rows = options["path"], int(options.get("page_rows", PAGE_ROWS))
        self.first = int(options.get("after", 0))

    def open(self) -> tuple[afs.FileSystem, str]:
        return afs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (afs.LocalFileSystem(), self.folder)

    def names(self, folder: str) -> list[str]:
        files, root = self.open()
        return [f.base_name for f in files.get_file_info(afs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))]

    def epochs(self) -> list[int]:
        return sorted(int(m[1]) for name in self.names("") if (m := re.fullmatch(r"after=(\d+)", name)))

    def pages(self, after: int) -> Iterator[tuple[int, list | None, str]]:
        """The pages of a listing up to its last one: number, rides (None if it is no array), text."""
        files, root = self.open()
        held = {int(m[1]) for name in self.names(f"after={after}") if (m := re.fullmatch(r"page-(\d+)\.json", name))}
        number = 1
        while number in held:
            with files.open_input_stream(f"{root}/after={after}/page-{number}.json") as stream:
                text = stream.read().decode("utf-8", "replace")
            try:
                rides = json.loads(text)
            except ValueError:
                rides = None
            rides = rides if isinstance(rides, list) else None
            yield number, rides, text
            if rides is not None and len(rides) < self.rows:
                return
            number += 1

    def ended(self, after: int) -> bool:
        """Whether the page that ends the listing has landed; a broken page ends nothing."""
        last = None
        for _, rides, _ in self.pages(after):
            last = rides
        return last is not None and len(last) < self.rows

    def rides(self, after: int) -> Iterator[tuple]:
        width = len(schema.RAW_RIDE.fields)
        for number, rides, text in self.pages(after):
            if rides is None:
                yield (*[None] * width, after, number, text)
            for one in rides or ():
                values = sound(one)
                yield (*values, after, number, None) if values else (*[None] * width, after, number, json.dumps(one))


def sound(one) -> tuple | None:
    """The values of a listed ride; None if it is no object, has no id, or a value of another kind."""
    if not isinstance(one, dict) or not isinstance(one.get("id"), int):
        return None
    out = []
    for f in schema.RAW_RIDE.fields:
        v = one.get(f.name)
        kind = KINDS[type(f.dataType)]
        if v is not None and (not isinstance(v, kind) or (isinstance(v, bool) and kind is not bool)):
            return None
        out.append(float(v) if v is not None and isinstance(f.dataType, T.DoubleType) else v)
    return tuple(out)


class PagedRides(DataSource):
    """Options: path; after (epoch, 0): listings from there on; page_rows (50): rides of a full page."""

    @classmethod
    def name(cls) -> str:
        return "paged_rides"

    def schema(self) -> T.StructType:
        return SHAPE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return StreamReader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.source = Pages(dict(options))

    def partitions(self) -> list[InputPartition]:
        return [Listing(e) for e in self.source.epochs() if e >= self.source.first]

    def read(self, partition: Listing) -> Iterator[tuple]:
        return self.source.rides(partition.after)


class StreamReader(DataSourceStreamReader):
    """Offsets are epochs: a micro-batch holds the listings after its start up to its end."""

    def __init__(self, options: dict[str, str]):
        self.source = Pages(dict(options))

    def initialOffset(self) -> dict:
        return {"after": self.source.first - 1}

    def latestOffset(self) -> dict:
        """The last listing before the first that has not ended."""
        last = self.source.first - 1
        for epoch in self.source.epochs():
            if epoch < self.source.first:
                continue
            if not self.source.ended(epoch):
                break
            last = epoch
        return {"after": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Listing(e) for e in self.source.epochs() if start["after"] < e <= end["after"]]

    def read(self, partition: Listing) -> Iterator[tuple]:
        return self.source.rides(partition.after)

    def commit(self, end: dict) -> None:
        pass

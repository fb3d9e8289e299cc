"""Python data sources: tables in zip archives, and paged services, read in parallel and resumable.

``read_zipped_csv`` has a partition for each member of each archive; a member is inflated and parsed as
it streams. ``paged_search`` has a partition for each page; as a stream its offset is the last page that
was read, so a run that was stopped goes on behind it. Folders and services are named by options, and
only the list of members, or the number of pages, is on the driver.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from urllib.request import urlopen

import pyarrow as pa
from pyarrow import csv
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a CSV member that are parsed at a time.
CHUNK = 4 << 20


def _filesystem(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, options["path"]
        self.members = options.get("members", ".csv")

    def partitions(self) -> list[Member]:
        found, base = _filesystem(self.folder)
        out = []
        for info in found.get_file_info(pafs.FileSelector(base, recursive=True)):
            if info.is_file and info.extension == "zip" and not info.base_name.startswith("."):
                with found.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                    out += [Member(info.path, n) for n in z.namelist() if n.endswith(self.members)]
        return sorted(out, key=lambda m: (m.path, m.name)) or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        arrow = to_arrow_schema(self.schema)
        types = {f.name: f.type for f in arrow}
        found, _ = _filesystem(self.folder)
        with found.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            if not member.peek(1):
                return
            rows = csv.open_csv(pa.PythonFile(member, "r"), csv.ReadOptions(block_size=CHUNK), csv.ParseOptions(newlines_in_values=True), csv.ConvertOptions(column_types=types, include_columns=list(types), include_missing_columns=True, strings_can_be_null=True, quoted_strings_can_be_null=False))
            for batch in rows:
                yield batch.cast(arrow)


class ZippedTables(DataSource):
    """Format ``zipped_csv``: option ``path`` is a folder of archives; the schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> ZippedReader:
        return ZippedReader(schema, self.options)


def read_zipped_csv(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All members ``*.csv`` of all archives in a folder, with the columns of ``schema`` by name; an empty
    field that is not quoted is null, a column that a member lacks is null."""
    spark.dataSource.register(ZippedTables)
    return spark.read.format("zipped_csv").schema(schema).option("path", folder).load()


def write_zipped_csv(df: DataFrame, folder: str) -> None:
    """An archive with one member for each partition; an archive appears whole or not at all."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = _filesystem(folder)
        found.create_dir(base, recursive=True)
        name, attempt = f"part-{TaskContext.get().partitionId():05d}", uuid.uuid4().hex
        n, writer, entry, archive, stream = 0, None, None, None, None
        for batch in batches:
            if writer is None:
                stream = found.open_output_stream(f"{base}/.{attempt}.part", compression=None)
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                entry = archive.open("part.csv", "w", force_zip64=True)
                writer = csv.CSVWriter(entry, batch.schema)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer is not None:
            for x in (writer, entry, archive, stream):
                x.close()
            found.move(f"{base}/.{attempt}.part", f"{base}/{name}.zip")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    # A task that runs twice writes to names of its own and moves one after the other to the partition's name.
    df.mapInArrow(rows, "n long").write.format("noop").mode("overwrite").save()


class Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


def _fetch(url: str) -> dict:
    with urlopen(url, timeout=30) as answer:
        return json.load(io.TextIOWrapper(answer, "utf-8"))


class _Pages:
    """What batch and stream readers share: ``url`` with ``{page}`` in it, pages from 1."""

    def __init__(self, options: dict):
        self.url = options["url"]

    def count(self) -> int:
        return int(_fetch(self.url.format(page=1)).get("response", {}).get("pages", 1))

    def rows(self, page: int) -> Iterator[tuple]:
        for n, result in enumerate(_fetch(self.url.format(page=page)).get("response", {}).get("results", [])):
            yield page, n, str(result.get("id")), json.dumps(result, sort_keys=True)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(1, self.pages.count() + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition.page)


class PagedStream(DataSourceStreamReader):
    """A batch takes ``pagesPerBatch`` pages at most."""

    def __init__(self, options: dict):
        self.pages, self.most, self.seen = _Pages(options), int(options.get("pagesPerBatch", 1000)), 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        self.seen = min(self.pages.count(), self.seen + self.most)
        return {"page": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.seen = max(self.seen, end["page"])
        return [Page(k) for k in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition.page)

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end["page"])


class PagedSearch(DataSource):
    """Format ``paged_search``: option ``url`` with ``{page}``; rows are ``page, n, id, body`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "page int, n int, id string, body string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options)

"""Landed pages of the vulnerability feed as a data source, for batches and streams.

``read_feed(spark, folder)`` has a partition for each page and takes a condition on ``year`` into the reader;
``stream_feed`` reads pages as they land, each of them once. Pages are JSON objects with a list ``vulnerabilities``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from flowtally.schema import VULNERABILITY_DDL

FORMAT = "feed_pages"
#: year: of publication, null where that has none; page: the file's path; place: the record's number in it.
FEED_DDL = f"{VULNERABILITY_DDL}, year INT, page STRING, place INT"
#: Records of an Arrow batch.
ROWS = 500


def pages_of(folder: str, suffixes: tuple[str, ...]) -> list[tuple[int, str]]:
    """Time of landing (nanoseconds) and path of every page below a folder, in that order. Names that begin with a dot
    or an underscore are not pages."""
    target, base = fs.FileSystem.from_uri(folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    found = target.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, scheme + f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes) and f.base_name[0] not in "._")


def shaped(value, kind: T.DataType):
    """A JSON value in the form of a column type; null where it has another one."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: shaped(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [shaped(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    return value


def _year(cve: dict | None) -> int | None:
    head = ((cve or {}).get("published") or "")[:4]
    return int(head) if len(head) == 4 and head.isascii() and head.isdigit() else None


class FeedPage(InputPartition):
    def __init__(self, path: str, years: tuple[int, ...] | None):
        super().__init__(path)
        self.path, self.years = path, years


def read_page(partition: FeedPage | None, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The records of a page; a page that is no JSON object with a list has none. A folder without pages gives the
    reader no partition at all."""
    if partition is None:
        return
    target, plain = fs.FileSystem.from_uri(partition.path)
    with target.open_input_file(plain) as f:
        data = f.readall()
    try:
        page = json.loads(data)
    except ValueError:
        page = None
    listed = page.get("vulnerabilities") if isinstance(page, dict) else None
    kind, out, kinds = schema["cve"].dataType, [], to_arrow_schema(schema)
    for place, item in enumerate(listed if isinstance(listed, list) else []):
        cve = shaped(item.get("cve") if isinstance(item, dict) else None, kind)
        year = _year(cve)
        if partition.years is None or year in partition.years:
            out.append({"cve": cve, "year": year, "page": partition.path, "place": place})
        if len(out) == ROWS:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=kinds)


class FeedReader(DataSourceReader):
    def __init__(self, folder: str, suffixes: tuple[str, ...], schema: T.StructType):
        self.folder, self.suffixes, self.schema, self.years = folder, suffixes, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on the year are met while pages are read; others go back."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("year",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.years = tuple(sorted(wanted if self.years is None else wanted & set(self.years)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FeedPage(path, self.years) for _, path in pages_of(self.folder, self.suffixes)]

    def read(self, partition: FeedPage) -> Iterator[pa.RecordBatch]:
        return read_page(partition, self.schema)


class FeedStreamReader(DataSourceStreamReader):
    """An offset is the newest page read, by time of landing and path; a batch holds the pages between two of them."""

    def __init__(self, folder: str, suffixes: tuple[str, ...], schema: T.StructType):
        self.folder, self.suffixes, self.schema = folder, suffixes, schema

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        pages = pages_of(self.folder, self.suffixes)
        return {"at": pages[-1][0], "path": pages[-1][1]} if pages else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return [FeedPage(page[1], None) for page in pages_of(self.folder, self.suffixes) if low < page <= high]

    def read(self, partition: FeedPage) -> Iterator[pa.RecordBatch]:
        return read_page(partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


class FeedPages(DataSource):
    """Options: path, and suffixes of the pages' names (``.json`` by default, parted by commas)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FEED_DDL

    def _given(self) -> tuple[str, tuple[str, ...]]:
        return self.options["path"], tuple(self.options.get("suffixes", ".json").split(","))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FeedReader(*self._given(), schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return FeedStreamReader(*self._given(), schema)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedPages)


def read_feed(spark: SparkSession, folder: str, years: list[int] | None = None, suffixes: str = ".json") -> DataFrame:
    """All records of the landed pages (cve, year, page, place), optionally of given publication years."""
    _register(spark)
    rows = spark.read.format(FORMAT).option("suffixes", suffixes).load(folder)
    return rows.where(F.col("year").isin([int(y) for y in years])) if years else rows


def stream_feed(spark: SparkSession, folder: str, suffixes: str = ".json") -> DataFrame:
    """The same as a stream: pages that land later come in later batches, each page once."""
    _register(spark)
    return spark.readStream.format(FORMAT).option("suffixes", suffixes).load(folder)


def land_pages(rows: DataFrame, page_no, folder: str) -> None:
    """Write records (``cve``) as feed pages, one file for each page number below ``folder``."""
    page = F.to_json(F.struct(F.count(F.lit(1)).alias("totalResults"), F.collect_list(F.struct("cve")).alias("vulnerabilities")))
    pages = rows.withColumn("page", page_no).groupBy("page").agg(page.alias("value"))  # a page holds what one request gives
    pages.repartition("page").write.partitionBy("page").text(folder)

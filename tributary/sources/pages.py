"""A source of pages, with offsets, retries and a cool-down; object listing and gzip JSON."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Tries of a page, seconds before the second one and the longest wait.
TRIES, COOLDOWN, LONGEST = 3, 1.0, 60.0


def with_retries(fetch: Callable[[], pa.RecordBatch], tries: int = TRIES, cooldown: float = COOLDOWN, sleep: Callable[[float], None] = time.sleep) -> pa.RecordBatch:
    """What fetch gives; after an error of the store it is tried again, each wait twice the last. The last error is raised."""
    for k in range(tries):
        try:
            return fetch()
        except OSError:
            if k == tries - 1:
                raise
            sleep(min(LONGEST, cooldown * 2**k))
    raise ValueError("tries must be 1 or more")


@dataclass
class Page(InputPartition):
    path: str
    number: int


class _Pages:
    """Pages of a folder of Parquet files: row groups, files by name. Files that are added later must have later names."""

    def __init__(self, options: dict[str, str]):
        self.store, self.path = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.tries, self.cooldown = int(options.get("tries", TRIES)), float(options.get("cooldown", COOLDOWN))

    def files(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.path, recursive=True)) if self.store.get_file_info(self.path).type == fs.FileType.Directory else [self.store.get_file_info(self.path)]
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))

    def of(self, path: str) -> int:
        return with_retries(lambda: pq.ParquetFile(path, filesystem=self.store).num_row_groups, self.tries, self.cooldown)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        table = with_retries(lambda: pq.ParquetFile(partition.path, filesystem=self.store).read_row_group(partition.number), self.tries, self.cooldown)
        yield from table.to_batches()


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(p, k) for p in self.files() for k in range(self.of(p))]


class PageStream(_Pages, DataSourceStreamReader):
    """Offsets count the files that were read, in order of their names, and name the last one."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.most = int(options.get("files", 1))

    def initialOffset(self) -> dict:
        return {"read": 0, "last": ""}

    def latestOffset(self, start: dict | None = None, limit=None) -> dict:
        files = self.files()
        # All there is; how much of it a batch takes is Spark's to say.
        return {"read": len(files), "last": files[-1] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        wanted = [p for p in self.files() if start["last"] < p <= end["last"]]
        return [Page(p, k) for p in wanted for k in range(self.of(p))]

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    """`spark.read.format("pages").schema(...).load(path)`, and readStream likewise. Options: tries, cooldown (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> StructType:
        raise ValueError("give the schema of the pages")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStream(dict(self.options))


def read_pages(spark: SparkSession, path: str, schema: StructType, tries: int = TRIES, cooldown: float = COOLDOWN) -> DataFrame:
    """A folder page by page, each a task that is tried again by itself."""
    spark.dataSource.register(Pages)
    return spark.read.format("pages").schema(schema).option("tries", tries).option("cooldown", cooldown).load(path)


def stream_pages(spark: SparkSession, path: str, schema: StructType, tries: int = TRIES, cooldown: float = COOLDOWN) -> DataFrame:
    """The same as a stream; what was read is in the stream's checkpoint."""
    spark.dataSource.register(Pages)
    return spark.readStream.format("pages").schema(schema).option("tries", tries).option("cooldown", cooldown).load(path)


def trimmed_stream(spark: SparkSession, path: str, schema: StructType, archive: str | None = None) -> DataFrame:
    """Files as they arrive; those of finished batches are archived, or deleted without an archive."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("cleanSource", "archive" if archive else "delete")
    return (rows.option("sourceArchiveDir", archive) if archive else rows).parquet(path)


def objects(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """(key, size, modified_at) of the files under a path, by name, without reading them; the first `most` by key."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    listed = found.select(F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified_at"))
    return listed if most is None else listed.orderBy("key").limit(most)


def put_json(rows: DataFrame, path: str, gzip: bool = True) -> None:
    """Rows as lines of JSON, packed."""
    rows.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def get_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines of JSON as rows, packed or not; lines that are no JSON come back as nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def object_key(kind: str, tenant: Column, *parts: Column, suffix: str = "") -> Column:
    """`kind/tenant/part/...suffix`; an empty or null tenant is default."""
    owner = F.coalesce(F.nullif(tenant, F.lit("")), F.lit("default"))
    return F.concat(F.concat_ws("/", F.lit(kind), owner, *parts), F.lit(suffix))

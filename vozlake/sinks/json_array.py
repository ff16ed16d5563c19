"""One JSON array written by many tasks.

Every task writes its own part of the array, in order, with its own separators.  The commit renames the parts and
puts small files between them: a bracket, commas, a bracket.  So the files of the folder, in the order of their
names, are one JSON array (``cat folder/*.json``), and neither the driver nor any task holds more than its part.
A repeated task writes to another name, and only the parts that the commit names stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from vozlake.session import bounded_batches

FORMAT = "vozlake_json_array"
SEPARATOR = b",\n"


@dataclass
class Part(WriterCommitMessage):
    place: int
    name: str
    items: int


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def _folder(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        return system, root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, root = self._folder()
        system.create_dir(root)
        place, name, items = TaskContext.get().partitionId(), f"_{uuid4().hex}", 0
        with system.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                values = [x.encode() for x in batch.column(0).to_pylist()]
                if values:
                    out.write((SEPARATOR if items else b"") + SEPARATOR.join(values))
                    items += len(values)
        return Part(place, name, items)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, root = self._folder()
        system.create_dir(root)
        parts = sorted((m for m in messages if m), key=lambda m: m.place)
        filled = [m for m in parts if m.items]
        for old in system.get_file_info(fs.FileSelector(root)):
            if old.base_name.endswith(".json") or old.base_name in {m.name for m in parts if not m.items}:
                system.delete_file(old.path)
        for k, part in enumerate(filled):
            system.move(f"{root}/{part.name}", f"{root}/{2 * k + 1:08d}.json")
        between = [b"[\n", *[SEPARATOR] * (len(filled) - 1), b"\n]\n"] if filled else [b"[\n]\n"]
        for k, text in enumerate(between):
            with system.open_output_stream(f"{root}/{2 * k:08d}.json") as out:
                out.write(text)

    def abort(self, messages: list[Part | None]) -> None:
        system, root = self._folder()
        for part in messages:
            if part:
                system.delete_file(f"{root}/{part.name}")


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        if not overwrite:
            raise ValueError("an array can't be appended to")
        return ArrayWriter(self.options["path"], overwrite)


def write_json_array(rows: DataFrame, item: Column, path: str, by: list[str]) -> None:
    """The rows' ``item`` as one array in the folder ``path``, ordered by the columns ``by``, then by the item itself.

    ``path`` must be a folder that driver and executors share."""
    rows.sparkSession.dataSource.register(ArraySource)
    bounded_batches(rows.sparkSession, "4m")
    lines = rows.select(*by, F.to_json(item).alias("value"))
    order = list(dict.fromkeys([*by, "value"]))
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("value").write.format(FORMAT).mode("overwrite").option("path", path).save()


def read_json_array(spark: SparkSession, path: str, item_type: str) -> DataFrame:
    """The items (column ``item``) of such a folder; each stands on a line of its own."""
    lines = spark.read.text(path, pathGlobFilter="*.json").select(F.regexp_replace("value", ",$", "").alias("value"))
    return lines.where(~F.col("value").isin("", "[", "]")).select(F.from_json("value", item_type).alias("item"))

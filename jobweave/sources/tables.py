"""Append-only tables with committed batches: rows are inserted or ignored, conflicts reported, a repeated batch changes nothing.

A table is a folder of Parquet files and a manifest for each committed batch. Tasks write files of their own and report
them; only the commit on the driver, one small manifest, makes them visible. Lost tasks and failed jobs leave files that no
manifest names. The folder may be in any file system that Arrow reaches by its URI; reads are Spark's own Parquet reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(uri: str):
    """The Arrow file system of a folder's URI, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    path: str | None
    rows: int


class BatchWriter(DataSourceArrowWriter):
    """Writes one batch into the folder of a table."""

    def __init__(self, folder: str, batch: str) -> None:
        self.folder, self.batch = folder, batch

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.folder)
        writer, rows, path = None, 0, f"data/{self.batch}-{uuid.uuid4().hex}.parquet"
        for batch in batches:
            if batch.num_rows:
                if writer is None:
                    files.create_dir(f"{root}/data", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{path}", batch.schema, filesystem=files, compression="zstd")
                writer.write_batch(batch)
                rows += batch.num_rows
        if writer is not None:
            writer.close()
        return Written(path if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.folder)
        if committed(self.folder, self.batch) is not None:  # by an earlier run of the same batch
            self.abort(messages)
            return
        said = {"batch": self.batch, "files": [m.path for m in messages if m and m.path], "rows": sum(m.rows for m in messages if m)}
        files.create_dir(f"{root}/commits", recursive=True)
        with files.open_output_stream(f"{root}/commits/.{self.batch}") as out:
            out.write(json.dumps(said).encode())
        files.move(f"{root}/commits/.{self.batch}", f"{root}/commits/{self.batch}.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.folder)
        for m in messages:
            if m and m.path:
                files.delete_file(f"{root}/{m.path}")


class BatchTable(DataSource):
    """`df.write.format("batch_table").option("folder", ...).option("batch", ...)`"""

    @classmethod
    def name(cls) -> str:
        return "batch_table"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["folder"], self.options["batch"])


def committed(folder: str, batch: str) -> dict | None:
    """The manifest of a batch, null before it is committed."""
    from pyarrow.fs import FileType

    files, root = opened(folder)
    path = f"{root}/commits/{batch}.json"
    if files.get_file_info(path).type == FileType.NotFound:
        return None
    with files.open_input_stream(path) as said:
        return json.loads(said.read())


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows of committed batches."""
    from pyarrow.fs import FileSelector

    files, root = opened(folder)
    names = [f.base_name[:-5] for f in files.get_file_info(FileSelector(f"{root}/commits", allow_not_found=True)) if f.base_name.endswith(".json")]
    paths = [f"{folder}/{p}" for n in sorted(names) for p in committed(folder, n)["files"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def insert(rows: DataFrame, folder: str, batch: str, keys: list[str], order: list[str]) -> DataFrame:
    """Inserts the rows whose keys the table doesn't have; of rows with one key the first by `order`. Returns the conflicts:

    rows that differ from what the table holds under their keys. Rows that equal it are ignored. A batch is written once,
    by whatever name its maker gives it; asked for again, it gives the same conflicts and changes nothing.
    """
    spark = rows.sparkSession
    spark.dataSource.register(BatchTable)
    rest = [c for c in rows.columns if c not in keys]  # keys are shuffled once, not again inside values
    if committed(folder, batch) is None:
        first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*") if rest else rows.distinct()
        new = first.join(read(spark, folder, rows.schema).select(*keys), keys, "left_anti").select(*rows.columns)
        new.write.format("batch_table").option("folder", folder).option("batch", batch).mode("append").save()
    held = read(spark, folder, rows.schema).select(*keys, *(F.col(c).alias(f"held_{i}") for i, c in enumerate(rest)))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"held_{i}")) for i, c in enumerate(rest)), F.lit(True))
    return rows.join(held, keys).where(~same).select(*rows.columns)

"""Delivery of the outbox: each planned write is sent once, and what was made is fed to the writes that refer to it.

A Python data source takes the writes. Each task leaves a file and reports it;
only the files that a commit names count, so tasks that Spark runs again and
runs that break half-way deliver nothing twice. The sink here is a folder of
Parquet files that another program forwards; a sink of another kind is a writer
with the same messages.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What is sent, in order: each kind may refer to the one before it.
KINDS = ("source", "citation", "attach")
#: ``handle``: the name of what the write makes; the same write always makes the same. ``refers_to``: the handle that it builds on.
COLUMNS = "key string, kind string, url string, title string, document_id bigint, registry_person_id string, confidence int, handle string, refers_to string"


def _place(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder.rstrip("/")))


@dataclass
class Sent(WriterCommitMessage):
    """The file of one task and its number of writes; no file where it had none."""

    file: str | None
    writes: int


class FolderWriter(DataSourceArrowWriter):
    """Writes of each task into a file of its own under ``parts``; a commit names them."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        disk, root = _place(self.folder)
        name, out, n = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                disk.create_dir(f"{root}/parts", recursive=True)
                out = pq.ParquetWriter(f"{root}/parts/{name}", batch.schema, filesystem=disk)
            out.write_batch(batch)
            n += batch.num_rows
        if out is None:
            return Sent(None, 0)
        out.close()
        return Sent(name, n)

    def commit(self, messages: list[Sent | None]) -> None:
        files = [m.file for m in messages if m and m.file]
        if not files:
            return
        disk, root = _place(self.folder)
        disk.create_dir(f"{root}/commits", recursive=True)
        name = uuid.uuid4().hex
        with disk.open_output_stream(f"{root}/commits/.{name}") as out:
            out.write(json.dumps({"files": files, "writes": sum(m.writes for m in messages if m)}).encode())
        disk.move(f"{root}/commits/.{name}", f"{root}/commits/{name}.json")

    def abort(self, messages: list[Sent | None]) -> None:
        disk, root = _place(self.folder)
        for m in messages:
            if m and m.file and disk.get_file_info(f"{root}/parts/{m.file}").type == arrow_fs.FileType.File:
                disk.delete_file(f"{root}/parts/{m.file}")


class RegistryWrites(DataSource):
    """``registry_writes``: append-only sink of the folder in the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "registry_writes"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("deliveries are only added to")
        return FolderWriter(self.options["path"])


def _one_per_key(rows: DataFrame) -> DataFrame:
    """The first row of each key, by its other columns in order."""
    others = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.min(F.struct(*others)).alias("_row")).select("key", "_row.*")


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """The writes that commits of ``folder`` name, each key once: of two runs at the same time that sent the same, either's (they are alike)."""
    disk, root = _place(folder)
    found = disk.get_file_info(arrow_fs.FileSelector(f"{root}/commits", allow_not_found=True))
    files: list[str] = []
    for f in found:
        if f.base_name.endswith(".json"):
            with disk.open_input_stream(f.path) as src:
                files += json.loads(src.read())["files"]
    if not files:
        return spark.createDataFrame([], COLUMNS)
    return spark.read.schema(COLUMNS).parquet(*[f"{folder.rstrip('/')}/parts/{f}" for f in files]).transform(_one_per_key)


def _send(rows: DataFrame, folder: str) -> None:
    """Deliver rows of one kind, which have all of ``COLUMNS`` but the handle."""
    made = rows.withColumn("handle", F.concat_ws("-", "kind", F.substring("key", 1, 24)))
    schema = rows.sparkSession.createDataFrame([], COLUMNS).schema
    made.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.format("registry_writes").mode("append").option("path", folder).save()


def deliver(outbox: DataFrame, folder: str, sources: DataFrame | None = None) -> DataFrame:
    """Send what of ``outbox`` (with ``key``) hasn't been sent to ``folder``; returns all that is delivered there.

    Sources go first; a source that the registry has by now (``sources``, with
    ``registry_id``, ``handle``, ``attributes``) isn't made. Citations carry the
    handle of their source, made or known, attachments that of their citation; a
    write whose reference isn't there yet waits for a later run. Repeated rows
    and null addresses, people and documents are fine: a key is sent once.
    """
    from ..checkpoints import settle
    from ..operators.cite import source_by_url

    spark = outbox.sparkSession
    spark.dataSource.register(RegistryWrites)
    known = None
    if sources is not None:
        known = settle(source_by_url(sources, outbox.filter("kind = 'source' OR kind = 'citation'")).filter("handle IS NOT NULL").select(F.col("url").alias("_url"), F.col("handle").alias("_known")))
    for kind in KINDS:
        done = delivered(spark, folder)
        planned = outbox.filter(F.col("kind") == kind).select("key", "kind", "url", "title", "document_id", "registry_person_id", "confidence")
        rows = _one_per_key(planned.join(done.select("key"), "key", "left_anti"))
        if kind == "source":
            if known is not None:
                rows = rows.join(known, F.col("url") == F.col("_url"), "left_anti")
            rows = rows.withColumn("refers_to", F.lit(None).cast("string"))
        elif kind == "citation":
            made = done.filter("kind = 'source'").select(F.col("url").alias("_made_url"), F.col("handle").alias("_made"))
            rows = rows.join(made, F.col("url").eqNullSafe(F.col("_made_url")), "left")
            if known is not None:
                rows = rows.join(known, F.col("url") == F.col("_url"), "left")
            rows = rows.withColumn("refers_to", F.coalesce(F.col("_known") if known is not None else F.lit(None), "_made")).filter("refers_to IS NOT NULL")
        else:
            cited = done.filter("kind = 'citation'").select(F.col("registry_person_id").alias("_person"), F.col("document_id").alias("_document"), F.col("handle").alias("refers_to"))
            rows = rows.join(cited, F.col("registry_person_id").eqNullSafe(F.col("_person")) & F.col("document_id").eqNullSafe(F.col("_document")))
        _send(rows, folder)
    return delivered(spark, folder)

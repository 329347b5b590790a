"""Files by name from rows, with a commit: a data source writer.

Tasks write to a staging folder beside the files' own; only when all of them
are done does the driver move the files to their names, and a job that fails
removes the staging folder, so no part of a run is ever seen.  Folders are
paths or URIs of any file system that Arrow knows (file, hdfs, s3, gs), so no
folder has to be mounted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship_package

FORMAT = "veiltrack_files"
#: Files that the driver moves at a time.
MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged."""

    folder: str
    files: list[str]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def file_name(name: Column, suffix: str = "") -> Column:
    """A file's name: escaped as in a URL but for spaces and bars, so that names stay apart and in their folder."""
    plain = F.url_encode(F.coalesce(name.cast("string"), F.lit("null")))
    for escaped, sign in (("+", " "), ("%7C", "|")):
        plain = F.replace(plain, F.lit(escaped), F.lit(sign))
    return F.concat(F.when(plain.isin("", ".", ".."), F.concat(F.lit("%"), plain)).otherwise(plain), F.lit(suffix))


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.folder}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (name, text) whose equal names stand together: a file a name, of its texts one after the other."""
        files, root = _open(self.staging)
        own, made, now, out = f"{root}/{uuid.uuid4().hex}", [], None, None
        try:
            for batch in iterator:
                names, texts = (batch.column(i).combine_chunks() if isinstance(batch.column(i), pa.ChunkedArray) else batch.column(i) for i in (0, 1))
                same = [False, *pc.equal(names[1:], names[:-1]).to_pylist()] if len(names) else []
                starts = [i for i, s in enumerate(same) if not s] + [len(names)]
                for a, b in zip(starts, starts[1:]):
                    name = names[a].as_py()
                    if out is None or name != now:
                        if out is not None:
                            out.close()
                        if not made:
                            files.create_dir(own, recursive=True)
                        now, out = name, files.open_output_stream(f"{own}/{name}")
                        made.append(name)
                    out.write("".join(t for t in texts[a:b].to_pylist() if t is not None).encode())
        finally:
            if out is not None:
                out.close()
        return Written(own, made)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.folder)
        files.create_dir(root, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            for m in filter(None, messages):
                list(pool.map(lambda name, m=m: files.move(f"{m.folder}/{name}", f"{root}/{name}"), m.files))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = _open(self.staging)
        if files.get_file_info(root).type == fs.FileType.Directory:
            files.delete_dir(root)


class NamedFiles(DataSource):
    """Writes (name, text) rows as files below the option path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_files(rows: DataFrame, name: Column, text: Column, folder: str, suffix: str, order: list[str]) -> None:
    """A file for each name, of its rows' texts in that order.  Rows are dealt by name and stream into their file; files of the same names are replaced."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(NamedFiles)
    made = rows.select(file_name(name, suffix).alias("name"), text.alias("text"), *order)
    made = made.repartition("name").sortWithinPartitions("name", *order).select("name", "text")
    made.write.format(FORMAT).mode("append").save(folder)


def paths_of(names: DataFrame, column: str, folder: str, suffix: str) -> DataFrame:
    """The column, each value once, with the path of its file."""
    return names.select(column).distinct().withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), file_name(F.col(column), suffix)))

"""One exact file per name: the merged output of a job, the text of a job (S7, F12).

Spark's writers make folders of parts.  Here every file is put together by one task, in constant
memory, below a staging folder, which becomes the target by one rename when all tasks are done.  A failed
or repeated task leaves nothing: a file enters the staging folder whole, and each is written by one task.
No list of files passes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gridweave.session import scratch_dir
from gridweave.sources.sinks import GROUP_FILE, write_merged

_FORMAT = "exact_files"


def _register(spark: SparkSession) -> None:
    """The sink, defined here so that it travels to the workers by value and they need not import this package."""

    def open_folder(path):
        from pyarrow.fs import FileSystem

        plain = path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        fs, inside = FileSystem.from_uri(plain)
        return fs, inside.rstrip("/")

    def checked(name):
        if not name or name.startswith("/") or any(p in ("", ".", "..") for p in name.split("/")):
            raise ValueError(f"not a file name: {name!r}")
        return name

    class Writer(DataSourceWriter):
        def __init__(self, path, overwrite):
            from pyarrow.fs import FileType

            self.path, self.overwrite = path, overwrite
            fs, self.target = open_folder(path)
            if not overwrite and fs.get_file_info(self.target).type != FileType.NotFound:
                raise ValueError(f"{path} exists already")
            head, _, tail = self.target.rpartition("/")
            self.staged = f"{head}/.{tail}-{uuid.uuid4().hex}"

        def write(self, iterator):
            fs, _ = open_folder(self.path)
            mine = f"{self.staged}.tasks/{uuid.uuid4().hex}"
            fs.create_dir(mine)
            name, out = None, None

            def finish():
                if out is not None:
                    out.close()
                    fs.create_dir(f"{self.staged}/{name}".rpartition("/")[0])
                    fs.move(f"{mine}/file", f"{self.staged}/{name}")

            for row in iterator:
                if out is None or row["file"] != name:
                    finish()
                    name, out = checked(row["file"]), fs.open_output_stream(f"{mine}/file")
                if row["part"] is not None:
                    source, inside = open_folder(row["part"])
                    with source.open_input_stream(inside) as part:
                        while chunk := part.read(1 << 22):
                            out.write(chunk)
                if row["value"] is not None:
                    out.write(row["value"].encode())
            finish()
            return WriterCommitMessage()

        def commit(self, messages):
            fs, _ = open_folder(self.path)
            fs.create_dir(self.staged)
            if self.overwrite:
                self._drop(fs, self.target)
            fs.move(self.staged, self.target)
            self._drop(fs, f"{self.staged}.tasks")

        def abort(self, messages):
            fs, _ = open_folder(self.path)
            self._drop(fs, self.staged)
            self._drop(fs, f"{self.staged}.tasks")

        @staticmethod
        def _drop(fs, folder):
            from pyarrow.fs import FileType

            if fs.get_file_info(folder).type != FileType.NotFound:
                fs.delete_dir(folder)

    class ExactFiles(DataSource):
        @classmethod
        def name(cls):
            return _FORMAT

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], overwrite)

    ExactFiles.__module__ = Writer.__module__ = "__main__"
    spark.dataSource.register(ExactFiles)


def write_files(df: DataFrame, folder: str, order: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """``folder/<file>`` for every ``file`` of ``df``: what its rows hold, in ``order``, one after another.

    A row holds text (``value``, written as UTF-8 with nothing added) or names a file whose bytes it stands for (``part``); a
    null adds nothing, so a file of null rows is empty.  ``file`` may have folders in it; null, empty, absolute
    names and those with ``..`` are an error.  ``folder`` must not exist unless ``overwrite`` is set.  It lies where
    all executors see it: a shared mount or a store that Arrow's file systems open.  Other columns are
    for ``order`` only.
    """
    _register(df.sparkSession)
    missing = [F.lit(None).cast("string").alias(c) for c in ("value", "part") if c not in df.columns]
    dealt = df.select("*", *missing).repartition("file").sortWithinPartitions("file", *order)
    dealt.select("file", "value", "part").write.format(_FORMAT).mode("overwrite" if overwrite else "append").save(folder)


def write_group_files(merged: DataFrame, folder: str, overwrite: bool = False) -> None:
    """The lines of :func:`merge_text_outputs` as ``folder/<job>/group.out``, one file per job.

    The lines are sorted and written as parts by as many tasks as their number asks for, so a job with most of
    the lines is spread; then one task per job copies the bytes of its parts together.
    """
    spark = merged.sparkSession
    with scratch_dir(spark, "group-parts") as parts:
        write_merged(merged, parts)
        found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
                 .load(parts).select("path"))
        coded = F.regexp_extract("path", r"/job=([^/]*)/[^/]*$", 1)
        job = F.url_decode(F.replace(coded, F.lit("+"), F.lit("%2B")))
        rows = found.select(F.concat(job, F.lit("/" + GROUP_FILE)).alias("file"), F.col("path").alias("part"))
        write_files(rows, folder, ("part",), overwrite)

"""Named files written by tasks and committed as one: all of them appear, or none does."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    """What a task wrote: temporary names and the names they are to have."""

    files: list[tuple[str, str]]


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class CommittedFiles(DataSource):
    """Rows ``name, content``: the contents of a name, one after the other, become the file of that name in the folder ``path``.

    A task writes under temporary names; what a failed or repeated attempt wrote is never
    seen. The commit deletes what the folder held and gives files their names; an
    aborted write leaves the files of the folder as they were. A name belongs to one task, and a folder to one write at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("the columns are name and content")
        return _Writer(self.options["path"], uuid.uuid4().hex)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _folder(self.path)
        store.create_dir(f"{folder}/_temporary-{self.run}", recursive=True)
        files: list[tuple[str, str]] = []
        out, seen = None, set()
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not name or re.search(r"^[._]|/\.\.?/|^/", f"{name}/"):
                        raise ValueError(f"{name!r} is no name of a file")
                    if not files or files[-1][1] != name:
                        if name in seen:
                            raise ValueError(f"the rows of {name} do not lie together")
                        seen.add(name)
                        if out is not None:
                            out.close()
                        files.append((f"_temporary-{self.run}/{uuid.uuid4().hex}", name))
                        out = store.open_output_stream(f"{folder}/{files[-1][0]}")
                    out.write(content or b"")
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, folder = _folder(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of the same name")
        store.create_dir(folder, recursive=True)
        for old in store.get_file_info(fs.FileSelector(folder)):
            if old.base_name != f"_temporary-{self.run}":
                (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for part, name in files:
            if "/" in name:
                store.create_dir(f"{folder}/{name.rpartition('/')[0]}", recursive=True)
            store.move(f"{folder}/{part}", f"{folder}/{name}")
        self.abort(messages)
        store.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[_Written | None]) -> None:
        """Delete what this write left in its temporary folder, and nothing else."""
        store, folder = _folder(self.path)
        where = f"{folder}/_temporary-{self.run}"
        if store.get_file_info(where).is_file or store.get_file_info(where).type.name == "Directory":
            store.delete_dir(where)


def write_files(rows: DataFrame, path: str) -> None:
    """Write ``name, content`` as files of a folder, which holds nothing else afterwards.

    ``path`` is a folder in a store that Arrow knows. Rows of a name lie together in one partition, in their order.
    """
    spark = rows.sparkSession
    spark.dataSource.register(CommittedFiles)
    rows.select(rows["name"].cast("string").alias("name"), rows["content"].cast("binary").alias("content")).write.format("committed_files").option("path", path).mode("append").save()

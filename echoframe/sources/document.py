"""One text file from an ordered table, through Spark's Python data source API.

The rows are dealt by ranges of their order, each task writes its range as a part, and
the commit, which runs once all tasks are done, joins head, parts and tail in order and
then removes the parts.  No rows come to the driver; it only copies bytes from file to
file.  A task that is run again writes a part of its own, and only the parts that
Spark reports as committed are joined, so a lost executor leaves nothing behind in the
document."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_COPY = 1 << 22


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.target, self.head, self.tail = options["path"], options.get("head", ""), options.get("tail", "")
        self.parts = f"{self.target}.parts-{options['run']}"

    def write(self, iterator):
        number = TaskContext.get().partitionId()
        fs, folder = file_system(self.parts)
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/{number:08d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as out:
            for batch in iterator:
                out.write("".join(batch.column(0).to_pylist()).encode())
        return _Part(number, path)

    def commit(self, messages):
        fs, target = file_system(self.target)
        made = f"{target}.made-{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as out:
            out.write(self.head.encode())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with fs.open_input_stream(part.path) as piece:
                    while block := piece.read(_COPY):
                        out.write(block)
            out.write(self.tail.encode())
        fs.move(made, target)
        self._clear(fs)

    def abort(self, messages):
        self._clear(file_system(self.target)[0])

    def _clear(self, fs):
        folder = file_system(self.parts)[1]
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class Document(DataSource):
    """``df.write.format("ordered-document")`` with options ``path``, ``head``, ``tail`` and
    ``run`` (a name for this write): a table of one text column, already in order."""

    @classmethod
    def name(cls) -> str:
        return "ordered-document"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_document(pieces: DataFrame, order: list[str], path: str, head: str = "", tail: str = "") -> None:
    """Write the ``text`` of ``pieces`` in ``order`` between ``head`` and ``tail`` as the
    file ``path``, which driver and executors must both see; a file there is replaced.
    Null texts add nothing, and without pieces head and tail are all."""
    spark = pieces.sparkSession
    spark.dataSource.register(Document)
    rows = pieces.where("text is not null").repartitionByRange(*order).sortWithinPartitions(*order).select("text")
    rows.write.format("ordered-document").mode("append").options(path=path, head=head, tail=tail, run=uuid.uuid4().hex).save()

"""A folder of source files as a table, through Spark's Python data source API.

Spark's own file sources leave out every name that begins with ``_`` or ``.``,
``__init__.py`` for one, so this source lists the folder itself.  The listing,
names and sizes only, is made by the driver; files are read by the tasks, in
parts of about equal bytes, so the folder must be one that all of them see.
Symbolic links are not followed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import RepositoryOptions
from ..errors import RepositoryError

PART_BYTES = 32 << 20


class _Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.extensions = {x for x in options.get("extensions", "").split(",") if x}
        self.most = int(options.get("maxfilebytes", options.get("maxFileBytes", 1 << 60)))

    def partitions(self):
        found = []
        for folder, folders, names in os.walk(self.root, onerror=_fail):
            folders[:] = [f for f in folders if not os.path.islink(os.path.join(folder, f))]
            for name in names:
                path = os.path.join(folder, name)
                stem, dot, ext = name.rpartition(".")
                wanted = not self.extensions or (stem and dot and ext.lower() in self.extensions)
                if wanted and not os.path.islink(path) and os.path.getsize(path) <= self.most:
                    found.append((os.path.relpath(path, self.root), os.path.getsize(path)))
        parts, held, size = [], [], 0
        for name, n in sorted(found):
            held.append(name)
            size += n
            if size >= PART_BYTES:
                parts.append(_Part(held))
                held, size = [], 0
        return [*parts, _Part(held)]

    def read(self, partition):
        for name in partition.names:
            with open(os.path.join(self.root, name), "rb") as f:
                content = f.read()
            yield name.replace(os.sep, "/"), len(content), content


def _fail(error: OSError) -> None:
    raise error


class SourceTree(DataSource):
    """``spark.read.format("source-tree").option("path", root)``; options
    ``extensions`` (comma-separated) and ``maxFileBytes``."""

    @classmethod
    def name(cls) -> str:
        return "source-tree"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema):
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, options: RepositoryOptions | None = None) -> DataFrame:
    """(path, length, content) of the wanted files below ``root``, paths relative
    to it with ``/`` between their parts."""
    options = options or RepositoryOptions()
    if not os.path.isdir(root):
        raise RepositoryError(f"{root} is not a folder")
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source-tree").option("extensions", ",".join(options.extensions))
    return reader.option("maxFileBytes", str(options.max_file_bytes)).load(root)


def fragments_from_json(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A fragment table from JSON objects {id, path, text, language?, span?}."""
    from ..errors import InvalidFragment
    from ..functions.languages import language_named
    from ..plans.detector import normalized
    from ..schema import FRAGMENT

    out = []
    names = {"startByte": "start_byte", "endByte": "end_byte", "startLine": "start_line", "endLine": "end_line"}
    for row in rows:
        label = str(row.get("id", ""))
        unknown = set(row) - {"id", "path", "text", "language", "span"}
        if unknown:
            raise InvalidFragment(label, f"unknown field {sorted(unknown)[0]}")
        if not all(isinstance(row.get(k), str) for k in ("id", "path", "text")):
            raise InvalidFragment(label, "id, path and text are required")
        span = row.get("span")
        if span is not None and (set(span) != set(names) or not all(type(v) is int and v >= 0 for v in span.values())):
            raise InvalidFragment(label, "span needs startByte, endByte, startLine and endLine")
        language = language_named(row["language"]) if row.get("language") is not None else None
        out.append((row["id"], row["path"], language, row["text"], span and {names[k]: v for k, v in span.items()}))
    return normalized(spark.createDataFrame(out, FRAGMENT))


"""Text outputs that appear whole or not at all.

Tasks write their lines into a staging folder of the write and report what they wrote. Only when all have, the driver
moves the parts to their names, adds a count line where one is asked for, checks model numbers, and at last puts a
manifest in place that names the parts. A reader goes by the manifest, so a failed or repeated write shows nothing. A
task that outlives an aborted write may leave a file in that write's staging folder, which nobody reads.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_manifest.json"


def _system(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: its place in the order, its file, its lines, and its first and last number."""

    place: int
    name: str
    rows: int
    first: int | None
    last: int | None


class CommittedText(DataSource):
    """``df.write.format("committed_text")`` of ``line`` or of ``number, line``, in the order of partitions."""

    @classmethod
    def name(cls) -> str:
        return "committed_text"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("countline", "false") == "true", schema.names)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, count_line: bool, names: list[str]):
        self.path, self.count_line, self.names = path, count_line, names
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = _system(self.path)
        folder = posixpath.join(root, self.staging)
        system.create_dir(folder)
        place, name, rows, first, last = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None, None
        number, line = self.names.index("number") if "number" in self.names else None, self.names.index("line")
        with system.open_output_stream(posixpath.join(folder, name)) as out:
            for row in iterator:
                if number is not None:
                    if last is not None and row[number] != last + 1:
                        raise ValueError("numbers of a part must be consecutive")
                    first, last = row[number] if first is None else first, row[number]
                out.write(f"{row[line]}\n".encode())
                rows += 1
        return Part(place, name, rows, first, last)

    def commit(self, messages):
        system, root = _system(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.place)
        numbered = [m for m in parts if m.first is not None]
        expected = 1
        for m in numbered:
            if m.first != expected:
                self.abort(messages)
                raise ValueError("numbers of the parts do not follow one another")
            expected = m.last + 1
        # names carry the write's own number, so that a write over an older one does not touch the older one's parts
        own = self.staging.removeprefix(".staging-")
        names = []
        if self.count_line:
            names.append(f"part-{own}-head")
            with system.open_output_stream(posixpath.join(root, names[0])) as out:
                out.write(f"{sum(m.rows for m in parts)}\n".encode())
        for k, m in enumerate(parts):
            names.append(f"part-{own}-{k:05d}")
            system.move(posixpath.join(root, self.staging, m.name), posixpath.join(root, names[-1]))
        draft = posixpath.join(root, self.staging, MANIFEST)
        system.create_dir(posixpath.join(root, self.staging))
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"parts": names, "rows": [m.rows for m in parts]}).encode())
        system.move(draft, posixpath.join(root, MANIFEST))
        system.delete_dir(posixpath.join(root, self.staging))

    def abort(self, messages):
        from pyarrow import fs

        system, root = _system(self.path)
        folder = posixpath.join(root, self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def write_committed(lines: DataFrame, path: str, count_line: bool = False) -> None:
    """Write ``line`` (or ``number, line``) in the order of ``lines``; ``count_line`` puts the number of lines in front."""
    lines.sparkSession.dataSource.register(CommittedText)
    lines.write.format("committed_text").option("countLine", str(count_line).lower()).mode("append").save(path)


def committed_parts(path: str) -> list[str] | None:
    """Paths of a committed output's parts in their order; None if nothing has been committed."""
    from pyarrow import fs

    system, root = _system(path)
    place = posixpath.join(root, MANIFEST)
    if system.get_file_info(place).type != fs.FileType.File:
        return None
    with system.open_input_stream(place) as manifest:
        return [posixpath.join(path, n) for n in json.loads(manifest.read())["parts"]]


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of a committed output."""
    parts = committed_parts(path)
    if parts is None:
        raise FileNotFoundError(f"nothing committed at {path}")
    if not parts:
        return spark.createDataFrame([], "line string")
    return spark.read.text(parts).select(F.col("value").alias("line"))

"""Growing and rotated log files as a stream of lines.

A data source for ``spark.readStream.format("tail")``: its offset log says for each file how many bytes of it are done. A file is
known by its first line, not by its name, so one that was renamed goes on where it was and a new one under the old name
begins at its start. Only whole lines count: a batch ends behind the last line feed a file had when the batch was planned.
Large stretches are read by several tasks, each from the first line that begins in its range.

Offsets live in the stream's checkpoint, so a restarted stream loses and doubles no line. What leaves the folder before it
was read is lost; what was read and left is forgotten. Files of one folder must differ in their first lines, as audit logs
with time stamps do; a file that begins like another is an error. An empty file, or one without a whole line, waits.
"""

from __future__ import annotations

import fnmatch
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
FIRST_LINE = 64 << 10  # a first line is told apart by at most so many bytes


@dataclass
class Stretch(InputPartition):
    """Bytes of a file whose lines one task reads: those that begin in [start, end)."""

    mark: str
    path: str
    begin: int
    start: int
    end: int


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def mark_of(file) -> str | None:
    """What a file is known by: a digest of its first line. None as long as there is no whole line."""
    import hashlib

    file.seek(0)
    head = file.read(FIRST_LINE)
    end = head.find(b"\n")
    return None if end < 0 and len(head) < FIRST_LINE else hashlib.sha1(head[: end if end >= 0 else FIRST_LINE]).hexdigest()


def whole_lines(file, size: int) -> int:
    """Bytes up to and with the last line feed."""
    at = size
    while at:
        step = min(CHUNK, at)
        file.seek(at - step)
        found = file.read(step).rfind(b"\n")
        if found >= 0:
            return at - step + found + 1
        at -= step
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, range_bytes: int) -> None:
        self.folder, self.pattern, self.range_bytes = folder, pattern, range_bytes

    def files(self) -> dict[str, tuple[str, int]]:
        """Path and bytes of whole lines of each file, by its mark."""
        from pyarrow import fs

        files, base = file_system(self.folder)
        found: dict[str, tuple[str, int]] = {}
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if not info.is_file or not fnmatch.fnmatch(info.base_name, self.pattern):
                continue
            with files.open_input_file(info.path) as file:
                mark = mark_of(file)
                if mark is None:
                    continue
                if mark in found:
                    raise ValueError(f"{info.path} begins with the same line as {found[mark][0]}")
                found[mark] = (info.path, whole_lines(file, file.size()))
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {mark: end for mark, (_, end) in self.files().items()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        paths = {mark: path for mark, (path, _) in self.files().items()}
        out = []
        for mark, last in sorted(end.items()):
            first = start.get(mark, 0)
            for at in range(first, last, self.range_bytes):
                out.append(Stretch(mark, paths.get(mark, ""), first, at, min(at + self.range_bytes, last)))
        return out

    def opened(self, files, stretch: Stretch):
        """The file of a stretch, which may have been renamed since the batch was planned."""
        try:
            file = files.open_input_file(stretch.path)
            if mark_of(file) == stretch.mark:
                return file
            file.close()
        except OSError:
            pass
        path, _ = self.files().get(stretch.mark, (None, 0))
        if path is None:
            raise FileNotFoundError(f"{stretch.path} was removed before its lines were read")
        return files.open_input_file(path)

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        files, _ = file_system(self.folder)
        with self.opened(files, stretch) as file:
            at = stretch.start
            if at > stretch.begin:  # a line that began before belongs to the range before
                file.seek(at - 1)
                while data := file.read(CHUNK):
                    found = data.find(b"\n")
                    if found >= 0:
                        at += found
                        break
                    at += len(data)
            file.seek(at)
            held = b""
            while at < stretch.end or held:
                data = file.read(CHUNK)
                if not data:
                    break
                held += data
                *lines, held = held.split(b"\n")
                for line in lines:
                    if at >= stretch.end:
                        return
                    yield stretch.mark, at, line.decode("utf-8", "replace")
                    at += len(line) + 1
                if at >= stretch.end:
                    return

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: ``path`` (a folder that every executor reaches), ``pattern`` of file names, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, position bigint, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("rangebytes", RANGE_BYTES)))


def tail(spark: SparkSession, folder: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, position, value): every line that is written to the files of ``folder``, and where in its file it begins.

    ``folder`` is a URI or an absolute path, ``file`` a digest of the file's first line.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", folder).option("pattern", pattern).option("rangeBytes", str(range_bytes)).load()

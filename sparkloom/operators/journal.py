"""Rows made durable by the task that made them, a few at a time, before its job commits.

A task appends small files of JSON lines to a folder that all machines share. A file is
written aside under a name that readers pass over and then renamed, so it is there whole
or not at all. Whoever reads the folder later, be it another attempt of the same task or
another session, finds what was appended, whatever became of the job.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyarrow import fs

#: Rows wait until they are so many bytes, or the oldest has waited so many seconds. Calls that take longer are kept one by one.
BYTES, SECONDS = 4 << 20, 1.0


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as Spark writes paths, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), str(Path(path).absolute())


class Appender:
    """Appends dictionaries to a folder; ``close`` (or leaving the ``with`` block, in whatever way) keeps the rest.

    Quick calls make files of some MB, not one for every few rows: files are listed, opened and
    deleted one by one. ``every`` bounds the rows that wait as well.
    """

    def __init__(self, path: str, every: int | None = None, seconds: float = SECONDS, clock=time.monotonic):
        self.fs, self.path = place(path)
        self.every, self.seconds, self.clock = every, seconds, clock
        self.lines: list[str] = []
        self.size, self.since = 0, 0.0

    def append(self, row: dict) -> None:
        if not self.lines:
            self.since = self.clock()
        self.lines.append(json.dumps(row) + "\n")
        self.size += len(self.lines[-1])  # JSON is escaped to ASCII

    def settle(self) -> None:
        """Keeps what waits if it is much or has waited long; called after every result."""
        much = self.size >= BYTES or (self.every is not None and len(self.lines) >= self.every)
        if self.lines and (much or self.clock() - self.since >= self.seconds):
            self.flush()

    def flush(self) -> None:
        if not self.lines:
            return
        self.fs.create_dir(self.path, recursive=True)
        name = f"{uuid.uuid4().hex}.json"
        aside = f"{self.path}/_{name}"
        with self.fs.open_output_stream(aside) as out:
            out.write("".join(self.lines).encode())
        self.fs.move(aside, f"{self.path}/{name}")
        self.lines, self.size = [], 0

    def __enter__(self) -> Appender:
        return self

    def __exit__(self, *_) -> None:
        self.flush()


def read(path: str) -> Iterator[dict]:
    """All rows appended to a folder so far."""
    where, base = place(path)
    for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.type == fs.FileType.File and f.base_name.endswith(".json") and not f.base_name.startswith("_"):
            with where.open_input_stream(f.path) as s:
                for line in s.read().decode().splitlines():
                    yield json.loads(line)

"""A folder of checkouts as a table: every file, folder, link and pipe, and every folder that can't be listed.

``scan`` is a data source of its own kind: the driver lists only as many folders as it takes to have ``parts`` of them in hand, the
rest of the tree is walked by tasks, one subtree each. Links aren't followed. A folder that can't be listed keeps its row, with
``err``, and the walk goes on beside it. The folder must be mounted on every executor; for object stores, which have
neither links nor pipes, ``corpus.read_folder`` reads files by Spark's own reader.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders in hand after which the driver stops listing, and rows of a batch.
PARTS, ROWS = 256, 4096

SCHEMA = "repo string, rel string, kind string, is_dir boolean, special boolean, size bigint, mtime timestamp, err string"
_ARROW = pa.schema([
    ("repo", pa.string()), ("rel", pa.string()), ("kind", pa.string()), ("is_dir", pa.bool_()), ("special", pa.bool_()), ("size", pa.int64()),
    ("mtime", pa.timestamp("us", tz="UTC")), ("err", pa.string()),
])


def _kind(mode: int) -> str:
    for name, test in (("dir", stat.S_ISDIR), ("file", stat.S_ISREG), ("link", stat.S_ISLNK), ("pipe", stat.S_ISFIFO), ("socket", stat.S_ISSOCK)):
        if test(mode):
            return name
    return "device"


def _entry(entry: os.DirEntry) -> tuple[str, int, datetime | None] | None:
    """Kind, size and time of an entry; null if it vanished after the listing. A folder that can't be asked has no time."""
    try:
        info = entry.stat(follow_symlinks=False)
    except FileNotFoundError:
        return None
    except OSError:
        return ("dir", 0, None) if entry.is_dir(follow_symlinks=False) else None
    kind = _kind(info.st_mode)
    return kind, info.st_size if kind == "file" else 0, datetime.fromtimestamp(info.st_mtime_ns // 1000 / 1e6, UTC)


def _listing(path: str) -> tuple[list[os.DirEntry], str | None]:
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name), None
    except OSError as error:
        return [], error.strerror or str(error)


class _Walk:
    """Rows of folders below a root; ``repo`` is the first element of a path, or the root's name."""

    def __init__(self, root: str, with_repo: bool):
        self.root, self.with_repo = root, with_repo

    def path(self, rel: str) -> str:
        return os.path.join(self.root, rel) if rel else self.root

    def row(self, rel: str, kind: str, size: int, mtime: datetime | None, err: str | None = None) -> dict | None:
        rel = os.fsencode(rel).decode("utf-8", "replace")  # names are bytes
        repo, _, inner = rel.partition("/") if self.with_repo else (os.path.basename(self.root), "", rel)
        if not inner:  # the repository's own folder; a loose file beside the repositories belongs to none
            if err is None or not self.with_repo:
                return None
            inner = "."
        return {
            "repo": repo, "rel": inner, "kind": kind, "is_dir": kind == "dir", "special": kind not in ("file", "dir"), "size": size,
            "mtime": mtime, "err": err,
        }

    def step(self, rel: str, mtime: datetime | None) -> tuple[list[dict], list[tuple[str, datetime]]]:
        """The row of a folder and those of its entries that aren't folders, and its folders."""
        entries, err = _listing(self.path(rel))
        if err is not None and not rel:
            raise OSError(f"{self.root}: {err}")
        rows, folders = [self.row(rel, "dir", 0, mtime, err)] if rel else [], []
        for entry in entries:
            about = _entry(entry)
            if about is None:
                continue
            below = f"{rel}/{entry.name}" if rel else entry.name
            if about[0] == "dir":
                folders.append((below, about[2]))
            else:
                rows.append(self.row(below, *about))
        return [r for r in rows if r is not None], folders


class _Part(InputPartition):
    def __init__(self, rows: list[dict], folder: tuple[str, datetime] | None):
        super().__init__(None)
        self.rows, self.folder = rows, folder


class _Reader(DataSourceReader):
    def __init__(self, walk: _Walk, parts: int):
        self.walk, self.parts = walk, parts

    def partitions(self) -> list[_Part]:
        """Folders are opened breadth first until there are enough; each open one becomes a task."""
        waiting: deque = deque([("", None)])
        out = []
        while waiting and len(waiting) < self.parts and len(out) < self.parts:
            rows, folders = self.walk.step(*waiting.popleft())
            waiting.extend(folders)
            if rows:
                out.append(_Part(rows, None))
        return out + [_Part([], folder) for folder in waiting] or [_Part([], None)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        held, waiting = list(partition.rows), [partition.folder] if partition.folder else []
        while waiting:
            rows, folders = self.walk.step(*waiting.pop())
            waiting.extend(reversed(folders))
            held += rows
            while len(held) >= ROWS:
                yield pa.RecordBatch.from_pylist(held[:ROWS], _ARROW)
                del held[:ROWS]
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class FolderSource(DataSource):
    """``spark.read.format("atlas_folder").load(root)``; options ``with_repo`` and ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "atlas_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        root = self.options["path"].removeprefix("file://").rstrip("/") or "/"
        with_repo = self.options.get("with_repo", "true").lower() == "true"
        return _Reader(_Walk(root, with_repo), int(self.options.get("parts", PARTS)))


def scan(spark: SparkSession, root: str, with_repo: bool = True, parts: int = PARTS) -> DataFrame:
    """(repo, rel, kind, is_dir, special, size, mtime, err) of everything below ``root``.

    With ``with_repo`` each folder right below ``root`` is a repository, whose own folder has no row unless it can't be listed (then
    ``.``); otherwise ``root`` is one. ``root`` itself must be readable.
    """
    spark.dataSource.register(FolderSource)
    return spark.read.format("atlas_folder").option("with_repo", str(with_repo).lower()).option("parts", parts).load(root)

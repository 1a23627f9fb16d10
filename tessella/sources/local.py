"""Directory trees as a Spark data source: one partition for each top directory, entries as ``lstat`` sees them."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, path string, name binary, t int, size bigint, mode bigint, uid bigint, gid bigint, mtime_ns bigint, ctime_ns bigint, dev bigint, ino bigint, nlink bigint, target binary, problem string"


class Directory(InputPartition):
    def __init__(self, path: str, alone: bool):
        self.path, self.alone = path, alone  # alone: its files, but not what lies in its directories


class LocalTree(DataSource):
    """Options: ``path``; ``oneFileSystem`` (true: what lies on another device is not entered); ``prune``: names of directories not to enter, by comma."""

    @classmethod
    def name(cls) -> str:
        return "tessella_local"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LocalReader:
        return LocalReader(self.options)


class LocalReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.one = str(options.get("onefilesystem", "false")).lower() == "true"
        self.prune = {p for p in options.get("prune", "").split(",") if p}

    def partitions(self) -> list[Directory]:
        if not os.path.isdir(self.root):
            return [Directory(self.root, True)]
        with os.scandir(self.root) as found:
            below = sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
        return [Directory(self.root, True)] + [Directory(p, False) for p in below if os.path.basename(p) not in self.prune]

    def _row(self, path: str):
        try:
            s = os.lstat(path)
            kind = 1 if stat.S_ISDIR(s.st_mode) else 2 if stat.S_ISLNK(s.st_mode) else 0
            target = os.fsencode(os.readlink(path)) if kind == 2 else None
            problem = None if kind or stat.S_ISREG(s.st_mode) else "not a regular file"
            return kind, s, (self.root, path, os.fsencode(os.path.basename(path)), kind, s.st_size if kind == 0 else None, s.st_mode, s.st_uid, s.st_gid, s.st_mtime_ns, s.st_ctime_ns, s.st_dev, s.st_ino, s.st_nlink, target, problem)
        except OSError as e:
            return 0, None, (self.root, path, os.fsencode(os.path.basename(path)), *[None] * 11, str(e))

    def read(self, partition: Directory) -> Iterator[tuple]:
        device = os.lstat(self.root).st_dev if self.one else None
        if partition.alone:
            if not os.path.isdir(self.root):
                yield self._row(self.root)[2]
                return
            with os.scandir(self.root) as found:
                for e in sorted(found, key=lambda e: os.fsencode(e.name)):
                    if not e.is_dir(follow_symlinks=False) or e.name in self.prune:
                        yield self._row(e.path)[2]
            return
        todo = [partition.path]
        while todo:
            path = todo.pop()
            kind, s, row = self._row(path)
            elsewhere = self.one and s is not None and s.st_dev != device
            if not (elsewhere and kind == 0):
                yield row
            if kind != 1 or elsewhere or os.path.basename(path) in self.prune and path != partition.path:
                continue
            try:
                with os.scandir(path) as found:
                    todo += sorted((e.path for e in found), key=os.fsencode, reverse=True)
            except OSError as e:
                yield (self.root, path, os.fsencode(os.path.basename(path)), *[None] * 11, str(e))


def register(spark) -> None:
    spark.dataSource.register(LocalTree)

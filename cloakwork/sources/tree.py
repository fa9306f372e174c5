"""A folder that all executors share as a table of its settings files: dotfiles too, which Spark's own file sources leave out."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SKIP = ".git node_modules vendor dist build .next .nuxt target __pycache__ .venv venv coverage .terraform".split()


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/") or "/"
        self.largest = int(options.get("largest", 4 << 20))

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and each folder below it with all that it holds."""
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in SKIP)
        return [Folder(self.root, False), *(Folder(p, True) for p in below)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for folder, dirs, names in os.walk(partition.path):
            dirs[:] = sorted(d for d in dirs if d not in SKIP) if partition.deep else []
            for name in sorted(names):
                path = os.path.join(folder, name)
                link = os.path.islink(path)
                size = 0 if link else os.path.getsize(path)
                content = None
                if not link and size <= self.largest:
                    with open(path, "rb") as file:
                        content = file.read().decode("utf-8", "replace")
                yield os.path.relpath(path, self.root), link, size, content


class Tree(DataSource):
    """spark.dataSource.register(Tree); spark.read.format("settings_tree").load(folder): (path, is_link, n_bytes, content).

    Links are listed and never read; files over the option `largest` have a null content."""

    @classmethod
    def name(cls) -> str:
        return "settings_tree"

    def schema(self) -> str:
        return "path string, is_link boolean, n_bytes long, content string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

"""Source files and commits as data sources: the driver lists names, executors read what they stand for.

The folder has to be where executors can see it, as every input of a cluster has to.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

#: Files and bytes of a partition, and commits of one.
FILES, BYTES, COMMITS = 512, 16 << 20, 100


class Found(NamedTuple):
    """A file's place in the order of reading, its name below the folder, its size."""

    place: int
    name: str
    size: int


class Part(InputPartition):
    def __init__(self, items: list):
        self.items = items


def listed(folder: str, suffixes: tuple[str, ...], without: frozenset[str], hidden: bool) -> list[Found]:
    """Files below a folder in the order of their paths, whatever their names start with; names of ``without`` are left out with all below
    them, and what starts with a dot unless ``hidden``."""
    root, out = Path(folder), []
    for at, folders, names in root.walk():
        folders[:] = [d for d in folders if d not in without and (hidden or not d.startswith("."))]
        for n in names:
            if n.endswith(suffixes) and n not in without and (hidden or not n.startswith(".")) and (p := at / n).is_file():
                out.append((p.relative_to(root), p.stat().st_size))
    return [Found(i, str(p), size) for i, (p, size) in enumerate(sorted(out))]


class Sources(DataSource):
    """place, name, size, content of the files below ``path``. Options: suffixes and without, joined by commas; hidden; parts, of which
    there are as many at least, if there are files for them."""

    @classmethod
    def name(cls) -> str:
        return "crossfile_sources"

    def schema(self) -> str:
        return "place long, name string, size long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SourcesReader(dict(self.options))


class SourcesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        words = lambda key: tuple(x for x in options.get(key, "").split(",") if x)
        self.folder, self.suffixes, self.without, self.hidden = options["path"], words("suffixes"), frozenset(words("without")), options.get("hidden") == "true"
        self.parts = int(options.get("parts", "1"))
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Those on names are met where names are listed: files that they leave out aren't opened."""
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("name",):
                self.kept.append(f)
            else:
                yield f

    def _meets(self, name: str) -> bool:
        tests = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value), StringEndsWith: lambda f: name.endswith(f.value)}
        return all(tests[type(f)](f) for f in self.kept)

    def partitions(self) -> list[Part]:
        parts, size = [[]], 0
        found = [f for f in listed(self.folder, self.suffixes, self.without, self.hidden) if self._meets(f.name)]
        most = max(1, min(FILES, len(found) // self.parts))
        for f in found:
            if parts[-1] and (len(parts[-1]) >= most or size + f.size > BYTES):
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += f.size
        return [Part(p) for p in parts]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        root = Path(self.folder)
        for f in partition.items:
            content = (root / f.name).read_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([f.place]), pa.array([f.name]), pa.array([len(content)]), pa.array([content], pa.binary())], ["place", "name", "size", "content"])


class Commits(DataSource):
    """pos, value: the last commits that touch ``path``, newest first; each a line of hash and subject, and the files it changed."""

    @classmethod
    def name(cls) -> str:
        return "crossfile_commits"

    def schema(self) -> str:
        return "pos int, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CommitsReader(self.options["path"], int(self.options.get("commits", "1000")))


class CommitsReader(DataSourceReader):
    def __init__(self, folder: str, commits: int):
        self.folder, self.commits = folder, commits

    def _git(self, *words: str) -> str:
        return subprocess.run(["git", *words], capture_output=True, text=True, cwd=self.folder, check=True).stdout

    def partitions(self) -> list[Part]:
        try:
            found = self._git("rev-list", f"-n{self.commits}", "HEAD", "--", ".").split()
        except (OSError, subprocess.CalledProcessError):
            found = []
        at = list(enumerate(found))
        return [Part(at[i : i + COMMITS]) for i in range(0, len(at), COMMITS)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.items:
            text = self._git("log", "--no-walk=unsorted", "--name-only", "--format=%x00%h %s", *(h for _, h in partition.items), "--", ".")
            yield from zip((pos for pos, _ in partition.items), text.split("\0")[1:], strict=True)


def sources(spark: SparkSession, folder: str | Path, suffixes: tuple[str, ...], without: tuple[str, ...] = (), hidden: bool = True) -> DataFrame:
    """place, name, size, content of the files below a folder."""
    spark.dataSource.register(Sources)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"suffixes": ",".join(suffixes), "without": ",".join(without), "hidden": str(hidden).lower(), "parts": str(4 * spark.sparkContext.defaultParallelism)}
    return spark.read.format("crossfile_sources").options(**options).load(str(folder))


def commits(spark: SparkSession, folder: str | Path, most: int) -> DataFrame:
    spark.dataSource.register(Commits)
    return spark.read.format("crossfile_commits").option("commits", str(most)).load(str(folder))

"""Trees of small files as a data source: many files in few, even partitions, and one file for each path.

Spark's readers and writers make a file for each task; a corpus of dialogues is a file for each patient. The format
file_tree reads such a tree and writes one, in any file system that pyarrow knows and all machines share.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "file_tree"
COLUMNS = "path string, rel_path string, length long, content binary"
#: The further column of a numbered read: a file's number from 1 in the order of paths.
NUMBER = "nth long"
#: Names in a tree that are no part of it.
STAGING, DONE, COLLISIONS = "_staging-", "_SUCCESS", "_collisions"
#: In a staging folder, the manifests of the tasks that ended.
MANIFESTS = "manifests"
#: Bytes that opening a file counts for in a partition, and that a batch of files holds, about.
OPEN_COST, BATCH_BYTES = 1 << 16, 8 << 20
#: Files that are moved at once, and how many a manifest names.
MOVERS, MOVES = 16, 10_000


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path within it. A local path may hold characters that no URI can."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if local.startswith("/"):
        return pafs.LocalFileSystem(), posixpath.normpath(local)
    return pafs.FileSystem.from_uri(path)


def packed(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs (first, end) of files in order whose sizes, opening included, add up to about most: even ones, as their number is that which the whole needs."""
    if not sizes:
        return []
    weights = [s + OPEN_COST for s in sizes]
    total = sum(weights)
    n = -(-total // most)
    runs, first, done = [], 0, 0
    for i, w in enumerate(weights):
        # a file belongs to the run that its middle falls in
        if i > first and (done + w / 2) * n >= total * (len(runs) + 1):
            runs.append((first, i))
            first = i
        done += w
    return [*runs, (first, len(sizes))]


@dataclass
class Run(InputPartition):
    """Files in order, and how many come before them."""

    files: list[tuple[str, str, int]]
    before: int = 0


class TreeReader(DataSourceReader):
    """Lists once, in the order of paths, and packs files by bytes: partitions, and rows within them, follow that order."""

    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"]) if "roots" in options else [options["path"]]
        self.pattern, self.prefix = options.get("glob", "*"), options.get("prefix", "")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 128 << 20)))
        self.numbered = options.get("numbered", "false").lower() == "true"

    def listed(self) -> list[tuple[str, str, int]]:
        """path, path within its root and size of all files that the filters let pass, in order; a missing root has none, a root that is a file itself alone."""
        found = set()
        for root in self.roots:
            system, top = located(root)
            itself = system.get_file_info(top)
            if itself.type == pafs.FileType.NotFound:
                continue
            for info in [itself] if itself.is_file else system.get_file_info(pafs.FileSelector(top, recursive=self.recursive)):
                if not info.is_file:
                    continue
                rel = itself.base_name if itself.is_file else info.path.removeprefix(top).lstrip("/")
                own = not rel.startswith((STAGING, f"{COLLISIONS}/")) and rel != DONE
                if own and rel.startswith(self.prefix) and fnmatchcase(info.base_name, self.pattern):
                    found.add((info.path if root.startswith(("/", "file:")) else f"{root.rstrip('/')}/{rel}", rel, info.size))
        return sorted(found)

    def partitions(self) -> list[Run]:
        files = self.listed()
        return [Run(files[a:b], a) for a, b in packed([size for _, _, size in files], self.most)] or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for nth, (path, rel, _) in enumerate(partition.files, partition.before + 1):
            system, at = located(path)
            with system.open_input_stream(at) as stream:
                content = stream.read()
            rows.append((path, rel, len(content), content, nth))
            held += len(content)
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "rel_path": pa.string(), "length": pa.int64(), "content": pa.binary()} | ({"nth": pa.int64()} if self.numbered else {})
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


@dataclass
class Staged(WriterCommitMessage):
    manifests: list[str]


def _named(path: str, manifest: str) -> list[tuple[str, str]]:
    """Where the files that a manifest names are, and their places."""
    system, root = located(path)
    folder, _, first = manifest.rpartition("/manifest-")
    with system.open_input_stream(manifest) as stream:
        return [(f"{folder}/{n}", f"{root}/{rel}") for n, rel in enumerate(json.loads(stream.read()), int(first))]


def look(path: str, manifest: str) -> None:
    """Raises an error if something is at a place of a manifest's files."""
    system, _ = located(path)
    for info in system.get_file_info([to for _, to in _named(path, manifest)]):
        if info.type != pafs.FileType.NotFound:
            raise FileExistsError(info.path)


def place(path: str, manifest: str) -> None:
    """Moves a manifest's files to their places. May be done again, as a task may."""
    system, _ = located(path)
    named = _named(path, manifest)

    def move(some: list[tuple[str, str]]) -> None:
        for at, to in some:
            try:
                system.move(at, to)
            except OSError:  # another attempt has moved it
                if [x.type == pafs.FileType.NotFound for x in system.get_file_info([at, to])] != [True, False]:
                    raise

    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(system.create_dir, {posixpath.dirname(to) for _, to in named}))
        list(pool.map(move, (named[i : i + 100] for i in range(0, len(named), 100))))


class TreeWriter(DataSourceArrowWriter):
    """Writes rel_path and content: each task to a staging folder of its own. Files of tasks that ended are then moved to their places: by the commit, or, where staging names the folder, by who named it.

    Nothing stands in its place before all tasks have ended. A task's manifests, beside its files, tell the places of
    MOVES files each.
    """

    def __init__(self, path: str, overwrite: bool, staging: str | None = None) -> None:
        self.path, self.overwrite = path, overwrite
        self.later, self.staging = staging is not None, staging or f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = located(self.path)
        folder = f"{root}/{self.staging}/{TaskContext.get().taskAttemptId()}"
        system.create_dir(folder)
        n, rels, manifests = 0, [], []

        def close() -> None:
            manifests.append(f"{folder}/manifest-{n - len(rels)}")
            with system.open_output_stream(manifests[-1]) as out:
                out.write(json.dumps(rels).encode())
            rels.clear()

        try:
            for batch in iterator:
                for rel, content in zip(batch.column("rel_path"), batch.column("content")):
                    with system.open_output_stream(f"{folder}/{n}") as out:
                        out.write(content.as_buffer())
                    rels.append(rel.as_py())
                    n += 1
                    if len(rels) == MOVES:
                        close()
            if rels:
                close()
        except BaseException:
            system.delete_dir(folder)
            raise
        return Staged(manifests)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = located(self.path)
        manifests = [x for m in messages if m is not None for x in m.manifests]
        system.create_dir(f"{root}/{self.staging}")  # where no task had a row
        if self.later:
            with system.open_output_stream(f"{root}/{self.staging}/{MANIFESTS}") as out:
                out.write(json.dumps(manifests).encode())
        else:
            settle(self.path, self.staging, self.overwrite, lambda act: [act(self.path, m) for m in manifests])

    def abort(self, messages: list[Staged | None]) -> None:
        discard(self.path, self.staging)


def discard(path: str, staging: str) -> None:
    system, root = located(path)
    if system.get_file_info(f"{root}/{staging}").type == pafs.FileType.Directory:
        system.delete_dir(f"{root}/{staging}")


def settle(path: str, staging: str, overwrite: bool, each: Callable[[Callable[[str, str], None]], object]) -> None:
    """Gives staged files their places: each does something with every manifest.

    All places are looked at before the first is taken.
    """
    system, root = located(path)
    if overwrite:
        for info in system.get_file_info(pafs.FileSelector(root)):
            if info.base_name != staging:
                system.delete_file(info.path) if info.is_file else system.delete_dir(info.path)
    else:
        each(look)
    each(place)
    system.delete_dir(f"{root}/{staging}")
    with system.open_output_stream(f"{root}/{DONE}"):
        pass


class FileTree(DataSource):
    """file_tree. Reading: path, or roots as a JSON list; glob (of names), prefix (of paths within a root), recursive, partitionBytes, numbered (true: a column nth). Writing: path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{COLUMNS}, {NUMBER}" if dict(self.options).get("numbered") == "true" else COLUMNS

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], overwrite, self.options.get("staging"))


def read(spark: SparkSession, roots: str | list[str], glob: str = "*", prefix: str = "", recursive: bool = True, partition_bytes: int = 128 << 20, numbered: bool = False) -> DataFrame:
    """path, rel_path, length and content of the files below some roots, in the order of their paths; numbered: nth, their numbers from 1 in it.

    A file that two roots hold comes once for each place it has within a root. Roots that are missing are skipped. The
    numbers come with the listing, so that nothing is read for them; rows that are filtered later are numbered by
    files.numbered.
    """
    spark.dataSource.register(FileTree)
    given = json.dumps([roots] if isinstance(roots, str) else roots)
    options = {"roots": given, "glob": glob, "prefix": prefix, "recursive": str(recursive).lower(), "partitionBytes": partition_bytes, "numbered": str(numbered).lower()}
    return spark.read.format(FORMAT).options(**options).load()


def write(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file for each row of rel_path and content (binary), at its path below the given one, its bytes as they are.

    Rows have to have paths of their own: see sinks.write_mirrored. A file that is there already is an error, and then
    nothing is moved; overwrite replaces the whole tree. Tasks write the files and, when all have ended, other tasks move them.
    """
    spark, staging = files.sparkSession, f"{STAGING}{uuid.uuid4().hex}"
    spark.dataSource.register(FileTree)
    files.select("rel_path", "content").write.format(FORMAT).mode("overwrite" if overwrite else "append").options(path=path, staging=staging).save()
    system, root = located(path)
    try:
        with system.open_input_stream(f"{root}/{staging}/{MANIFESTS}") as stream:
            manifests = json.loads(stream.read())  # one for MOVES files
        settle(path, staging, overwrite, lambda act: _by_tasks(spark, path, manifests, act))
    except BaseException:
        discard(path, staging)
        raise


def _by_tasks(spark: SparkSession, path: str, manifests: list[str], act: Callable[[str, str], None]) -> None:
    """Does something with every manifest, dealt to tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for manifest in batch.column(0).to_pylist():
                act(path, manifest)
            yield batch

    if manifests:
        spark.createDataFrame([(m,) for m in manifests], "manifest string").mapInArrow(of, "manifest string").write.format("noop").mode("overwrite").save()

"""Inventories that tasks list, folder by folder: paths never pass the driver, which sees one job per level of the tree.

Spark's own listing (``inventory.file_inventory``) ends with every file on the driver. Here the folders of a level are
dealt out to tasks, each lists its folders and writes what it found to the shared folder, and the folders among that are
the next level. A local folder is walked entry by entry; of other stores a task holds the entries of one folder.
Tasks reach the store through ``pyarrow``; paths that only Spark can open are left to ``file_inventory``.

Names that Spark takes for hidden (``_`` without ``=``, ``.``) are hidden here too. Files of no bytes are listed. An empty
root has no rows, a root that does not exist is an error, a folder that goes while it is listed counts as empty.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.session import durable
from feedops.sources.inventory import with_names

SCHEMA = "path string, size long, mtime timestamp, folder boolean"
#: Entries in a batch.
BATCH = 10_000

Opener = Callable[[str], tuple[fs.FileSystem, str]]


def hidden(name: str) -> bool:
    """Names that Spark's scans pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def local_path(uri: str) -> str | None:
    """The path of a local URI, None for another store."""
    found = re.match(r"(?s)(?:file:/*(?=/))?(/.*)", uri)
    return found.group(1) if found else None


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI and the path in it."""
    return fs.FileSystem.from_uri(quote(uri, safe=":/@?&=+,%"))


def entries(uri: str, opener: Opener = opened) -> Iterator[tuple[str, int, int, bool]]:
    """``path, size, mtime in microseconds, is it a folder`` of what stands in a folder; a file stands for itself."""
    base, own = uri.rstrip("/") or "/", local_path(uri)
    if own is not None:
        if os.path.isfile(own):
            stat = os.stat(own)
            yield base, stat.st_size, stat.st_mtime_ns // 1_000_000 * 1000, False
            return
        with os.scandir(own) as found:
            for entry in found:
                try:
                    stat, folder = entry.stat(), entry.is_dir()
                except FileNotFoundError:
                    continue
                yield f"{base.rstrip('/')}/{entry.name}", 0 if folder else stat.st_size, stat.st_mtime_ns // 1_000_000 * 1000, folder
        return
    store, path = opener(uri)
    here = store.get_file_info(path)
    listed = [here] if here.is_file else store.get_file_info(fs.FileSelector(path))
    for info in listed:
        mtime = (info.mtime_ns or 0) // 1_000_000 * 1000
        folder = info.type == fs.FileType.Directory
        yield base if here.is_file else f"{base}/{info.base_name}", 0 if folder else info.size, mtime, folder


def _lister(pattern: str | None, last: bool, first: bool, opener: Opener):
    """Task over folders: their entries, or those whose name fits."""
    fits = re.compile(pattern, re.DOTALL).fullmatch if pattern else None

    def wanted(folder: str) -> Iterator[tuple[str, int, int, bool]]:
        try:
            for entry in entries(folder, opener):
                name = entry[0].rpartition("/")[2]
                if not hidden(name) and (fits is None or fits(name)) and (pattern is None or entry[3] is not last):
                    yield entry
        except FileNotFoundError:
            if first:
                raise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = wanted(folder)
                while part := list(islice(found, BATCH)):
                    path, size, mtime, is_folder = zip(*part)
                    yield pa.record_batch(
                        [pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(mtime, pa.timestamp("us", "UTC")), pa.array(is_folder)],
                        names=["path", "size", "mtime", "folder"],
                    )

    return run


def _level(folders: DataFrame, pattern: str | None, last: bool, first: bool, opener: Opener) -> DataFrame:
    tasks = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of its own, as few bytes of folders may stand for many files
    return durable(folders.repartition(tasks, "path").mapInArrow(_lister(pattern, last, first, opener), SCHEMA))


def _uri(path: str) -> str:
    """A local path as an absolute ``file:`` URI, others as they are."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return re.sub("^file:/+", "file:/", path)
    return "file:" + os.path.abspath(path)


def list_files(
    spark: SparkSession, root: str | Sequence[str], suffixes: Sequence[str] = (".csv", ".csv.gz"), recursive: bool = True, opener: Opener = opened
) -> DataFrame:
    """``path, directory, name, size, mtime`` as ``inventory.file_inventory`` gives them, listed by tasks.

    ``opener`` gives a task the ``pyarrow`` store of a URI, where credentials or end points have to be named.
    """
    roots = [root] if isinstance(root, str) else list(root)
    folders, levels = spark.createDataFrame([(_uri(r),) for r in dict.fromkeys(roots)], "path string"), []
    while True:
        levels.append(_level(folders, None, False, not levels, opener))
        folders = levels[-1].filter("folder").select("path")
        if not recursive or folders.isEmpty():
            break
    files = reduce(DataFrame.unionByName, levels).filter("NOT folder")
    if suffixes:
        files = files.filter(reduce(lambda a, b: a | b, [F.col("path").endswith(s) for s in suffixes]))
    return with_names(files, roots[0] if len(roots) == 1 else "").select("path", "directory", "name", "size", "mtime")


def glob_pattern(glob: str) -> str:
    """Regex of one path level: ``*``, ``?``, ``[ab]``, ``[^ab]``, ``{x,y}``, and ``\\`` before a plain sign."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2)
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c in "*?":
            out.append("[^/]*" if c == "*" else "[^/]")
        elif c == "[" and close > 0:
            inside = glob[i + 1:close].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[^{inside[1:]}]" if inside[0] in "!^" else f"[{inside}]")
            i = close
        elif c == "{" and "}" in glob[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        else:
            out.append("|" if c == "," and depth else re.escape(c))
        i += 1
    return "".join(out)


def match_files(spark: SparkSession, patterns: Sequence[str], opener: Opener = opened) -> DataFrame:
    """``path, directory, name, size, mtime`` of the files that match any glob, each once; braces stay inside one level.

    Only folders that fit are entered: one job per level below the first that holds a sign of a glob. ``directory`` is the
    whole folder. A folder that matches adds no row, nor does a pattern that nothing matches.
    """
    levels = []
    for pattern in dict.fromkeys(map(_uri, patterns)):
        parts = pattern.split("/")
        plain = next((i for i, p in enumerate(parts) if re.search(r"[*?\[{\\]", p)), len(parts) - 1)
        found = spark.createDataFrame([("/".join(parts[:plain]) or "/",)], "path string")
        for i in range(plain, len(parts)):
            found = _level(found.select("path"), glob_pattern(parts[i]), i == len(parts) - 1, False, opener)
        levels.append(found)
    if not levels:
        levels.append(spark.createDataFrame([], SCHEMA))
    files = reduce(DataFrame.unionByName, levels).dropDuplicates(["path"])
    return with_names(files).select("path", "directory", "name", "size", "mtime")

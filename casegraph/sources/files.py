"""A repository as rows: files, lines, look-ups in them."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.text import WHITE, extension, let, posix, splitlines, strip
from casegraph.scratch import materialize

# Languages by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".java": "java", ".rb": "ruby", ".php": "php",
}
# Folder names.
VENDOR_PARTS = ("node_modules", "vendor", "site-packages", ".venv", "venv")
IGNORED_PARTS = (".git", ".audit", ".superpowers", ".pytest_cache", "__pycache__")
UNSEARCHED_PARTS = (".git", ".audit", ".superpowers", "node_modules", ".venv")


def language_of(path: Column) -> Column:
    """The language by the path's extension; null if it isn't known."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return table[extension(path)]


def is_vendor(path: Column) -> Column:
    return F.arrays_overlap(F.split(posix(path), "/"), F.array(*[F.lit(p) for p in VENDOR_PARTS]))


def inside_root(path: str, root: str) -> str:
    """The resolved path; ValueError if it leaves ``root``."""
    base, target = Path(root).resolve(), Path(root, path).resolve()
    if not target.is_relative_to(base):
        raise ValueError(f"{path} is outside {root}")
    return str(target)


#: Folders that a task lists before it hands those that are left to the next round.
FOLDERS_A_TASK = 500


def file_system(path: str):
    """Arrow's file system for a path or URI, and the place in it."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def _list_folders(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(path, length, left, task): the files in the folders given and below them.

    Breadth first, so that folders near the root are at hand when ``most`` folders have been listed: those that are still
    to be listed then are returned with ``left``. Folders that are never read are not entered.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()

    def rows(paths: list[str], sizes: list[int], left: bool) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(paths), 10_000):
            some = paths[k : k + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array(sizes[k : k + 10_000], pa.int64()), pa.array([left] * len(some)), pa.array([task] * len(some), pa.int32())],
                names=["path", "length", "left", "task"],
            )

    waiting: deque[str] = deque()
    listed = 0
    for batch in batches:
        waiting.extend(batch.column("path").to_pylist())
    while waiting and listed < most:
        folder = waiting.popleft()
        listed += 1
        system, place = file_system(folder)
        head = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
        found = [i for i in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if i.type != fs.FileType.NotFound]
        waiting.extend(head + i.path for i in found if i.type == fs.FileType.Directory and i.base_name not in IGNORED_PARTS)
        files = [i for i in found if i.type != fs.FileType.Directory]
        yield from rows([head + i.path for i in files], [int(i.size or 0) for i in files], False)
    yield from rows(list(waiting), [0] * len(waiting), True)


def listing_rounds(spark: SparkSession, root: str, most: int = FOLDERS_A_TASK) -> list[DataFrame]:
    """(path, length, left, task) of each round of listing; files are the rows without ``left``.

    Folders are dealt to tasks, each of which lists ``most`` of its folders and what it meets below; what is left is
    dealt anew, to all tasks. Wherever a repository's files are, in many folders or below one, all tasks share them
    after the first round. A table's round is written, so a lost executor costs its own folders again.
    """
    tasks = spark.sparkContext.defaultParallelism
    folders, rounds = spark.createDataFrame([(root,)], "path string"), []
    while True:
        listed = folders.mapInArrow(lambda b: _list_folders(b, most), "path string, length long, left boolean, task int")
        rounds.append(materialize(listed, "listing"))
        left = rounds[-1].filter("left")
        if left.isEmpty():
            return rounds
        folders = left.select("path").repartition(tasks, "path")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, path, length) of every file below ``root``, hidden ones included; the driver holds none of them.

    Spark's file source leaves out names that start with ``.`` or ``_``, so tasks list folders with Arrow's file systems.
    """
    top = root if re.match("^[a-z0-9+]+:/", root) else str(Path(root).resolve())
    base = top.rstrip("/") + "/"
    whole = reduce(DataFrame.unionByName, listing_rounds(spark, top)).filter("not left")
    return whole.select(F.substring("path", len(base) + 1, 1 << 30).alias("rel_path"), "path", "length")


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content) for files that the size and folder rules keep.

    Names and sizes are filtered before a byte is read; the files are dealt evenly to tasks, which open them one by one.
    """
    kept = listing(spark, root).filter(
        ~F.arrays_overlap(F.split("rel_path", "/"), F.array(*[F.lit(p) for p in IGNORED_PARTS]))
        & (F.col("length") <= S.MAX_FILE_BYTES)
    )
    dealt = materialize(kept.select("rel_path", "path"), "listing").repartition("rel_path")
    return dealt.mapInArrow(_open_files, "rel_path string, content binary")


def _open_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, path in zip(batch.column("rel_path").to_pylist(), batch.column("path").to_pylist(), strict=True):
            system, place = file_system(path)
            with system.open_input_stream(place) as stream:
                content = stream.read()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["rel_path", "content"])


def describe_files(contents: DataFrame) -> DataFrame:
    """Rows (rel_path, content binary) as file records; binaries, huge and minified files are dropped.

    Columns: rel_path, language, is_vendor, file_hash, loc, text.
    """
    sized = contents.filter(F.length("content") <= S.MAX_FILE_BYTES)
    head = F.decode(F.substring("content", 1, S.BINARY_SNIFF_BYTES), "ISO-8859-1")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = sized.filter(~F.contains(head, F.lit("\x00"))).withColumn("text", text)
    rows = rows.withColumn("loc", F.size(splitlines(F.col("text"))).cast("long"))
    rows = rows.filter((F.col("loc") == 0) | (F.length("text") / F.col("loc") <= S.MAX_MEAN_LINE))
    return rows.select(
        posix(F.col("rel_path")).alias("rel_path"),
        language_of(F.col("rel_path")).alias("language"),
        is_vendor(F.col("rel_path")).alias("is_vendor"),
        F.sha2("content", 256).alias("file_hash"),
        "loc",
        "text",
    )


def scan_repository(spark: SparkSession, root: str) -> DataFrame:
    return describe_files(read_contents(spark, root))


def lines_of(files: DataFrame, id_col: str = "rel_path", text_col: str = "text") -> DataFrame:
    """(id, line, text): every line with its number from 1."""
    return files.select(F.col(id_col), F.posexplode(splitlines(F.col(text_col))).alias("line", "text")).withColumn(
        "line", (F.col("line") + 1).cast("long")
    )


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1, both included), joined; a start below 1 counts as 1, none gives ''."""

    def body(lines: Column) -> Column:
        start = F.greatest(first, F.lit(1))
        n = F.greatest(F.least(last, F.size(lines)) - start + 1, F.lit(0))
        return F.array_join(F.slice(lines, start, n), "\n")

    return F.coalesce(let(splitlines(text), body), F.lit(""))


def hydrate_snippet(snippet: Column, text: Column, line: Column, context: int = 0) -> Column:
    """A tool's snippet, or the file's line(s) where the tool withheld it.

    An empty snippet or "requires login" is replaced; without the file or the line it stays.
    """
    withheld = strip(F.coalesce(snippet, F.lit("")))

    def body(lines: Column) -> Column:
        start = F.greatest(line - context, F.lit(1))
        n = F.least(line + context, F.size(lines)) - start + 1
        inside = (line >= 1) & (line <= F.size(lines))
        return F.when(inside, strip(F.array_join(F.slice(lines, start, F.greatest(n, F.lit(0))), "\n")))

    found = F.when(text.isNotNull(), let(splitlines(text), body))
    usable = (withheld != "") & (F.lower(withheld) != "requires login")
    return F.when(usable, snippet).otherwise(F.coalesce(found, snippet))


def grep(lines: DataFrame, pattern: str, file_col: str = "rel_path", limit: int = S.MAX_GREP_ROWS) -> DataFrame:
    """The first ``limit`` matching lines by file and number (file, line, stripped text)."""
    hits = lines.filter(F.col("text").rlike(pattern))
    hits = hits.filter(
        ~F.arrays_overlap(F.split(F.col(file_col).cast("string"), "/"), F.array(*[F.lit(p) for p in UNSEARCHED_PARTS]))
    )
    return hits.orderBy(file_col, "line").limit(limit).select(
        F.col(file_col).alias("file"), "line", strip(F.col("text")).alias("text")
    )


def stripped_code_lines(lines: DataFrame) -> DataFrame:
    """Lines trimmed, without blank ones and comments."""
    bare = F.regexp_replace("text", f"^{WHITE}|{WHITE}$", "")
    rows = lines.withColumn("text", bare)
    comment = F.startswith("text", F.lit("//")) | F.startswith("text", F.lit("#")) | F.startswith("text", F.lit("*"))
    return rows.filter((F.col("text") != "") & ~comment & ~F.startswith("text", F.lit("/*")))

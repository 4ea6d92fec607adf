"""Maildir folders of a file: store, listed, read and written by tasks.

A message is a file, so what a file costs is what a Maildir costs. Spark's file index keeps and looks up each file on the driver, one by one, and Hadoop's calls take some ten
times as long as the system's own. So names are a table here, which tasks list, and whose files tasks open.
"""

from __future__ import annotations

import itertools
import os
import re
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from urllib import parse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .tables import saved, scratch

FOLDERS = ("cur", "new")
#: What opening a file counts when files are dealt out to tasks, and how much a task gets, in bytes.
FILE_COST, TASK_BYTES = 16_384, 134_217_728
#: Names in a batch of a list, and batches of it in a task; messages and bytes in a batch that goes from Python to Spark.
LIST_ROWS, LIST_BATCHES, BATCH_ROWS, BATCH_BYTES = 10_000, 10, 1_000, 8_388_608
#: The longest file that a row can hold.
MOST_BYTES = 2_000_000_000
#: A folder's time is too coarse to tell what came within so many nanoseconds of it.
_COARSE_NS = 2_000_000_000
#: A message, and when it was modified in microseconds since 1970, which only streams that forget names ask for.
_LISTED = pa.schema([("file_path", pa.string()), ("folder_rank", pa.int32()), ("name", pa.binary()), ("modified", pa.int64())])
NAMES = "file_path string, folder_rank int, name binary, modified long"
_PLAIN = re.compile(rb"[A-Za-z0-9_.!~'()*,;:$&+=@/-]*")

Batches = Iterator[pa.RecordBatch]


def on_file_store(spark: SparkSession, path: str) -> bool:
    """Whether a path is a file: URL, or an absolute path without a scheme where that is the default store."""
    if path.startswith("/"):
        return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
    return path.startswith("file:")


def local_root(spark: SparkSession, path: str) -> str | None:
    """The folder that a path on a file: store names; None for other stores, and for patterns and names that need more than that, which Spark reads."""
    return parse.urlsplit(path).path if on_file_store(spark, path) and not re.search(r"[][*?{}%#\\]", path) else None


def _url(path: bytes) -> str:
    """A file's path as Spark gives it in _metadata."""
    if _PLAIN.fullmatch(path):
        return f"file:{path.decode()}"
    kept = lambda c: _PLAIN.fullmatch(c.encode("utf-8", "surrogateescape")) or (c.isprintable() and ord(c) > 127)
    return "file:" + "".join(c if kept(c) else parse.quote_from_bytes(os.fsencode(c)) for c in os.fsdecode(path))


def _is_message(entry: os.DirEntry[bytes]) -> bool:
    """Files and links to them; names that start with a dot or _ are hidden, as Spark has it."""
    return not entry.name.startswith((b".", b"_")) and (entry.is_file() or (entry.is_symlink() and not entry.is_dir()))


def _stat(path: bytes) -> os.stat_result | None:
    try:
        return os.stat(path)
    except FileNotFoundError:  # it has gone, or is a link to nowhere
        return None


def _listed(root: str, rank: int, times: bool = False) -> Batches:
    """The messages of a folder in batches of ``NAMES``, without an order; a folder that is missing has none."""
    folder = os.fsencode(f"{root}/{FOLDERS[rank]}/")
    try:
        entries = os.scandir(folder)
    except FileNotFoundError:
        return
    with entries:
        names = (e.name for e in entries if _is_message(e))
        while some := list(itertools.islice(names, LIST_ROWS)):
            modified = [(s := _stat(folder + n)) and s.st_mtime_ns // 1000 for n in some] if times else [None] * len(some)
            columns = [_url(folder + n) for n in some], [rank] * len(some), some, modified
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTED, strict=True)], schema=_LISTED)


def list_names(spark: SparkSession, root: str) -> DataFrame:
    """The messages of cur and new as a stored table of ``NAMES``; each folder is listed by one task, which hands names on as it finds them."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rank in batch.column(0).to_pylist():
                yield from _listed(root, rank)

    return saved(spark.range(0, len(FOLDERS), 1, len(FOLDERS)).mapInArrow(run, NAMES), "maildir-names")


def dealt_out(names: DataFrame, root: str) -> DataFrame:
    """``names`` over as many tasks as their files ask for; all of them are looked up, by tasks."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [_stat(path) for path in _paths(batch, root)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(FILE_COST + (s.st_size if s else 0) for s in found)], pa.int64())], ["cost"])

    cores = names.sparkSession.sparkContext.defaultParallelism
    total = names.select("folder_rank", "name").repartition(cores).mapInArrow(run, "cost long").agg(F.sum("cost")).first()[0] or 0
    size = min(TASK_BYTES, max(FILE_COST, total // cores))
    return names.repartition(max(1, -(-total // size)))


def _paths(batch: pa.RecordBatch, root: str) -> list[bytes]:
    folders = [os.fsencode(f"{root}/{f}/") for f in FOLDERS]
    return [folders[rank] + name for rank, name in zip(batch.column("folder_rank").to_pylist(), batch.column("name").to_pylist(), strict=True)]


def read_files(names: DataFrame, root: str, *keep: str) -> DataFrame:
    """raw, file_path, folder_rank, error and ``keep`` of the messages in a table or stream of ``NAMES``. Each file is opened once, and one that cannot be read is a row with an error.

    A message that has moved since it was listed is looked up by its name without flags.
    """
    kept = ["file_path", "folder_rank", *keep]
    kinds = names.select(*kept).schema
    rows = names.select(*kept, "name").mapInArrow(_read(root, kept), "raw binary, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds))
    error = F.when(F.col("raw").isNull(), F.concat(F.lit("failed to read file: "), "file_path"))
    return rows.select(F.coalesce(F.col("raw").cast("string"), F.lit("")).alias("raw"), "file_path", "folder_rank", error.alias("error"), *keep)


def _read(root: str, kept: list[str]) -> Callable[[Batches], Batches]:
    def rows(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), *batch.select(kept).columns], names=["raw", *kept])

    def read(batches: Batches) -> Batches:
        for batch in batches:
            lost, here, texts, size = [], [], [], 0
            for i, path in enumerate(_paths(batch, root)):
                try:
                    texts.append(_content(path))
                except FileNotFoundError:
                    lost.append(i)
                    continue
                here.append(i)
                size += len(texts[-1] or b"")
                if size >= BATCH_BYTES or len(texts) == BATCH_ROWS:
                    yield rows(batch.take(pa.array(here, pa.int32())), texts)
                    here, texts, size = [], [], 0
            if here:
                yield rows(batch.take(pa.array(here, pa.int32())), texts)
            if lost:
                names = {i: _base(batch.column("name")[i].as_py()) for i in lost}
                moved = _moved(root, set(names.values()))
                for i, name in names.items():
                    try:
                        text = _content(moved[name]) if name in moved else None
                    except FileNotFoundError:
                        text = None
                    yield rows(batch.slice(i, 1), [text])

    return read


def _content(path: bytes) -> bytes | None:
    """A file's bytes; None where it cannot be read."""
    try:
        with open(path, "rb", buffering=0) as file:
            return file.readall() if os.fstat(file.fileno()).st_size <= MOST_BYTES else None
    except FileNotFoundError:
        raise
    except OSError:
        return None


def _base(name: bytes) -> bytes:
    return name.split(b":2,", 1)[0]


def _moved(root: str, names: set[bytes]) -> dict[bytes, bytes]:
    """Where messages are now, by their names without flags."""
    found = {}
    for folder in (os.fsencode(f"{root}/{f}") for f in FOLDERS):
        if os.path.isdir(folder):
            with os.scandir(folder) as entries:
                found |= {name: e.path for e in entries if (name := _base(e.name)) in names}
    return found


# Streams


class MaildirNames(DataSource):
    """The names in a Maildir as a stream of ``NAMES``. Each batch has the names that were not there before it. All names are stored as a list first, so a batch that is handled again has
    the same names; where the list before is lost, it has those of earlier batches too. Options: root (a folder), lists (a folder for the lists, shared with the executors) and times (whether
    modified is told)."""

    @classmethod
    def name(cls) -> str:
        return "maildir_names"

    def schema(self) -> str:
        return NAMES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _NamesReader(self.options["root"], self.options["lists"], self.options["times"] == "true")


class _Piece(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _NamesReader(DataSourceStreamReader):
    """An offset is the path of a list; none is made while the folders stay as they are."""

    def __init__(self, root: str, lists: str, times: bool):
        self.root, self.lists, self.times = root, lists, times
        self.offset, self.state = None, None

    def initialOffset(self) -> dict:
        return {"list": ""}

    def latestOffset(self) -> dict:
        state, now = self._state(), time.time_ns()
        if self.offset is None or state != self.state:
            self.offset = {"list": self._stored()}
            self.state = state if all(now - s[1] > _COARSE_NS for s in state if s) else None
        return self.offset

    def _state(self) -> list[tuple[int, int] | None]:
        found = []
        for folder in FOLDERS:
            try:
                at = os.stat(f"{self.root}/{folder}")
                found.append((at.st_ino, at.st_mtime_ns))
            except FileNotFoundError:
                found.append(None)
        return found

    def _stored(self) -> str:
        os.makedirs(self.lists, exist_ok=True)
        path, n = f"{self.lists}/{uuid.uuid4().hex}.arrow", 0
        with pa.OSFile(path, "wb") as file, pa.ipc.new_file(file, _LISTED) as writer:
            for rank in range(len(FOLDERS)):
                for batch in _listed(self.root, rank, self.times):
                    writer.write_batch(batch)
                    n += 1
        return path if n else ""

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        if not end["list"]:
            return []
        path, n, before = f"{end['list']}.new", 0, self._before(start)
        with pa.memory_map(end["list"]) as listed, pa.OSFile(path, "wb") as file, pa.ipc.new_file(file, _LISTED) as writer:
            names = pa.ipc.open_file(listed)
            for i in range(names.num_record_batches):
                batch = names.get_batch(i)
                if before is not None:
                    batch = batch.filter(pc.invert(pc.is_in(batch.column("name"), value_set=before)))
                if batch.num_rows:
                    writer.write_batch(batch)
                    n += 1
        return [_Piece(path, i, min(i + LIST_BATCHES, n)) for i in range(0, n, LIST_BATCHES)]

    def _before(self, start: dict) -> pa.ChunkedArray | None:
        if not start["list"] or not os.path.exists(start["list"]):
            return None
        with pa.memory_map(start["list"]) as file:
            return pa.ipc.open_file(file).read_all().column("name")

    def read(self, partition: _Piece) -> Batches:
        with pa.OSFile(partition.path) as file:
            names = pa.ipc.open_file(file)
            for i in range(partition.first, partition.end):
                yield names.get_batch(i)

    def commit(self, end: dict) -> None:
        """The list of the last batch stays, to tell what is new."""
        if end["list"] and os.path.dirname(end["list"]) == self.lists:
            last, now = os.path.basename(end["list"]), self.offset and os.path.basename(self.offset["list"])
            for name in os.listdir(self.lists):
                if name not in (last, now) and not (now and name.startswith(now)):
                    os.remove(f"{self.lists}/{name}")


def stream_names(spark: SparkSession, root: str, times: bool) -> DataFrame | None:
    """The stream of ``MaildirNames``; None where the shared folder is no file: store, as lists could not be kept there."""
    lists = local_root(spark, scratch(spark, "maildir-lists"))
    if lists is None:
        return None
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that plans a stream is not given the files that the session has added
    spark.dataSource.register(MaildirNames)
    return spark.readStream.format("maildir_names").option("root", root).option("lists", lists).option("times", times).load()


# Delivery


def deliver(rows: DataFrame, root: str, folders: list[str]) -> None:
    """Messages (raw, and the place of their folder in ``folders``), each with a newline at its end, to one or more folders at once.

    Tasks write to a folder in tmp for each. When all are done, what failed attempts have left is removed there, and it becomes the folder, in one move; where that is there already, tasks move
    the files into it. A system adds files to a folder one after the other, whoever asks, so each file is added to one folder once.
    """
    write = f"{root}/tmp/{uuid.uuid4().hex}"
    for i in range(len(folders)):
        os.makedirs(f"{write}.{i}", exist_ok=True)
    done = rows.mapInArrow(_put(write, len(folders)), "folder int, attempt string, n long").collect()  # a row for each task and folder
    for i, folder in enumerate(folders):
        _handed_over(rows.sparkSession, [r for r in done if r.folder == i], f"{write}.{i}", f"{root}/{folder}")


def _put(write: str, folders: int) -> Callable[[Batches], Batches]:
    def put(batches: Batches) -> Batches:
        task, n = TaskContext.get(), [0] * folders
        attempt = f"{os.path.basename(write)}.{task.partitionId()}.{task.taskAttemptId()}"
        for batch in batches:
            for text, i in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                with open(f"{write}.{i}/{attempt}.{n[i]}", "wb") as file:
                    file.write(text.as_buffer() if text.is_valid else b"")
                    file.write(b"\n")
                n[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(folders), pa.int32()), pa.array([attempt] * folders, pa.string()), pa.array(n, pa.int64())], ["folder", "attempt", "n"])

    return put


def _handed_over(spark: SparkSession, done: list[Row], held: str, target: str) -> None:
    """What the attempts in ``done`` have written becomes ``target``, or goes into it."""
    whole = f"{held}.all"
    os.rename(held, whole)  # from here on attempts that still run can write no file
    good = {r.attempt for r in done}
    with os.scandir(whole) as entries:
        for entry in entries:
            if entry.name.rpartition(".")[0] not in good:
                os.remove(entry.path)
    if not os.path.lexists(target):
        try:
            return os.rename(whole, target)
        except OSError:  # another delivery may have made it
            if not os.path.lexists(target):
                raise
    if some := [(r.attempt, r.n) for r in done if r.n]:
        spark.createDataFrame(some, "attempt string, n long").repartition(len(some)).mapInArrow(_move(whole, target), "n long").agg(F.sum("n")).collect()
    os.rmdir(whole)


def _move(whole: str, target: str) -> Callable[[Batches], Batches]:
    def move(batches: Batches) -> Batches:
        for batch in batches:
            for attempt, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(n):
                    try:
                        os.rename(f"{whole}/{attempt}.{i}", f"{target}/{attempt}.{i}")
                    except FileNotFoundError:
                        os.stat(f"{target}/{attempt}.{i}")  # an earlier attempt has moved it
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return move

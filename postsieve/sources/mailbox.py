"""mbox files and Maildir folders as tables of raw messages."""

from __future__ import annotations

from urllib import parse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import first_messages, number_messages
from . import maildir
from .tables import saved

#: The largest limit whose file names the driver holds; beyond, names are numbered as a table.
MOST_LISTED = 10_000
#: How many times as many files are looked at when those so far hold too few messages for a limit.
FILE_GROWTH = 4
_BOUNDARY = "\nFrom "
#: Names of messages in a Maildir have colons. Of local files, checksum files would get names that Hadoop can't read then; so they are read without.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: What Spark gives of a whole file. Its text source would make a new Hadoop configuration for each one.
_FILE = "path string, modificationTime timestamp, length long, content binary"
#: What opening a file counts when files are packed into tasks, in bytes: Spark's 4 MB would give each task of a Maildir some 30 messages only.
OPEN_COST = 65_536
#: Most tasks that look up the files of a stream's batch, of which Spark is told one by one.
LISTING_TASKS = 256
#: Tasks that put files into their folder themselves; else the driver alone moves them, one after the other.
_MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _after_envelope(value: Column) -> Column:
    """A record without what is left of its envelope line, with which every record starts."""
    return F.when(F.contains(value, F.lit("\n")), F.substr(value, F.instr(value, "\n") + 1)).otherwise(F.lit(""))


def _first_files(spark: SparkSession, path: str, limit: int) -> list[str] | str:
    """The first files by name that together hold ``limit`` messages. Ever more files are looked at, each time no further than the limit; if that
    takes too many, or all files hold fewer, it is the path again."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_path")).orderBy("file_path")
    some = 1
    while some <= MOST_LISTED:
        files = [r.file_path for r in names.limit(some).collect()]
        if len(files) < some:
            break
        if spark.read.option("lineSep", _BOUNDARY).text(files).where(_after_envelope(F.col("value")) != "").limit(limit).count() >= limit:
            return files
        some *= FILE_GROWTH
    return path


def read_mbox(spark: SparkSession, path: str, limit: int | None = None, unquote: bool = False, numbered: bool = False, stream: bool = False) -> DataFrame:
    """Raw messages (raw, file_path, block_start, row_id) of mbox files, split at lines that start with ``From ``.

    Files are read in splits, so a large mbox is many tasks. The envelope line goes; a boundary right after a boundary makes no message. ``unquote`` turns ``>From`` at the
    start of a line back. The separator takes a message's last newline, which all but the last message of a file get back; a stream
    cannot tell the last one and gives one to each message without. ``numbered`` adds message_num over all files; ``limit`` (0 or None: all) keeps the first ones and
    numbers them, and only the first files that hold so many are read.
    """
    reader = (spark.readStream if stream else spark.read).option("lineSep", _BOUNDARY)
    columns = [F.col("value"), F.col("_metadata.file_path").alias("file_path")]
    if not stream:
        columns += [F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_id")]
    records = reader.text(_first_files(spark, path, limit) if limit and not stream else path).select(*columns)
    if stream:
        ended = F.when(F.col("value").endswith("\n"), F.col("value")).otherwise(F.concat("value", F.lit("\n")))
    else:
        last = records.groupBy("file_path").agg(F.max(F.struct("block_start", "row_id")).alias("_last"))
        records = records.join(last, "file_path")  # a row for each file
        at_end = (F.col("_last.block_start") == F.col("block_start")) & (F.col("_last.row_id") == F.col("row_id"))
        ended = F.when(at_end, F.col("value")).otherwise(F.concat("value", F.lit("\n")))
    records = records.withColumn("value", ended)
    rest = _after_envelope(F.col("value"))
    raw = F.regexp_replace(rest, r"(?m)^>(>*From )", "$1") if unquote else rest
    rows = records.withColumn("raw", raw).where("raw <> ''").drop("value", "_last")
    if limit or numbered:
        rows = number_messages(rows, [F.col("file_path"), F.col("block_start")])
    return first_messages(rows, limit)


def base_name(file_path: Column) -> Column:
    """The name of a message in a Maildir: its file's name without the flags, which follow ``:2,``."""
    return F.regexp_extract(F.substring_index(file_path, "/", -1), r"(?s)^(.*?)(?:(?::|%3A)2,.*)?$", 1)


def write_maildir(raw: DataFrame, path: str, folder: str | Column = "new") -> None:
    """The column ``raw`` as messages in a folder of a Maildir: one file each, which ends with a newline. A column says of each message whether it goes to cur or to new; both are written at once.

    On a file: store tasks deliver as mail servers do: they write to tmp, and what tasks that succeeded have written is moved to the folder, so attempts that fail leave nothing there. Other stores
    are written by Spark, to a folder that is not there yet. (Spark's files would take a chmod process each where Hadoop's native library is missing.)
    """
    text, folders = F.col("raw").cast("string"), [folder] if isinstance(folder, str) else list(maildir.FOLDERS)
    place = F.lit(0) if isinstance(folder, str) else F.when(folder == "cur", 0).when(folder == "new", 1).otherwise(F.raise_error(F.lit("a message goes to cur or to new")))
    rows = raw.select(text.alias("raw"), place.cast("int").alias("place"))
    if maildir.on_file_store(raw.sparkSession, path):
        return maildir.deliver(rows, path if path.startswith("/") else parse.unquote(parse.urlsplit(path).path), folders)
    for i, name in enumerate(folders):
        rows.where(F.col("place") == i).select("raw").write.options(**_MOVED_BY_TASKS).option("maxRecordsPerFile", 1).text(f"{path}/{name}")


def _many_files(spark: SparkSession) -> None:
    """Have many small files read by fewer tasks, unless the session asks for less. The settings stay for the session, as files are dealt out when a query runs."""
    for name, most in (("files.openCostInBytes", OPEN_COST), ("sources.parallelPartitionDiscovery.parallelism", LISTING_TASKS)):
        value = str(spark.conf.get(f"spark.sql.{name}")).removesuffix("b")
        if not value.isdigit() or int(value) > most:
            spark.conf.set(f"spark.sql.{name}", str(most))


def read_maildir(spark: SparkSession, path: str, limit: int | None = None, numbered: bool = False, stream: bool = False, forget_after: str | None = None) -> DataFrame:
    """Raw messages (raw, file_path, folder_rank, error) of a Maildir: files of cur before those of new, by name; subfolders and tmp are not read.

    A file that cannot be read is a row with an error, and the scan goes on. A missing folder counts as empty. Each file is opened once. On a
    file: store tasks list the folders and open the files (``maildir``); elsewhere, and where the path has a pattern, Spark does. Many files are then
    given to a task, for which spark.sql.files.openCostInBytes is lowered for the session. Numbers are dealt to the names alone: ranges of them, as a table, are counted and numbered within, so no task sees
    all names. With a ``limit`` only the files of the first names are read.

    A stream gives each message once: moving a file from new to cur, or changing its flags, keeps its name up to ``:2,``, and the names that were read
    are the stream's state. A file that moves under its whole name is not opened again. ``forget_after`` (such as "30 days") bounds it: a name is forgotten so long after the newest modification time that was seen.
    """
    rank = F.when(F.regexp_extract("file_path", r"/(cur|new)/[^/]*$", 1) == "cur", 0).otherwise(1)
    _many_files(spark)
    root = maildir.local_root(spark, path)
    if root and stream and (names := maildir.stream_names(spark, root, bool(forget_after))) is not None:
        names = _once(names.withColumn("modified_", F.timestamp_micros("modified")), F.substring_index(F.col("name").cast("string"), ":2,", 1), forget_after)
        return maildir.read_files(names, root).select("raw", "file_path", "folder_rank", "error")
    if root and not stream:
        return _listed_maildir(spark, root, limit, numbered)
    both = f"{path}/{{cur,new}}"  # either may be missing
    try:
        if stream:
            rows = spark.readStream.options(**_PLAIN_FILES).option("fileNameOnly", True).format("binaryFile").schema(_FILE).load(both)
            rows = rows.select(F.col("content").cast("string").alias("raw"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified_"))
            return _once(rows, base_name(F.col("file_path")), forget_after).withColumn("folder_rank", rank).withColumn("error", F.lit(None).cast("string"))
        if limit or numbered:
            return _numbered_maildir(spark, both, rank, limit)
        return _read_files(spark, both, rank)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "raw string, file_path string, folder_rank int, error string" + (", message_num long" if limit or numbered else ""))


def _once(rows: DataFrame, name: Column, forget_after: str | None) -> DataFrame:
    """A stream's messages, each name once; ``modified_`` goes."""
    rows = rows.withColumn("name_", name)
    rows = rows.withWatermark("modified_", forget_after).dropDuplicatesWithinWatermark(["name_"]) if forget_after else rows.dropDuplicates(["name_"])
    return rows.drop("name_", "modified_")


def _listed_maildir(spark: SparkSession, root: str, limit: int | None, numbered: bool) -> DataFrame:
    names, order = maildir.list_names(spark, root), ["folder_rank", "file_path"]
    if limit and limit <= MOST_LISTED:
        first = names.orderBy(*order).limit(limit).select("file_path", "folder_rank", "name").collect()
        numbers = spark.createDataFrame([(*r, n + 1) for n, r in enumerate(first)], "file_path string, folder_rank int, name binary, message_num long")
        return maildir.read_files(maildir.dealt_out(numbers, root), root, "message_num")
    if limit or numbered:
        ranges = saved(names.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "maildir-names")
        numbers = first_messages(number_messages(ranges, [F.col("range")], "file_path"), limit).drop("range")
        return maildir.read_files(maildir.dealt_out(numbers, root), root, "message_num")
    return maildir.read_files(maildir.dealt_out(names, root), root).select("raw", "file_path", "error", "folder_rank")


def _numbered_maildir(spark: SparkSession, both: str, rank: Column, limit: int | None) -> DataFrame:
    names = spark.read.options(**_PLAIN_FILES).format("binaryFile").load(both).select(F.col("_metadata.file_path").alias("file_path")).withColumn("folder_rank", rank)
    if limit and limit <= MOST_LISTED:
        first = [r.file_path for r in names.orderBy("folder_rank", "file_path").limit(limit).collect()]
        if not first:
            return _read_files(spark, both, rank).withColumn("message_num", F.lit(0).cast("long")).limit(0)
        numbers = spark.createDataFrame([(p, n + 1) for n, p in enumerate(first)], "file_path string, message_num long")
        return _read_files(spark, first, rank).join(F.broadcast(numbers), "file_path").select("raw", "file_path", "folder_rank", "error", "message_num")
    ranges = names.repartitionByRange("folder_rank", "file_path").withColumn("range", F.spark_partition_id())
    ranges = saved(ranges, "maildir-names")
    numbers = number_messages(ranges, [F.col("range")], "file_path").select("file_path", "message_num")
    rows = _read_files(spark, both, rank).join(first_messages(numbers, limit), "file_path")
    return rows.select("raw", "file_path", "folder_rank", "error", "message_num")


def _read_files(spark: SparkSession, paths: str | list[str], rank: Column) -> DataFrame:
    """(raw, file_path, error, folder_rank) of whole files; of a file that is listed but cannot be read, the error."""
    files = spark.read.options(**_PLAIN_FILES).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).format("binaryFile").load(paths)
    names = files.select(F.col("_metadata.file_path").alias("file_path"))  # opens no file, so it has those that cannot be read
    read = files.select(F.col("_metadata.file_path").alias("file_path"), F.col("content").cast("string").alias("text_"))
    error = F.when(F.col("text_").isNull(), F.concat(F.lit("failed to read file: "), "file_path"))
    return names.join(read, "file_path", "left").select(F.coalesce("text_", F.lit("")).alias("raw"), "file_path", error.alias("error"), rank.alias("folder_rank"))

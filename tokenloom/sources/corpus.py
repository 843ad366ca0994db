"""Reading a corpus: a table of texts, or a folder of source files."""

from __future__ import annotations

import fnmatch
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORPUS_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType(), False), T.StructField("content", T.StringType(), True)]
)


def spread(scan: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Deal a corpus of few splits out to `partitions`; a large corpus has splits enough, one for each core.

    Filters and column choices still pass through to the scan.
    """
    if partitions is None or scan.rdd.getNumPartitions() >= min(partitions, scan.sparkSession.sparkContext.defaultParallelism):
        return scan
    return scan.repartition(partitions, key)


def default_spread(spark: SparkSession) -> int:
    """Partitions for a small corpus: two for each core."""
    return 2 * spark.sparkContext.defaultParallelism


def scan_corpus(
    spark: SparkSession,
    path: str,
    language: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    language_column: str = "lang",
    partitions: int | None = None,
) -> DataFrame:
    """`doc_id, content` of a Parquet corpus.

    The language filter reaches the scan: it prunes folders of a corpus partitioned by
    language, and row groups of any other. Only the two columns are read. `partitions` deals a
    corpus of few splits out to more cores; leave it out for a large one.
    """
    fields = [T.StructField(doc_id, T.LongType()), T.StructField(text, T.StringType())]
    if language is not None:
        fields.append(T.StructField(language_column, T.StringType()))
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    if language is not None:
        rows = rows.where(F.col(language_column) == language)
    corpus = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("content"))
    return spread(corpus, "doc_id", partitions)


#: How Hadoop prints the status of a file or folder.
_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false)(?:; length=(\d+))?")
#: A split counts every file it opens as 4 MB, so a split of small files holds only some thirty.
#: So many splits make one task.
_SPLITS_OF_TASK = 16


def _empty_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Locations of the files without a byte, written as the text reader writes them.

    `path` is a file, a folder or a glob. A folder is listed by one call to the file system; a local one
    by the operating system, since the statuses of a million files are slow to pass as text.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    top = place(path)
    fs = top.getFileSystem(conf)
    show = jvm.org.apache.commons.lang3.ArrayUtils.toString
    matches = fs.globStatus(top)
    pending, found = [show(matches)] if matches is not None else [], []

    def location(name: str) -> str:
        # The text reader leaves out an empty authority.
        return place(name).toUri().toString().replace(":///", ":/", 1)

    while pending:
        for name, folder, length in _STATUS.findall(pending.pop()):
            last = name.rsplit("/", 1)[-1]
            if last.startswith(("_", ".")):
                continue
            if folder == "true" and name.startswith("file:/"):
                found += [location(f"file:{p}") for p in _empty_below(name[5:], pattern)]
            elif folder == "true":
                pending.append(show(fs.listStatus(place(name))))
            elif length == "0" and fnmatch.fnmatchcase(last, pattern):
                found.append(location(name))
    return found


def _empty_below(folder: str, pattern: str) -> list[str]:
    """The files without a byte below a local folder."""
    pending, found = [folder], []
    while pending:
        with os.scandir(pending.pop()) as entries:
            for entry in entries:
                if entry.name.startswith(("_", ".")):
                    continue
                if entry.is_dir():
                    pending.append(entry.path)
                elif fnmatch.fnmatchcase(entry.name, pattern) and os.path.isfile(entry.path) and entry.stat().st_size == 0:
                    found.append(entry.path)
    return found


def _stored_as_is(spark: SparkSession, pattern: str) -> bool:
    """Whether no name that matches `pattern` is that of a compressed file."""
    ending = re.search(r"\.\w+\Z", pattern)
    if ending is None:
        return False
    jvm = spark.sparkContext._jvm.org.apache.hadoop
    codecs = jvm.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    return codecs.getCodec(jvm.fs.Path(f"/x{ending[0]}")) is None


def _local_path(spark: SparkSession, path: str) -> str | None:
    """`path` as the operating system names it; None on any other file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def write_source_files(files: DataFrame, path: str) -> None:
    """One file `<doc_id>.txt` for each row of `doc_id, folder, value`, the value and a newline, below `folder=<folder>`.

    `doc_id` is unique and not null. On a local (or mounted) file system the tasks write the files themselves:
    Hadoop starts a process for the mode of each file there, which costs more than all else.
    """
    top = _local_path(files.sparkSession, path)
    if top is None:
        (
            files.select("folder", "value")
            .write.partitionBy("folder")
            .option("maxRecordsPerFile", 1)
            # Files move into place in the tasks, not one after another in the driver.
            .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
            .text(path)
        )
        return

    def run(batches):
        made = set()
        for batch in batches:
            ids, folders, values = (batch.column(c).to_pylist() for c in ("doc_id", "folder", "value"))
            for name, folder, value in zip(ids, folders, values):
                into = f"{top}/folder={folder}"
                if folder not in made:
                    os.makedirs(into, exist_ok=True)
                    made.add(folder)
                # Readers pass over hidden names: what a lost task leaves is not read.
                hidden = f"{into}/.{name}.{uuid.uuid4().hex}"
                with open(hidden, "wb") as f:
                    f.write(value.encode() + b"\n")
                os.replace(hidden, f"{into}/{name}.txt")
            yield pa.RecordBatch.from_pydict({"n": [len(ids)]})

    os.makedirs(top)
    files.select("doc_id", "folder", "value").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def read_source_files(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """One row per file below `path` (a file, a folder, or a glob of either): its location as `doc_id`, its whole text as `content`.

    Spark's readers pass over files without a byte; those are listed and added. For folders of
    source files: every file is listed on the driver. `with_doc_id` numbers the rows for packing.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": pattern}
    if _stored_as_is(spark, pattern):
        # The text reader copies the Hadoop settings for each file, one file at a time in the whole executor.
        files = spark.read.format("binaryFile").options(**options).load(path)
        text = F.col("content").cast("string")
    else:
        files = spark.read.text(path, wholetext=True, **options)
        text = F.col("value")
    rows = files.select(F.col("_metadata.file_path").alias("doc_id"), text.alias("content"))
    splits = files.rdd.getNumPartitions()
    rows = rows.coalesce(max(default_spread(spark), -(-splits // _SPLITS_OF_TASK)))
    empty = _empty_files(spark, path, pattern)
    if not empty:
        return rows
    return rows.unionByName(spark.createDataFrame([(p, "") for p in empty], "doc_id string, content string"))

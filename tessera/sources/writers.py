"""Sinks: chat lines, manifests, reports, polygon label texts, dataset descriptions, result documents.

What replaces a folder is written beside it first and takes its place when the whole job is done, so a job that fails
leaves the old files as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tessera.functions import geometry as G


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets write(folder) fill a folder beside `path`, then puts it in its place by two renames; a failed write leaves `path` as it was."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex[:12]
    new, old, here = at(f"{path.rstrip('/')}.new-{mark}"), at(f"{path.rstrip('/')}.old-{mark}"), at(path)
    try:
        write(new.toString())
        if system.exists(here) and not system.rename(here, old):
            raise OSError(f"{path} can't be moved")
        if not system.rename(new, here):
            system.rename(old, here)
            raise OSError(f"{path} can't be put in place")
        system.delete(old, True)
    finally:
        system.delete(new, True)


def write_chat(rows: DataFrame, path: str) -> None:
    """JSON lines by split, nulls kept; what was there is replaced."""
    replace_folder(rows.sparkSession, path, rows.write.partitionBy("split").option("ignoreNullFields", "false").json)


def packed_box(box: Column) -> Column:
    return F.concat_ws("|", *[box[k].cast("string") for k in ("x_min", "y_min", "x_max", "y_max")])


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV with a header; values that need quotes have them, and quotes in them are doubled."""
    replace_folder(rows.sparkSession, path, rows.write.option("header", True).option("escape", '"').csv)


def report(rows: DataFrame, reason: str = "reason", **settings: str | int | float) -> DataFrame:
    """One JSON text: rows by reason, their total, and the settings."""
    counts = rows.groupBy(reason).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return counts.select(F.to_json(F.struct("total", "counts", F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("settings"))).alias("value"))


def write_report(rows: DataFrame, path: str, reason: str = "reason", **settings: str | int | float) -> None:
    replace_folder(rows.sparkSession, path, report(rows, reason, **settings).write.text)


def label_line(points: Column, width: Column, height: Column, label: int = 0) -> Column:
    """A polygon as a line of a label file: its class, then points as shares of the frame's sides."""
    share = lambda v, n: F.format_string("%.6f", G.clamp(v / n, 0.0, 1.0))
    return F.concat_ws(" ", F.lit(str(label)), F.concat_ws(" ", F.flatten(F.transform(points, lambda p: F.array(share(p["x"], width), share(p["y"], height))))))


def label_texts(polygons: DataFrame, samples: DataFrame) -> DataFrame:
    """The text of every sample's label file, empty where it has no polygon: polygons has sample_id, idx, points, width, height."""
    lines = polygons.select("sample_id", "idx", label_line(F.col("points"), F.col("width"), F.col("height")).alias("line"))
    texts = lines.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    texts = texts.select("sample_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return samples.select("sample_id").distinct().join(texts, "sample_id", "left").select("sample_id", F.coalesce("text", F.lit("")).alias("text"))


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has finished."""

    names: list[str]


class LabelTextWriter(DataSourceWriter):
    """Writes a file a row, named by its first column, into a folder that takes the target's place when all tasks are done.

    A task writes each file under a name of its own attempt and then gives it its name, so a task that runs twice or is lost
    leaves no part of a file. Attempts' leftovers and the folder go at commit or abort.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.mark = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def prepared(self) -> LabelTextWriter:
        """Makes the folder before any task runs: one that still writes when the job has been given up finds none, and so leaves nothing."""
        system, _, staged = self._opened()
        system.create_dir(f"{staged}/_drafts", recursive=True)
        return self

    def _opened(self) -> tuple[fs.FileSystem, str, str]:
        system, folder = fs.FileSystem.from_uri(self.path)
        return system, folder, f"{folder}.new-{self.mark}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, _, staged = self._opened()
        drafts, names = f"{staged}/_drafts", []
        for sample, text in rows:
            if not sample or sample in (".", "..") or any(c in sample for c in "/\\\0"):
                raise ValueError(f"{sample!r} is no name of a file")
            draft = f"{drafts}/{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(text.encode())
            system.move(draft, f"{staged}/{sample}.txt")
            names.append(f"{sample}.txt")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder, staged = self._opened()
        system.delete_dir(f"{staged}/_drafts")
        there = system.get_file_info(folder).type == fs.FileType.Directory
        if self.overwrite or not there:
            if there:
                system.move(folder, f"{folder}.old-{self.mark}")
            system.move(staged, folder)
            if there:
                system.delete_dir(f"{folder}.old-{self.mark}")
            return
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{staged}/{name}", f"{folder}/{name}")
        system.delete_dir(staged)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, staged = self._opened()
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class LabelTexts(DataSource):
    """The sink of write_label_texts(): option path, a folder as a URI."""

    @classmethod
    def name(cls) -> str:
        return "label_texts"

    def writer(self, schema: StructType, overwrite: bool) -> LabelTextWriter:
        return LabelTextWriter(self.options["path"], overwrite).prepared()


def write_label_texts(texts: DataFrame, path: str, overwrite: bool = True) -> int:
    """A file `<sample_id>.txt` for every sample in one folder, written by the tasks themselves; the number of files written.

    The folder's old files stay until all tasks are done, and for good if one fails. Without overwrite, files are added, and
    one of the same name is replaced. path is a folder that all executors reach, by a scheme that Arrow's file systems know; without a
    scheme it belongs to the session's default file system. A sample_id that is empty or would leave the folder is an error.
    """
    spark = texts.sparkSession
    spark.dataSource.register(LabelTexts)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    rows = texts.select(F.col("sample_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.format("label_texts").mode("overwrite" if overwrite else "append").option("path", whole).save()
    return seen.get["n"]


def dataset_description(root: str, names: list[str]) -> str:
    """The description that training tools read."""
    listed = "\n".join(f"  {i}: {name}" for i, name in enumerate(names))
    return f"path: {root}\ntrain: images/train\nval: images/val\ntest: images/test\nnames:\n{listed}\n"


def exit_code(rows: DataFrame, status: str = "status") -> int:
    """0 if every result is ok, else 2; none at all are not ok."""
    told = rows.agg(F.count("*").alias("n"), F.count_if(F.col(status) == "ok").alias("ok")).first()
    return 0 if told["n"] and told["n"] == told["ok"] else 2


def write_results(rows: DataFrame, path: str) -> None:
    """Result documents, one per line, nulls kept."""
    replace_folder(rows.sparkSession, path, rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text)


def write_if_absent(rows: DataFrame, path: str) -> None:
    rows.write.mode("ignore").parquet(path)

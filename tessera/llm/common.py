"""What the operators of this subpackage share: staged tables, text slices, folds, a word memo."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import lean, small_batches  # noqa: F401

#: The six white-space characters of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
_SPACE = re.compile(r"\s")
#: Characters of texts that a Python worker cuts into words at a time.
PIECE = 1 << 18
_local_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    It is spark.checkpoint.dir where the session sets it. Where it is unset, a
    single-machine session gets a temporary folder, and a cluster an error: any folder
    chosen for it might be one that its machines do not share.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
        return f"file://{_local_root[0]}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: nothing can be removed through it
        return


class Scratch:
    """Tables written once to the shared folder and read back.

    A staged table cuts the lineage: an executor that is lost later costs only the
    tasks it ran, and no earlier stage. The shuffle files of a table's plan go as soon as it
    is written, since nothing refers to them again. The folder goes by drop(), at the end
    of the temporary() block it was opened in, or when the driver exits.
    """

    _open: ClassVar[list[list[Scratch]]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, self.path)
        if Scratch._open:
            Scratch._open[-1].append(self)

    @classmethod
    @contextlib.contextmanager
    def temporary(cls) -> Iterator[None]:
        """Removes at its end all that operators stage within; what is to stay must have been written elsewhere."""
        cls._open.append([])
        try:
            yield
        finally:
            for scratch in cls._open.pop():
                scratch.drop()

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str | None = None) -> None:
        _remove(self.spark, f"{self.path}/{name}" if name else self.path)

    def keep_only(self, *names: str) -> None:
        """Removes the staged tables that no result reads any more."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        for status in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
            if status.getPath().getName() not in names:
                self.drop(status.getPath().getName())


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def fold_of(docs: DataFrame, key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key counts as empty text."""
    return F.crc32(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")) % folds


def smallest_keys(rows: DataFrame, key: str, most: int) -> list:
    """At most `most` distinct keys, the same ones on every run: those with the smallest md5.

    Only the keys under a bound on the md5 are made distinct, and the bound is raised until
    enough of them are there, so a key that repeats counts once and the whole table's keys
    are never shuffled.
    """
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.md5(F.col(key).cast("string").cast("binary")).alias("_md5"))
    share = min(1.0, 4 * most / max(1, keys.count()))
    while True:
        some = keys if share >= 1 else keys.where(F.col("_md5") < f"{int(share * (1 << 32)):08x}")
        found = [r["_key"] for r in some.distinct().orderBy("_md5", "_key").limit(most).collect()]
        if len(found) >= most or share >= 1:
            return found
        share = min(1.0, 8 * share)


def bounded_sample(rows: DataFrame, keys: list, most_chars: int) -> list[tuple[str, object]]:
    """(text, value) by key, in the order of the keys, of at most `most_chars` characters together.

    rows has _key, _text and _value. Of the rows of one key the first by md5 of its text,
    then by value, is taken, so a hot key cannot fill the sample and equal keys have an order.
    From the first text on with which the characters would be too many, texts are left out, but
    never all. Digests and lengths are compared in the cluster; only chosen texts are collected.
    """
    if not keys:
        return []
    spark = rows.sparkSession
    kind = rows.schema["_key"].dataType.simpleString()
    told = rows.where("_text IS NOT NULL AND _value IS NOT NULL").withColumn("_m", F.md5(F.col("_text").cast("binary")))
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in keys], f"_key {kind}"))
    narrow = told.join(wanted, "_key", "left_semi").select("_key", F.struct("_m", "_value", F.length("_text").alias("n")).alias("_first"))
    first = {r["_key"]: r["_first"] for r in narrow.groupBy("_key").agg(F.min("_first").alias("_first")).collect()}
    chosen, held = [], 0
    for k in keys:
        if k in first:
            held += first[k]["n"]
            if chosen and held > most_chars:
                break
            chosen.append((k, first[k]["_m"], first[k]["_value"]))
    if not chosen:
        return []
    wanted = F.broadcast(spark.createDataFrame(chosen, f"_key {kind}, _m string, _value {rows.schema['_value'].dataType.simpleString()}"))
    found = told.join(wanted, ["_key", "_m", "_value"], "left_semi").groupBy("_key").agg(F.min(F.struct("_text", "_value")).alias("x"))
    texts = {r["_key"]: (r["x"]["_text"], r["x"]["_value"]) for r in found.collect()}
    return [texts[k] for k, _, _ in chosen]


def slices(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts holding about `most` characters each; a longer text is alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """A text in parts of about `most` characters, cut before white space; one longer word is not cut."""
    start = 0
    while len(text) - start > most:
        cut = _SPACE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class WordMemo:
    """Rows of numbers by word, computed for many new words at once and kept up to a bound.

    compute(words) returns an array with one row per word. The memo is emptied when it
    holds `most` words or `most_chars` characters, so memory is bounded and results never
    depend on what is in it.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], most: int = 200_000, most_chars: int = 8 << 20) -> None:
        self.compute, self.most, self.most_chars = compute, most, most_chars
        self.index: dict[str, int] = {}
        self.rows: np.ndarray | None = None
        self.chars = 0

    def __call__(self, words: list[str]) -> np.ndarray:
        """One row per word, repeated words included."""
        new = list(set(words).difference(self.index))
        chars = sum(map(len, new))
        if new and (len(self.index) + len(new) > self.most or self.chars + chars > self.most_chars):
            self.index, self.rows, self.chars = {}, None, 0
            new = list(set(words))
            chars = sum(map(len, new))
        if new:
            made = self.compute(new)
            n = len(self.index)
            need = n + len(new)
            if self.rows is None:
                self.rows = made.copy()
            else:
                if need > len(self.rows):
                    grown = np.empty((max(need, 2 * len(self.rows)), *self.rows.shape[1:]), self.rows.dtype)
                    grown[:n] = self.rows[:n]
                    self.rows = grown
                self.rows[n:need] = made
            self.index.update(zip(new, range(n, need)))
            self.chars += chars
        if self.rows is None:
            return self.compute([])
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        found = self.rows[at]
        if len(self.index) > self.most or self.chars > self.most_chars:  # these words alone are too many to keep
            self.index, self.rows, self.chars = {}, None, 0
        return found


def sum_by_text(values: np.ndarray, counts: Iterable[int]) -> np.ndarray:
    """Sums of consecutive runs of rows; a run may be empty."""
    counts = np.asarray(list(counts), np.int64)
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def word_groups(texts: list[str], most: int = PIECE) -> Iterator[list[tuple[int, str]]]:
    """The texts in groups of (text number, piece) of about `most` characters, in order; a text may go over several groups."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, most):
            if group and held + len(piece) > most:
                yield group
                group, held = [], 0
            group.append((i, piece))
            held += len(piece)
    if group:
        yield group

"""Writers of result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trackflow.operators.tables import materialise, row_count

ONE_FILE_ROWS = 100_000


def write_layers(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each table to ``path``/name as parquet, replacing what was there once all of them are written.

    The tables are staged beside the layers first, so a failure leaves the old ones as they are. A journal then names
    what takes which place; a run that dies while it moves them is finished by the next ``write_layers`` or
    ``finish_layers``. Layers that are not among ``tables`` stay.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    finish_layers(spark, path)
    run = uuid.uuid4().hex
    files = _Files(spark, path)
    try:
        for name, table in tables.items():
            table.write.parquet(f"{path}/.staged-{run}/{name}")
    except Exception:
        files.drop(f".staged-{run}")
        raise
    files.write_whole(f".publish-{run}", "\n".join(tables))
    finish_layers(spark, path)


def finish_layers(spark: SparkSession, path: str) -> None:
    """Moves staged layers that a journal names to their places. Without a journal there is nothing to do."""
    files = _Files(spark, path)
    for journal in files.listed(".publish-"):
        staged = journal.replace(".publish-", ".staged-")
        for name in files.read(journal).split("\n"):
            if files.there(f"{staged}/{name}"):  # else it has been moved before
                files.drop(name)
                files.move(f"{staged}/{name}", name)
        files.drop(staged)
        files.drop(journal)


class _Files:
    """Names below a folder of whatever file system Spark reads it from."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark.sparkContext._jvm
        self.folder = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def there(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def listed(self, prefix: str) -> list[str]:
        found = self._fs.globStatus(self._at(f"{prefix}*"))
        return [f.getPath().getName() for f in found or []]

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{name} could not be moved to {to} in {self.folder.toString()}")

    def write_whole(self, name: str, text: str) -> None:
        """The file is there in whole or not at all."""
        out = self._fs.create(self._at(f".new{name}"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.move(f".new{name}", name)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def write_csv(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each summary table to ``path``/name as CSV with a header.

    A matrix (animal_id and one column per animal) is written in animal order
    without the name column, so row order equals header order. A table of up to ONE_FILE_ROWS
    rows becomes one file; a larger one is dealt by ranges into parts whose names follow the order.
    """
    for name, table in tables.items():
        table = materialise(table)
        matrix = set(table.columns) > {"animal_id"}
        sorted_ = table.orderBy("animal_id") if matrix else table.orderBy(*table.columns)
        if row_count(table) <= ONE_FILE_ROWS:
            sorted_ = sorted_.coalesce(1)
        sorted_ = sorted_.drop("animal_id") if matrix else sorted_
        sorted_.write.mode("overwrite").csv(f"{path}/{name}", header=True)

"""Scalar column expressions on source names, labels and times.

Fixed values (file name and layer name formats):
  file   R<group>-<BREED><nn>.gpkg        e.g. R1-HO01.gpkg
  layer  MM-DD-A | MM-DD-M                 A = evening, M = morning
  layer names ending in "lns" hold auxiliary lines
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
AUXILIARY_SUFFIX = "lns"


def extract(source: Column, pattern: str, group: int) -> Column:
    """Regex group, NULL (not '') where nothing matches."""
    found = F.regexp_extract(source, pattern, group)
    return F.when(found != "", found)


def parse_time(text: Column) -> Column:
    """The instant that a text without a zone names in UTC, whatever the session's zone."""
    return F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{TIME_FORMAT} xx"))


def breed_from_file(file: Column) -> Column:
    return extract(file, r"-([A-Z]{2})", 1)


def number_from_file(file: Column) -> Column:
    return extract(file, r"(\d{2})\.gpkg", 1)


def animal_from_file(file: Column) -> Column:
    return extract(file, r"-(\w+)\.gpkg", 1)


def study_group(file: Column) -> Column:
    return F.substring(file, 1, 2)


def period(file: Column) -> Column:
    return extract(file, r"(R1|R2|R3)", 1)


def day_part(layer: Column) -> Column:
    return F.substring(layer, 7, 1)


def breed_from_animal(animal_id: Column) -> Column:
    return extract(animal_id, r"^([A-Z]+)", 1)


def time_of_day(time: Column) -> Column:
    """HH:mm:ss in UTC, whatever the session's zone."""
    second = F.pmod(F.floor(F.unix_micros(time) / F.lit(1_000_000)), F.lit(86400))
    parts = [F.lpad(p.cast("int").cast("string"), 2, "0") for p in (F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)]
    return F.when(time.isNotNull(), F.concat_ws(":", *parts))


def hour_number(time: Column) -> Column:
    """Full hours since the epoch."""
    return F.floor(F.unix_micros(time) / F.lit(3_600_000_000)).cast("long")


def epoch_seconds(time: Column) -> Column:
    return F.unix_micros(time) / F.lit(1e6)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def round_to_second(seconds: Column) -> Column:
    """Epoch seconds (double) to a timestamp on the full second, halves up."""
    return F.timestamp_seconds(F.floor(seconds + F.lit(0.5)))


def shift_seconds(time: Column, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(time) + F.lit(int(seconds * 1_000_000)))


def rescale(df: DataFrame, column: str, lo: float, hi: float, by: list[str], name: str) -> DataFrame:
    """Min-max rescale of ``column`` to [lo, hi] within each ``by`` group.

    The extremes come from an aggregate (partial per task) joined back, so no
    group has to pass through one task. A constant group maps to the middle.
    """
    from trackflow.operators.tables import attach, materialise

    ends = materialise(df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))
    share = F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    scaled = F.when(
        F.col(column).isNotNull(), F.coalesce(share, F.lit(0.5)) * F.lit(hi - lo) + F.lit(lo)
    )
    return attach(df, ends, by).withColumn(name, scaled).drop("_lo", "_hi")


def parse_source_columns(df: DataFrame) -> DataFrame:
    """Adds every column derived from the file and layer names and the time text."""
    file, layer = F.col("source_file"), F.col("source_layer")
    return df.withColumns(
        {
            "time": parse_time(F.col("time_text")),
            "breed": breed_from_file(file),
            "number": number_from_file(file),
            "animal_id": animal_from_file(file),
            "study_group": study_group(file),
            "period": period(file),
            "session_id": layer,
            "day_part": day_part(layer),
        }
    ).withColumn("time_of_day", time_of_day(F.col("time")))


def interleave_position(rank: Column) -> Column:
    """Sort key that puts ranks in the order 1, 3, 5, ..., 2, 4, ..."""
    return F.struct((rank % 2 == 0).alias("even"), rank.alias("rank"))


def interleaved(df: DataFrame, by: list[str], value: str, tiebreak: str, name: str) -> DataFrame:
    """The i-th row (by ``value``) of each group gets the i-th of 1, 3, 5, ..., 2, 4, ....

    Expects summary rows (one per animal), not fixes.
    """
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(value, tiebreak))
    size = F.count(F.lit(1)).over(w)
    odd = F.floor((size + 1) / 2)
    return df.withColumn(
        name,
        F.when(place <= odd, 2 * place - 1).otherwise(2 * (place - odd)).cast("int"),
    )

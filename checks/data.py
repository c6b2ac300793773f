"""GPS-like fixes, gates and routes derived from the events table.

The SQL is the same text in Spark and in the equivalent queries. Session = half
day; animals walk out (x rising) for six hours and back for six. Days of even
number use a way 60 m further north; some events jump 4 km.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackflow.plans.study import Setting, Study, between_x

# Fixed values of the derived field.
START_X, END_X = 2780300, 2781000
GATE_SOUTH, GATE_NORTH = 1160900, 1161200
TRAIL_Y, ROAD_Y = 1161000, 1161060
MAX_SPEED = 1.0

TRACKS_SQL = """
select event_id,
  case a % 3 when 0 then 'HO' when 1 then 'HW' else 'OB' end as breed,
  concat(case a % 3 when 0 then 'HO' when 1 then 'HW' else 'OB' end, lpad(cast(cast(floor(a / 3) as int) + 1 as varchar(2)), 2, '0')) as animal_id,
  concat(lpad(cast(mo as varchar(2)),2,'0'),'-',lpad(cast(d as varchar(2)),2,'0'), case when h < 12 then '-M' else '-A' end) as session_id,
  time, h as hour, k % 16 as nsat,
  cast(2780000 as double) + 1400 * (1 - abs(2 * (cast(s as double) / 43200) - 1)) - 12 * a + 3 * (event_id % 13) as x,
  cast(1161000 as double) + (event_id % 9) - 4 + case when d % 2 = 0 then 60 else 0 end
    + case when event_type = 'error' and event_id % 20 = 0 then 4000 else 0 end as y
from (select event_id, event_type, date_trunc('second', ts) as time, cast(user_id % 16 as int) as a,
       cast(extract(month from ts) as int) as mo, cast(extract(day from ts) as int) as d, cast(extract(hour from ts) as int) as h,
       (cast(extract(hour from ts) as int) % 12) * 3600 + cast(extract(minute from ts) as int) * 60 + cast(floor(extract(second from ts)) as int) as s,
       cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events}) e
"""

# Raw rows as a folder of files would give them: names and the time as text.
# One kind of event comes from a file that is no track, one from auxiliary
# layers, one has an unreadable time.
RAW_SQL = """
select event_id,
  case when event_type = 'signup' then 'overview.txt' else concat('R', cast(grp as varchar(1)), '-', breed, animal_no, '.gpkg') end as source_file,
  case when event_type = 'purchase' then concat(layer, 'lns') else layer end as source_layer,
  case when event_type = 'click' and event_id % 7 = 0 then 'unknown' else concat(cast(day_text as varchar(10)), ' ', clock) end as time_text
from (select event_id, event_type,
    cast(extract(day from ts) as int) % 3 + 1 as grp,
    case cast(user_id % 16 as int) % 3 when 0 then 'HO' when 1 then 'HW' else 'OB' end as breed,
    lpad(cast(cast(floor(cast(user_id % 16 as int) / 3) as int) + 1 as varchar(2)), 2, '0') as animal_no,
    concat(lpad(cast(cast(extract(month from ts) as int) as varchar(2)),2,'0'),'-',lpad(cast(cast(extract(day from ts) as int) as varchar(2)),2,'0'),
      case when cast(extract(hour from ts) as int) < 12 then '-M' else '-A' end) as layer,
    cast(ts as date) as day_text,
    concat(lpad(cast(cast(extract(hour from ts) as int) as varchar(2)),2,'0'),':',lpad(cast(cast(extract(minute from ts) as int) as varchar(2)),2,'0'),
      ':',lpad(cast(cast(floor(extract(second from ts)) as int) as varchar(2)),2,'0')) as clock
  from {events}) e
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACKS_SQL, events=events(spark, sf_dir))


def raw_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_SQL, events=events(spark, sf_dir))


def gates(spark: SparkSession) -> DataFrame:
    """Seven upright gate lines, evenly spaced, on both routes."""
    x = F.lit(float(START_X)) + F.lit(float(END_X - START_X)) * F.col("id") / F.lit(6.0)
    return spark.range(7).select(
        F.explode(F.array(F.lit("trail"), F.lit("road"))).alias("route"),
        F.col("id").cast("int").alias("gate_no"),
        x.alias("x1"),
        F.lit(float(GATE_SOUTH)).alias("y1"),
        x.alias("x2"),
        F.lit(float(GATE_NORTH)).alias("y2"),
    )


def routes(spark: SparkSession) -> DataFrame:
    """Two straight routes with a vertex every 100 m."""
    ways = F.array(
        F.struct(F.lit("trail").alias("route"), F.lit(float(TRAIL_Y)).alias("y")),
        F.struct(F.lit("road").alias("route"), F.lit(float(ROAD_Y)).alias("y")),
    )
    return spark.range(15).select(
        F.col("id").alias("seq"), (F.lit(2780000.0) + 100.0 * F.col("id")).alias("x"), F.explode(ways).alias("w")
    ).select("w.route", "seq", "x", "w.y")


def study(spark: SparkSession, sf_dir: str) -> Study:
    setting = Setting(
        gates=gates(spark), routes=routes(spark), in_band=between_x(START_X, END_X), max_speed=MAX_SPEED
    )
    return Study(tracks(spark, sf_dir), setting)

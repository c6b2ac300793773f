"""GeoPackage files, gate tables and result files."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from trackflow.functions.columns import parse_source_columns
from trackflow.operators import network
from trackflow.sources import sinks
from trackflow.sources.tracks import append_by_name, read_gates, read_tracks


def blob(x, y, order="<", envelope=False):
    flags = (1 if order == "<" else 0) | (2 if envelope else 0)
    head = b"GP" + bytes([0, flags]) + struct.pack(order + "i", 2056)
    box = struct.pack(order + "4d", x, x, y, y) if envelope else b""
    return head + box + bytes([1 if order == "<" else 0]) + struct.pack(order + "Idd", 1, x, y)


def make_file(path, layers):
    db = sqlite3.connect(path)
    db.execute("create table gpkg_contents (table_name text, data_type text, srs_id int)")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id int)")
    for name, (fields, rows) in layers.items():
        db.execute("insert into gpkg_contents values (?, 'features', 2056)", [name])
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POINT', 2056)", [name])
        db.execute(f'create table "{name}" (fid integer primary key, geom blob, {", ".join(fields)})')
        db.executemany(f'insert into "{name}" (geom, {", ".join(fields)}) values (?{", ?" * len(fields)})', rows)
    db.commit()
    db.close()


@pytest.fixture
def folder(tmp_path):
    fix = ["ID", "Time", "NSat"]
    make_file(tmp_path / "R1-HO01.gpkg", {
        "06-25-A": (fix, [(blob(1.5, 2.5), 1, "2025-06-25 15:00:00", 7), (blob(3.0, 4.0, ">", True), 1, "2025-06-25 15:00:20", None)]),
        "06-25-Alns": (["ID"], [(None, 1)]),
    })
    make_file(tmp_path / "R3-OB12.gpkg", {"08-02-M": ([*fix, "PDOP"], [(blob(5, 6), 12, "bad", 3, 1.25)]), "empty": (fix, [])})
    (tmp_path / "notes.txt").write_text("not a track")
    return str(tmp_path)


def test_every_layer_of_every_file(spark, folder):
    raw = read_tracks(spark, folder)
    rows = {(r["source_file"], r["source_layer"], r["fid"]): r for r in raw.collect()}
    assert set(rows) == {("R1-HO01.gpkg", "06-25-A", 1), ("R1-HO01.gpkg", "06-25-A", 2), ("R1-HO01.gpkg", "06-25-Alns", 1), ("R3-OB12.gpkg", "08-02-M", 1)}
    first, second = rows[("R1-HO01.gpkg", "06-25-A", 1)], rows[("R1-HO01.gpkg", "06-25-A", 2)]
    assert (first["x"], first["y"], first["nsat"], first["pdop"]) == (1.5, 2.5, 7, None)
    assert (second["x"], second["y"], second["nsat"]) == (3.0, 4.0, None)
    assert rows[("R1-HO01.gpkg", "06-25-Alns", 1)]["x"] is None
    parsed = {r["source_file"]: r for r in parse_source_columns(raw).filter("source_layer <> '06-25-Alns'").collect()}
    cow = parsed["R3-OB12.gpkg"]
    assert (cow["breed"], cow["animal_id"], cow["number"], cow["study_group"], cow["day_part"], cow["time"]) == ("OB", "OB12", "12", "R3", "M", None)
    assert parsed["R1-HO01.gpkg"]["time_of_day"].startswith("15:00:")


def test_layers_are_read_in_ranges(spark, folder):
    from trackflow.sources import geopackage

    geopackage.register(spark)
    split = spark.read.format("gpkg_tracks").option("rowsPerTask", 1).load(folder)
    assert split.rdd.getNumPartitions() == 4
    assert split.count() == 4


def test_append_fills_missing_columns(spark):
    both = append_by_name([spark.range(1).withColumn("p", F.lit("x")), spark.range(1, 2)])
    assert [tuple(r) for r in both.orderBy("id").collect()] == [(0, "x"), (1, None)]


def test_gates_from_csv(spark, tmp_path):
    (tmp_path / "gates.csv").write_text("route,gate_no,x1,y1,x2,y2\nroad,1,1,2,3,4.5\n")
    gates = read_gates(spark, str(tmp_path / "gates.csv"), "csv")
    assert gates.schema.simpleString() == "struct<route:string,gate_no:int,x1:double,y1:double,x2:double,y2:double>"
    assert tuple(gates.head()) == ("road", 1, 1.0, 2.0, 3.0, 4.5)


def test_csv_layout_and_overwrite(spark, tmp_path):
    animals = spark.createDataFrame([("HW05",), ("HO11",), ("OB02",)], "animal_id string")
    pairs = spark.createDataFrame([("HO11", "HW05", 3), ("HO11", "OB02", 2)], "a string, b string, n long")
    for _ in range(2):
        sinks.write_csv({"matrix": network.pair_matrix(pairs, animals), "animals": animals}, str(tmp_path))
    (matrix,) = (tmp_path / "matrix").glob("*.csv")
    assert matrix.read_text().split() == ["HO11,HW05,OB02", "0,3,2", "3,0,0", "2,0,0"]
    (names,) = (tmp_path / "animals").glob("*.csv")
    assert names.read_text().split() == ["animal_id", "HO11", "HW05", "OB02"]
    sinks.write_layers({"pairs": pairs}, str(tmp_path))
    sinks.write_layers({"pairs": pairs.limit(1)}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1


def test_large_csv_is_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ONE_FILE_ROWS", 50)
    table = spark.range(2000).select(F.format_string("%05d", 1999 - F.col("id")).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test's parts are small
    try:
        sinks.write_csv({"many": table, "few": table.limit(50)}, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "few").glob("part-*"))) == 1
    parts = sorted((tmp_path / "many").glob("part-*"))
    assert len(parts) > 1
    assert [x for p in parts for x in p.read_text().split()[1:]] == [f"{i:05d}" for i in range(2000)]


def test_matrix_of_too_many_animals_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(network, "MAX_MATRIX_ANIMALS", 2)
    pairs = spark.createDataFrame([("A", "B", 1)], "a string, b string, n long")
    animals = spark.createDataFrame([("A",), ("B",), ("C",)], "animal_id string")
    assert network.pair_matrix(pairs, animals.limit(2)).count() == 2
    with pytest.raises(ValueError, match="with_zero_pairs"):
        network.pair_matrix(pairs, animals)


def test_layers_are_replaced_together(spark, tmp_path):
    """The third of four layers fails: the old four stay. A run that died while moving is finished by the next."""
    names = ["a", "b", "c", "d"]
    old = {n: spark.range(i + 1) for i, n in enumerate(names)}
    path = str(tmp_path / "layers")
    rows = lambda: {n: spark.read.parquet(f"{path}/{n}").count() for n in names}
    sinks.write_layers(old, path)
    assert rows() == {"a": 1, "b": 2, "c": 3, "d": 4}
    broken = {n: spark.range(9) for n in names} | {"c": spark.range(9).select(F.raise_error(F.lit("no"))  .alias("id"))}
    with pytest.raises(Exception, match="no"):
        sinks.write_layers(broken, path)
    assert rows() == {"a": 1, "b": 2, "c": 3, "d": 4} and {p.name for p in (tmp_path / "layers").iterdir() if not p.name.endswith(".crc")} == set(names)
    moves, real = [], sinks._Files.move

    def dies(self, name, to):
        moves.append(name)
        if len(moves) == 4:
            raise KeyboardInterrupt
        real(self, name, to)

    sinks._Files.move = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            sinks.write_layers({n: spark.range(7) for n in names}, path)
    finally:
        sinks._Files.move = real
    sinks.finish_layers(spark, path)
    assert rows() == dict.fromkeys(names, 7)
    sinks.write_layers({"b": spark.range(2)}, path)
    assert rows() == {"a": 7, "b": 2, "c": 7, "d": 7}


def test_only_asked_columns_are_read(spark, folder):
    from pyspark.sql.types import StructType

    from trackflow.sources.geopackage import GeoPackageReader

    asked = lambda kinds: GeoPackageReader(StructType.fromDDL(kinds), {"path": folder}).statement("06-25-A", "geom", {"ID", "Time", "NSat", "PDOP"})
    by_row = 'from "06-25-A" where rowid between ? and ? order by rowid'
    assert asked("source_layer string, nsat int") == (f'select rowid, "NSat" {by_row}', ["nsat"])
    assert asked("fid long, x double, altitude double") == (f'select rowid, "geom" {by_row}', ["_geometry"])
    assert asked("source_file string") == (f"select rowid {by_row}", [])
    narrow = spark.read.format("gpkg_tracks").schema("source_file string, x double").option("bytesPerTask", 1000).load(folder)
    assert narrow.rdd.getNumPartitions() > 10 and narrow.count() == 4 and {r["x"] for r in narrow.collect()} == {1.5, 3.0, 5.0, None}


def test_a_filter_leaves_the_next_query_whole(spark, folder):
    raw = read_tracks(spark, folder)
    assert [raw.filter("nsat = 7").count(), raw.count(), raw.filter("source_layer > '06'").count()] == [1, 4, 4]

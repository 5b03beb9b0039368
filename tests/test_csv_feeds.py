"""CSV files that each have their own header: fields, lines of rejects, warnings and errors."""

import random

import pytest

from corrob.operators import ingest
from corrob.sources import files

ALIASES = {"country": ["country"], "year": ["year"], "price": ["price", "usd per gram"]}


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode())


def rows(df):
    return sorted((r["file"].rsplit("/", 1)[1], r["line"], r["country"], r["year"], r["price"]) for r in df.collect())


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path, "a.csv", "country,year,price\nDE,2021,7\n")
    write(tmp_path, "b.csv", 'Price,Country,Year\r\n\r\n  \r\n9,FR,2020\r\n"1,5","a ""b""",2019,extra\r\n')
    write(tmp_path / "deeper", "c.csv", "﻿Usd_per%Gram,Year\n3,2018\n")
    write(tmp_path / "deeper", "d.csv", "country,unknown\nX,y\n")
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "blank.csv", "\n\n")
    out, warnings = files.read_aliased_csv(spark, str(tmp_path), ALIASES, ["year", "price"])
    assert rows(out) == [("a.csv", 2, "DE", "2021", "7"), ("b.csv", 2, "FR", "2020", "9"), ("b.csv", 3, 'a "b"', "2019", "1,5"), ("c.csv", 2, None, "2018", "3")]
    assert [(r["file"].rsplit("/", 1)[1], r["message"]) for r in warnings.collect()] == [("d.csv", "missing columns: year, price")]


def test_ambiguous_and_repeated_headers(spark, tmp_path):
    write(tmp_path, "a.csv", "value,year,Year\n1,2,3\n")
    out, warnings = files.read_aliased_csv(spark, str(tmp_path), {"price": ["value"], "load": ["value"], "year": ["year"]}, ["year"])
    assert out.select("price", "load", "year").collect() == [("1", None, "3")]  # the first field, the last header
    assert [r["message"] for r in warnings.collect()] == ["ambiguous header: value"]


def test_too_many_layouts_are_an_error(spark, tmp_path):
    for i in range(4):
        write(tmp_path, f"{i}.csv", f"year,h{i}\n1,2\n")
    with pytest.raises(ValueError, match="headers"):
        files.read_aliased_csv(spark, str(tmp_path), ALIASES, ["year"], most_layouts=3)


@pytest.mark.parametrize("most_broadcast", [0, 1000])
def test_lines_are_numbered_through_blocks(spark, tmp_path, most_broadcast):
    """Files of many blocks, read by several tasks: each row is on the line that it says."""
    rng = random.Random(1)
    for k in range(3):
        lines, at = ["year,price,country" if k else "country,price,year"], 1
        for _ in range(6000):
            if rng.random() < 0.1:
                lines.append(" " * rng.randrange(3))
            at += 1
            lines.append(f"{at},7,c{k}" if k else f"c{k},7,{at}")
        write(tmp_path, f"{k}.csv", "\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "8192")
    try:
        out, _ = files.read_aliased_csv(spark, str(tmp_path), ALIASES, ["year"], most_broadcast=most_broadcast)
        got = out.selectExpr("count(*) n", "count_if(cast(line as string) = year) right", "count(distinct file, line) places", "count_if(file like concat('%', substr(country, 2), '.csv')) own").first()
    finally:
        spark.conf.set(key, was)
    assert tuple(got) == (18_000,) * 4


def test_rejects_name_file_and_line_and_reports_name_data_sets(spark, tmp_path):
    write(tmp_path / "nodes", "n.csv", "id,label,lat,lng\nShan North,Shan,20,97\n,,1,2\n")
    write(tmp_path / "stats", "s.csv", "region,year,ha,index\nshan_north,2020,5,50\nelsewhere,2020,6,50\nshan_north,2020,-1,5\n")
    write(tmp_path / "stats", "t.csv", "region,ha\na,1\n")
    names = lambda *xs: {x: [x] for x in xs}
    tables, report = files.load_feeds(spark, {
        "stats": files.Feed(str(tmp_path / "stats"), names("region", "year", "ha", "index"), ["region", "year", "ha"], ingest.region_stats, knows=("nodes",)),
        "nodes": files.Feed(str(tmp_path / "nodes"), names("id", "label", "lat", "lng"), ["label"], ingest.nodes),
        "gone": files.Feed(str(tmp_path / "gone"), names("id"), ["id"], ingest.nodes),
    })
    got = sorted((r["dataset"], r["kind"], r["n"], (r["file"] or "").rsplit("/", 1)[-1], r["line"]) for r in report.collect())
    assert got == [
        ("gone", "error", None, "", None), ("nodes", "loaded", 1, "", None), ("nodes", "warning", None, "n.csv", 3),
        ("stats", "loaded", 2, "", None), ("stats", "warning", None, "s.csv", 4), ("stats", "warning", None, "t.csv", None),
    ]
    assert sorted((r["region"], r["unknown_region"]) for r in tables["stats"].collect()) == [("elsewhere", True), ("shan_north", False)]
    assert {r["message"] for r in report.where("kind = 'warning'").collect()} == {"Row 3: missing required fields", "Row 4: negative ha", "missing columns: year"}
    assert files.load_feeds(spark, {})[1].count() == 0

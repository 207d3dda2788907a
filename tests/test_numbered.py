"""CSV with line numbers: splits, quoted line feeds, headers, messages."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from skein.sources import numbered, tables

ALIAS = tables.RETURNS["ALIAS"]


def write(path, rows, header=ALIAS):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    w.writerows(rows)
    path.write_text(out.getvalue(), encoding="utf-8")


def test_records_across_splits(spark, tmp_path):
    """Small splits cut records in two; numbers are those of a reader of the whole file."""
    r = random.Random(1)
    cells = ["plain", "two\nlines", 'a "quoted" one', "", "many\n\n\nlines, and commas", "漢字"]
    files = {}
    for name in ("a.csv", "b.csv"):
        rows = [[str(i), *[r.choice(cells) for _ in range(len(ALIAS) - 1)]] for i in range(300)]
        write(tmp_path / name, rows)
        files[name] = rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = spark.read.text(str(tmp_path))
        assert read.rdd.getNumPartitions() > 8
        found = numbered.returned(spark, str(tmp_path), "ALIAS").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(x["file"].rsplit("/", 1)[1], x["record"]): x for x in found}
    assert len(found) == len(got) == 600
    for name, rows in files.items():
        reader = csv.reader(io.StringIO((tmp_path / name).read_text(encoding="utf-8")))
        next(reader)
        line = reader.line_num
        for k, row in enumerate(rows):
            next(reader)
            x = got[name, k + 2]
            assert [x[c] for c in ALIAS] == [v.strip() for v in row] and x["line"] == line + 1
            line = reader.line_num


def test_header_in_any_order_and_blank_cells(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿Notes, student_id,source,language,alias,Entity_Type,entity_name,extra\n,s1,x,en,b,T,a,q\n\n,s1,, ,b,T,a,q\n", encoding="utf-8")
    rows = numbered.returned(spark, str(path), "ALIAS")
    assert rows.columns == ["file", "line", "record", *ALIAS]
    assert {(r["line"], r["column"]) for r in numbered.violations(rows).collect()} == {(4, "language"), (4, "source")}
    assert {r["entity_name"] for r in rows.collect()} == {"a"}


@pytest.mark.parametrize(("text", "message"), [("", "no data rows"), (",".join(ALIAS) + "\n", "no data rows"), ("a,b\n1,2\n", "missing headers: entity_name")])
def test_files_that_are_refused(spark, tmp_path, text, message):
    path = tmp_path / "r.csv"
    path.write_text(text)
    with pytest.raises(ValueError, match=message):
        numbered.returned(spark, str(path), "ALIAS")
    with pytest.raises(ValueError, match="unknown task"):
        numbered.returned(spark, str(path), "OTHER")


def test_lenient_casts_and_last_rows(spark):
    rows = spark.createDataFrame([("f", 2, "k", "7"), ("f", 9, "k", "x"), ("f", 3, "m", " 5 "), ("g", 1, "m", None)], "file string, line long, id string, n string")
    assert {(r["id"], r["line"], r["n"]) for r in numbered.last_rows(numbered.cast(rows, {"n": "int"}), "id").collect()} == {("k", 9, None), ("m", 1, None)}
    assert numbered.cast(rows, {"n": "int"}).agg(F.sum("n")).first()[0] == 12

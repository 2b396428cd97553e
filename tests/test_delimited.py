import random

import pyarrow as pa
import pytest

from casegrain.sources import delimited, readers

SCHEMA = "id string, t string, u string"


def written(path, seed, n, sep=","):
    """Records with quotes, separators and line breaks inside quoted fields."""
    rng = random.Random(seed)
    parts = ["a", "é", sep, '""', "\n", " ", "\n\n", "x y", "'"]
    with open(path, "w", encoding="utf-8", newline="") as out:
        for i in range(n):
            fields = [str(i)]
            for _ in range(2):
                text = "".join(rng.choices(parts, k=rng.choice([0, 3, 12, 200 if i % 50 == 0 else 5])))
                quoted = rng.random() < 0.7
                fields.append(f'"{text}"' if quoted else text.replace("\n", " ").replace(sep, ";").replace('""', "q"))
            out.write(sep.join(fields) + "\n")


def multi_line(spark, path, sep, header=False):
    reader = spark.read.options(**readers.CSV_OPTIONS).option("sep", sep).option("header", header)
    return sorted(map(str, reader.csv(path, schema=SCHEMA).collect()))


@pytest.mark.parametrize("sep", [",", "\t"])
def test_many_splits_equal_one_task(spark, tmp_path, sep):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, n in enumerate((400, 1, 60)):
        written(str(folder / f"f{i}.csv"), i, n, sep)
    expected = multi_line(spark, str(folder), sep)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = delimited.read_delimited(spark, str(folder), SCHEMA, sep)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        assert sorted(map(str, rows.collect())) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_header_blank_lines_and_carriage_returns(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'id,t,u\r\n1,"a\r\nb",c\r\n\r\n2,"say ""so""",\r\n3,5" wide,"x"\r\n')
    rows = sorted(map(tuple, delimited.read_delimited(spark, str(path), SCHEMA, header=True).collect()))
    assert rows == [("1", "a\r\nb", "c"), ("2", 'say "so"', None), ("3", '5" wide', "x")]
    (tmp_path / "empty.csv").write_text("")
    assert delimited.read_delimited(spark, str(tmp_path / "empty.csv"), SCHEMA).count() == 0


@pytest.mark.parametrize("line, inside, expected", [
    ("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True),
    ('a,b"c', False, False), ('x",y', True, False), ('x""', True, True), ("x", True, True),
    ('x","y', True, True), ('"a"b,"c', False, True), ('"a",""', False, False), ('""', True, True), ('"\r', True, False),
])
def test_how_a_line_ends(line, inside, expected):
    assert delimited.ends_inside(line, inside, ",") is expected


def test_few_lines_are_python_objects_at_once(monkeypatch):
    monkeypatch.setattr(delimited, "LINES_AT_ONCE", 3)
    monkeypatch.setattr(delimited, "TEXT_AT_ONCE", 20)
    lines = [f"{i},\"a" if i % 2 else f"b\",{i}" for i in range(1, 40)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["f"] * len(lines)), pa.array([0] * len(lines), pa.int64()), pa.array(lines)], ["file", "start", "line"])

    class Chained:
        value = ({}, set())

    found = list(delimited._records(",", False, Chained)(iter([batch])))
    assert max(b.num_rows for b in found) <= 5 < len(found)
    assert [t for b in found for t in b.column("text").to_pylist()] == [
        "\n".join(lines[i: i + 2]) for i in range(0, len(lines), 2)]

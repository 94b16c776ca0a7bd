"""A1: rows are numbered by list, file and place, however Spark cuts the files."""

import pytest

from riskflow.schema import RAW_TX
from riskflow.sources import io

COLS = [f.name for f in RAW_TX.fields if f.name != "tie"]


def write(path, times, header=True):
    lines = [",".join(COLS)] * header + [",".join({"cc_num": f"c{t % 3}", "unix_time": str(t), "amt": "1.5", "category": "x" * (t % 40)}.get(c, "") for c in COLS) for t in times]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def tiny_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def order(df):
    rows = df.select("tie", "unix_time").collect()
    assert sorted(r["tie"] for r in rows) == list(range(len(rows)))
    return [r["unix_time"] for r in sorted(rows)]


@pytest.mark.parametrize("most", [0, io.BLOCKS_BROADCAST_BYTES])
def test_folder_file_and_similar_names(spark, tmp_path, tiny_blocks, monkeypatch, most):
    monkeypatch.setattr(io, "BLOCKS_BROADCAST_BYTES", most)
    folder = tmp_path / "folder"
    for i, name in enumerate(["part-2.csv", "part-0.csv", "part-1.csv"]):
        write(folder / name, range(1000 * (i + 1), 1000 * (i + 1) + 150 + 40 * i))
    last = write(tmp_path / "old_tx.csv", range(50))
    first = write(tmp_path / "tx.csv", range(500, 620))
    empty = write(tmp_path / "zero.csv", [])
    read = io.read_transactions(spark, [first, str(tmp_path / "missing.csv"), str(folder), empty, last])
    want = [*range(500, 620), *range(2000, 2190), *range(3000, 3230), *range(1000, 1150), *range(50)]
    assert order(read) == want
    assert order(read.repartition(5)) == want
    assert order(read.where("unix_time >= 0")) == want
    assert "tie" in read.columns and read.where("tie = 5").first()["unix_time"] == 505


def test_a_file_listed_twice_counts_twice(spark, tmp_path, tiny_blocks):
    one = write(tmp_path / "a" / "one.csv", range(90))
    assert order(io.read_transactions(spark, [str(tmp_path / "a"), one])) == [*range(90), *range(90)]


def test_many_blocks_in_several_ranges(spark, tmp_path, tiny_blocks, monkeypatch):
    monkeypatch.setattr("riskflow.operators.ordering.ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(io.running_totals, "__defaults__", (False, None, 3, "cum_"))
    for i in range(4):
        write(tmp_path / f"p{i}.csv", range(i * 200, i * 200 + 200))
    assert order(io.read_transactions(spark, [str(tmp_path)])) == list(range(800))


def test_nothing_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.read_transactions(spark, [str(tmp_path / "none.csv")])

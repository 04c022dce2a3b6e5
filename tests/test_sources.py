import pytest

from headmint.sources.tables import PEOPLE, TARGETS, Datasets, read_csv, read_parquet, write_csv, write_parquet


def test_csv_and_parquet_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("b", 0.5, 7), ("a,\"q\"", None, 9)], TARGETS)
    write_csv(t, f"file://{tmp_path}/t", ["name"])
    assert [tuple(r) for r in read_csv(spark, f"file://{tmp_path}/t", TARGETS).collect()] == [('a,"q"', None, 9), ("b", 0.5, 7)]
    write_parquet(t, f"file://{tmp_path}/p")
    assert read_parquet(spark, f"file://{tmp_path}/p", ["name"]).columns == ["name"]
    write_csv(spark.createDataFrame([], PEOPLE), f"file://{tmp_path}/e", ["slug"])
    assert read_csv(spark, f"file://{tmp_path}/e", PEOPLE).count() == 0


def test_dataset_is_fetched_once_and_completely(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/src")
    data = next((tmp_path / "src").glob("part-*.parquet")).read_bytes()
    calls = []

    def fetch(name):
        calls.append(name)
        yield data[:10]
        yield data[10:]

    d = Datasets(str(tmp_path / "cache"), ["numbers", "broken"], fetch)
    assert d.read(spark, "numbers").count() == 3 and d.read(spark, "numbers").count() == 3 and calls == ["numbers"]
    with pytest.raises(KeyError):
        d.path("unknown")

    def fail(name):
        yield b"x"
        raise OSError("cut off")

    with pytest.raises(OSError, match="cut off"):
        Datasets(str(tmp_path / "cache"), ["broken"], fail).path("broken")
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["numbers.parquet"]
    with pytest.raises(FileNotFoundError):
        Datasets(str(tmp_path / "cache"), ["broken"]).path("broken")

import pytest

from kilocast.errors import InvalidOperation
from kilocast.plans.storage import pin, remove, shared_folder, subfolders
from kilocast.schemas import DATA_TABLES
from kilocast.sources.files import cast_years, read_table, write_table


def test_csv_with_byte_order_mark_and_free_column_order(spark, tmp_path):
    path = tmp_path / "gdp.csv"
    path.write_bytes("﻿value,model_year,geography\n50.5,2025,x\n".encode())
    df = read_table(spark, str(path), DATA_TABLES["gdp"])
    assert df.collect() == [(50.5, 2025, "x")]
    assert dict(df.dtypes)["model_year"] == "bigint"


def test_csv_types_are_inferred_without_schema(spark, tmp_path):
    path = tmp_path / "gdp.csv"
    path.write_text("geography,model_year,value\nx,2025,50.5\n")
    assert dict(read_table(spark, str(path)).dtypes)["value"] == "double"


@pytest.mark.parametrize("suffix", [".csv", ".parquet"])
def test_round_trip_and_overwrite(spark, tiny, tmp_path, suffix):
    path = str(tmp_path / f"out{suffix}")
    write_table(tiny["gdp"], path)
    back = read_table(spark, path, DATA_TABLES["gdp"])
    assert sorted(back.collect()) == sorted(tiny["gdp"].collect())
    with pytest.raises(Exception, match="(?i)exist"):
        write_table(tiny["gdp"], path)
    write_table(tiny["gdp"].limit(1), path, overwrite=True)
    assert read_table(spark, path, DATA_TABLES["gdp"]).count() == 1


def test_nested_parquet_folders(spark, tiny, tmp_path):
    write_table(tiny["gdp"], str(tmp_path / "all.parquet/a/part.parquet"))
    write_table(tiny["gdp"], str(tmp_path / "all.parquet/b/part.parquet"))
    assert read_table(spark, str(tmp_path / "all.parquet")).count() == 2 * tiny["gdp"].count()


def test_other_suffixes_are_refused(spark, tiny, tmp_path):
    with pytest.raises(NotImplementedError):
        read_table(spark, str(tmp_path / "x.json"))
    with pytest.raises(NotImplementedError):
        write_table(tiny["gdp"], str(tmp_path / "x.json"))


def test_year_ids_become_numbers(spark):
    df = spark.createDataFrame([("2025", "7")], "model_year string, other string")
    assert cast_years(df).dtypes == [("model_year", "bigint"), ("other", "string")]


def test_pin_keeps_rows_without_a_hint(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    path = str(tmp_path / "t" / "pinned")
    kept = pin(df, path)
    assert kept.count() == 100
    assert "ResolvedHint" not in kept._jdf.queryExecution().analyzed().toString()
    assert shared_folder(spark) == shared_folder(spark)
    assert subfolders(spark, str(tmp_path / "t")) == ["pinned"]
    remove(spark, path)
    assert subfolders(spark, str(tmp_path / "t")) == []


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(InvalidOperation):
        shared_folder(Session())


def test_partition_columns_come_back(spark, tiny, tmp_path):
    path = str(tmp_path / "by_year.parquet")
    tiny["gdp"].write.partitionBy("model_year").parquet(path)
    assert set(read_table(spark, path).columns) == {"geography", "model_year", "value"}

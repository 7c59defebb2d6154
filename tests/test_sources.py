"""Tables as single files and as folders of part files."""

import pytest
from pyspark.errors import AnalysisException

from tillflow.sources.tables import table, table_stream


def streamed(spark, folder, name, tmp_path):
    query = (table_stream(spark, folder, name).writeStream.format("memory").queryName(f"rows_{tmp_path.name[-1]}_{name}")
             .option("checkpointLocation", f"{tmp_path}/checkpoint-{folder[-1]}").trigger(availableNow=True).start())
    query.awaitTermination(120)
    return spark.table(f"rows_{tmp_path.name[-1]}_{name}")


def test_a_foldered_table_streams_all_its_rows(spark, folder, tmp_path):
    parts = f"{tmp_path}/parts"
    events = table(spark, folder, "events")
    events.repartition(3).write.parquet(f"{parts}/events.parquet")
    table(spark, folder, "region").write.parquet(f"{parts}/events_old.parquet")
    got = streamed(spark, parts, "events", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.collect()))


def test_a_single_file_streams_all_its_rows(spark, folder, tmp_path):
    assert streamed(spark, folder, "events", tmp_path).count() == table(spark, folder, "events").count()


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        table_stream(spark, str(tmp_path), "events")

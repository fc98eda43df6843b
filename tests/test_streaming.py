"""Queries over streams."""

import pytest

from pathquill.api import Tables
from pathquill.errors import EngineError
from pathquill.streaming.files import filtered, over_stream


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(20)], "id long, k int, name string")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    tables = Tables(spark).register("t", df, "id")
    got = filtered(spark, tables, "@t/[k = 1] and /[name re \"[05]$\"] | /id", str(tmp_path / "t"))
    assert sorted(r.id for r in got.collect()) == [i for i in range(20) if i % 3 == 1 and str(i)[-1] in "05"]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    for text in ("@t/* | count", "@t/* | limit 3", "@t/* | asc /id", "@t/* | del"):
        with pytest.raises(EngineError):
            over_stream(stream, tables, text)
    assert over_stream(stream, tables, "@t/* | all - /k").columns == ["id", "name"]

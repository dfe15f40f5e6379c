import os

from curaspark.llm import runtime


def test_staged_tables_and_sweep(spark):
    df = runtime.staged(spark.range(5), "five")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    own = runtime._own(spark).removeprefix("file:")
    assert os.path.isdir(own)
    runtime.sweep(spark)
    assert not os.path.exists(own)
    assert runtime.staged(spark.range(0), "none").count() == 0

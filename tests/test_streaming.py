"""The incremental job: files that arrive in two rounds are each validated once."""

import datetime

from statelens.streaming import incremental as S


def test_new_files_are_validated_once(spark, tmp_path):
    source, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    at = datetime.datetime(2024, 1, 1)
    good = "@startuml\n[*] --> A\nA --> [*]\n@enduml"
    for round_, rows in enumerate([[("a", good, at), ("b", "", at)], [("c", good, at)]]):
        spark.createDataFrame(rows, S.SCHEMA).write.mode("append").parquet(source)
        S.validate_stream(spark, source, target, cp).awaitTermination()
        got = {r.diagram_id: r.strict_valid for r in spark.read.parquet(target).collect()}
        assert got == ({"a": True, "b": False} if round_ == 0 else {"a": True, "b": False, "c": True})


def test_windows(spark):
    rows = [("a", "@startuml\n@enduml", datetime.datetime(2024, 1, 1, 0, 5)), ("b", "x", datetime.datetime(2024, 1, 1, 0, 50)), ("c", None, datetime.datetime(2024, 1, 1, 3, 0))]
    got = sorted((r.window.start.hour, r.n, r.complete) for r in S.validity_over_time(spark.createDataFrame(rows, S.SCHEMA)).collect())
    assert got == [(0, 2, 1), (3, 1, 0)]

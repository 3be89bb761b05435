"""Progress and readiness as a stream and as a batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryline.streaming import campaigns

START = dt.datetime(2025, 1, 1, 8)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


LINES = [
    ("a", 0, "nothing to see"),
    ("a", 10, "[EN CURSO] Paso 03 | reading | 12 s"),
    ("a", 20, "[ETAPA] 4/9 | masks"),
    ("a", 25, "[RESUME] masks reutilizado"),
    ("a", 30, "[EN CURSO] masks"),
    ("a", 40, "[PROGRESO] Paso 04 | view 3 of 25 | Tiempo total 3 s"),
    ("a", 45, "[EN CURSO] something outside"),
    ("a", 50, "[PROGRESO] 04_masks.py | view 3 of 25 | 14.5 s"),
    ("a", 55, "[INICIO] Procesando paso 04..."),
    ("a", 58, "[CPU] Completado: x"),
    ("a", 900, "[PROGRESO] view 4 of 25"),
    ("a", 910, "[RESUME] later reutilizado"),
    ("b", 5, "[ETAPA] 1/9 | pairs"),
    ("b", 6, "[RESUME] pairs reutilizado"),
    ("b", 7, "[CPU] pairs | 8 cores"),
    ("b", 950, "[ETAPA] 2/9 | depth"),
    ("c", 2000, "[ETAPA] 1/9 | pairs"),
]


def told(rows):
    return sorted((r["campaign"], (r["ts"] - START).total_seconds(), r["event"], r["stage"], r["activity"], r["stage_s"], r["activity_s"], r["total_s"]) for r in rows)


WANT = sorted([
    ("a", 10.0, "activity", None, "reading", 10.0, 10.0, 10.0),
    ("a", 20.0, "stage", "4/9 | masks", campaigns.OPENED, 0.0, 10.0, 20.0),
    ("a", 25.0, "activity", "4/9 | masks", "masks reutilizado", 5.0, 5.0, 25.0),
    ("a", 40.0, "activity", "4/9 | masks", "view 3 of 25", 20.0, 20.0, 40.0),
    ("a", 658.0, "silent", "4/9 | masks", "view 3 of 25", 638.0, 618.0, 658.0),
    ("a", 900.0, "activity", "4/9 | masks", "view 4 of 25", 880.0, 860.0, 900.0),
    ("a", 1510.0, "silent", "4/9 | masks", "view 4 of 25", 1490.0, 610.0, 1510.0),
    ("b", 5.0, "stage", "1/9 | pairs", campaigns.OPENED, 0.0, 0.0, 0.0),
    ("b", 6.0, "activity", "1/9 | pairs", "pairs reutilizado", 1.0, 1.0, 1.0),
    ("b", 7.0, "activity", "1/9 | pairs", "pairs | 8 cores", 2.0, 2.0, 2.0),
    ("b", 607.0, "silent", "1/9 | pairs", "pairs | 8 cores", 602.0, 600.0, 602.0),
    ("b", 950.0, "stage", "2/9 | depth", campaigns.OPENED, 0.0, 943.0, 945.0),
    ("b", 1550.0, "silent", "2/9 | depth", campaigns.OPENED, 600.0, 600.0, 1545.0),
    ("c", 2000.0, "stage", "1/9 | pairs", campaigns.OPENED, 0.0, 0.0, 0.0),
], key=str)
SCHEMA = "campaign string, ts timestamp, line string"


def test_progress_of_a_batch(spark):
    rows = [(c, at(s), t) for c, s, t in LINES]
    df = spark.createDataFrame([*rows, *rows[3:9], (None, at(1), "[ETAPA] x"), ("a", None, "[ETAPA] x"), ("a", at(3), None)], SCHEMA)
    assert sorted(told(campaigns.progress(df).collect()), key=str) == WANT
    assert campaigns.progress(df.where("false")).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(frame, out, checkpoint):
    frame.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_progress_of_a_stream_is_that_of_a_batch(spark, tmp_path, rocks):
    """Batch by batch, restarted from its checkpoint each time, with repeated and late lines."""
    lines = sorted(LINES, key=lambda x: x[1])
    parts = [lines[:4], [*lines[4:9], lines[2]], [*lines[9:12], ("a", 1, "[ETAPA] far too late")], lines[12:]]
    source, out, checkpoint = (tmp_path / x for x in ("in", "out", "ck"))
    for part in parts:
        put(spark, source, [(c, at(s), t) for c, s, t in part], SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        run(campaigns.progress(stream), out, checkpoint)
    assert sorted(told(spark.read.parquet(str(out)).collect()), key=str) == WANT


CAPTURED, CLOSED = "session string, ts timestamp, views int", "session string, ts timestamp, steps int, flag string"
TURN = campaigns.STEPS_PER_TURN
CAPTURES = [("s1", at(0), 25), ("s2", at(60), 24), ("s3", at(120), 25), ("s4", at(180), 25), ("s5", at(240), 25), ("s1", at(5), 25)]
CLOSURES = [("s1", at(900), TURN, "1"), ("s2", at(950), TURN, "1"), ("s3", at(1000), TURN - 1, "1"), ("s5", at(9000), TURN, "1"), ("s1", at(905), TURN, "0"), ("s9", at(10), TURN, "1")]
READY = {"s1": (True, None), "s2": (False, "views"), "s3": (False, "turn"), "s4": (False, "closure"), "s5": (False, "closure")}


def test_readiness_of_a_batch(spark):
    got = campaigns.ready_sessions(spark.createDataFrame([*CAPTURES, (None, at(0), 25)], CAPTURED), spark.createDataFrame(CLOSURES, CLOSED)).collect()
    assert len(got) == len(READY) and {r["session"]: (r["ready"], r["reason"]) for r in got} == READY


def test_readiness_of_a_stream(spark, tmp_path):
    """Each session once, also after a restart, and without a closure once none can come."""
    out, checkpoint = tmp_path / "out", tmp_path / "ck"
    steps = [(CAPTURES[:3], CLOSURES[:1]), (CAPTURES[3:], [CLOSURES[1], CLOSURES[4], CLOSURES[2]]), ([("late", at(20_000), 25)], [CLOSURES[3], ("late", at(20_010), TURN, "1")]), ([("end", at(40_000), 25)], [("end", at(40_001), TURN, "1")])]
    for captures, closures in steps:
        put(spark, tmp_path / "captures", captures, CAPTURED)
        put(spark, tmp_path / "closures", closures, CLOSED)
        run(campaigns.ready_sessions(spark.readStream.schema(CAPTURED).parquet(str(tmp_path / "captures")), spark.readStream.schema(CLOSED).parquet(str(tmp_path / "closures"))), out, checkpoint)
    got = spark.read.parquet(str(out)).where(~F.col("session").isin("late", "end")).collect()
    assert len(got) == len(READY) and {r["session"]: (r["ready"], r["reason"]) for r in got} == READY

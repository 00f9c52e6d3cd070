import datetime as dt

from pyspark.sql import functions as F

from tests.compare import rows
from lectern import schemas
from lectern.sources import html as H
from lectern.streaming import events as E

START = dt.datetime(2024, 1, 1)


def events(spark, items):
    data = [(i, START + dt.timedelta(milliseconds=ms), user, "click", 0.0, None) for i, (user, ms) in enumerate(items)]
    return spark.createDataFrame(data, schemas.EVENT)


def test_debounce(spark):
    e = events(spark, [(1, 0), (1, 100), (1, 250), (1, 900), (2, 50), (2, 350), (2, 649)])
    got = E.debounce(e, ["user_id"], 300, block_ms=200)
    assert rows(got, "event_id") == [(2,), (3,), (4,), (6,)]
    plain = E.debounce(e.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["user_id"], 300)
    assert rows(plain, "event_id") == rows(got, "event_id")


def test_streams_equal_batches(spark, tmp_path):
    e = events(spark, [(u, ms) for u in (1, 2, 3) for ms in (0, 100, 400, 699, 2000, 2100, 9000 + u)])
    folder = str(tmp_path / "in")
    for part in range(3):
        e.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)

    state = {}

    def keep(batch, _):
        state.update({(r.user_id,): (r.bookmarked, r.flips) for r in batch.collect()})

    stream = E.read_event_stream(spark, folder, schemas.EVENT, per_trigger=1)
    E.run_available(E.toggle_state(stream, ["user_id"]), keep, str(tmp_path / "c1"), mode="update")
    batch = {(r.user_id,): (r.bookmarked, r.flips) for r in E.toggle_state(e, ["user_id"]).collect()}
    assert state == batch

    quiet = []

    def collect(batch, _):
        quiet.extend((r.user_id, r.event_id) for r in batch.collect())

    # One more far event closes the last sessions of the stream.
    events(spark, [(9, 3_600_000)]).withColumn("event_id", F.lit(999).cast("bigint")).write.mode("append").parquet(folder)
    stream = E.read_event_stream(spark, folder, schemas.EVENT)
    E.run_available(E.debounce_stream(stream, ["user_id"]), collect, str(tmp_path / "c2"))
    assert sorted(quiet) == sorted((r.user_id, r.event_id) for r in E.debounce(e, ["user_id"]).collect())


def test_ingest_takes_only_new_pages(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("pages", "out", "mark"))

    def add(*ids):
        spark.createDataFrame([(i, f"u{i}", f"<p>page {i}</p>") for i in ids], schemas.PAGE).coalesce(1).write.mode("append").parquet(folder)

    def run():
        E.ingest_pages(spark, folder, schemas.PAGE, H.shred_html, out, mark)
        return rows(spark.read.parquet(out), "page_id", "text")

    add(1, 2)
    assert run() == [(1, "page 1"), (2, "page 2")]
    assert run() == [(1, "page 1"), (2, "page 2")]
    add(3)
    assert run() == [(1, "page 1"), (2, "page 2"), (3, "page 3")]

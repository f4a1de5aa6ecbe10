"""Newest-first buffers over streams, and hashes of large files."""

import datetime as dt
import hashlib
import random

from tierwatch.operators import logs
from tierwatch.streaming import incremental, recent

LOG = "event_id bigint, timestamp timestamp, level string, message string"


def _records(spark, n, seed):
    rng = random.Random(seed)
    start = dt.datetime(2025, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(40)), rng.choice(["DEBUG", "INFO", "ERROR"]), f"m{i}") for i in range(n)]
    rows.append((n, None, "INFO", "without a time"))
    rng.shuffle(rows)
    return rows


def test_buffer_equals_the_batch_query_after_every_batch(spark, tmp_path):
    rows = _records(spark, 90, 4)
    landing, root = str(tmp_path / "landing"), str(tmp_path / "buffer")
    for upto in (1, 20, 25, 91):
        seen = spark.createDataFrame(rows[:upto], LOG)
        fresh = spark.createDataFrame(rows[{1: 0, 20: 1, 25: 20, 91: 25}[upto]:upto], LOG)
        fresh.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(LOG).parquet(landing)
        recent.stream_recent_logs(stream, root, str(tmp_path / "ckpt"), 12, ordinal="event_id").awaitTermination()
        want = logs.recent_logs(seen, 12, ordinal="event_id").collect()
        assert sorted(recent.read_buffer(spark, root, seen.schema).collect(), key=str) == sorted(want, key=str)


def test_a_replayed_batch_replaces_its_own_slot(spark, tmp_path):
    root = str(tmp_path / "buffer")
    newest = lambda df: logs.recent_logs(df, 3, ordinal="event_id")
    parts = [spark.createDataFrame(_records(spark, 6, s)[:4], LOG) for s in (1, 2, 3)]
    for i, part in enumerate(parts):
        recent.buffer_batch(part, i, root, newest)
    once = sorted(recent.read_buffer(spark, root, parts[0].schema).collect(), key=str)
    recent.buffer_batch(parts[2], 2, root, newest)
    assert sorted(recent.read_buffer(spark, root, parts[0].schema).collect(), key=str) == once
    assert len(once) == 3


def test_no_buffer_and_empty_batches(spark, tmp_path):
    root = str(tmp_path / "buffer")
    none = spark.createDataFrame([], LOG)
    assert recent.read_buffer(spark, root, none.schema).count() == 0
    recent.buffer_batch(none, 0, root, logs.recent_logs)
    assert recent.read_buffer(spark, root, none.schema).count() == 0


def test_files_beyond_two_gigabytes_are_hashed_in_blocks(spark, tmp_path):
    big = tmp_path / "large upload 100%.csv"
    with open(big, "wb") as f:
        f.write(b"supplier_id\n")
        f.truncate((1 << 31) + 5)               # sparse: takes no disk
    (tmp_path / "empty.csv").write_bytes(b"")       # not listed: no contents
    (tmp_path / "small.csv").write_bytes(b"x" * 1000)
    want = {}
    for p in tmp_path.iterdir():
        with open(p, "rb") as f:
            want[p.name] = hashlib.file_digest(f, "sha256").hexdigest()
    del want["empty.csv"]
    rows = incremental.file_hashes(spark, str(tmp_path)).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["content_sha256"] for r in rows} == want
    few = incremental.file_hashes(spark, str(tmp_path), "small*", whole=10).collect()
    assert [r["content_sha256"] for r in few] == [want["small.csv"]]

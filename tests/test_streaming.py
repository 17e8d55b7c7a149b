"""Streams in several drains: late rows, repeated batches, restarts, state that ends."""

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from threadline.operators.signals import extract_signals
from threadline.plans import stream_queries
from threadline.plans.registry import Inputs
from threadline.schemas import OBSERVATION
from threadline.streaming.signals import EdgeCountStream, SignalStream, edge_counts, read_observation_stream

DAY = dt.datetime(2024, 3, 1)
EDGE = EdgeCountStream.EDGE


def observation(n, text, hours):
    when = None if hours is None else DAY + dt.timedelta(hours=hours)
    return ("C", "EV", f"ART-{n}", "JOB", f"O-{n}", "DOCUMENT_TEXT", "Page 1", "k", text, 1.0, "note", when)


def arrive(spark, folder, rows):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OBSERVATION.fields) + ", observed_at timestamp"
    frame = spark.createDataFrame(rows, schema)
    frame.coalesce(1).write.mode("append").parquet(folder)
    return frame




def test_signals_late_restart_and_rebuild(spark, tmp_path):
    source, root = f"{tmp_path}/source", f"{tmp_path}/root"
    batches = [
        [observation(1, "mail a@x.org", 0), observation(2, "mail b@x.org", 1)],
        [observation(1, "mail a@x.org", 2), observation(3, "mail c@x.org", 200)],  # the first again, within the delay
        [observation(4, "mail d@x.org", 3), observation(5, "mail e@x.org", 201), observation(6, "mail f@x.org", None)],  # late; without a time
        [observation(2, "mail b@x.org", 300), observation(4, "mail d@x.org", 302)],  # a repeat after its state ended
    ]
    frames = []
    for rows in batches:  # each drain is a stream of its own that starts from the checkpoint
        frames.append(arrive(spark, source, rows))
        stream = SignalStream(spark, root, delay=24 * 3600)
        stream.drain(read_observation_stream(spark, source))
    late = {r.observation_id for r in stream.late().collect()}
    assert late == {"O-4", "O-6"}
    accepted = sorted((r.observation_id, r.observed_at) for r in stream.accepted().collect())
    assert [i for i, _ in accepted] == ["O-1", "O-2", "O-2", "O-3", "O-4", "O-5"]
    everything = frames[0]
    for frame in frames[1:]:
        everything = everything.unionByName(frame)
    expected = {r.signal_key for r in extract_signals(everything).collect()}
    table = stream.rebuild()
    assert sorted(r.signal_key for r in table.collect()) == sorted(expected)
    assert {r.observation_id: r.observed_at for r in table.collect()}["O-4"] == DAY + dt.timedelta(hours=3)
    # Nothing new: the table stays; a later drain is merged into it.
    assert sorted(r.signal_key for r in stream.rebuild().collect()) == sorted(expected)
    arrive(spark, source, [observation(7, "mail g@x.org", 1), observation(8, "mail h@x.org", 310)])
    stream = SignalStream(spark, root, delay=24 * 3600)
    stream.drain(read_observation_stream(spark, source))
    assert {r.observation_id for r in stream.rebuild().collect()} == {f"O-{n}" for n in range(1, 9)}


def test_signal_state_is_bounded_by_the_watermark(spark, tmp_path):
    source, root = f"{tmp_path}/source", f"{tmp_path}/root"
    stream = SignalStream(spark, root, delay=3600)
    for day in range(4):
        arrive(spark, source, [observation(100 * day + n, f"mail m{day}-{n}@x.org", 24 * day) for n in range(50)])
        stream.drain(read_observation_stream(spark, source))
    commits = sorted((pathlib.Path(root) / "state-once" / "offsets").iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)
    marks = [json.loads(p.read_text().splitlines()[1])["batchWatermarkMs"] for p in commits if p.name.isdigit()]
    assert marks == sorted(marks) and marks[-1] == int((DAY + dt.timedelta(hours=71)).replace(tzinfo=dt.UTC).timestamp() * 1000)
    held = spark.read.format("statestore").load(f"{root}/state-once")
    assert held.count() == 50  # the last day; the three before it are gone
    assert stream.accepted().count() == 200


def edges(rows):
    return [("C", s, t, None if h is None else DAY + dt.timedelta(hours=h)) for s, t, h in rows]


def drained(spark, tmp_path, batches, delay=24 * 3600):
    source = f"{tmp_path}/edges"
    for rows in batches:
        spark.createDataFrame(edges(rows), EDGE).coalesce(1).write.mode("append").parquet(source)
        stream = EdgeCountStream(spark, f"{tmp_path}/counts", "1 day", delay)
        stream.drain(spark.readStream.schema(EDGE).parquet(source))
    return stream, spark.read.parquet(source)


def counted(frame):
    return sorted(tuple(r) for r in frame.select(*EdgeCountStream.KEYS, "interactions").collect())


BATCHES = [
    [("a", "b", 0), ("a", "b", 1), ("c", "d", 5)],
    [("a", "b", 2), ("a", "b", 900)],  # the first window is still open: counted on
    [("a", "b", 3), ("c", "d", 4), ("c", "d", 901), ("e", "f", 890)],  # two late edges
    [("a", "b", 902), ("c", "d", 2), ("e", "f", 891)],
]


def test_edge_counts_with_late_edges(spark, tmp_path):
    stream, everything = drained(spark, tmp_path, BATCHES)
    assert stream.split.late(everything.schema).count() == 3
    assert counted(stream.counts()) != counted(edge_counts(everything))
    stream.merge_late()
    assert counted(stream.counts()) == counted(edge_counts(everything))
    # An open window goes on counting after its late edges were merged.
    stream, everything = drained(spark, tmp_path, [[("c", "d", 903), ("a", "b", 1)]])
    stream.merge_late()
    assert counted(stream.counts()) == counted(edge_counts(everything))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    stream, everything = drained(spark, tmp_path, BATCHES[:2])
    before, paths = counted(stream.counts()), stream.table.paths()
    again = spark.createDataFrame(edges([("a", "b", 0)] * 7), EDGE)
    for number in (0, 1):
        stream.take(edge_counts(again), number)
    stream.merge_late()
    stream.merge_late()
    assert counted(stream.counts()) == before == counted(edge_counts(everything))
    assert stream.table.paths() == paths


def test_a_batch_that_failed_before_its_commit_is_taken_once(spark, tmp_path, monkeypatch):
    stream = EdgeCountStream(spark, f"{tmp_path}/counts")
    counts = edge_counts(spark.createDataFrame(edges([("a", "b", 0), ("a", "b", 1)]), EDGE))
    with monkeypatch.context() as patch:
        patch.setattr(stream.table, "_ledger", lambda: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            stream.table.commit("counts-0", counts.select(
                *stream.KEYS, F.col("interactions").alias("counted"), F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("late")
            ), stream._slot(), stream._merge)
    assert stream.counts().count() == 0
    stream.take(counts, 0)
    stream.take(counts, 0)
    assert [r.interactions for r in stream.counts().collect()] == [2]


def test_reading_costs_one_table(spark, tmp_path):
    stream, _ = drained(spark, tmp_path, BATCHES)
    files = stream.counts().inputFiles()
    assert len(files) == len(stream.table.paths()) == 2  # one file for each month
    assert "Exchange" not in stream.counts()._jdf.queryExecution().executedPlan().toString()
    kept = [p for p in pathlib.Path(f"{tmp_path}/counts/table/rows").rglob("_slot=*") if p.is_dir()]
    assert len(kept) <= 2 * len(files)  # replaced files are deleted


def test_late_batches_are_counted_in_one_commit(spark, tmp_path):
    stream, everything = drained(spark, tmp_path, BATCHES)
    late = {r.batch for r in stream.split.late(everything.schema).select("batch").distinct().collect()}
    assert len(late) == 2
    stream.merge_late()
    ledger = stream.table._ledger().filter("entry like 'late-%'")
    assert {r.entry for r in ledger.collect()} == {f"late-{n}" for n in late}
    assert ledger.select("at").distinct().count() == 1 and all(stream.table.committed(f"late-{n}") for n in late)
    paths = stream.table.paths()
    stream.merge_late()
    assert stream.table.paths() == paths and counted(stream.counts()) == counted(edge_counts(everything))


def test_a_batch_of_many_files_loses_no_signal(spark, tmp_path):
    """Rows of one batch lie far apart in time: none of its files may move the watermark for the others."""
    source, root = f"{tmp_path}/source", f"{tmp_path}/root"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OBSERVATION.fields) + ", observed_at timestamp"
    rows = [observation(n, f"mail m{n}@x.org", 100 * (40 - n)) for n in range(40)]
    spark.createDataFrame(rows, schema).repartition(8, "observation_id").write.parquet(source)
    stream = SignalStream(spark, root, delay=3600)
    stream.drain(read_observation_stream(spark, source, 8))
    stream.drain(read_observation_stream(spark, source, 8))
    assert stream.accepted().count() == 40


def test_the_arrivals_are_four_batches_of_many_files(spark, data):
    conf = "spark.sql.shuffle.partitions"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "16")
    try:
        seen = []
        arrivals = stream_queries._stream(Inputs(spark, data), "documents", "doc_id")
        running = arrivals.writeStream.foreachBatch(lambda b, n: seen.append((b.select(F.input_file_name()).distinct().count(), b.count()))).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    assert [files for files, _ in seen] == [4] * 4 and sum(n for _, n in seen) == spark.read.parquet(f"{data}/documents.parquet").count()

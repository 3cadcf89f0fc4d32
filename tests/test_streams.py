"""Sinks and logs of change streams against row-by-row Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F, types as T

from siltstone.functions import evolution
from siltstone.operators import reconcile
from siltstone.session import fresh_path
from siltstone.streaming import cdc, handover, stages
from siltstone.streaming.buckets import Buckets, bytes_of, folders, versions
from siltstone.streaming.seen import SeenKeys

CHANGES = "id long, seq long, deleted boolean, value string"


def test_bucket_sink_equals_replay_of_the_log(spark):
    rnd = random.Random(4)
    log = [(rnd.randrange(40), seq, rnd.random() < 0.2, f"v{seq}") for seq in range(300)]
    rnd.shuffle(log)  # late changes in later batches
    sink, want = Buckets(spark, fresh_path(spark, "sink"), buckets=5, deltas=3), {}
    assert sink.read() is None
    for number in range(6):
        some = log[number * 50 : number * 50 + 50]
        for again in range(1 + (number == 3)):  # a batch that is replayed
            sink.put(spark.createDataFrame(some, CHANGES), number)
        for k, seq, deleted, v in some:
            if seq > want.get(k, (-1,))[0]:
                want[k] = (seq, deleted, v)
        assert {r.id: (r.seq, r.value) for r in sink.read().collect()} == {k: (s, v) for k, (s, d, v) in want.items() if not d}
    assert versions(spark, f"{sink.path}/base")  # compacted on the way
    base, deltas = sink.layout()
    assert all(len(some) < 3 for some in deltas.values()) and set(base) <= set(range(5))


def test_a_batch_writes_what_it_holds_and_touches_its_buckets_only(spark):
    sink = Buckets(spark, fresh_path(spark, "sink"), buckets=8, deltas=100)
    sink.put(spark.range(20_000).select("id", F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted"), F.sha2(F.col("id").cast("string"), 256).alias("value")), 0)
    whole = bytes_of(spark, sink.path)
    for number, keys in ((1, [7]), (2, [7, 8, 9])):
        sink.put(spark.createDataFrame([(k, number, False, "x") for k in keys], CHANGES), number)
        touched = {r.b for r in spark.createDataFrame([(k,) for k in keys], "id long").select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
        assert set(folders(spark, f"{sink.path}/delta/v={number}", "bucket=")) == touched
        assert bytes_of(spark, f"{sink.path}/delta/v={number}") < whole / 20
    assert sink.read().where("value = 'x'").count() == 3 and sink.read().count() == 20_000


def test_empty_batches_and_new_columns(spark):
    sink = Buckets(spark, fresh_path(spark, "sink"))
    sink.put(spark.createDataFrame([], CHANGES), 0)
    assert sink.read() is None
    sink.put(spark.createDataFrame([(1, 1, False, "a")], CHANGES), 1)
    sink.put(spark.createDataFrame([(2, 2, None, 5.5)], "id long, seq long, deleted boolean, other double"), 2)
    assert {(r.id, r.value, r.other) for r in sink.read().collect()} == {(1, "a", None), (2, None, 5.5)}


@pytest.mark.parametrize("a, b, want", [
    ("int", "bigint", "bigint"), ("bigint", "double", "double"), ("decimal(4,2)", "float", "double"), ("string", "bigint", "string"), ("void", "date", "date"),
    ("struct<x:int>", "struct<x:double,y:string>", "struct<x:double,y:string>"), ("array<int>", "array<double>", "array<double>"), ("array<int>", "struct<x:int>", "string"),
])
def test_common_types(a, b, want):
    a, b = (T._parse_datatype_string(x) for x in (a, b))
    assert evolution.common(a, b).simpleString() == want and evolution.common(a, a) == a


def test_widened_tables_have_one_schema(spark):
    one = spark.createDataFrame([(1, 5, (1, [1]), None), (2, None, None, "t")], "id int, n long, s struct<a:int,l:array<int>>, c string")
    two = spark.createDataFrame([(3, 2.5, (0.5, "z"), (7,))], "id long, n double, s struct<a:double,b:string>, c struct<q:int>")
    both = evolution.widened([one, two])
    assert both[0].schema == both[1].schema
    rows = {r.id: r for r in both[0].unionByName(both[1]).collect()}
    assert rows[1].n == 5.0 and rows[1].s == (1.0, [1], None) and rows[2].s is None and rows[3].s == (0.5, None, "z") and rows[3].c == '{"q":7}' and rows[2].c == "t"


def test_topics_with_types_that_change(spark):
    path, out, dead, log = (fresh_path(spark, n) for n in ("topics", "out", "dead", "log"))
    batches = [['{"id": 1, "seq": 1, "n": 5, "o": {"a": 1}}', '{"id": 2, "seq": 2, "n": null}', "{broken", '{"seq": 3}'], ['{"id": 1, "seq": 4, "n": 5.5, "o": {"a": "x", "b": [1, 2]}}', '{"id": 3, "seq": 5, "deleted": true}']]
    for lines in batches:
        spark.createDataFrame([("db.t", x) for x in lines] + [("other", "{}")], "topic string, line string").coalesce(1).write.mode("append").json(path)
        cdc.apply_topics(spark.readStream.schema("topic string, line string").json(path), out, dead, log, r"^db\.(.*)$").awaitTermination()
    got = cdc.snapshot(spark, f"{out}/t")
    assert dict(got.dtypes) == {"id": "bigint", "n": "double", "o": "struct<a:string,b:array<bigint>>", "seq": "bigint"}
    assert sorted((r.id, r.n, r.o and (r.o.a, r.o.b)) for r in got.collect()) == [(1, 5.5, ("x", [1, 2])), (2, None, None)]
    assert sorted(r.line for r in spark.read.parquet(dead).select("line").collect()) == sorted(["{broken", '{"seq": 3}', "{}", "{}"])


def test_seen_keys_open_few_old_files(spark):
    sink = SeenKeys(spark, fresh_path(spark, "seen"), "k", buckets=4)
    of = lambda keys: spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, t string")
    assert sink.read() is None
    for number in range(5):
        sink.put(of(range(number * 1000, number * 1000 + 1000)), number)
    sink.put(of([50_001]), 5)
    assert sink.opened <= 2  # none, but for the odd key that a filter takes for its own
    sink.put(of([3, 3, 4, 2003, 60_000]), 6)
    assert 2 <= sink.opened <= 8 and sink.read().count() == 5002 == sink.read().select("k").distinct().count()
    sink.put(of([3, 3, 4, 2003, 60_000]), 6)  # again
    sink.put(spark.createDataFrame([(None, "n"), (None, "n"), (60_000, "late")], "k long, t string"), 7)
    sink.put(spark.createDataFrame([(None, "m")], "k long, t string"), 8)
    sink.put(of([]), 9)
    got = {r.k: r.t for r in sink.read().collect()}
    assert len(got) == sink.read().count() == 5003 and got[None] == "n" and got[60_000] == "v60000"


def replayed(steps, stages_of=6):
    out, by = [], {}
    for task, ts, i, stage, status in sorted(steps, key=lambda s: (s[0], s[1], s[2])):
        n, over = by.get(task, (0, False))
        if not over:
            by[task] = (n + 1, status == "FAIL")
            out.append((task, i, stage, status, n + 1, min(100, int((n + 1) * 100 / stages_of + 0.5))))
    return sorted(out)


def test_stage_log_over_restarts_and_late_steps(spark):
    rnd = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    steps = [(t, start + datetime.timedelta(minutes=rnd.randrange(0, 240)), 100 * t + i, f"s{i}", "FAIL" if rnd.random() < 0.15 else "OK") for t in range(12) for i in range(9)]
    path, out, cp = (fresh_path(spark, n) for n in ("steps", "log", "cp"))
    for k in range(6):  # batches by time; a third of the steps come an hour late
        some = [s for s in steps if min(4, (s[1] - start).seconds // 3600 + (s[2] % 3 == 0)) == k] if k < 5 else [(None, start + datetime.timedelta(days=1), None, None, None)]
        if some:
            spark.createDataFrame(some, stages.STEPS).write.mode("append").parquet(path)
        stages.start(stages.until_failure(spark.readStream.schema(stages.STEPS).parquet(path), "2 hours"), out, cp).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("task_id", "id", "stage", "status", "n", "percent").collect())) == replayed(steps)


def test_handover_with_changes_at_every_moment(spark):
    """Chunks are read at any moment between their marks; the log goes on all the time; one chunk is begun anew."""
    rnd = random.Random(7)
    log = [(rnd.randrange(30), seq, rnd.random() < 0.25, f"v{seq}") for seq in range(0, 800, 2)]
    state = lambda at: {k: v for k, v in ((k, [c for c in log if c[0] == k and c[1] <= at][-1]) for k in {c[0] for c in log if c[1] <= at}) if not v[2]}
    marks = [("low", 0, 101), ("high", 0, 181), ("low", 1, 161), ("low", 1, 301), ("high", 1, 399), ("low", 2, 401), ("high", 2, 403)]
    reads = {(0, 101): 150, (1, 161): 170, (1, 301): 380, (2, 401): 402}
    kept = [c for c in log if c[1] >= 90]
    path, own, cp = (fresh_path(spark, n) for n in ("log", "own", "cp"))
    schema = "mark string, chunk long, id long, seq long, deleted boolean, value string"
    rows = [(None, None, *c) for c in kept] + [(m, c, None, s, None, None) for m, c, s in marks]
    sink = Buckets(spark, fresh_path(spark, "sink"), buckets=4)
    chunks = {key: [(key[0], k, v[3]) for k, v in state(at).items() if k % 3 == key[0]] for key, at in reads.items()}

    def read(opened):
        last = {}
        for r in opened.collect():
            last[r.chunk] = max(last.get(r.chunk, 0), r.seq)
        return spark.createDataFrame([x for c, s in last.items() for x in chunks[c, s]], "chunk long, id long, value string")

    for low in range(0, 800, 110):
        some = [r for r in rows if low <= r[3] < low + 110]
        spark.createDataFrame(some, schema).write.mode("append").parquet(path)
        handover.follow(spark.readStream.schema(schema).parquet(path), sink, read, own, cp, ["value"]).awaitTermination()
    assert {r.id: r.value for r in sink.read().collect()} == {k: v[3] for k, v in state(800).items()}


def test_merge_of_plain_tables_is_as_before(spark):
    old = spark.createDataFrame([(1, 5, False, "a")], CHANGES)
    new = spark.createDataFrame([(1, 4, False, "late"), (2, 1, True, "gone")], CHANGES)
    assert {(r.id, r.value) for r in reconcile.present(reconcile.merge(old, new, "id", "seq", "deleted")).collect()} == {(1, "a")}

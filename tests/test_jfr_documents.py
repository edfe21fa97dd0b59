import json
import random

from pyspark.sql import functions as F

from gristmill.sources import jfr_documents as J

THREAD = {"osName": "x", "osThreadId": 3, "javaName": "n, [", "javaThreadId": 5, "group": None, "virtual": False}


def wait(i, **values):
    return {
        "type": "jdk.ThreadPark",
        "values": {
            "startTime": f"2024-01-01T00:00:{i % 60:02d}.5Z", "duration": "PT0.00002S", "eventThread": dict(THREAD, javaName=f'q"{i}\\, }}]'),
            "stackTrace": {"truncated": False, "frames": []}, "address": i, "parkedClass": None, "timeout": None, "until": None,
        } | values,
    }


def judged(spark, documents, threshold=10_000, major=21):
    frame = spark.createDataFrame(list(documents.items()), "capture_id string, document string")
    targets = frame.select("capture_id", F.lit(7).cast("long").alias("target_pid"), F.lit(major).alias("jdk_major"), F.lit(threshold).cast("long").alias("threshold_ns"))
    return J.read_documents(J.pieces_of(frame), targets)


def whole(events, **dump):
    return json.dumps({"recording": {"events": events}}, **dump)


def test_large_document_is_read_by_many_tasks(spark, tmp_path):
    """One document on one line; the splits end inside strings, numbers and escapes."""
    rng = random.Random(1)
    junk = ['\\', '"', ',', '{', ']', "\n", "é", " ", "a"]
    events = [wait(i, eventThread=dict(THREAD, osName="".join(rng.choice(junk) for _ in range(rng.randrange(40))))) for i in range(3000)]
    path = tmp_path / "one.json"
    path.write_text(whole(events, ensure_ascii=False))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30011")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 20
        pieces = J.read_pieces(spark, str(path)).withColumnRenamed("path", "capture_id").checkpoint()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    parts, frames = J.elements(pieces)
    got = [json.loads(r.text) for r in parts.orderBy("source_index").collect()]
    assert got == events
    row = frames.first()
    assert (row.prefix_ok, row.suffix_ok, row.closed, row.events) == (True, True, True, 3000)


def test_verdicts(spark):
    good = [wait(i) for i in range(4)]
    text = whole(good)
    documents = {
        "good": text, "pretty": whole(good, indent=2), "none": whole([]), "blank": '{"recording":{"events":[ \n ]}}',
        "cut in a string": text[:300], "cut behind": text[:-1], "more fields": text[:-2] + ',"x":[1,2]}}', "twice": text + text, "other": '{"recording":{"metadata":1}}',
        "trailing": text[:-3] + ",]}}", "number": text[:-3] + ",7]}}", "array": text[:-3] + ',[{"type":1}]]}}', "empty": "", "bad json": whole(good).replace('"until": null', '"until": nul', 1),
        "float": whole([wait(0), wait(1, address=1.5)]), "field": whole([wait(0, timedOut=None)]), "outer": whole([wait(0) | {"total": 1}]),
        "frames": whole([wait(0, stackTrace={"truncated": False, "frames": [{"method": None}] * 128})]), "no thread": whole([wait(0, eventThread=None)]),
        "no os id": whole([wait(0, eventThread=dict(THREAD, osThreadId=0))]), "virtual": whole([wait(0, eventThread=dict(THREAD, osThreadId=0, virtual=True))]),
        "no mark": whole([wait(0, eventThread={k: v for k, v in THREAD.items() if k != "virtual"})]), "time": whole([wait(0, startTime="2024-13-01T00:00:00Z")]),
        "duration": whole([wait(0, duration="20 ms")]), "short": whole([wait(0), wait(1, duration="PT0.000009S")]),
        "loss": whole([wait(0), {"type": "jdk.DataLoss", "values": {"startTime": "s", "amount": 5, "total": 4}}]),
    }
    found = {r.capture_id: r for r in judged(spark, documents).captures.collect()}
    assert {k: (r.reason, r.source_index) for k, r in found.items()} == {
        "good": (None, None), "pretty": (None, None), "none": (None, None), "blank": (None, None), "cut in a string": ("TRUNCATED", 0), "cut behind": ("TRUNCATED", 3),
        "more fields": ("TRAILING_FIELDS", 3), "twice": ("TRAILING_FIELDS", 3), "other": ("NOT_A_RECORDING", 0), "trailing": ("EMPTY_ELEMENT", 4), "number": ("NOT_AN_OBJECT", 4),
        "array": ("NOT_AN_OBJECT", 4), "empty": ("NOT_A_RECORDING", 0), "bad json": ("NOT_AN_OBJECT", 0), "float": ("INVALID_EVENT", 1), "field": ("INVALID_EVENT", 0),
        "outer": ("INVALID_EVENT", 0), "frames": ("INVALID_EVENT", 0), "no thread": ("INVALID_EVENT", 0), "no os id": ("INVALID_THREAD", 0), "virtual": (None, None),
        "no mark": ("INVALID_THREAD", 0), "time": ("INVALID_TIME", 0), "duration": ("INVALID_DURATION", 0), "short": ("BELOW_THRESHOLD", 1), "loss": ("INVALID_EVENT", 1),
    }
    assert (found["good"].events, found["good"].waits, found["good"].empty_stacks, found["good"].truncated) == (4, 4, 4, True)
    assert (found["none"].events, found["none"].truncated, found["blank"].events) == (0, False, 0)


def test_older_runtimes_have_no_virtual_threads(spark):
    old = [wait(0, eventThread={k: v for k, v in THREAD.items() if k != "virtual"})]
    assert judged(spark, {"a": whole(old)}, major=17).captures.first().accepted


def test_waits_of_accepted_documents(spark):
    read = judged(spark, {"a": whole([wait(5), wait(2)]), "b": whole([wait(0)])[:-1]})
    rows = J.document_waits(read).orderBy("ts_ns").collect()
    assert [(r.capture_id, r.source_event_id, r.ts_ns, r.duration_ns) for r in rows] == [("a", "jfr-event-2", 20_000, 20_000), ("a", "jfr-event-1", 3_000_020_000, 20_000)]
    nothing = judged(spark, {})
    assert nothing.captures.isEmpty() and J.document_waits(nothing).isEmpty()


def test_long_documents_close_once_and_take_little_space(spark):
    """Documents of many chunks, closed, broken off, closed twice; what is written on the way is less than their text."""
    import os

    text = whole([wait(i) for i in range(2000)])
    documents = {"good": text, "cut": text[:-3], "twice": text + text}
    folder = spark.conf.get("spark.checkpoint.dir")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    before = size()
    found = {r.capture_id: (r.reason, r.source_index, r.events) for r in judged(spark, documents).captures.collect()}
    assert found == {"good": (None, None, 2000), "cut": ("TRUNCATED", 1999, 2000), "twice": ("TRAILING_FIELDS", 1999, 2000)}
    assert size() - before < sum(map(len, documents.values()))

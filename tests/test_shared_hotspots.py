import collections

from pyspark.sql import functions as F

from gristmill.operators import hotspots as H
from gristmill.operators import quality as Q
from gristmill.plans import compare_queries as C
from gristmill.sources.folded import plain_frame

STACKS = [
    ("a", 1, 3, "main;f;g"), ("a", 1, 2, "main;f;f;g;f"), ("a", 2, 5, "main"), ("a", 2, 1, "g;g"), ("b", 1, 7, "main;f;[unknown]"),
    ("b", 3, 4, "f;main;f;main"), ("b", None, 1, "x;f"),
]


def samples(spark):
    rows = spark.createDataFrame(STACKS, "capture_id string, thread_id int, weight long, stack string")
    frames = F.transform(F.split("stack", ";"), lambda s: plain_frame(s, F.when(s == "g", "lib").when(s != "x", "app")))
    return rows.select(
        "capture_id", "thread_id", "weight", F.lit("user").alias("sample_context"), frames.alias("frames"), F.lit("cycles").alias("event"),
        F.lit("sample_count").alias("weight_unit"), F.lit("folded_weight").alias("weight_source"),
    )


def test_recursive_and_unnamed_frames_by_hand(spark):
    want = collections.defaultdict(lambda: [0, 0, 0, 0, set()])
    for capture, thread, weight, stack in STACKS:
        names = [(None, None) if s == "x" else (s, "lib" if s == "g" else "app") for s in stack.split(";")]
        for i, name in enumerate(names):
            row = want[(capture, *name)]
            row[0] += weight * (i == len(names) - 1)
            row[1] += weight * (name not in names[:i])
            row[2] += name not in names[:i]
            row[3] += 1
            row[4] |= {thread} - {None}
    got = {
        (r.capture_id, r.symbol, r.dso): [r.self_weight, r.inclusive_weight, r.sample_count, r.stack_occurrence_count, r.thread_count]
        for r in H.hotspots(samples(spark)).collect()
    }
    assert got == {k: [*v[:4], len(v[4])] for k, v in want.items()}


def test_quality_takes_what_its_caller_has(spark, monkeypatch):
    rows = samples(spark)
    spots, paths = H.hotspots(rows).cache(), H.call_paths(rows).cache()
    want = sorted(str(r) for r in Q.evidence_quality(rows, hotspot_limit=2).collect())
    calls = []
    for name in ("hotspots", "call_paths"):
        monkeypatch.setattr(H, name, lambda samples, name=name: calls.append(name))
    assert sorted(str(r) for r in Q.evidence_quality(rows, hotspot_limit=2, spots=spots, paths=paths).collect()) == want
    assert not calls


def test_queries_work_hotspots_and_paths_out_once(spark, monkeypatch):
    rows = samples(spark).withColumn("sample_seq", F.lit(0))
    monkeypatch.setattr(C.views, "samples", lambda spark, sf_dir, kept=False: rows)
    calls = collections.Counter()
    for name in ("hotspots", "call_paths"):
        monkeypatch.setattr(H, name, lambda samples, name=name, real=getattr(H, name): calls.update([name]) or real(samples))
    assert sorted(tuple(r) for r in C.verify_exports(spark, "").collect()) == [("a", 22, True), ("b", 22, True)]
    assert calls == {"hotspots": 1, "call_paths": 1}
    calls.clear()
    C.diagnosis(spark, "").collect()
    assert calls == {"hotspots": 1, "call_paths": 1}

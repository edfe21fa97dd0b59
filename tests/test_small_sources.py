"""Benchmark documents, counters, container counter files, rules."""

from __future__ import annotations

import json

import pytest

from gristmill.operators import bench as OB
from gristmill.operators import resources as V
from gristmill.operators import stat as T
from gristmill.sources import bench as B
from gristmill.sources import cgroup as G
from gristmill.sources import stat as S
from gristmill.sources.rules import rule_from


def test_benchmark_dialects(spark):
    entry = {"name": "BM/r", "run_name": "BM", "run_type": "iteration", "time_unit": "ns", "items_per_second": 10.0}
    docs = {
        "h": {"results": [{"command": "./b", "times": [2.5, 4.0, 3.0, 7.0], "exit_codes": [0, 3, 0, 0]}]},
        "p": {"version": "1.0", "metadata": {"cpu_count": 6}, "benchmarks": [
            {"metadata": {"name": "parse", "unit": "second"}, "runs": [{"values": [5.0, 8.0]}, {"values": [6.0]}]}]},
        "g": {"context": {"num_cpus": 12, "library_build_type": "release"}, "benchmarks": [
            {**entry, "real_time": 70, "cpu_time": 61}, {**entry, "real_time": 74},
            {**entry, "real_time": 66, "cpu_time": 60}, {**entry, "run_type": "aggregate", "real_time": 1}]},
        "n": {"schema_version": "1.0", "benchmark_id": "x", "name": "own", "build_type": "release", "environment": {"cpu_model": "c"},
              "metrics": {"wall": {"unit": "s", "higher_is_better": False, "values": [1.0, 2.0]}}},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "capture_id string, document string")
    stats = OB.metric_stats(B.benchmark_values(rows), ["capture_id", "name", "metric"]).collect()
    got = {(r["capture_id"], r["name"], r["metric"]): (r["samples"], r["median"], r["unit"]) for r in stats}
    assert got == {
        ("h", "./b", "wall_time"): (4, 3.5, "seconds"),
        ("p", "parse", "value"): (3, 6.0, "second"),
        ("g", "BM", "real_time"): (3, 70.0, "ns"),
        ("g", "BM", "items_per_second"): (3, 10.0, "items/second"),
        ("n", "own", "wall"): (2, 1.5, "s"),
    }
    runs = {r["capture_id"]: (r["error_count"], r["fields"]) for r in B.benchmark_runs(rows).collect()}
    assert runs["h"][0] == 1 and runs["g"][1]["build_type"] == "release" and runs["p"][1] == {"environment.cpu_count": "6"}
    assert runs["n"][1]["environment.cpu_model"] == "c"


def test_dialect_is_found_once(spark):
    texts = ['{"results":[{"command":"c","times":[1.0]}]}', None, "", "[1]", "{broken", '{"schema_version":"1.0","results":[]}', '{"schema_version":"1.0","benchmark_id":1}',
             '{"schema_version":"1.1","benchmark_id":1,"benchmarks":[],"version":1}', '{"benchmarks":[],"context":{},"version":1}']
    rows = spark.createDataFrame(list(enumerate(texts)), "capture_id int, document string")
    # neither the values nor the runs look at the keys of a document again, in whichever form they read it
    for read in (B.benchmark_values(rows), B.benchmark_runs(rows)):
        assert "json_object_keys" not in read._jdf.queryExecution().optimizedPlan().toString()
    found = B.with_dialect(rows)
    assert B.with_dialect(found) is found
    assert {r[0]: r["dialect"] for r in found.collect()} == {
        0: "hyperfine", 1: None, 2: None, 3: None, 4: None, 5: "hyperfine", 6: "native", 7: "pyperf", 8: "google_benchmark",
    }


def test_counters_and_ipc(spark):
    rows = [
        ("# a note", "SKIP"), ("840;;cycles;77;100.00", None), ("1260;;instructions;77;100.00", None), ("31;;branches;70;91.25%", None),
        ("<not supported>;;LLC-loads;0;0.00", None), ("one field", "TOO_FEW_FIELDS"), ("inf;;cycles;77;1", "INVALID_VALUE"),
    ]
    lines = spark.createDataFrame([("c", i, x) for i, (x, _) in enumerate(rows)], "capture_id string, line_no int, line string")
    parsed = S.parse_stat(lines)
    assert [r["reject"] for r in parsed.orderBy("line_no").collect()] == [reject for _, reject in rows]
    by_event = {m["event"]: m for m in T.with_ipc(S.stat_metrics(parsed)).collect()}
    assert by_event["instructions-per-cycle"]["value"] == 1260 / 840 and by_event["LLC-loads"]["status"] == "not_supported"
    assert by_event["branches"]["running_percent"] == 91.25


def _files(usage, throttled, rbytes, oom, limit="max"):
    return {
        "cpu.stat": f"usage_usec {usage}\nuser_usec 5\nsystem_usec 2\nnr_periods 3\nnr_throttled {throttled}\nthrottled_usec 9\n",
        "cpu.max": "max 100000\n", "cpuset.cpus.effective": "0-3,8\n", "memory.current": "4096\n", "memory.max": f"{limit}\n",
        "memory.events": f"low 0\noom {oom}\n", "memory.pressure": "some avg10=0.00 total=7\nfull avg10=0.00 total=1\n",
        "io.stat": f"8:0 rbytes={rbytes} wbytes=2 rios=3 wios=4 dbytes=0\n", "io.max": "8:0 rbps=100 wbps=max\n9:0 rbps=max\n",
        "io.pressure": "some avg10=0.00 total=3\n", "pids.current": "5\n", "pids.max": "max\n",
    }


def test_container_counters(spark):
    rows = [("a", 1, _files(100, 0, 10, 1)), ("a", 2, _files(150, 1, 30, 2, "8192")),
            ("b", 1, _files(100, 0, 10, 0)), ("b", 2, _files(90, 0, 10, 0)),
            ("x", 1, {**_files(1, 1, 1, 1), "cpu.stat": "usage_usec 1\nusage_usec 2\n", "cpuset.cpus.effective": "3-1"})]
    parsed = G.parse_snapshots(spark.createDataFrame(rows, "capture_id string, ts_ns long, files map<string,string>"))
    one = parsed.where("capture_id = 'a' and ts_ns = 1").collect()[0]
    assert (one["cpu_usage_usec"], one["cpu_quota_usec"], one["cpu_period_usec"], one["memory_max_bytes"]) == (100, None, 100000, None)
    assert (one["memory_pressure_some_usec"], one["memory_pressure_full_usec"], one["io_pressure_full_usec"]) == (7, 1, None)
    assert [tuple(d) for d in one["io_devices"]] == [(8, 0, 10, 2, 3, 4)] and [tuple(d) for d in one["io_limits"]] == [(8, 0, 100, None, None, None)]
    assert one["invalid"] == [] and one["memory_events"] == {"low": 0, "oom": 1}
    assert parsed.where("capture_id = 'x'").collect()[0]["invalid"] == ["cpu.stat", "cpuset.cpus.effective"]
    deltas = {r["capture_id"]: r for r in V.resource_delta(parsed.where("capture_id <> 'x'")).collect()}
    a, b = deltas["a"], deltas["b"]
    assert (a["cpu_usage_usec"], a["io_read_bytes"], a["memory_event_deltas"]["oom"], a["valid"]) == (50, 20, 1, True)
    assert a["changed_limits"] == ["memory_limit"] and b["negative_counters"] == ["cpu_usage_usec"] and not b["valid"]


def test_rules_are_checked():
    document = {
        "id": "r", "version": 1, "scope": "cpp", "match": {"symbol_regex": ["x"]}, "classification": {"category": "c", "confidence": "low"},
        "observation": "{symbol}", "limitations": [], "missing_evidence": [], "next_steps": [], "forbidden_conclusions": [],
    }
    assert rule_from(document).category == "c"
    with pytest.raises(ValueError):
        rule_from({**document, "extra": 1})
    with pytest.raises(ValueError):
        rule_from({**document, "match": {"symbol_regex": []}})

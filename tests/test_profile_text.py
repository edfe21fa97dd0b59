"""Folded stacks and profiler text against hand-written expectations."""

from __future__ import annotations

from gristmill.operators import hotspots as H
from gristmill.operators import quality as Q
from gristmill.sources import folded as FO
from gristmill.sources import perf_script as P


def _write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def _spots(samples):
    rows = H.export_hotspots(H.hotspots(samples)).orderBy("rank").collect()
    return [(r["hotspot_id"], r["symbol"], r["self_weight"], r["inclusive_weight"], r["sample_count"]) for r in rows]


# weights of made-up stacks; every expectation below is worked out from this table
STACKS = {("boot", "serve", "hash"): [40, 2], ("boot", "serve"): [9], ("boot", "flush", "hash"): [25]}


def test_folded_profile(spark, tmp_path):
    text = "".join(f"{';'.join(stack)} {w}\n" for stack, weights in STACKS.items() for w in weights)
    samples = FO.read_folded(spark, _write(tmp_path, "a.folded", text))
    total = sum(sum(w) for w in STACKS.values())
    own, inclusive, seen = {}, {}, {}
    for stack, weights in STACKS.items():
        for symbol in stack:
            inclusive[symbol] = inclusive.get(symbol, 0) + sum(weights)
            seen[symbol] = seen.get(symbol, 0) + len(weights)
        own[stack[-1]] = own.get(stack[-1], 0) + sum(weights)
    order = sorted(inclusive, key=lambda n: (-own.get(n, 0), -inclusive[n], n))
    assert _spots(samples) == [
        (f"H-{i:03d}", n, own.get(n, 0), inclusive[n], seen[n]) for i, n in enumerate(order, 1)
    ]
    paths = H.export_call_paths(H.call_paths(samples)).orderBy("rank").collect()
    heavy = sorted(STACKS, key=lambda k: -sum(STACKS[k]))
    assert [(p["path_id"], tuple(f["symbol"] for f in p["path"]), p["weight"], p["record_count"], p["percent"]) for p in paths] == [
        (f"P-{i:03d}", k, sum(STACKS[k]), len(STACKS[k]), round(100 * sum(STACKS[k]) / total, 6)) for i, k in enumerate(heavy, 1)
    ]
    assert all(r["passed"] for r in Q.aggregation_invariants(samples).collect())
    quality = Q.evidence_quality(samples).collect()[0]
    assert quality["quality_status"] == "verified" and quality["event"] == "unknown"
    top = H.export_hotspots(H.hotspots(samples), limit=2).orderBy("rank").collect()
    assert [r["symbol"] for r in top] == order[:2]


LINES = {
    "": "BLANK", " \u2003 ": "BLANK", "go;run 11": None, "word": "MISSING_WEIGHT", " word ": "MISSING_WEIGHT", "go;;run 6": "EMPTY_FRAME",
    ";run 6": "EMPTY_FRAME", "run; 6": "EMPTY_FRAME", "\u00a0;run 6": "EMPTY_FRAME", "go;run six": "INVALID_WEIGHT", "go 0": "INVALID_WEIGHT",
    "go -6": "INVALID_WEIGHT", "go 6.5": "INVALID_WEIGHT", "go 9223372036854775808": "INVALID_WEIGHT", "go +6": None, "go 006": None,
    "[unknown];run 8": None, "go;map<k, v> at 8": None, "go;run 5\u00a0": None, "go;run\u2003 5": None, "\tgo ; run\t5 ": None,
}


def test_folded_rejects(spark, tmp_path):
    parsed = FO.read_folded_parsed(spark, _write(tmp_path, "b.folded", "\n".join(LINES) + "\n"))
    rows = parsed.orderBy("line_no").collect()
    assert [r["reject"] for r in rows] == list(LINES.values())
    symbols = {r["line"]: r["symbols"] for r in rows if r["reject"] is None}
    assert symbols["go;map<k, v> at 8"] == ["go", "map<k, v> at"]
    assert all(symbols[k] == ["go", "run"] for k in ("go;run 11", "go;run 5\u00a0", "go;run\u2003 5", "\tgo ; run\t5 "))
    bad = [k for k in LINES.values() if k not in (None, "BLANK")]
    d = FO.folded_diagnostics(parsed).collect()[0]
    assert (d["parsed_records"], d["malformed_records"], d["skipped_records"]) == (len(symbols), len(bad), len(LINES) - len(symbols))
    warnings = FO.folded_warnings(parsed).orderBy("line_no").collect()
    assert [w["code"] for w in warnings] == bad


def test_long_lines_and_deep_stacks_are_kept(spark, tmp_path):
    deep = ";".join(f"f{i}" for i in range(6000)) + ";" + "g" * 1_100_000
    samples = FO.read_folded(spark, _write(tmp_path, "deep.folded", deep + " 4\n"))
    assert [len(r["frames"]) for r in samples.select("frames.symbol").withColumnRenamed("symbol", "frames").collect()] == [6001]


def test_files_of_one_name_are_captures_of_their_own(spark, tmp_path):
    for name in ("east/cpu.folded", "west/cpu.folded", "cpu.first.folded", "cpu.second.folded"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        _write(tmp_path, name, "x 3\n")
    samples = FO.read_folded(spark, [str(tmp_path), str(tmp_path / "east"), str(tmp_path / "west")])
    assert samples.select("capture_id").distinct().count() == 4
    one = FO.read_folded(spark, str(tmp_path / "east" / "cpu.folded"))
    assert [r["capture_id"] for r in one.collect()] == ["cpu.folded"]


def test_recursion_counts_once(spark, tmp_path):
    text = "top;visit;visit;visit;end 6\ntop;visit;end 3\ntop;end 1\n"
    samples = FO.read_folded(spark, _write(tmp_path, "c.folded", text))
    row = H.hotspots(samples).where("symbol = 'visit'").collect()[0]
    assert (row["self_weight"], row["inclusive_weight"], row["sample_count"], row["stack_occurrence_count"]) == (0, 9, 2, 4)


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    from gristmill.sources.lines import numbered_lines

    text = "".join(f"row {i} {'x' * (i % 50)}\n" for i in range(3000))
    path = _write(tmp_path, "many.txt", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        got = [r["line"] for r in lines.orderBy("line_no").collect()]
        assert got == text.splitlines() and lines.agg({"line_no": "max"}).collect()[0][0] == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_invalid_bytes_are_counted(spark, tmp_path):
    from pyspark.sql import functions as F

    from gristmill.sources.lines import invalid_byte_count, read_lines

    cases = [b"plain", b"bad\xff\xfebytes", b"cut\xe2\x82", "ok � mark".encode(), b"\xf0\x9f\x92 x"]
    path = _write(tmp_path, "bytes.txt", b"\n".join(cases) + b"\n")
    got = [r[0] for r in read_lines(spark, path).orderBy("row_id").select(invalid_byte_count(F.col("line"))).collect()]
    want = [sum(0xDC80 <= ord(c) <= 0xDCFF for c in b.decode("utf-8", "surrogateescape")) for b in cases]
    assert got == want


def _head(name, ids, cpu, at, rest):
    return f"{name} {ids} {f'[{cpu:03d}] ' if cpu is not None else ''}{at}: {rest}"


def _frame(ip, symbol, dso, place=""):
    return f"\t{ip:x} {symbol} ({dso}){' ' + place if place else ''}"


# a made-up worker with an inlined callee, a kernel thread without cpu, and damaged records
PERF = "\n".join([
    _head("io worker", "71/74", 6, 9.125, "90 instructions:u:"),
    _frame(0xA20, "Codec::pack(int)+0x4", "/srv/lib/codec.so", "/b/codec.cpp:301"),
    _frame(0xA00, "pump", "/srv/bin/relay"),
    "  /b/ring.h:77 (inlined)",
    "",
    _head("io worker", "71/72", 0, 9.25, "15 instructions:u: a24 Codec::pack(int)+0x8 (/srv/lib/codec.so) /b/codec.cpp:305"),
    _frame(0xA24, "Codec::pack(int)+0x8", "/srv/lib/codec.so", "/b/codec.cpp:305"),
    _frame(0x9F0, "start", "/srv/bin/relay", "/b/start.cpp:2"),
    "",
    _head("kswap", "0/58", None, 9.5, "4 instructions:u: ee20 reclaim+0x40 ([kernel.kallsyms])"),
    _frame(0xEE00, "thread_fn+0x0", "[kernel.kallsyms]"),
    "",
    "what is this",
    _frame(0x1, "lost", "/srv/bin/none"),
    _head("script", "90", 2, 11.0, "instructions:u:"),
    "\tno address here",
    _frame(0xC0, "shout", "/srv/My Tools (beta)/run", "/b/shout.c:5"),
    _frame(0xC8, "py::area:/j/shape.py", "/tmp/perf-90.map"),
    "  [JIT] tid 90[c8]",
    _head("bare", "91/91", 1, 12.0, "3 instructions:u:"),
]) + "\n"


def test_perf_script(spark, tmp_path):
    samples, diagnostics = P.read_perf_script(spark, _write(tmp_path, "p.txt", PERF))
    rows = samples.orderBy("sample_seq").collect()
    assert [(r["thread_name"], r["process_id"], r["thread_id"], r["cpu"], r["weight"], r["weight_source"]) for r in rows] == [
        ("io worker", 71, 74, 6, 90, "perf_period"),
        ("io worker", 71, 72, 0, 15, "perf_period"),
        ("kswap", 0, 58, None, 4, "perf_period"),
        ("script", 90, 90, 2, 1, "sample_count_fallback"),
    ]
    assert [r["weight_unit"] for r in rows] == ["instructions"] * 3 + ["sample_count"]
    assert [[f["symbol"] for f in r["frames"]] for r in rows] == [
        ["pump", "Codec::pack(int)"],
        ["start", "Codec::pack(int)"],
        ["thread_fn", "reclaim"],
        ["py::area", "shout", "unknown"],
    ]
    inlined = rows[0]["frames"][0]
    assert (inlined["source_file"], inlined["source_line"], inlined["is_inline"]) == ("/b/ring.h", 77, True)
    spaced = rows[3]["frames"][1]
    assert (spaced["dso"], spaced["source_file"], spaced["source_line"]) == ("/srv/My Tools (beta)/run", "/b/shout.c", 5)
    mapped = rows[3]["frames"][0]
    assert (mapped["source_file"], mapped["source_line"]) == ("/j/shape.py", None)
    assert rows[2]["frames"][0]["is_kernel"] and rows[3]["frames"][2]["is_unknown"]
    d = diagnostics.collect()[0]
    assert (d["parsed_records"], d["duplicate_frame_lines"], d["malformed_records"]) == (4, 1, 3)
    assert d["address_annotation_lines"] == 1 and d["unicode_replacement_count"] == 0
    merged = H.symbol_variants(samples).where("symbol = 'Codec::pack(int)'").collect()[0]
    assert merged["symbol_variants"] == ["Codec::pack(int)"] and not merged["normalization_merged"]


def test_headers_are_matched_once(spark):
    """The running values read lines that are classified already, and one replacement finds all parts."""
    odd = ["a b 1/2 [003] U 4.5: 7 cycles:u: 8 f (x) ", "\u0001c 5 6.25: ev:", "x 1/2 3: 4 e: t\u0001t", "no header 5:6", "n 1 2 [3] 4: e: \tz "]
    lines = spark.createDataFrame([("c", i + 1, t) for i, t in enumerate(odd)], "capture_id string, line_no long, line string")
    marked = P.mark_lines(lines)
    assert "rlike" not in marked._jdf.queryExecution().optimizedPlan().toString().lower()
    found = [tuple(r.header) if r.header else None for r in marked.orderBy("line_no").collect()]
    assert found == [
        ("a b", 1, 2, 3, "U", 4.5, 7, "cycles:u", "8 f (x)"),
        ("\u0001c", 5, 5, None, None, 6.25, None, "ev", ""),
        ("x", 1, 2, None, None, 3.0, 4, "e", "t\u0001t"),
        None,
        ("n", 1, 2, 3, None, 4.0, None, "e", "z"),
    ]

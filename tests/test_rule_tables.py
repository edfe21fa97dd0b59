import json
import random
import re
import string

from pyspark.sql import functions as F

from gristmill.operators import classify as C
from gristmill.sources import rule_tables as T
from gristmill.sources.rules import BUILTIN_RULES, Rule

SPOTS = "capture_id int, hotspot_id string, rank int, symbol string, dso string, self_weight long, self_percent double, inclusive_percent double"
WORDS = ["malloc", "std::mutex::lock", "operator new", "memcpy", "__cxa_throw", "read", "Futex_wait", "copy_from_user", "straſse", "K", "LİNEA", "lınea", "ab", "", "línea", "pthread_mutex_lock", "x" * 200]
OBJECTS = ["libc.so", "[kernel.kallsyms]", None, "app", ""]


def spots(spark, n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        symbol = rng.choice(WORDS) + rng.choice(["", "@plt", "_1", "::" + rng.choice(WORDS)])
        rows.append((i % 2, f"H{i}", i // 2 + 1, symbol if i % 50 else None, rng.choice(OBJECTS), i % 3, float(rng.randrange(6)), float(rng.randrange(8))))
    return spark.createDataFrame(rows, SPOTS).repartition(4)


def plain(df):
    return sorted((tuple(str(x) for x in r) for r in df.select(sorted(df.columns)).collect()))


def test_same_as_the_projection(spark):
    rules = [*BUILTIN_RULES, Rule(id="free", category="c", symbol_regex=(r"^.{2,5}$", r"[0-9]$")), Rule(id="two", category="c", symbol_regex=("LINEA|straSSe|strasse", "K"), dso_regex=("^app$", "libc"))]
    frame = spots(spark)
    assert plain(C.classify_by_table(frame, T.rule_frame(spark, rules))) == plain(C.classify(frame, rules))
    assert C.classify_by_table(frame, T.rule_frame(spark, rules)).count() > 50
    assert C.classify_by_table(frame, T.rule_frame(spark, rules).limit(0)).isEmpty()
    assert C.classify_by_table(frame.limit(0), T.rule_frame(spark, rules)).isEmpty()


def test_required_texts():
    assert T.required_texts(r"(^|::)(malloc|calloc)$") == ["malloc", "calloc"]
    assert T.required_texts(r"pthread_(mutex|rwlock)") == ["pthread_"]
    assert T.required_texts(r"std::.*MUTEX") == ["std::"]
    assert T.required_texts(r"(abc)+d?") == ["abc"] and T.required_texts(r"(abc)*") is None
    assert T.required_texts(r".+") is None and T.required_texts("ab") is None and T.required_texts("[abc]{5}") is None
    assert T.required_texts(r"(?:foo|b)ar") is None and T.required_texts("(") is None and T.required_texts(r"(?=look)ahead") == ["ahead"]


def test_no_match_without_its_text():
    """Whatever a random pattern matches holds one of the texts it is said to require."""
    rng = random.Random(5)

    def pattern(depth=0):
        kind = rng.randrange(8 if depth < 3 else 3)
        if kind < 3:
            return "".join(rng.choice("abcAB") for _ in range(rng.randint(1, 4)))
        inner = pattern(depth + 1)
        return [f"({inner})", f"(?:{inner}|{pattern(depth + 1)})", f"({inner})?", f"({inner}){{1,2}}", inner + "." + pattern(depth + 1)][kind - 3]

    found = 0
    texts = ["".join(rng.choice("abcABC") for _ in range(12)) for _ in range(400)]
    for _ in range(1500):
        p = pattern() + pattern()
        need = T.required_texts(p)
        for t in texts[:60] if need else []:
            if re.search(p, t, re.IGNORECASE):
                found += 1
                assert any(n in t.lower() for n in need), (p, t, need)
    assert found > 100


def test_candidates_are_few_and_meet_by_key(spark):
    """Thousands of rules: pairs are found by their texts, none by comparing all with all."""
    names = ["".join(random.Random(i).choice(string.ascii_lowercase) for _ in range(10)) for i in range(3000)]
    symbols = spark.createDataFrame([(f"ns::{n}", "app") for n in names], "symbol string, dso string")
    rules = T.rule_frame(spark, [Rule(id=n, category="c", symbol_regex=(f"^ns::{n}$",)) for n in names[::2]])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.rule_candidates(symbols, rules)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert 1500 <= found.count() < 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_candidates_hold_the_whole_text(spark):
    """Symbols that share a run of three characters with a pattern's text, but not the text, are no candidates."""
    symbols = spark.createDataFrame([(f"alloc_{i}", "app") for i in range(100)], "symbol string, dso string")
    rules = T.rule_frame(spark, [Rule(id=f"r{i}", category="c", symbol_regex=(f"^alloc_{i}$",)) for i in range(10, 20)])
    assert C.rule_candidates(symbols, rules).count() == 10


def test_many_rules_of_few_kinds_over_many_tasks(spark, monkeypatch):
    """Rules with the same patterns and other thresholds; the matches of one capture are numbered in many tasks."""
    monkeypatch.setattr(C, "PAIRS", 64, raising=False)
    rules = [
        Rule(id=f"r{i}", category="c", symbol_regex=(r".+",) if i % 3 else ("^mem", "cpy"), dso_regex=("^app$",) if i % 2 else (), self_percent_gte=float(i % 5), inclusive_percent_gte=float(i % 7))
        for i in range(60)
    ]
    frame = spots(spark).where("capture_id = 0")
    found = C.classify_by_table(frame, T.rule_frame(spark, rules))
    assert plain(found) == plain(C.classify(frame, rules))
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) > 1000 and max(shares) < sum(shares) / 8


def test_repeated_rules_and_hotspots(spark):
    """Rows that come twice match twice, are numbered once each, and ties of the rank stay in the order of the rules."""
    rules = [Rule(id="a", category="c", symbol_regex=("x",)), Rule(id="b", category="c", symbol_regex=("x", "^x$"), self_percent_gte=2.0)]
    frame = spark.createDataFrame([(0, "H1", 1, "x", None, 1, 3.0, 3.0), (0, "H2", 1, "xx", "app", 1, 3.0, 3.0), (0, "H3", 2, "x", None, 1, 1.0, 1.0)], SPOTS)
    table = T.rule_frame(spark, rules)
    found = C.classify_by_table(frame, table.unionByName(table)).select("classification_id", "rank", "rule_id").collect()
    assert sorted(tuple(r) for r in found) == [(f"C-{n + 1:03d}", *r) for n, r in enumerate([(1, "a")] * 4 + [(1, "b")] * 4 + [(2, "a")] * 2)]


def test_rule_files(spark, tmp_path):
    good = {
        "id": "a", "version": 2, "scope": "cpp", "match": {"symbol_regex": ["^x"], "dso_regex": ["lib"]}, "thresholds": {"self_percent_gte": 1.5},
        "classification": {"category": "c", "confidence": "low"}, "observation": "{symbol}", "limitations": ["l"],
    }
    bad = [
        dict(good, id=None), dict(good, match={"symbol_regex": []}), dict(good, match={"symbol_regex": ["("]}), dict(good, scope="other"),
        dict(good, classification={"category": "c", "confidence": "sure"}), dict(good, classification={"confidence": "low"}), dict(good, match={"symbol_regex": ["a"], "dso_regex": ["*"]}),
    ]
    (tmp_path / "1.json").write_text(json.dumps([good, *bad, dict(good, id="b", thresholds=None)]))
    (tmp_path / "2.json").write_text(json.dumps(dict(good, id="c")))
    (tmp_path / "3.json").write_text("no json")
    rules, rejects = T.read_rules(spark, str(tmp_path))
    got = {r.rule_id: r for r in rules.collect()}
    assert {n: r.rule_no for n, r in got.items()} == {"a": 0, "b": 1, "c": 2}
    assert got["a"].self_percent_gte == 1.5 and got["b"].self_percent_gte == 0.0 and got["a"].rule_version == 2 and list(got["a"].limitations) == ["l"]
    reasons = sorted((r.path[-6:], r.position, r.reason) for r in rejects.collect())
    assert [r for p, _, r in reasons if p == "1.json"] == [
        "missing_id", "missing_symbol_pattern", "invalid_pattern", "unknown_scope", "unknown_confidence", "missing_category", "invalid_pattern",
    ]
    assert [r for p, _, r in reasons if p == "3.json"] == ["not_a_rule_document"]
    assert rules.schema.names == [f.name for f in T.rule_frame(spark, BUILTIN_RULES).schema]

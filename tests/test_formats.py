import pytest
from pyspark.sql import functions as F

from gristmill.operators import hotspots as H
from gristmill.sources import folded as FO
from gristmill.sources import formats as R
from gristmill.sources import stat as ST


def plain(df):
    return sorted(str(tuple(r)) for r in df.collect())


def folder(tmp_path):
    for name, text in {"a.folded": "x;y 3\nz 4\n", "b.folded": "x;y 5\n", "deep/a.folded": "q 9\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_builtin_formats_give_what_their_readers_give(spark, tmp_path):
    root = folder(tmp_path)
    spots = lambda samples: plain(H.hotspots(samples).drop("threads"))
    assert spots(R.read(spark, "folded", f"{root}/a.folded")) == spots(FO.read_folded(spark, f"{root}/a.folded"))
    (tmp_path / "c.stat").write_text("100;ns;cycles;5;100.00\n<not counted>;;branches;0;0\n")
    assert plain(R.read(spark, "perf-stat", f"{root}/c.stat")) == plain(ST.stat_metrics(ST.read_stat(spark, f"{root}/c.stat")))
    assert R.formats() == R.formats() | {"folded": "samples", "perf-script": "samples", "perf-stat": "counters"}


def test_only_files_of_the_captures_are_read(spark, tmp_path):
    root = folder(tmp_path / "f" if (tmp_path / "f").mkdir() is None else tmp_path)
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "false")
    assert {r.capture_id for r in R.list_captures(spark, root).collect()} == {"a.folded", "b.folded", "deep/a.folded"}
    rows = R.read(spark, "folded", root, captures=["deep/a.folded", "b.folded"])
    assert {(r.capture_id, r.weight) for r in rows.collect()} == {("deep/a.folded", 9), ("b.folded", 5)}
    assert sorted(f.rpartition("/")[2] for f in rows.inputFiles()) == ["a.folded", "b.folded"]
    assert R.read(spark, "folded", root, captures=[]).isEmpty()
    with pytest.raises(ValueError, match="no capture"):
        R.read(spark, "folded", root, captures=["z.folded"])


def test_a_format_of_ones_own(spark, tmp_path):
    """``weight<TAB>leaf<TAB>caller`` lines become samples that the operators take."""
    def parse(lines):
        fields = F.split("line", "\t")
        stacked = lines.withColumn("symbols", F.reverse(F.slice(fields, 2, 9))).withColumn("weight", fields[0].cast("bigint")).withColumn("reject", F.lit(None).cast("string"))
        return FO.full_samples(FO.folded_samples(stacked))

    R.register("tabs", "samples", parse, numbered=False)
    (tmp_path / "t.tabs").write_text("3\tleaf\troot\n4\troot\n")
    found = {r["symbol"]: (r["self_weight"], r["inclusive_weight"]) for r in H.hotspots(R.read(spark, "tabs", str(tmp_path))).collect()}
    assert found == {"leaf": (3, 3), "root": (4, 7)}
    with pytest.raises(ValueError, match="already"):
        R.register("tabs", "samples", parse)
    with pytest.raises(ValueError, match="unknown kind"):
        R.register("other", "nothing", parse)
    R.register("short", "counters", lambda lines: lines.select("capture_id", F.lit("x").alias("event"), F.lit(1).alias("value")))
    with pytest.raises(ValueError, match="value double, unit string, status string"):
        R.read(spark, "short", str(tmp_path))
    with pytest.raises(ValueError, match="unknown format"):
        R.read(spark, "none", str(tmp_path))

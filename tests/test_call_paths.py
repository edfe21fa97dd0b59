from gristmill.operators import hotspots as H
from gristmill.plans import views

SF_DIR = "/root/testdata/sf0.001"


def test_paths_of_any_text_stay_apart(spark):
    """Nulls, empty names, marks and quotes: each path is its own group and comes back as it was."""
    names = [None, "", "a", "a\0b", 'q"', "x,y", "\\", "null", "é", "\n"]
    paths = [[(s, d)] for s in names for d in names] + [[], [("a", "b"), ("c", None)], [("a", "b"), ("c", "null")], [("a", 'b","c')]]
    rows = [("c", path, i + k) for i, path in enumerate(paths) for k in (1, 2)]
    samples = spark.createDataFrame(rows, "capture_id string, path array<struct<symbol: string, dso: string>>, weight long")
    got = {tuple(tuple(f) for f in r.path): (r.weight, r.record_count) for r in H.call_paths(samples).collect()}
    assert got == {tuple(path): (2 * i + 3, 2) for i, path in enumerate(paths)}


def test_kept_samples_are_joined_once(spark):
    """Queries that read samples several times read the written rows, not the joined tables."""
    kept, joined = views.samples(spark, SF_DIR, kept=True), views.samples(spark, SF_DIR)
    assert not any("lineitem" in f for f in kept.inputFiles()) and any("lineitem" in f for f in joined.inputFiles())
    assert kept.count() == joined.count() and kept.exceptAll(joined).isEmpty()

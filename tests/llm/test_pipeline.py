import random

import corpus_pipeline

from .support import DOCS

RNG = random.Random(21)
VOCAB = [f"w{i}" for i in range(3000)]


def prose(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def write_tables(spark, folder):
    """Clean documents, and planted: copies, a near copy, toxic texts, a shared passage, a leak, odd rows."""
    texts = [" ".join(prose(90)) for _ in range(160)]
    labels = [(i, 1, 0) for i in range(120)]
    passage, item = " ".join(prose(60)), " ".join(prose(30))
    for i in range(120, 160):
        words = texts[i].split()
        for _ in range(5):
            words[RNG.randrange(len(words))] = RNG.choice(["snorvex", "grumblic"])
        texts[i] = " ".join(words)
        labels.append((i, 1, 1))
    planted = {
        "copy": texts[3],
        "near": " ".join(texts[4].split()[:-1] + ["other"]),
        "passage 1": " ".join(prose(40)) + " " + passage,
        "passage 2": passage + " " + " ".join(prose(40)),
        "leak": " ".join(prose(30)) + " " + item + " " + " ".join(prose(30)),
        "toxic": " ".join(prose(40)) + " snorvvex grumblik snorvex",
        "null": None,
        "empty": "",
    }
    texts += planted.values()
    ids = {name: 160 + n for n, name in enumerate(planted)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, ids, passage


def test_each_stage_does_its_work(spark, tmp_path):
    folder = str(tmp_path)
    texts, ids, passage = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/stage{n}")
        docs = spark.read.parquet(f"{folder}/stage{n}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    clean = set(range(120))
    after = [set(kept[name]) for name, _ in corpus_pipeline.STAGES]
    assert after[0] == clean | set(ids.values()) - {ids["toxic"]}
    assert after[1] == after[0] - {ids["copy"], ids["near"]}
    assert after[2] == after[1]
    for name in ("passage 1", "passage 2"):
        row = kept["substring dedup"][ids[name]]
        assert len(row.text.split()) == 40 and row.n_chars == len(row.text) and passage not in row.text
    assert all(kept["substring dedup"][i].text == texts[i] for i in clean)
    assert after[3] == after[2] - {ids["leak"]}
    assert after[4] == after[3]
    # the whole run gives the last stage's rows
    rows = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    last = spark.read.parquet(f"{folder}/stage4").collect()
    assert rows == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in last}


def test_empty_tables_and_extra_columns(spark, tmp_path):
    folder = str(tmp_path)
    extra = DOCS + ", size string, spans string, score string, root string, k1 string"
    spark.createDataFrame([], extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0

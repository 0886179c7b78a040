"""The pipeline as a whole, and the registration of its queries."""

from collections import defaultdict

import corpus_pipeline
from lexigrain.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    ids = {r["doc_id"] for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            left = {r["doc_id"] for r in docs.collect()}
            assert left <= ids
            ids = left
    assert {r["doc_id"] for r in docs.collect()} == ids


def test_run_fills_sequences(spark):
    used = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        used[r["sequence_id"]] += r["length"]
    assert used and max(used.values()) <= 2048


def test_run_over_rows_of_all_kinds(spark, tmp_path):
    """Null ids and texts, repeated rows, empty texts and clashing columns; then an empty table."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "a text without an id"), (4, text + " more"), (5, "  \n "), (6, "x" * 5000), (7, "short\nshort\n" + text)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, line long, key long, lost string, part int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), None, None, None, None) for i, t in rows], schema)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0), (2, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        frame.write.parquet(folder + "/documents.parquet")
        labels.write.parquet(folder + "/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        kept = {r["doc_id"] for r in got}
        assert kept >= {1, 2, 3, None, 5, 6} and 4 not in kept if name == "some" else not got
        left = list(__import__("pathlib").Path(spark.conf.get("spark.checkpoint.dir")).glob("pipeline-*/0-*"))
        assert not left


def test_near_copies_go_in_the_stage(spark):
    import random

    from lexigrain.llm import stages

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(60):
        own = [word() for _ in range(200)]
        near = list(own)
        for at in rng.sample(range(200), 5):  # 2.5 % of the words
            near[at] = word()
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(near))]
    kept = stages.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").count()
    assert kept <= 66


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op")) == list(range(1, 11))

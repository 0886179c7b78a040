"""Exact copies of short lines, as the query and the stage find them."""

from lexigrain.llm import line_dedup, queries, stages

TEXTS = [(1, "Les.\nA\n\nown words here"), (2, "Les.\nB\n\nA"), (3, "Les.\nA"), (4, " \n\t\n "), (5, None), (6, "Lex.\nthis line has more than twenty code points"), (7, "this line had more than twenty code points\nLex.")]


def docs(spark):
    return spark.createDataFrame([(i, t, len(t or "")) for i, t in TEXTS], "doc_id long, text string, n_chars long")


def test_every_line_has_a_class(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    first, lines = {}, []
    for i, text in TEXTS:
        for k, line in enumerate((text or "").split("\n")):
            if line:
                first.setdefault("this" if line.startswith("this") else line, (i, k))
                lines.append((i, k, line))
    want = {(i, k): (len(x), *first["this" if x.startswith("this") else x], int(x.startswith("this"))) for i, k, x in lines}
    got = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    assert {(r[0], r[1]): tuple(r[2:6]) for r in got} == want
    assert all(r["kept"] == ((r["class_doc_id"], r["class_line_no"]) == (r["doc_id"], r["line_no"])) for r in got)


def test_repeated_short_lines_go(spark):
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages.drop_repeated_lines(spark, docs(spark), "").collect()}
    texts = {1: "Les.\nA\n\nown words here", 2: "B\n", 4: " \n\t", 6: "Lex.\nthis line has more than twenty code points"}
    assert got == {**{i: (t, len(t)) for i, t in texts.items()}, 5: (None, 0)}


def test_settings_name_the_shortest_line():
    assert line_dedup.Settings().floor == 20 and line_dedup.ALL_LINES.floor == 1 and line_dedup.Settings(least_chars=5, exact_chars=9).floor == 5

"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator on documents."""

import pytest

from lexigrain.llm import brown_lm, byte_bpe, line_dedup, license_scan, minhash_dedup, packing, toxicity, transport_stream

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
CLASHING = "id long, key long, line long, a long, b long, n long, word long, bucket int, role int, rep long, component long, held_out string, part int, lost string, lost_ string, slot int"
LONG = "lorem ipsum dolor sit amet " * 60_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "one two three four five six seven eight nine ten eleven twelve"), (1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (None, "a text without an id that is long enough to be a line"), (4, LONG), (5, "x" * 1_500_000), (6, " \n\t\n "), (7, "é😀 \x00 ok")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    blank = (None,) * len(CLASHING.split(", "))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) + blank for i, t in texts], schema).repartition(3)


OPERATORS = {
    "toxicity": lambda d: toxicity.grade_documents(d, toxicity.train(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))),
    "packing": lambda d: packing.pack_documents(d, RANKS, P.PATTERN),
    "transport": lambda d: transport_stream.store_texts(d),
    "brown": lambda d: brown_lm.score(d, brown_lm.Settings(classes=4, groups=8, sweeps=1)),
    "lines": lambda d: line_dedup.link_lines(d),
    "licenses": lambda d: license_scan.scan_licenses(d),
    "bpe": lambda d: byte_bpe.encode_documents(d, RANKS, P.PATTERN),
    "minhash": lambda d: minhash_dedup.group_documents(d),
}
ONE_ROW_EACH = {"toxicity", "transport", "brown", "bpe", "minhash"}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_all_kinds(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "1", "2", "3", "None", "4", "5", "6", "7"])
        same = [r.asDict() for r in rows if r["doc_id"] == 1]
        assert same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", ["toxic", "lines", "groups"])
def test_stages_keep_columns(docs, stage):
    run = {
        "toxic": lambda d: toxicity.without_toxic(d, toxicity.train(d, d.selectExpr("doc_id", "0 as toxic"))),
        "lines": line_dedup.drop_lines,
        "groups": minhash_dedup.keep_one,
    }[stage]
    for d in (docs, docs.limit(0)):
        out = run(d)
        assert out.columns == docs.columns
        rows = out.collect()
    got = run(docs).collect()
    assert {str(r["doc_id"]) for r in got} == {"1", "2", "3", "None", "4", "5", "6", "7"}


def test_empty_text_values(docs):
    rows = {r["doc_id"]: r for r in OPERATORS["minhash"](docs).collect()}
    assert rows[2]["n_shingles"] == rows[3]["n_shingles"] == rows[6]["n_shingles"] == 0
    assert rows[2]["kept"] and rows[3]["kept"] and rows[None]["component_id"] is None and rows[None]["kept"]
    assert rows[5]["n_shingles"] == 1

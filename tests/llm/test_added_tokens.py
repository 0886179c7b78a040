"""Packed ids against the JSON tokenizer at its default setting."""

import json
import zlib

import numpy as np
import pytest

from lexigrain.llm import packing, queries, stages

P = pytest.importorskip("public_tokenizers")
E = "<|endoftext|>"
TEXTS = ["a <|endoftext|> b", E, E * 3, f"  {E}  x", f"don{E}'t", f"one\n\n{E}\n\n two {E}", "<|endoftext|", "<|ENDOFTEXT|>", f"é😀{E}日本", "plain words  \n", ""]


def test_texts_that_hold_an_added_token(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in TEXTS]
    assert ids[0] == [64, 220, 50256, 275, 1]
    for got in (queries.op3_packing(spark, str(tmp_path)).collect(), stages.pack(spark, docs, "").collect()):
        for k, own in enumerate(ids):
            pieces = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"])
            assert [r["doc_tokens"] for r in pieces] == [len(own)] * len(pieces) and sum(r["length"] for r in pieces) == len(own)
            for r in pieces:
                assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


@pytest.mark.parametrize("flag", ["single_word", "lstrip", "rstrip"])
def test_added_tokens_that_ask_for_more(tmp_path, flag):
    token = {"id": 9, "content": "<x>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"added_tokens": [token], "normalizer": None}))
    assert packing.added_tokens(str(path)) == (("<x>", 9),)
    path.write_text(json.dumps({"added_tokens": [token | {flag: True}], "normalizer": None}))
    with pytest.raises(ValueError):
        packing.added_tokens(str(path))

"""Packing of very long runs of one letter, and of conversations under three limits that all bind."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexigrain.llm import packing, queries

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("letter", [" ", "\n", "a", "😀", "ab "])
def test_long_runs(letter):
    encode = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, packing.added_tokens(P.path("byte_bpe_50k.json")))
    for n in (90_000, 1_300_000 // len(letter)):
        ids = encode(letter * n + "end<|endoftext|> x")
        assert ids[-3] == 50256 or 50256 in ids[-4:]
        import tiktoken
        from lexigrain.llm.byte_bpe import read_ranks

        back = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={"<|endoftext|>": 50256})
        assert back.decode(ids) == letter * n + "end<|endoftext|> x"


def test_both_ways_of_encoding_agree(monkeypatch):
    texts = ["one two  three\n\n four " * 50, "  \n \t x" * 300, "日本語 text مرحبا " * 99, "a" * 5000 + "  "]
    encode = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    short = [encode(t) for t in texts]
    monkeypatch.setattr(packing, "LONG_TEXT", 1)
    assert [encode(t) for t in texts] == short


def test_conversations_under_three_limits(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    ids = defaultdict(list)
    for r in turns:
        ids[r["conv_id"], r["turn"]].append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    role = {(r["conv_id"], r["turn"]): r["role"] for r in turns}
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in queries.pack_conversations(spark, SF).collect():
        bins[r["sequence_id"]].append(r)
        pieces[r["conv_id"], r["turn"]].append(r)
    assert set(pieces) == set(ids)
    for key, own in pieces.items():
        assert sorted(n for r in own for n in range(r["start"], r["start"] + r["length"])) == sorted(n for x in ids[key] for n in range(len(x)))
        for r in own:
            assert any(r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in ids[key])
            assert r["loss_tokens"] == (r["length"] if role[key] == "assistant" else 0)
    full = {"tokens": 0, "segments": 0, "loss": 0}
    for own in bins.values():
        total, loss = sum(r["length"] for r in own), sum(r["loss_tokens"] for r in own)
        assert total <= 2048 and len(own) <= 16 and loss <= 1024
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        full["tokens"] += total > 2040
        full["segments"] += len(own) == 16
        full["loss"] += loss > 1010
    assert all(full.values()), full


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, None, None, "x"), (2, 0, "assistant", "word " * 9000), (2, 0, "assistant", "word " * 9000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = packing.pack_conversations(frame, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    by = defaultdict(int)
    for r in got:
        by[r["conv_id"], r["turn"]] += r["length"]
        assert r["loss_tokens"] <= 1024
    assert by[1, 0] == by[1, 1] == 1 and by[None, None] == 2 and by[2, 0] % 2 == 0 and by[2, 0] >= 18_000
    assert packing.pack_conversations(frame.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0

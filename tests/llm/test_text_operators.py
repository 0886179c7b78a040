"""Tokenizing, packing, media, licences and extraction against independent results."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexigrain.llm import byte_bpe, html_crf, license_scan, packing, transport_stream, words

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n\n  a", "don't I'll we've", "a" * 3000, "日本語 text مرحبا", "😀😀 x y", "<|endoftext|>", "\x00\x01\x7f", "  \t  \n", "1234567 89², ½"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_texts():
    rng = random.Random(4)
    letters = "abc XYZ \n\t'.,!?éßñ漢字😀0123²"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(200)]


def test_codec_equals_the_library():
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    for text in odd_texts():
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_model_file_needs_gapless_ranks():
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({b"a": 0, b"b": 2})


def test_encode_documents(documents):
    for r in documents.join(byte_bpe.encode_documents(documents, RANKS, P.PATTERN, with_ids=True), "doc_id").collect():
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()


def test_packing_covers_every_id_once(documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = documents.collect()
    ids = {r["doc_id"]: [*e.ids, 1] for r, e in zip(rows, tokenizer.encode_batch([r["text"] for r in rows], add_special_tokens=False))}
    pieces = packing.pack_documents(documents, RANKS, P.PATTERN, json_path=P.path("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        part = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        assert p["ids_crc32"] == zlib.crc32(part) and p["length"] > 0
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            at += p["length"]
        assert at == len(ids[doc])
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and len(own) <= 64
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padding < 0.01 * total


def test_examples_keep_all_limits(spark):
    rng = random.Random(1)
    rows = [(k, n := rng.randint(0, 900), rng.randint(0, n)) for k in range(700)]
    limits = packing.Limits(tokens=1000, segments=5, loss_tokens=600, window=64)
    rows = [(k, n, min(m, 600)) for k, n, m in rows] + [(1000, None, None)]
    out = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long"), limits).collect()
    assert sorted(r["example_id"] for r in out) == sorted(r[0] for r in rows)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append(r)
    for own in bins.values():
        assert sum(r["tokens"] for r in own) <= 1000 and len(own) <= 5 and sum(r["loss_tokens"] for r in own) <= 600
        assert sorted(r["segment"] for r in own) == list(range(len(own)))
    need = max(sum(r[1] or 0 for r in rows) / 1000, len(rows) / 5, sum(r[2] or 0 for r in rows) / 600)
    assert len(bins) <= 1.35 * need + 4


def test_example_over_a_limit():
    packer = packing.Packer(packing.Limits(tokens=10, loss_tokens=10), cuts=False)
    with pytest.raises(ValueError):
        list(packer.add("x", 11, 0))


def test_binary_tail():
    parts = list(packing.binary_tail([("a", 0, 100), ("b", 5, 37)], 2048))
    assert [sum(n for _, _, n in p) for p in parts] == [128, 8, 1]


def test_streams_round_trip():
    rng = random.Random(2)
    for n in [*range(0, 400), 32_640, 32_641, 70_001, 300_000]:
        payload = rng.randbytes(n)
        got = transport_stream.demux(transport_stream.mux(payload))
        assert got.data == payload and got.continuity_errors == 0
        assert len(got.pts) == -(-n // transport_stream.UNIT_BYTES)
        assert [u for u, _, _ in got.random_access] == list(range(0, len(got.pts), transport_stream.RANDOM_EVERY))


def test_damaged_streams():
    stream = bytearray(transport_stream.mux(b"abc" * 500))
    lost = bytes(stream[: 3 * 188] + stream[4 * 188 :])
    with pytest.raises(transport_stream.StreamError):
        transport_stream.demux(lost)  # the elementary packet is short
    hit = stream.copy()
    hit[20] ^= 1
    with pytest.raises(transport_stream.StreamError):
        transport_stream.demux(bytes(hit))  # a table's checksum
    twisted = stream.copy()
    twisted[4 * 188 + 3] ^= 5
    assert transport_stream.demux(bytes(twisted)).continuity_errors > 0


def test_stored_texts(documents):
    for r in documents.join(transport_stream.store_texts(documents, with_media=True), "doc_id").collect():
        n, payload = transport_stream.pad_payload(r["text"])
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 64 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])


def test_words_against_a_plain_split():
    import re

    split = re.compile(rb"[^\x20\x09-\x0D]+")
    texts = [t.encode() for t in odd_texts()] + [b"w" * 600_000 + b" tail", b"ab cd " * 120_000]
    known = {}
    for first, last, hashes, endings, bounds in words.words_and_endings(texts, 3):
        for i in range(first, last):
            own = split.findall(texts[i].translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
            got = hashes[bounds[i - first] : bounds[i - first + 1]].tolist()
            ends = endings[bounds[i - first] : bounds[i - first + 1]].tolist()
            assert len(own) == len(got) == len(ends)
            for w, h, e in zip(own, got, ends):
                assert known.setdefault(w, h) == h and known.setdefault((w[-3:],), e) == e
    whole = {w: h for w, h in known.items() if isinstance(w, bytes)}
    assert len(set(whole.values())) == len(whole)


def license_windows(scanner, text):
    """{template: (share, first word)} of the best window of every template found, by looking at all windows."""
    own = text.encode().translate(words.PLAIN).lower().split()
    pairs, out = list(zip(own, own[1:])), {}
    for name in scanner.names:
        t = license_scan.TEMPLATES[name].encode().translate(words.PLAIN).lower().split()
        template = set(zip(t, t[1:]))
        shares = [(len(template.intersection(pairs[a : a + len(t) - 1])) / len(template), -a) for a in range(max(1, len(pairs) - len(t) + 2))]
        if (best := max(shares))[0] >= 0.8:
            out[name] = (best[0], -best[1])
    return out


def test_licenses_against_every_window(documents):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    rng = random.Random(12)
    extra = ["word " * 30 + license_scan.TEMPLATES["mit-grant"] + " more words", "Permission is hereby granted, free of cost, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction", "nothing here", "", "all rights", "All rights reserved. " * 40]
    for t in license_scan.TEMPLATES.values():
        own = t.split()
        for _ in range(6):  # words lost, put in and replaced, around the share that decides
            some = [w if rng.random() > 0.04 else rng.choice(["", "word", w + " word"]) for w in own]
            cut = rng.choice([0, 0, len(some) // 9])
            extra.append("some words before " * rng.choice([0, 1]) + " ".join(some[cut:]))
    texts = [r["text"] for r in documents.collect()] + extra
    got = [{} for _ in texts]
    for first, last, hashes, bounds in words.word_hashes([t.encode().translate(words.PLAIN) for t in texts]):
        for i, k, start, share in scanner.scan(hashes, bounds):
            got[first + i][scanner.names[k]] = (share, start)
    for text, found in zip(texts, got):
        want = license_windows(scanner, text)
        assert found.keys() == want.keys()
        for name, (share, start) in want.items():
            assert found[name][0] == pytest.approx(share) and found[name][1] == start
    assert sum(map(len, got)) > 150


def test_band_count():
    bands = license_scan.bands_for(0.6, 2, 0.999)
    assert 1 - (1 - 0.6**2) ** bands >= 0.999 > 1 - (1 - 0.6**2) ** (bands - 1)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Brand</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies to improve your visit.<button>OK</button></div>
<main><article><h1>A  headline &amp; more</h1><p>First paragraph with a <a href="/x">link</a> and
 some&nbsp;words that make up a sentence.</p><div class="advert">Buy now, cheap things for sale.</div><ul><li>One item of the list</li><li>Another item</li></ul>
<script>var x = "<p>no</p>";</script><p>Second<br>paragraph, long enough to be read by somebody.</p></article>
<section id="comments" class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I don't agree with this article at all.</p></div></section></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Other story</a></li></ul></aside>
<form><label>Search</label><input></form><footer>&copy; 2024 Somebody</footer></body></html>"""


def test_extraction_of_a_page():
    assert html_crf.trained().extract(PAGE).split("\n") == ["A headline & more", "First paragraph with a link and some words that make up a sentence.", "One item of the list", "Another item", "Second paragraph, long enough to be read by somebody."]


def test_marginals_against_enumeration():
    model, page = html_crf.trained(), html_crf.Page("<div><p>some text here</p><ul><li><a>x</a></li></ul></div>")
    n, scores = len(page.tags), [np.clip(sum(model.weights[list(f)]), -html_crf.TOP, html_crf.TOP) for f in html_crf.features(page)]
    total = np.zeros((n, 2))
    for state in range(2**n):
        y = [state >> k & 1 for k in range(n)]
        weight = sum(s * v for s, v in zip(scores, y)) + sum(model.edges[html_crf.kind(page.tags[k]), y[page.parent[k]], y[k]] for k in range(1, n))
        for k in range(n):
            total[k, y[k]] += np.exp(weight)
    assert np.allclose(model.marginals(page), total[:, 1] / total.sum(axis=1), atol=1e-9)


def test_held_out_pages():
    model, wrong, nodes = html_crf.trained(), 0, 0
    for source, labels in html_crf.labelled_pages(150, 77):
        p = model.marginals(html_crf.Page(source))
        wrong += sum((a >= 0.5) != b for a, b in zip(p, labels))
        nodes += len(labels)
    assert wrong < 0.02 * nodes


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_crf.extract_main_text(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "plain words only"), (3, "u", "<p>a<!-- x --><p>b<"), (4, "u", "<div>" * 20_000 + "deep"), (5, "u", "<a href='x>" * 50)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in html_crf.extract_main_text(odd).collect()}
    assert rows[1]["text"] == "" and rows[None]["n_chars"] == 0 and len(rows) == 6

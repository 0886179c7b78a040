"""Byte-level BPE through a sentencepiece model serialised from a rank file.

The model file is protobuf; its few fields are written here by hand: one piece
for each ranked byte string, spelt with one printable character a byte, scored
by its negative rank, so that sentencepiece's best-score-first merging is
merging by rank. The normaliser is the identity. Text is cut into pre-tokens
first and every match is encoded by itself; decoding maps ids back to pieces
and pieces back to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column

#: Pre-tokens kept with their ids before the memory of them is emptied.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """For each byte a printable character: itself where it is printable Latin-1, else the next from U+0100."""
    fine = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in fine else next(spare)) for b in range(256)]


LETTERS = byte_letters()
_SPELT = {b: LETTERS[b] for b in range(256)}


def spell(data: bytes) -> str:
    """Bytes as one character each."""
    return data.decode("latin-1").translate(_SPELT)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: integers as varints, floats as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks; one unknown piece follows them.

    Ranks must be 0..n-1 and hold all 256 single bytes; ValueError otherwise.
    """
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be gapless from 0 and hold every single byte")
    normal, unknown, bpe = 1, 2, 2  # enum values of the format
    pieces = [_field(1, spell(t).encode()) + _field(2, float(-r)) + _field(3, normal) for r, t in enumerate(by_rank)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(by_rank)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and ids to bytes with one model."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.find = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        unspelt = {c: b for b, c in enumerate(LETTERS)}
        #: decimal id -> bytes, read back from the model's own pieces
        self.bytes_of = {str(i): bytes(unspelt[c] for c in self.sp.id_to_piece(i)) for i in range(len(ranks))}
        self.known: dict[str, str] = {}

    def decimals(self, texts: list[str]) -> list[str]:
        """For each text its ids in decimal, joined by one space."""
        cut = list(map(self.find, texts))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*cut).difference(known))
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            for t, ids in zip(some, self.sp.encode([spell(t.encode()) for t in some], num_threads=1)):
                known[t] = " ".join(map(str, ids)) if len(ids) > 1 else str(ids[0])
        look = known.__getitem__
        return [" ".join(map(look, tokens)) for tokens in cut]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.decimals([text])[0].split()]

    def decode(self, ids: list[int]) -> bytes:
        """KeyError for an id outside the vocabulary."""
        return b"".join(self.bytes_of[str(i)] for i in ids)


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes each text and decodes it again, one row per input row.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one
    space), decoded_sha256 and, on request, ids. ``path`` is a rank file that
    every executor can open, ``pattern`` cuts the pre-tokens. A null text is an
    empty one: no tokens, both hashes those of no bytes. A null doc_id stays
    null; repeated rows give repeated results; an empty table gives none; other
    columns are ignored. Long texts are whole; memory is a few times the longest
    text. No shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (s for b in batches for s in slices(b)):
            counts, hashes, back, all_ids = [], [], [], []
            for said in own.decimals(batch.column(1).to_pylist()):
                ids = said.split(" ") if said else []
                counts.append(len(ids))
                hashes.append(hashlib.sha256(said.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(own.bytes_of.__getitem__, ids))).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids])
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, schema)

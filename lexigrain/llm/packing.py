"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
Bins are filled one after the other: of a bounded window of pending pieces the
fitting one with the largest dot product of its demand and the bin's remaining
room goes in next, each dimension weighted by how scarce it is in the window.
Every task packs the rows it reads, so nothing is shuffled and a task's state is
the window, one bin and one document.
"""

from __future__ import annotations

import array
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column

#: Local sequence numbers per task; the task's partition number stands above them.
LOCAL_BITS = 36


@dataclass
class Limits:
    """Of one sequence. ``window``: pending pieces looked at; ``least_cut``: a gap of so many tokens is filled by cutting a piece."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    window: int = 256
    least_cut: int = 8


@dataclass
class Packer:
    """Takes pieces (key, tokens, loss tokens), gives closed bins: lists of (key, cut from, tokens).

    With ``cuts`` a piece may be divided; its loss tokens are then divided in
    proportion, rounded up, which never exceeds the bin's room for them.
    """

    limits: Limits
    cuts: bool = True
    keys: list = field(default_factory=list)
    demand: list = field(default_factory=list)

    def add(self, key: object, tokens: int, loss: int) -> Iterator[list]:
        own = self.limits
        if not self.cuts and (tokens > own.tokens or loss > own.loss_tokens):
            raise ValueError(f"an example of {tokens} tokens, {loss} loss-bearing, exceeds the limits of a sequence")
        self.keys.append((key, 0))
        self.demand.append((tokens, 1, loss))
        if len(self.keys) >= own.window:
            yield self.fill()

    def rest(self) -> Iterator[list]:
        while self.keys:
            yield self.fill()

    def fill(self) -> list:
        own = self.limits
        demand = np.array(self.demand, dtype=np.int64)
        full = np.array([own.tokens, own.segments, own.loss_tokens], dtype=np.int64)
        room, alive, chosen = full.copy(), np.ones(len(demand), bool), []
        share = demand / np.maximum(full, 1)
        weighted = share * share.mean(axis=0)
        while True:
            fits = alive & (demand <= room).all(axis=1)
            if fits.any():
                score = np.where(fits, weighted @ (room / np.maximum(full, 1)), -1.0)
                k = int(score.argmax())
                alive[k] = False
                room -= demand[k]
                (key, start), tokens = self.keys[k], int(demand[k, 0])
                chosen.append((key, start, tokens))
                continue
            if self.cuts and room[0] >= own.least_cut and room[1] > 0 and alive.any():
                k = int(np.where(alive, demand[:, 0], -1).argmax())
                tokens, loss = int(demand[k, 0]), int(demand[k, 2])
                size = min(int(room[0]), int(room[2]) * tokens // loss if loss else int(room[0]), tokens - 1)
                if size >= own.least_cut:
                    part = min(loss, -(-loss * size // tokens))
                    if part <= room[2]:
                        (key, start) = self.keys[k]
                        chosen.append((key, start, size))
                        self.keys[k], demand[k, 0], demand[k, 2] = (key, start + size), tokens - size, loss - part
                        room -= (size, 1, part)
                        continue
            break
        self.keys = [x for x, a in zip(self.keys, alive) if a]
        self.demand = [tuple(map(int, x)) for x in demand[alive]]
        if not chosen:
            raise ValueError("a piece fits no empty sequence")
        return chosen


def binary_tail(pieces: list, tokens: int) -> Iterator[list]:
    """A part-filled bin as bins whose lengths are powers of two, largest first."""
    total = sum(p[2] for p in pieces)
    if total >= tokens or not total:
        yield pieces
        return
    pieces = list(pieces)[::-1]
    while total:
        want = size = 1 << (total.bit_length() - 1)
        own = []
        while want:
            key, start, n = pieces.pop()
            take = min(n, want)
            own.append((key, start, take))
            if take < n:
                pieces.append((key, start + take, n - take))
            want -= take
        total -= size
        yield own


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """(content, id) of the added tokens of a tokenizer's JSON form, which texts are split at before anything else."""
    with open(json_path, encoding="utf-8") as file:
        told = json.load(file)
    tokens = told["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and told["normalizer"]:
            raise ValueError(f"the added token {t['content']!r} asks for more than a plain match")
        if any(o is not t and o["content"].startswith(t["content"]) for o in tokens):
            raise ValueError(f"the added token {t['content']!r} begins another one")
    return tuple((t["content"], t["id"]) for t in tokens)


#: Code points from which a text is cut at pre-tokens here: the library's own matching fails on very long runs of white space.
LONG_TEXT = 100_000


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Callable[[str], list[int]]:
    """A function from a text to its ids; the ``added`` tokens are found in texts as one id each."""
    import tiktoken

    from .byte_bpe import codec, read_ranks

    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    ids_of_added = dict(added)
    find = re.compile("(" + "|".join(map(re.escape, ids_of_added)) + ")").split if added else None

    def plain(text: str) -> list[int]:
        return encoding.encode_ordinary(text) if len(text) < LONG_TEXT else codec(ranks_path, pattern).encode(text)

    def encode(text: str) -> list[int]:
        if find is None or not any(t in text for t in ids_of_added):
            return plain(text)
        out: list[int] = []
        for part in find(text):
            if part in ids_of_added:
                out.append(ids_of_added[part])
            elif part:
                out += plain(part)
        return out

    return encode


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, limits: Limits | None = None, end_id: int = 1, json_path: str | None = None) -> DataFrame:
    """Packs every document's ids, then ``end_id``, into sequences of at most ``limits.tokens``.

    One row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32 (of its little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset (from 0, gapless in the sequence). All tokens of a
    document bear loss. Stretches of ``limits.tokens`` fill sequences of their
    own; what is left of each document goes through the packer. A task's last,
    part-filled sequence is cut at powers of two, which need no padding.

    The ids are those of the vocabulary's JSON form at its default setting; the
    rank form of the same vocabulary is used because its library is several times
    faster, with the added tokens of ``json_path`` (without it a text that holds
    one is encoded as plain text). The driver reads that file. A null or
    empty text is the end id alone; a null doc_id stays null; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    Sequence numbers depend on how the input is split among tasks only.
    """
    own = limits or Limits()
    if own.loss_tokens < own.tokens:
        raise ValueError("all tokens of a document bear loss: loss_tokens must be tokens at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), F.lit(True).alias("loss"))
    return _pack_texts(texts, own, ranks_path, pattern, end_id, json_path)


def pack_conversations(turns: DataFrame, ranks_path: str, pattern: str, limits: Limits | None = None, learnt: str = "assistant", end_id: int = 1, json_path: str | None = None) -> DataFrame:
    """Packs the turns of conversations as instruction data under all three limits.

    A turn's ids, then ``end_id``, are one example; they bear loss where its
    ``role`` is ``learnt`` and none otherwise. Rows are as those of
    ``pack_documents``, with conv_id and turn in place of doc_id and loss_tokens
    (of the piece) at the end. A turn may be cut; all of it bears loss or none of
    it does, so a piece's loss is exact. A null text is empty, a null role isn't
    ``learnt``, null ids stay null; repeated rows are packed each; an empty table
    gives no rows; other columns are ignored.
    """
    own = limits or Limits(segments=16, loss_tokens=1024)
    texts = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_column(turns).alias("text"), F.coalesce(F.col("role") == learnt, F.lit(False)).alias("loss"))
    packed = _pack_texts(texts.select("conv_id", "text", "loss", "turn"), own, ranks_path, pattern, end_id, json_path)
    return packed.select("conv_id", "turn", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def _pack_texts(texts: DataFrame, own: Limits, ranks_path: str, pattern: str, end_id: int, json_path: str | None) -> DataFrame:
    """Pieces of texts. ``texts``: an id, the text, whether its ids bear loss, and with a second id also that and loss_tokens come back."""
    added = added_tokens(json_path) if json_path else ()
    ids_named = [c for c in texts.columns if c not in ("text", "loss")]
    several = len(ids_named) > 1
    schema = ", ".join([*(f"{c} long" for c in ids_named), SCHEMA, *(["loss_tokens long"] if several else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern, added)
        packer = Packer(own)
        held: dict[int, list] = {}  # number -> [ids of the row, ids of its text, first id held, left to place, all ids, loss]
        sequence = TaskContext.get().partitionId() << LOCAL_BITS
        rows: list[tuple] = []
        number = 0

        def place(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for key, start, n in pieces:
                doc = held[key]
                begin = doc[2] + start
                crc = zlib.crc32(doc[1][4 * start : 4 * (start + n)])
                rows.append((*doc[0], begin, n, crc, doc[4], sequence, offset, *([n if doc[5] else 0] if several else ())))
                offset += n
                doc[3] -= n
                if not doc[3]:
                    del held[key]
            sequence += 1

        def out() -> pa.RecordBatch:
            names = [x.split()[0] for x in schema.split(", ")]
            columns = list(zip(*rows)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in (s for b in batches for s in slices(b)):
            for first, text, loss, *others in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode(text)
                ids.append(end_id)
                data, total = array.array("I", ids).tobytes(), len(ids)
                # a stretch that fills a sequence by itself needs no packer
                whole = total - total % own.tokens if not loss or own.loss_tokens >= own.tokens else 0
                for a in range(0, whole, own.tokens):
                    crc = zlib.crc32(data[4 * a : 4 * (a + own.tokens)])
                    rows.append((first, *others, a, own.tokens, crc, total, sequence, 0, *([own.tokens if loss else 0] if several else ())))
                    sequence += 1
                if left := total - whole:
                    held[number] = [(first, *others), data[4 * whole :], whole, left, total, loss]
                    for pieces in packer.add(number, left, left if loss else 0):
                        place(pieces)
                    number += 1
                if len(rows) > 20_000:
                    yield out()
        closed = list(packer.rest())
        for pieces in closed[:-1]:
            place(pieces)
        for pieces in binary_tail(closed[-1], own.tokens) if closed else ():
            place(pieces)
        yield out()

    return texts.mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Places whole examples (example_id, tokens, loss_tokens) under all three limits; none is cut.

    Returns example_id, tokens, loss_tokens, sequence_id, offset, segment. Null
    counts are 0; an example without tokens still takes a segment. An example
    over a limit raises ValueError, since it fits nowhere. Rows are packed by the
    task that reads them.
    """
    own = limits or Limits()
    schema = "example_id long, tokens long, loss_tokens long, sequence_id long, offset long, segment int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = Packer(own, cuts=False), TaskContext.get().partitionId() << LOCAL_BITS

        def placed(pieces: list) -> list[tuple]:
            nonlocal sequence
            offset, out = 0, []
            for segment, (key, _, n) in enumerate(pieces):
                out.append((key[0], n, key[1], sequence, offset, segment))
                offset += n
            sequence += 1
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.int32()]
            columns = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

        for b in batches:
            rows = []
            for example, tokens, loss in zip(*(b.column(i).to_pylist() for i in range(3))):
                for pieces in packer.add((example, loss), tokens, loss):
                    rows += placed(pieces)
            yield batch_of(rows)
        yield batch_of([r for pieces in packer.rest() for r in placed(pieces)])

    some = examples.select(F.col("example_id").cast("long").alias("example_id"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("tokens", "loss_tokens")))
    return some.mapInArrow(run, schema)

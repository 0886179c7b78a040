"""A Brown class-based bigram model: exchange clustering, class transitions, word emissions.

P(word | before) = P(class of word | class of the word before) * P(word | class
of word). Exchange clustering goes on in two steps. The words whose share of all
training tokens is ``Settings.frequent`` at least are exchanged one at a time, with
all rarer words as groups of equal endings beside them: tasks count each one's
neighbours by class over the whole corpus, and each in turn moves to the class that
gains most in likelihood, the class counts following every move. Then each rarer
word, dealt by word to tasks with its own neighbours by class, joins the class that
gains most; ``Settings.words`` words get classes in this way. Only words beyond
those, the rarest, share the class of their ending. Every word, however rare, has
its own emission from its own count.

Classes and counts of these words are bounded by the settings and travel to all
tasks; counts of words beyond them don't fit everywhere, so lookups of them are
dealt by word in packed arrays, and their sums by document come back the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_column
from .words import words_and_endings

LOCAL_BITS = 36
#: Words whose counts are looked up in one bucket, about.
BUCKET_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    """``frequent``: share of words that are exchanged one at a time; ``words``: that have classes of their own at most; ``groups``: of other words by ending of ``ending`` bytes; ``prior``: weight of the class's own share in its transitions."""

    classes: int = 64
    frequent: float = 2e-5
    words: int = 2_000_000
    groups: int = 1024
    ending: int = 3
    sweeps: int = 6
    prior: float = 4.0
    seed: int = 17


class Units:
    """The unit of a word: its place among the frequent ones, else its ending's group; the text's end is the last unit."""

    def __init__(self, words: np.ndarray, groups: int):
        self.words, self.groups = np.sort(words), groups
        self.end = len(words) + groups

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        group = len(self.words) + (endings % np.uint64(self.groups)).astype(np.int64)
        if not len(self.words):
            return group
        signed = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.words, signed), len(self.words) - 1)
        return np.where(self.words[at] == signed, at, group)


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, order: np.ndarray, n_classes: int) -> np.ndarray:
    """One sweep: the units of ``order``, one after the other, each go to the class that gains most, and the class counts follow.

    ``before[u, c]`` and ``after[u, c]`` count the neighbours of u by class, as
    they were when the sweep began. The likelihood of a class bigram model is, but
    for constants, the sum of n log n over class pairs less that over the classes'
    totals on either side.
    """
    out = classes.copy()
    pair = np.zeros((n_classes, n_classes))
    np.add.at(pair, classes, after)
    rows, columns = pair.sum(axis=1), pair.sum(axis=0)
    for u in order.tolist():
        left, right, own = before[u], after[u], out[u]
        n_left, n_right = left.sum(), right.sum()
        if not n_left + n_right:
            continue
        pair[own] = np.maximum(pair[own] - right, 0)
        pair[:, own] = np.maximum(pair[:, own] - left, 0)
        rows[own], columns[own] = max(rows[own] - n_right, 0), max(columns[own] - n_left, 0)
        to, since = np.flatnonzero(right), np.flatnonzero(left)
        ahead, behind = pair[:, to], pair[since]
        gain = (_gain(ahead + right[to]) - _gain(ahead)).sum(axis=1) + (_gain(behind + left[since, None]) - _gain(behind)).sum(axis=0)
        gain -= _gain(rows + n_right) - _gain(rows) + _gain(columns + n_left) - _gain(columns)
        new = int(gain.argmax())
        pair[new] += right
        pair[:, new] += left
        rows[new] += n_right
        columns[new] += n_left
        out[u] = new
    return out


def joining(pair: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The class that each of some rare words joins by its neighbours: the gain of the sweep above, to first order in the word's counts."""
    rows, columns = np.log(pair.sum(axis=1) + 1), np.log(pair.sum(axis=0) + 1)
    seen = np.log(pair + 0.5)
    gain = after @ seen.T + before @ seen - after.sum(axis=1)[:, None] * rows[None, :] - before.sum(axis=1)[:, None] * columns[None, :]
    return gain[:, :-1].argmax(axis=1)  # the last class is the end's own


@dataclass(frozen=True)
class Model:
    """``units``: the words with classes of their own, groups, the end; ``counts``: of these words, in the units' order; ``join``: log10 transitions; ``room``: log10 of each class's denominator."""

    units: Units
    classes: np.ndarray
    counts: np.ndarray
    join: np.ndarray
    room: np.ndarray
    train_tokens: int
    distinct: int
    end_count: int


def _training(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held = F.crc32(key.cast("binary")) % 7 == 2
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), held.alias("held_out"))


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return b.column(1).cast(pa.binary()).to_pylist()


def _word_counts(train: DataFrame, settings: Settings) -> DataFrame:
    """(word, grp, c): every training word by hash, the group of its ending and its count; the word of a null is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = ends = 0

        def merged() -> tuple:
            word, group, times = (np.concatenate(c) for c in zip(*kept))
            found, at, back = np.unique(word, return_index=True, return_inverse=True)
            return found, group[at], np.bincount(back, times, len(found)).astype(np.int64)

        def out() -> pa.RecordBatch:
            word, group, times = merged()
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(group.astype(np.int32)), pa.array(times)], names=["word", "grp", "c"])

        for b in (s for x in batches for s in slices(x)):
            ends += b.num_rows
            for _, _, hashes, endings, _ in words_and_endings(_bytes(b), settings.ending):
                word, at, times = np.unique(hashes.view(np.int64), return_index=True, return_counts=True)
                kept.append((word, (endings[at] % np.uint64(settings.groups)).astype(np.int64), times))
                held += len(word)
                if held > 400_000:
                    kept = [merged()]
                    held = len(kept[0][0])
                    if held > 300_000:
                        yield out()
                        kept, held = [], 0
        if kept:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], names=["word", "grp", "c"])

    counted = train.select("doc_id", "text").mapInArrow(run, "word long, grp int, c long")
    return counted.groupBy("word").agg(F.max("grp").alias("grp"), F.sum("c").alias("c"))


def _unit_streams(train: DataFrame, units: Units, settings: Settings) -> DataFrame:
    """The training corpus as unit numbers, an end after each text, some texts to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            rows = []
            for _, _, hashes, endings, bounds in words_and_endings(_bytes(b), settings.ending):
                rows.append(np.insert(units.of(hashes, endings), bounds[1:], units.end).astype(np.uint32 if units.end > 0xFFFF else np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["units"])

    return train.select("doc_id", "text").mapInArrow(run, "units binary")


def _neighbours(streams: DataFrame, classes: np.ndarray, n: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each unit its neighbours before and after it by class; bounded by units and classes."""
    k, kind = settings.classes, np.uint32 if n - 1 > 0xFFFF else np.uint16
    shared = streams.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n * k), np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                u = np.frombuffer(raw, kind).astype(np.int64)
                c = shared.value[u].astype(np.int64)
                previous = np.append(shared.value[n - 1], c[:-1])
                total[0] += np.bincount(u * k + previous, minlength=n * k)
                # the end stands before the next text's first word
                total[1] += np.bincount(np.append(n - 1, u[:-1]) * k + c, minlength=n * k)
        both = np.concatenate(list(total.reshape(2, n, k)), axis=1)
        live = np.flatnonzero(both.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array([x.tobytes() for x in both[live].astype(np.uint32)], pa.binary())], names=["unit", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for u, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                some = np.frombuffer(raw, np.uint32)
                sums[u] = sums[u] + some if u in sums else some.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["unit", "counts"])

    got = streams.mapInArrow(count, "unit int, counts binary").repartition("unit").mapInArrow(add, "unit int, counts binary").toArrow()
    both = np.zeros((n, 2 * k))
    for u, raw in zip(got.column("unit").to_pylist(), got.column("counts").to_pylist()):
        both[u] = np.frombuffer(raw, np.int64)
    return both[:, :k], both[:, k:]


def _floor(counts: DataFrame, most: int, tokens: int) -> int:
    """The least count that ``most`` words at most reach."""
    steps = 1000
    found = {r["c"]: r["n"] for r in counts.where("word is not null").groupBy(F.least("c", F.lit(steps)).alias("c")).agg(F.count("*").alias("n")).collect()}
    if found.get(steps, 0) > most:
        return tokens // most + 1
    left, floor = most, steps
    while floor > 1 and found.get(floor - 1, 0) + found.get(floor, 0) <= left:
        left -= found.get(floor, 0)
        floor -= 1
    return floor if found.get(floor, 0) <= left else floor + 1


def _joined(training: DataFrame, units: Units, inner: Units, classes: np.ndarray, pair: np.ndarray, settings: Settings) -> np.ndarray:
    """The class of each word of ``units``: that of ``inner``, or for words that aren't there the one they join."""
    k, n = settings.classes, len(units.words)
    known = np.zeros(n, bool)
    if len(inner.words):
        known[np.searchsorted(units.words, inner.words)] = True
    rare = np.flatnonzero(~known)
    out = np.zeros(n, np.uint8)
    out[known] = classes[: len(inner.words)]
    if not len(rare):
        return out
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast((units, inner, classes, ~known))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4096 + 1)
    end = int(classes[inner.end])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed (word, side, class) of rare words' neighbours, by bucket of the word."""
        all_units, few, own, wanted = shared.value
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key = np.sort(np.concatenate(held))
            held.clear()
            place = key // (2 * k)
            bucket = (place % buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, key = bucket[order], key[order]
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
            rows = [(int(bucket[a]), key[a:z].astype(np.uint32).tobytes()) for a, z in zip(edges, edges[1:]) if z > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["bucket", "keys"])

        for b in (s for x in batches for s in slices(x)):
            for _, _, hashes, endings, bounds in words_and_endings(_bytes(b), settings.ending):
                c = own[few.of(hashes, endings)].astype(np.int64)
                line = np.insert(c, bounds[1:], end)
                at = np.arange(len(c)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                place = all_units.of(hashes, endings)
                some = np.flatnonzero(place < len(all_units.words))
                some = some[wanted[place[some]]]
                previous = np.append(end, line[:-1])[at[some]]
                held += [place[some] * (2 * k) + previous, place[some] * (2 * k) + k + line[at[some] + 1]]
                size += 2 * len(some)
                if size > 2_000_000:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key = np.frombuffer(raw, np.uint32).astype(np.int64)
                if bucket not in totals:
                    totals[bucket] = np.zeros(((n - bucket - 1) // buckets + 1, 2 * k), np.float32)
                place = key // (2 * k)
                np.add.at(totals[bucket], ((place - bucket) // buckets, key % (2 * k)), 1)
        for bucket, both in totals.items():
            live = np.flatnonzero(both.any(axis=1))
            chosen = joining(pair, both[live, :k].astype(np.float64), both[live, k:].astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array((live * buckets + bucket).astype(np.int32)), pa.array(chosen.astype(np.int16))], names=["place", "class"])

    packed = training.select("doc_id", "text").mapInArrow(neighbours, "bucket int, keys binary")
    got = packed.repartition(buckets, "bucket").mapInArrow(choose, "place int, class smallint").toArrow()  # ``words`` rows at most
    out[np.asarray(got.column("place"))] = np.asarray(got.column("class"))
    return out


def _transitions(training: DataFrame, units: Units, classes: np.ndarray, settings: Settings) -> np.ndarray:
    """How often each class follows each, an end after each text and before the first word of each."""
    k, end = settings.classes, int(classes[units.end])
    shared = training.sparkSession.sparkContext.broadcast((units, classes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_units, own = shared.value
        total = np.zeros(k * k, np.int64)
        for b in (s for x in batches for s in slices(x)):
            for _, _, hashes, endings, bounds in words_and_endings(_bytes(b), settings.ending):
                line = np.insert(own[all_units.of(hashes, endings)].astype(np.int64), bounds[1:], end)
                total += np.bincount(np.append(end, line[:-1]) * k + line, minlength=k * k)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(total[live])], names=["pair", "n"])

    counted = training.select("doc_id", "text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # classes squared at most
    out = np.zeros(k * k)
    for r in counted:
        out[r["pair"]] = r["n"]
    return out.reshape(k, k)


def _groups(counts: DataFrame, settings: Settings, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each group, of words below a count."""
    tokens, kinds = np.zeros(settings.groups), np.zeros(settings.groups)
    for r in counts.where(F.col("word").isNotNull() & (F.col("c") < F.lit(floor))).groupBy("grp").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["grp"]], kinds[r["grp"]] = r["c"], r["v"]
    return tokens, kinds


def _known(counts: DataFrame, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur so often, sorted, and their counts; bounded by the floor."""
    found = counts.where(F.col("word").isNotNull() & (F.col("c") >= F.lit(floor))).select("word", "c").toArrow()
    words, times = np.asarray(found.column("word"), np.int64), np.asarray(found.column("c"), np.int64)
    order = np.argsort(words)
    return words[order], times[order]


def train(docs: DataFrame, settings: Settings | None = None) -> tuple[Model, DataFrame, int]:
    """The model of the rows of ``docs`` that aren't held out, the counts of all its words, and the count from which they have classes of their own."""
    own = settings or Settings()
    training = _training(docs).where("not held_out")
    counts = cut(_word_counts(training, own))
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    n, v, ends = (int(x or 0) for x in totals)
    floor = _floor(counts, own.words, n)
    words, times = _known(counts, max(floor, own.frequent * n))
    inner = Units(words, own.groups)
    tokens, _ = _groups(counts, own, max(floor, own.frequent * n))
    tokens = np.concatenate([times, tokens, [ends]])
    streams = cut(_unit_streams(training, inner, own))
    k, last = own.classes, own.classes - 1
    classes = np.zeros(inner.end + 1, np.uint8)
    classes[np.argsort(-tokens, kind="stable")] = np.arange(inner.end + 1) % last  # round robin by frequency
    classes[inner.end] = last
    rng = np.random.default_rng(own.seed)
    for sweep in range(own.sweeps + 1):
        before, after = _neighbours(streams, classes, inner.end + 1, own)
        if sweep == own.sweeps:
            break
        # neighbours of neighbours have moved by the end of a sweep: later ones move a part of the units
        order = rng.permutation(inner.end)
        classes = _moved(before, after, classes, order if sweep < 2 else order[: len(order) * 3 // 5 + 1], last)
    pair = np.zeros((k, k))
    np.add.at(pair, classes, after)
    words, times = _known(counts, floor)
    units = Units(words, own.groups)
    own_classes = _joined(training, units, inner, classes, pair, own)
    classes = np.concatenate([own_classes, classes[len(inner.words) :]])
    tokens, kinds = _groups(counts, own, floor)
    tokens = np.concatenate([times, tokens, [ends]])
    kinds = np.concatenate([np.ones(len(words)), kinds, [1]])
    pair = _transitions(training, units, classes, own)
    share = (np.bincount(classes, tokens, k) + 1) / (tokens.sum() + k)
    join = np.log10((pair + own.prior * share[None, :]) / (pair.sum(axis=1, keepdims=True) + own.prior))
    unseen = np.bincount(classes[len(words) : units.end], minlength=k)  # one unknown word in each group
    room = np.log10(np.maximum(np.bincount(classes, tokens, k) + np.bincount(classes, kinds, k) + unseen, 1))
    return Model(units, classes, times, join, room, n, v, ends), counts, floor


def _moved(before: np.ndarray, after: np.ndarray, classes: np.ndarray, order: np.ndarray, last: int) -> np.ndarray:
    """Classes after one sweep; the end's class, the last one, takes no other unit."""
    out = exchange(before, after, classes.astype(np.int64), order, last + 1)
    out = np.where(out == last, classes, out)
    out[-1] = last
    return out.astype(np.uint8)


def score(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Scores every text by a model of the documents that aren't held out.

    One row per input row: doc_id, held_out (crc32 of the id as text mod 7 is 2),
    n_tokens (words and one end), n_known (of them seen in training),
    train_tokens, base_score (add-one unigram), score (the class model), both
    log10 probabilities, and bits_per_token of the latter.

    A null text is empty: its one token is the end. A null doc_id counts as an
    empty id. Repeated rows are each scored, and each train. Without training
    documents every token is unknown. An empty table gives no rows; other columns
    are ignored; texts are read whole. Words stand as 64-bit hashes.
    """
    own = settings or Settings()
    model, counts, floor = train(docs, own)
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), model.distinct // BUCKET_WORDS + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = "bucket int, role int, a binary, b binary, c binary"
    names = ["bucket", "role", "a", "b", "c"]

    def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, kinds)], names=names)

    def bucket_of(words: np.ndarray) -> np.ndarray:
        return (words.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)

    def parts(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        edges = [0, *(np.flatnonzero(np.diff(bucket.astype(np.int64))) + 1).tolist(), len(bucket)]
        columns = tuple(c[order] for c in columns)
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield int(bucket[a]), *(c[a:z] for c in columns)

    def pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, times = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)
            yield rows_batch([(k, 0, w.tobytes(), t.tobytes(), b"") for k, w, t in parts(bucket_of(words), words, times)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Role 1: words to look up with row and times; role 2: what is known of rows without that."""
        m = shared.value
        n_frequent, end_class = len(m.units.words), m.classes[m.units.end]
        log_count = np.log10(m.counts + 1.0)
        row = TaskContext.get().partitionId() << LOCAL_BITS
        base_end = np.log10(m.end_count + 1.0)
        for b in (s for x in batches for s in slices(x)):
            held = np.asarray(b.column(2)).astype(np.int64)
            ids = b.column(0)
            rare_words, rare_rows, told = [], [], []
            for first, last, hashes, endings, bounds in words_and_endings(_bytes(b), own.ending):
                n = last - first
                unit = m.units.of(hashes, endings)
                owner = np.repeat(np.arange(n), np.diff(bounds))
                frequent = unit < n_frequent
                known = np.bincount(owner, frequent, n) + (m.end_count > 0)
                logs = np.bincount(owner[frequent], log_count[unit[frequent]], n) + base_end
                c = m.classes[unit].astype(np.int64)
                line = np.insert(c, bounds[1:], end_class)
                joins = m.join[np.append(end_class, line[:-1]), line] - m.room[line]
                at = np.repeat(np.arange(n), np.diff(bounds) + 1)
                sums = np.bincount(at, joins, n)
                rare_words.append(hashes.view(np.int64)[~frequent])
                rare_rows.append(row + first + owner[~frequent])
                told.append(np.stack([np.diff(bounds) + 1.0, known, logs, sums], axis=1))
            word, at = np.concatenate(rare_words), np.concatenate(rare_rows)
            yield rows_batch([(k, 1, w.tobytes(), r.tobytes(), b"") for k, w, r in parts(bucket_of(word), word, at)])
            raw_ids = ids.to_pylist()
            numbers = np.array([x or 0 for x in raw_ids], np.int64)
            flags = held | np.array([2 * (x is None) for x in raw_ids], np.int64)
            yield rows_batch([((row // 7 + row) % buckets, 2, np.stack([row + np.arange(len(numbers)), numbers, flags]).tobytes(), np.concatenate(told).tobytes(), b"")])
            row += b.num_rows

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and role; gives sums by row (role 1), dealt like the rows they belong to."""
        at, words, times, table = None, [], [], None
        for b in batches:
            out = []
            for bucket, role, x, y, _ in zip(*(c.to_pylist() for c in b.columns)):
                if role == 2:
                    home = int(np.frombuffer(x, np.int64)[0] >> LOCAL_BITS) if x else 0
                    out.append((home, 2, x, y, b""))
                    continue
                if bucket != at:
                    at, words, times, table = bucket, [], [], None
                if role == 0:
                    words.append(np.frombuffer(x, np.int64))
                    times.append(np.frombuffer(y, np.int64))
                    continue
                if table is None:
                    w, t = (np.concatenate(words), np.concatenate(times)) if words else (np.zeros(1, np.int64), np.zeros(1, np.int64))
                    order = np.argsort(w)
                    table = w[order], t[order]
                word, row = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                place = np.minimum(np.searchsorted(table[0], word), len(table[0]) - 1)
                c = np.where(table[0][place] == word, table[1][place], 0)
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                sums = np.stack([np.add.reduceat((c > 0).astype(np.float64), starts), np.add.reduceat(np.log10(c + 1.0), starts)])
                out.append((int(row[0] >> LOCAL_BITS), 1, row[starts].tobytes(), sums.tobytes(), b""))
            yield rows_batch(out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        heads, stats, rows, sums = [], [], [], []
        for b in batches:
            for _, role, x, y, _ in zip(*(c.to_pylist() for c in b.columns)):
                if role == 2:
                    heads.append(np.frombuffer(x, np.int64).reshape(3, -1))
                    stats.append(np.frombuffer(y, np.float64).reshape(-1, 4))
                else:
                    rows.append(np.frombuffer(x, np.int64))
                    sums.append(np.frombuffer(y, np.float64).reshape(2, -1))
        if not heads:
            return
        head, stat = np.concatenate(heads, axis=1), np.concatenate(stats)
        order = np.argsort(head[0])
        head, stat = head[:, order], stat[order]
        tokens, known, logs, model_sum = stat.T.copy()
        if rows:
            at, total = np.searchsorted(head[0], np.concatenate(rows)), np.concatenate(sums, axis=1)
            known += np.bincount(at, total[0], len(known))
            logs += np.bincount(at, total[1], len(known))
        base = logs - tokens * np.log10(m.train_tokens + m.distinct + 1.0)
        model_sum = model_sum + logs
        for a in range(0, len(tokens), 50_000):
            z = slice(a, a + 50_000)
            ids = pa.array(head[1][z], mask=(head[2][z] & 2) > 0)
            columns = [ids, pa.array((head[2][z] & 1) > 0), pa.array(tokens[z].astype(np.int64)), pa.array(np.rint(known[z]).astype(np.int64)), pa.array(np.full(len(tokens[z]), m.train_tokens, np.int64)), pa.array(base[z]), pa.array(model_sum[z]), pa.array(-model_sum[z] / tokens[z] * np.log2(10))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_token"])

    known_counts = counts.where(F.col("word").isNotNull() & (F.col("c") < F.lit(floor))).select("word", "c").mapInArrow(pack_counts, packed)
    dealt = known_counts.union(_training(docs).mapInArrow(read, packed)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "role")
    summed = dealt.mapInArrow(look_up, packed)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_token double"
    # a row's sums come back to the task that read it: as many partitions as it takes
    return summed.repartition("bucket").mapInArrow(finish, schema)

"""Severity of toxicity by cumulative-link ordinal regression.

With grades 0 < 1 < ... < G, P(grade <= k) = sigmoid(cut[k] - score): one score,
linear in sparse text features, is shared by all ordered cuts. Features are
occurrences of words and of their beginnings, hashed, n of them counting
2n / (n + 1). Weights and cuts maximise the penalised
likelihood of a bounded sample of labelled documents; the expected severity is
the sum over k of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, text_column
from .words import PLAIN, word_hashes

BITS = 20
#: Beginnings of words, of so many bytes, are features beside whole words: inflected forms share them.
PREFIXES = (4, 5, 6)
#: P(grade > 0) from which a document is called toxic.
LIMIT = 0.2
#: Share of a toxic document's features that speak for toxicity, at least, for each grade after the first.
GRADE_STEPS = (0.04, 0.12)


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents fitted on; ``shrink``: the penalty on weights.

    A feature counts if ``least_docs`` documents and a ``least_share`` of either
    side (grade 0, higher) have it, and the odds of the sides differ ``odds`` times.
    """

    sample: int = 20_000
    least_docs: int = 8
    least_share: float = 0.01
    odds: float = 8.0
    shrink: float = 1e-4
    rounds: int = 250
    rate: float = 0.1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def exceeding(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and cut (columns)."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -60, 60)))


def saturated(times: np.ndarray) -> np.ndarray:
    return 2 * times / (times + 1)


def slots_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, slots of its words and of their beginnings, bounds) for runs of texts."""
    plain = [t.translate(PLAIN) for t in texts]
    for runs in zip(*(word_hashes(plain, prefix) for prefix in (0, *PREFIXES))):
        first, _, hashes, bounds = runs[0]
        whole = [hashes, *(h ^ np.uint64(p) for p, (_, _, h, _) in zip(PREFIXES, runs[1:]))]
        yield first, np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in whole], axis=1), bounds


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its features' indices and how often they occur."""
    for _, slots, bounds in slots_of(texts):
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            found, times = np.unique(slots[a:b], return_counts=True)
            yield found, times.astype(np.float32)


def score_texts(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The linear score of every text; only features with a weight are counted."""
    out = np.zeros(len(texts))
    for first, slots, bounds in slots_of(texts):
        word, kind = np.nonzero(weights[slots])
        if not len(word):
            continue
        owner = np.searchsorted(bounds, word, side="right") - 1
        pairs, times = np.unique(owner << BITS | slots[word, kind], return_counts=True)
        np.add.at(out, first + (pairs >> BITS), weights[pairs & (1 << BITS) - 1] * saturated(times))
    return out


def blank(texts: list[bytes]) -> np.ndarray:
    """Which texts have no word at all."""
    return np.array([not t.translate(PLAIN).strip() for t in texts], bool)


def fit(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: np.ndarray, settings: Settings | None = None) -> Model:
    """Penalised maximum likelihood. Entry i says: document rows[i] has slots[i] values[i] times.

    ValueError where there are fewer than two grades.
    """
    own = settings or Settings()
    top = int(grades.max(initial=0))
    if top < 1 or len(set(grades.tolist())) < 2:
        raise ValueError("at least two grades must occur among the labelled documents")
    n_high = int((grades > 0).sum())
    with_high, docs_with = np.bincount(slots[grades[rows] > 0], minlength=1 << BITS), np.bincount(slots, minlength=1 << BITS)
    telling = telling_slots(with_high, docs_with - with_high, n_high, len(grades) - n_high, own)
    keep = telling[slots]
    rows, slots, values = rows[keep], slots[keep], saturated(values[keep].astype(np.float64))
    used, at = np.unique(slots, return_inverse=True)
    n = len(grades)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-3))
    x = np.concatenate([np.zeros(len(used)), cuts[:1], gaps])
    first, second, m = np.zeros_like(x), np.zeros_like(x), len(used)
    low, high = grades > 0, grades < top
    for step in range(1, own.rounds + 1):
        cuts = x[m] + np.concatenate([[0], np.cumsum(np.exp(x[m + 1 :]))])
        s = np.bincount(rows, x[at] * values, n)
        a = np.where(high, 1 / (1 + np.exp(-np.clip(cuts[np.minimum(grades, top - 1)] - s, -35, 35))), 1.0)
        b = np.where(low, 1 / (1 + np.exp(-np.clip(cuts[np.maximum(grades - 1, 0)] - s, -35, 35))), 0.0)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        slope_s = (db - da) / n
        slope_cuts = (np.bincount(np.minimum(grades, top - 1), np.where(high, da, 0), top) - np.bincount(np.maximum(grades - 1, 0), np.where(low, db, 0), top)) / n
        tail = np.cumsum(slope_cuts[::-1])[::-1]
        slope = np.concatenate([np.bincount(at, slope_s[rows] * values, m) - own.shrink * x[:m], tail[:1], tail[1:] * np.exp(x[m + 1 :])])
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        x = x + own.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[:m]
    return Model(weights, x[m] + np.concatenate([[0], np.cumsum(np.exp(x[m + 1 :]))]))


def severity_grades(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, least_docs: int) -> np.ndarray:
    """Grades for documents labelled as toxic or not: 0 for the others, else 1 and one more for each of GRADE_STEPS reached.

    What is measured is a rate, not a length: the occurrences of features that
    the labels themselves show to be toxic (in ``least_docs`` toxic documents at
    least, and in a share of them 20 times that of the others) among the
    ``sizes`` features of the document in all.
    """
    is_toxic = toxic[rows] > 0
    yes, no = np.bincount(slots[is_toxic], minlength=1 << BITS), np.bincount(slots[~is_toxic], minlength=1 << BITS)
    n_yes, n_no = max(1, int((toxic > 0).sum())), max(1, int((toxic == 0).sum()))
    telling = (yes >= least_docs) & (yes / n_yes >= 20 * (no + 0.5) / n_no)
    rate = np.bincount(rows, np.where(telling[slots], values, 0), len(toxic)) / np.maximum(sizes, 1)
    return np.where(toxic > 0, 1 + sum((rate >= k).astype(int) for k in GRADE_STEPS), 0)


def telling_slots(with_high: np.ndarray, with_zero: np.ndarray, n_high: int, n_zero: int, settings: Settings) -> np.ndarray:
    """Which features count, by how many documents of either side have them."""
    share_high, share_zero = (with_high + 0.5) / (n_high + 1), (with_zero + 0.5) / (n_zero + 1)
    ratio = share_high * (1 - share_zero) / (share_zero * np.maximum(1e-9, 1 - share_high))
    often = np.maximum(share_high, share_zero) >= settings.least_share
    return (with_high + with_zero >= settings.least_docs) & often & (np.abs(np.log(np.maximum(ratio, 1e-300))) >= np.log(settings.odds))


def labelled_features(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[np.ndarray, ...]:
    """(rows, slots, values, sizes, toxic) of at most ``settings.sample`` labelled documents, chosen by hash of their id.

    A first pass counts, for each feature, the documents of either side that
    have it; a second brings the features that count to the driver.
    """
    sample = settings.sample
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = docs.sparkSession.createDataFrame(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect(), "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # at most ``sample`` pairs of numbers

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for b in (s for x in batches for s in slices(x)):
            yield from ((t, *f) for t, f in zip(b.column(0).to_pylist(), features(b.column(1).cast(pa.binary()).to_pylist())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, (1 << BITS) + 1), np.int64)
        for toxic, slots, _ in found(batches):
            totals[toxic, slots] += 1
            totals[toxic, -1] += 1
        seen = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(totals[1, seen]), pa.array(totals[0, seen])], names=["slot", "high", "zero"])

    counts = joined.mapInArrow(count, "slot int, high long, zero long").groupBy("slot").agg(F.sum("high").alias("high"), F.sum("zero").alias("zero"))
    table = counts.where((F.col("high") + F.col("zero") >= settings.least_docs) | (F.col("slot") == 1 << BITS)).toArrow()
    empty = np.zeros(0, np.int64)
    if not table.num_rows:
        return empty, empty, empty, empty, empty
    slot, high, zero = (np.asarray(table.column(c)) for c in ("slot", "high", "zero"))
    total = slot == 1 << BITS
    n_high, n_zero = (int(x[total].sum()) for x in (high, zero))
    kept = np.zeros(1 << BITS, bool)
    kept[slot[~total][telling_slots(high[~total], zero[~total], n_high, n_zero, settings)]] = True
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, float(v.sum()), s[k].astype(np.int32).tobytes(), v[k].tobytes()) for t, s, v in found(batches) for k in [shared.value[s]]]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int32(), pa.float64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["toxic", "size", "slots", "values"])

    got = joined.mapInArrow(gather, "toxic int, size double, slots binary, values binary").toArrow()
    each = [np.frombuffer(x, np.int32) for x in got.column("slots").to_pylist()]
    values = [np.frombuffer(x, np.float32) for x in got.column("values").to_pylist()]
    rows = np.repeat(np.arange(len(each)), list(map(len, each)))
    return rows, np.concatenate([empty.astype(np.int32), *each]), np.concatenate([np.zeros(0, np.float32), *values]), np.asarray(got.column("size").to_pylist(), np.float64), np.asarray(got.column("toxic").to_pylist(), np.int64)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fits on labelled documents; where labels show one class only, nothing is called toxic."""
    own = settings or Settings()
    rows, slots, values, sizes, toxic = labelled_features(docs, labels, own)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.array([60.0]))
    return fit(rows, slots, values, severity_grades(rows, slots, values, sizes, toxic, own.least_docs), own)


def grade_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, severity (expected grade), grade (most likely), p_toxic (P(grade > 0)), toxic (p_toxic >= LIMIT).

    A null text is empty. A text without words says nothing, whatever the labels'
    shares: severity, grade and p_toxic are 0. A null doc_id stays null; repeated
    rows give repeated results; an empty table gives none; other columns are
    ignored; texts are read whole. The weights (4 MB) are broadcast. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in (s for x in batches for s in slices(x)):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            over = own.exceeding(score_texts(texts, own.weights)) * ~blank(texts)[:, None]
            p = np.hstack([np.ones((len(over), 1)), over]) - np.hstack([over, np.zeros((len(over), 1))])
            columns = [b.column(0), pa.array(over.sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0]), pa.array(over[:, 0] >= LIMIT)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return some.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that aren't called toxic. A null text and one without words stay."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in (s for x in batches for s in slices(x, at)):
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array((own.exceeding(score_texts(texts, own.weights))[:, 0] < LIMIT) | blank(texts)))

    return docs.mapInArrow(run, docs.schema)

"""Near-duplicate documents by MinHash with tensored banding.

A small number m of collections of k minimum hashes each is computed; a table
key combines two collections, so that m * k hashes give m (m - 1) / 2 tables of
2k-hash keys. Two texts meet in a table if they agree on two collections at
least.

Equal shingle sets are one class and go on as one representative. In each table
entry the members are first checked against one of them only, the one that
agrees most with the entries it is in. Members that stay apart from their hub's
component are then checked against all of the hub's other members, block by
block, inside tasks, which give back only links that join components. So the
components are those of all candidate pairs, without a row for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_small, slices, text_column
from .linkage import attach, components, semi
from .words import mix, seeds, shingle_sets


#: Entries of a table key from which on they aren't brought together to be joined.
HOT = 2_000


@dataclass(frozen=True)
class Settings:
    """Texts are linked if ``of`` * intersection >= ``least`` * union of their ``width``-word shingles.

    With s the similarity, two texts miss each other with the chance that a
    binomial of (collections, s ** hashes) is under 2: 7e-5 at 0.85 for the
    defaults. The pipeline's stage links as the query does: with five words and
    0.8, which FIVE_WORDS has, a text with one word in fifty replaced is apart
    already.
    """

    width: int = 3
    least: int = 85
    of: int = 100
    collections: int = 10
    hashes: int = 2
    block: int = 512


DOCUMENTS = Settings()
FIVE_WORDS = Settings(width=5, least=80, collections=12)


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's digest and the collections' hashes (empty for an empty set)."""
    n = settings.collections * settings.hashes
    own_seeds = seeds(n, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            counts, low, high, held = [], [], [], []
            for found in shingle_sets(texts, settings.width):
                counts.append(len(found))
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                low.append(int.from_bytes(digest[:8], "little", signed=True))
                high.append(int.from_bytes(digest[8:], "little", signed=True))
                held.append(found)
            counted = np.array(counts, np.int64)
            filled = np.flatnonzero(counted)
            sigs: list = [[] for _ in counts]
            for a in range(0, len(filled), 256):
                some = filled[a : a + 256]
                every, begins = np.concatenate([held[i] for i in some]), np.cumsum([0, *counted[some][:-1]])
                least = np.stack([np.minimum.reduceat(mix(every ^ s), begins) for s in own_seeds], axis=1)
                grouped = least.reshape(len(some), settings.collections, settings.hashes)
                with np.errstate(over="ignore"):
                    key = np.zeros(grouped.shape[:2], np.uint64)
                    for r in range(settings.hashes):
                        key = mix(key * np.uint64(31) + grouped[:, :, r])
                for i, row in zip(some.tolist(), key.view(np.int64).tolist()):
                    sigs[i] = row
            columns = [b.column(0), pa.array(counted), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "low", "high", "collections"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return some.mapInArrow(run, "doc_id long, n_shingles long, low long, high long, collections array<long>")


def _sets(docs: DataFrame, settings: Settings) -> DataFrame:
    """(id, set): the shingles as sorted 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x)):
            found = [s.tobytes() for s in shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), settings.width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, int, list]]:
    """(key, role, rows) for runs of rows equal in the key columns and in the role column after them."""
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        heads = list(zip(*columns[: keys + 1]))
        edges = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield heads[a][:keys], heads[a][keys], list(zip(*(c[a:z] for c in columns[keys + 1 :])))


def _verify(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; a's set goes once to every 1,024 of its pairs."""
    least, of = settings.least, settings.of
    counted = cut_small(pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", (F.col("n") / 1024).cast("int").alias("top")))
    many = cut_small(counted.where("top > 0"))
    dealt = attach(pairs, many, "a").select("a", "b", "top").union(semi(pairs, many.select("a"), "a", "left_anti").select("a", "b", F.lit(0)))
    members = dealt.join(sets, dealt.b == sets.id).select("a", F.pmod(F.xxhash64("b"), F.col("top") + 1).cast("int").alias("part"), F.lit(1).alias("role"), "id", "set")
    hubs = counted.withColumn("part", F.explode(F.sequence(F.lit(0), "top"))).join(sets, counted.a == sets.id).select("a", "part", F.lit(0).alias("role"), "id", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for key, role, rows in _groups(batches, 2):
            found = []
            if role == 0:
                at, hub = key, np.frombuffer(rows[0][1], np.uint64)
            elif key == at:
                for other, raw in rows:
                    n, m = len(hub), len(raw) // 8
                    if of * min(n, m) < least * max(n, m):
                        continue
                    both = len(np.intersect1d(hub, np.frombuffer(raw, np.uint64), assume_unique=True))
                    if of * both >= least * (n + m - both):
                        found.append(other)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return hubs.union(members).repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], least: int, of: int) -> np.ndarray:
    """Matrix of whether sets are similar enough; intersections are counted as products of 0/1 matrices."""
    sizes = [np.array(list(map(len, side)), np.int64) for side in (left, right)]
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes)]
    common = np.intersect1d(*flat)
    both = np.zeros((len(left), len(right)))
    place = [np.searchsorted(common, x) for x in flat]
    inside = [(p < len(common)) & (common[np.minimum(p, max(0, len(common) - 1))] == x) if len(common) else np.zeros(len(x), bool) for p, x in zip(place, flat)]
    place, owner = [p[i] for p, i in zip(place, inside)], [o[i] for o, i in zip(owner, inside)]
    for a in range(0, len(common), 4096):
        matrices = []
        for p, o, side in zip(place, owner, (left, right)):
            here = (p >= a) & (p < a + 4096)
            m = np.zeros((len(side), min(4096, len(common) - a)), np.float32)
            m[o[here], p[here] - a] = 1
            matrices.append(m)
        both += matrices[0] @ matrices[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return (of * both >= least * union - 1e-3) & (both > 0)


def _apart(pairs: DataFrame, labels: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links between members of one hub that are still in different components, one for each pair of components at least."""
    least, of, block = settings.least, settings.of, settings.block
    family = pairs.select("a", "b").union(pairs.select("a", F.col("a").alias("b")).distinct())
    known = labels.select(F.col("id").alias("b"), "component")
    tagged = family.join(known, "b", "left").select("a", "b", F.coalesce("component", "b").alias("c"))
    sizes = tagged.groupBy("a", "c").agg(F.count("*").alias("m"), F.max(F.col("a") == F.col("b")).alias("own"))
    counts = sizes.groupBy("a").agg(F.sum("m").alias("n"), F.max(F.when(F.col("own"), F.col("c"))).alias("hub_c"), F.sum(F.when(~F.col("own"), F.col("m")).otherwise(0)).alias("odd"))
    open_ = counts.where("odd > 0 and n > 2").select("a", "hub_c", (F.col("n") / block).cast("int").alias("top_m"), (F.col("odd") / block).cast("int").alias("top_u"))
    rows = cut_small(attach(tagged, cut_small(open_), "a"))
    asks = rows.where("c <> hub_c").select("a", F.pmod(F.xxhash64("b"), F.col("top_u") + 1).cast("int").alias("u"), F.explode(F.sequence(F.lit(0), "top_m")).alias("m"), F.lit(0).alias("role"), "b", "c")
    told = rows.select("a", F.explode(F.sequence(F.lit(0), "top_u")).alias("u"), F.pmod(F.xxhash64("b"), F.col("top_m") + 1).cast("int").alias("m"), F.lit(1).alias("role"), "b", "c")
    dealt = asks.union(told).join(sets, F.col("b") == F.col("id")).select("a", "u", "m", "role", "b", "c", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(asked: list, met: list) -> pa.RecordBatch:
            found = []
            if asked and met:
                sides = [[np.frombuffer(r[2], np.uint64) for r in side] for side in (asked, met)]
                c = [np.array([r[1] for r in side]) for side in (asked, met)]
                linked = similar_pairs(*sides, least, of) & (c[0][:, None] != c[1][None, :])
                for i, j in zip(*np.nonzero(linked)):
                    found.append((asked[i][0], met[j][0], c[0][i], c[1][j]))
                found = list({(x, cy): (x, y) for x, y, _, cy in found}.values())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        at, sides = None, ([], [])
        for key, role, some in _groups(batches, 3):
            if key != at:
                yield close(*sides)
                at, sides = key, ([], [])
            sides[role].extend(some)
        yield close(*sides)

    return dealt.repartition("a", "u", "m").sortWithinPartitions("a", "u", "m", "role").mapInArrow(run, "a long, b long")


def group_documents(docs: DataFrame, settings: Settings = DOCUMENTS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    A document without words (null and empty texts among them) has no shingles
    and is linked with nothing; one with fewer words than a shingle has its whole
    sequence as the only one. Equal sets are linked whatever their ids; rows that
    repeat an id are the same document. A row with a null id gets a null
    component and is kept. An empty table gives no rows; other columns are
    ignored; texts are read whole. Shingles stand as 64-bit hashes.
    """
    found = cut(signatures(docs, settings))
    named = found.where("doc_id is not null")
    classes = cut(named.where("n_shingles > 0").groupBy("low", "high").agg(F.min("doc_id").alias("rep"), F.first("collections").alias("collections")))
    tables = [F.xxhash64(F.lit(t), F.col("collections")[i], F.col("collections")[j]) for t, (i, j) in enumerate(combinations(range(settings.collections), 2))]
    keyed = classes.select("rep", F.explode(F.array(*tables)).alias("key"))
    shared = cut_small(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    hot = cut_small(shared.where(F.col("n") >= HOT))
    if hot.limit(1).count():  # a hot key's entries stay where they are
        rest = semi(keyed, hot.select("key"), "key", "left_anti").join(shared.where(F.col("n") < HOT), "key")
        entries = cut_small(attach(keyed, hot, "key").select("key", "rep", "n").union(rest.select("key", "rep", "n")))
    else:
        entries = cut_small(keyed.join(shared, "key").select("key", "rep", "n"))
    central = entries.groupBy("rep").agg(F.sum("n").alias("agreed"))
    hubs = entries.join(central, "rep").groupBy("key").agg(F.max(F.struct("agreed", (-F.col("rep")).alias("minus"))).alias("best"), F.max("n").alias("n"))
    hubs = cut_small(hubs.select("key", (-F.col("best.minus")).alias("a"), "n"))
    met = entries.where(F.col("n") < HOT).join(hubs.where(F.col("n") < HOT).select("key", "a"), "key").select("a", "rep")
    if hot.limit(1).count():
        met = met.union(attach(entries.where(F.col("n") >= HOT), cut_small(hubs.where(F.col("n") >= HOT).select("key", "a")), "key").select("a", "rep"))
    pairs = cut_small(met.where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    wanted = cut_small(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_column(docs).alias("text"))
    sets = cut(_sets(semi(texts, wanted, "id"), settings).dropDuplicates(["id"]))
    links = cut_small(_verify(pairs, sets, settings))
    labels = components(links)
    more = cut_small(_apart(pairs, labels, sets, settings))
    if more.limit(1).count():
        labels = components(links.union(more))
    named = named.join(classes.select("low", "high", "rep"), ["low", "high"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    labelled = named.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    nameless = found.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return labelled.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, settings: Settings = DOCUMENTS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but for documents whose group has one with a smaller id."""
    gone = cut_small(group_documents(docs, settings).where("not kept").select("doc_id").distinct())
    return semi(docs, gone, "doc_id", "left_anti").select(*docs.columns)

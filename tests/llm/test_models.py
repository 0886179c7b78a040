"""Fitted models, similarity joins and searches against brute force or held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexigrain.llm import brown_lm, line_dedup, linkage, minhash_dedup, rp_forest, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- near-duplicates


def near_copies(seed=3):
    """Copies of a base with words replaced, chains of copies, texts that share a passage, short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, passage = [], [word() for _ in range(40)]
    base = [word() for _ in range(150)]
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(150), k % 9):
            own[at] = word()
        texts.append(own)
    chain = [word() for _ in range(150)]
    for _ in range(12):
        texts.append(list(chain))
        for at in rng.sample(range(150), 3):
            chain[at] = word()
    texts += [passage + [word() for _ in range(rng.choice([5, 20, 60]))] for _ in range(40)]
    texts += [["same", "words"], ["same", "words"], ["words", "same"], ["Same", "Words"], [], ["x"]]
    rng.shuffle(texts)
    return [(k * 3 + 1, " ".join(t)) for k, t in enumerate(texts)]


def brute_groups(rows, width, least):
    sets = {}
    for i, text in rows:
        w = tokens(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return sets, smallest_reachable(ids, links)


@pytest.mark.parametrize("settings", [minhash_dedup.DOCUMENTS, minhash_dedup.FIVE_WORDS, minhash_dedup.Settings(block=4)])
def test_groups_of_copies(spark, settings):
    rows = near_copies()
    sets, want = brute_groups(rows, settings.width, settings.least)
    got = {r["doc_id"]: r for r in minhash_dedup.group_documents(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_groups_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "HOT", 5)
    rows = near_copies(9)
    _, want = brute_groups(rows, 3, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.group_documents(docs).collect()} == want
    monkeypatch.setattr(linkage, "BROADCAST_IDS", 0)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.group_documents(docs).collect()} == want


def test_groups_of_the_table(documents):
    _, want = brute_groups([(r["doc_id"], r["text"]) for r in documents.collect()], 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.group_documents(documents).collect()} == want


def test_one_of_each_group_stays(spark):
    rows = near_copies(5)
    _, want = brute_groups(rows, 3, 85)
    kept = minhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == set(want.values())


def test_similar_pairs_against_sets():
    rng = np.random.default_rng(1)
    sides = [[np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(n)] for n in (20, 30)]
    got = minhash_dedup.similar_pairs(*sides, 30, 100)
    for i, a in enumerate(sides[0]):
        for j, b in enumerate(sides[1]):
            a_, b_ = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (bool(a_ & b_) and 100 * len(a_ & b_) >= 30 * len(a_ | b_))


@pytest.mark.parametrize("most, many", [(200_000, 2_000), (3, 2), (0, 2)])
def test_components(spark, monkeypatch, most, many):
    monkeypatch.setattr(linkage, "BROADCAST_IDS", most)
    monkeypatch.setattr(linkage, "MANY_LINKS", many)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r["id"]: r["component"] for r in linkage.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100}


# ---------------------------------------------------------------- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k, what = rng.randrange(len(out) + 1), rng.random()
        if what < 0.34 and out:
            del out[min(k, len(out) - 1)]
        elif what < 0.67:
            out.insert(k, rng.choice("abcé😀"))
        elif out:
            out[min(k, len(out) - 1)] = rng.choice("abcé😀")
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_band_against_the_full_table(edits):
    rng = random.Random(edits)
    left = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 4, 9, 40, 90]))) for _ in range(500)]
    right = [edited(rng, a, rng.randrange(edits + 3)) for a in left]
    codes = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    got = line_dedup.within(list(map(codes, left)), list(map(codes, right)), edits)
    assert got.tolist() == [distance(a, b) <= edits for a, b in zip(left, right)]


@pytest.mark.parametrize("settings", [line_dedup.Settings(), line_dedup.Settings(block=3), line_dedup.Settings(edits=1, least_chars=10), line_dedup.Settings(per=4, block=3, refine=3), line_dedup.Settings(per=4, block=2, refine=2, rounds=1), line_dedup.Settings(block=2, refine=2, rounds=0)])
def test_lines_against_all_pairs(spark, settings):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([12, 33, 40, 60, 110]))) for _ in range(25)]
    docs = []
    for k in range(60):
        own = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3, 5])) for _ in range(rng.randrange(6))]
        docs.append((k, "\n".join(own + ["short"])))
    found = line_dedup.link_lines(spark.createDataFrame(docs, "doc_id long, text string"), settings).collect()
    lines = [(i, k, line) for i, text in docs for k, line in enumerate(text.split("\n")) if len(line) >= settings.least_chars]
    distinct = sorted({x for _, _, x in lines})
    near = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if abs(len(a) - len(b)) <= (t := settings.edits_of(np.array([min(len(a), len(b))]))[0]) and distance(a, b) <= t]
    place = {x: n for n, x in enumerate(distinct)}
    label = smallest_reachable(range(len(distinct)), [(place[a], place[b]) for a, b in near])
    counts, head = Counter(x for pair in near for x in pair), {}
    for i, k, line in sorted(lines):
        head.setdefault(label[place[line]], (i, k))
    want = {(i, k): (len(line), *head[label[place[line]]], counts[line], head[label[place[line]]] == (i, k)) for i, k, line in lines}
    assert {(r[0], r[1]): tuple(r[2:]) for r in found} == want


def test_lines_that_many_share_are_passed_on(spark):
    """More variants of a line than one flush lists in full."""
    base = "a line that a great many documents have with a small change "
    rows = [(k, base + str(1000 + k)) for k in range(300)]
    got = line_dedup.link_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = [t for _, t in rows]
    want = [sum(a != b and distance(a[-4:], b[-4:]) <= 2 for b in words) for a in words]
    assert [r["n_links"] for r in sorted(got, key=lambda r: r["doc_id"])] == want
    assert sum(r["kept"] for r in got) == 1


def test_dropped_lines(spark):
    line = "this is a line of more than thirty-two characters"
    texts = [(2, f"first\n{line}!\nlast"), (1, f"{line}\nown words"), (3, line), (4, ""), (5, f"{line}\n{line}\nx")]
    out = line_dedup.drop_lines(spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long")).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out} == {1: (f"{line}\nown words", len(line) + 10), 2: ("first\nlast", 10), 4: ("", 0), 5: ("x", 1)}


# ---------------------------------------------------------------- search


def test_search_finds_nine_tenths(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    vectors = (centres[rng.integers(0, 30, 6000)] + 0.6 * rng.normal(size=(6000, 24))) * rng.uniform(0.5, 2, (6000, 1))
    vectors[1000:1500] = vectors[1000]
    vectors = vectors.astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = defaultdict(list)
    for r in rp_forest.nearest(table, settings=rp_forest.Settings(cell_bytes=2000 * 24 * 8, part=150)).collect():
        rows[r["query_id"]].append(r)
    exact = vectors.astype(np.float64)
    hits = total = 0
    for q in range(0, 6000, 20):
        scores = sum(exact[:, d] * exact[q, d] for d in range(24))
        order = [k for k in np.lexsort((np.arange(6000), -scores)) if k != q][:20]
        got = sorted(rows[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        assert all(abs(r["score"] - scores[r["vec_id"]]) < 1e-12 for r in got) and q not in {r["vec_id"] for r in got}
        hits += sum(r["score"] >= scores[order[-1]] for r in got)
        total += 20
    assert hits >= 0.9 * total


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0, None]), (100, [float("inf"), 1.0]), (5, [1.0, 1.0]), (4, [1.0, 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = rp_forest.nearest(table).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 4, 1.0), (0, 2, 5, 1.0)]
    lengths = [(0, [1.0]), (1, [2.0]), (20, [1.0, 2.0, 3.0]), (21, [0.0, 1.0, 0.0]), (40, [1e200]), (60, [1.0, 1.0])]
    table = spark.createDataFrame(lengths, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in rp_forest.nearest(table).collect()) == [(0, 1, 40, 1e200), (0, 2, 1, 2.0), (20, 1, 21, 2.0), (40, 1, 1, 2e200), (40, 2, 0, 1e200)]
    assert rp_forest.nearest(table.limit(0)).count() == 0


def searched(vectors, every=20):
    """Recall of a cell's search by its queries, and inner products (with vectors, with planes) for each query."""
    cell = rp_forest.Cell(np.arange(len(vectors)), vectors, rp_forest.Settings())
    asked, hits = np.arange(0, len(vectors), every), 0
    for q, (ids, scores) in zip(asked, cell.nearest(vectors[asked], asked, 20)):
        own = vectors @ vectors[q]
        own[q] = -np.inf
        hits += (scores >= np.partition(own, len(own) - 20)[len(own) - 20] - 1e-9).sum()
        assert len(ids) == 20 and len(set(ids.tolist())) == 20
    return hits / (20 * len(asked)), cell.vectors_met / cell.queries, cell.planes_met / cell.queries


def test_search_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    vectors = np.array([r["embedding"] for r in table if r["embedding"] is not None], np.float64)
    recall, met, planes = searched(vectors)
    assert recall >= 0.9 and met <= 0.55 * len(vectors) and planes <= 0.2 * len(vectors)


def test_search_grows_slower_than_its_rows():
    rng = np.random.default_rng(8)
    work = {}
    for n, every in ((2_000, 20), (10_000, 50), (40_000, 400)):
        vectors = rng.normal(size=(n, 64))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        recall, met, planes = searched(vectors, every)
        assert recall >= 0.9
        work[n] = (met + planes) / n
    assert work[40_000] < 0.45 and work[40_000] < 0.75 * work[2_000]


def test_very_large_and_equal_vectors(spark):
    rows = [(k, [3e38, 0.0] if k % 2 else [0.0, 1.0]) for k in range(6)] + [(k, [1.0, 1.0]) for k in range(6, 700)]
    got = defaultdict(list)
    for r in rp_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [2, 4, *range(6, 24)] and len(got) == 35
    assert got[20][:3] == [1, 3, 5] and got[20][3:] == [*range(6, 20), 21, 22, 23]


# ---------------------------------------------------------------- toxicity


def test_ordinal_slopes_against_differences():
    """The fitted model is a maximum: no small step makes the penalised likelihood better."""
    rng = np.random.default_rng(5)
    n = 600
    x = rng.integers(0, 2, (n, 3))
    score = x @ np.array([2.0, -1.0, 0.5]) + rng.logistic(size=n)
    grades = np.searchsorted([0.5, 2.0], score)
    rows, slots = np.nonzero(x)
    own = toxicity.Settings(least_docs=1, least_share=0.0, odds=1.0, shrink=1e-3, rounds=2500, rate=0.02)
    model = toxicity.fit(rows, slots, np.ones(len(rows)), grades, own)

    def value(w, cuts):
        over = 1 / (1 + np.exp(cuts[None, :] - (x @ w)[:, None]))
        p = np.hstack([np.ones((n, 1)), over]) - np.hstack([over, np.zeros((n, 1))])
        return np.log(p[np.arange(n), grades]).mean() - 0.5 * own.shrink * (w**2).sum()

    w, cuts = model.weights[:3].astype(float), model.cuts
    best = value(w, cuts)
    for k in range(5):
        for step in (-0.05, 0.05):
            dw, dc = w.copy(), cuts.copy()
            (dw if k < 3 else dc)[k if k < 3 else k - 3] += step
            assert value(dw, dc) < best + 1e-6
    assert cuts[0] < cuts[1]


def test_toxic_words_are_learned(spark):
    rng = random.Random(6)
    plain, bad = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)], ["nasty", "awful", "vile"]
    rows = []
    for k in range(600):
        toxic = k % 6 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "er", "est"]))
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows[:400]] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.grade_documents(docs, model).collect()}
    wrong = sum(got[i]["toxic"] != bool(t) for i, _, t in rows[400:])
    assert wrong <= 4
    assert all(0 <= r["severity"] <= len(model.cuts) and 0 <= r["grade"] <= len(model.cuts) for r in got.values())
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r["toxic"]}


# ---------------------------------------------------------------- language model


def test_scores_against_plain_counts(documents):
    rows = [(r["doc_id"], tokens(r["text"])) for r in documents.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, w in rows:
        if not held[i]:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in brown_lm.score(documents, brown_lm.Settings(classes=16, groups=64, sweeps=3)).collect()}
    totals = defaultdict(float)
    for i, w in rows:
        r, all_ = got[i], [*w, None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in all_)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(all_), sum(counts[t] > 0 for t in all_), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        totals[held[i], "base"] += base
        totals[held[i], "model"] += r["score"]
    assert totals[True, "model"] > totals[True, "base"]


SMALL = [brown_lm.Settings(classes=8, groups=16, sweeps=2, frequent=1e-3, words=700), brown_lm.Settings(classes=8, groups=16, sweeps=2, frequent=1e-3), brown_lm.Settings(classes=5, groups=4, sweeps=1, words=1)]


@pytest.mark.parametrize("own", SMALL)
def test_class_probabilities_sum_to_one(documents, own):
    model, counts, floor = brown_lm.train(documents, own)
    assert np.allclose((10**model.join).sum(axis=1), 1)
    n = len(model.units.words)
    assert n <= own.words and n == counts.where(f"word is not null and c >= {floor}").count()
    assert floor == 1 or floor > 1000 or counts.where(f"word is not null and c >= {floor - 1}").count() > own.words
    assert (model.classes[:-1] < own.classes - 1).all()
    mass = np.bincount(model.classes[:n], model.counts + 1.0, own.classes)
    for r in counts.where(f"word is not null and c < {floor}").collect():
        mass[model.classes[n + r["grp"]]] += r["c"] + 1
    mass += np.bincount(model.classes[n : n + own.groups], minlength=own.classes)
    mass[own.classes - 1] += model.end_count + 1
    used = mass > 0
    assert np.allclose(mass[used] / 10 ** model.room[used], 1)


@pytest.mark.parametrize("own", SMALL)
def test_scores_word_by_word(documents, own):
    from lexigrain.llm.words import words_and_endings

    model, counts, _ = brown_lm.train(documents, own)
    times = {r["word"]: r["c"] for r in counts.collect()}
    pairs, rows = np.zeros((own.classes, own.classes)), [(r["doc_id"], r["text"] or "") for r in documents.collect()]
    end, told = int(model.classes[-1]), {}
    for i, text in rows:
        total, before = 0.0, end
        words = tokens(text)
        for _, _, hashes, endings, _ in words_and_endings([w.encode() for w in words], own.ending) if words else ():
            for h, e in zip(hashes.view(np.int64).tolist(), endings.tolist()):
                at = np.searchsorted(model.units.words, h)
                known = at < len(model.units.words) and model.units.words[at] == h
                c = int(model.classes[at if known else len(model.units.words) + e % own.groups])
                pairs[before, c] += zlib.crc32(str(i).encode()) % 7 != 2
                total += model.join[before, c] + math.log10(times.get(h, 0) + 1) - model.room[c]
                before = c
        pairs[before, end] += zlib.crc32(str(i).encode()) % 7 != 2
        told[i] = total + model.join[before, end] + math.log10(times[None] + 1) - model.room[end]
    share = 10 ** model.join
    assert np.allclose(share.argmax(axis=1)[pairs.sum(axis=1) > 50], pairs.argmax(axis=1)[pairs.sum(axis=1) > 50])
    got = {r["doc_id"]: r["score"] for r in brown_lm.score(documents, own).collect()}
    assert got.keys() == told.keys() and all(got[i] == pytest.approx(told[i], rel=1e-9) for i in told)


def test_scores_without_training_documents(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:5]
    docs = spark.createDataFrame([(k, "some words here") for k in held], "doc_id long, text string")
    got = brown_lm.score(docs, brown_lm.Settings(classes=4, groups=4, sweeps=1)).collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(True, 4, 0, 0, 0.0)] * 5


def planted_text(rng, n=60_000, words=90):
    of = rng.integers(0, 3, words)
    pairs = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]])
    text, state = [], 0
    for _ in range(n):
        state = rng.choice(3, p=pairs[state])
        text.append(rng.choice(np.flatnonzero(of == state)))
    return of, np.array(text)


def neighbour_counts(text, classes, words, n_classes):
    before, after = np.zeros((words, n_classes)), np.zeros((words, n_classes))
    np.add.at(before, (text[1:], classes[text[:-1]]), 1)
    np.add.at(after, (text[:-1], classes[text[1:]]), 1)
    return before, after


def likelihood(text, classes, n_classes):
    pair = np.zeros((n_classes, n_classes))
    np.add.at(pair, (classes[text[:-1]], classes[text[1:]]), 1)
    gain = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return gain(pair) - gain(pair.sum(axis=1)) - gain(pair.sum(axis=0))


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_exchange_finds_planted_classes(seed):
    rng = np.random.default_rng(seed)
    of, text = planted_text(rng)
    classes = rng.integers(0, 3, 90)
    for sweep in range(6):
        before, after = neighbour_counts(text, classes, 90, 3)
        classes = brown_lm.exchange(before, after, classes, rng.permutation(90), 3)
    same = (classes[:, None] == classes[None, :]) == (of[:, None] == of[None, :])
    assert same.mean() > 0.95
    assert likelihood(text, classes, 3) >= likelihood(text, of, 3) - 50


def test_rare_words_join_their_classes():
    rng = np.random.default_rng(5)
    of, text = planted_text(rng, 40_000, 300)
    common = np.bincount(text, minlength=300) > 150
    classes = np.where(common, of, 3)
    before, after = neighbour_counts(text, classes, 300, 4)
    pair = np.zeros((4, 4))
    np.add.at(pair, (classes[text[:-1]], classes[text[1:]]), 1)
    got = brown_lm.joining(pair, before[~common], after[~common])
    assert (got == of[~common]).mean() > 0.9

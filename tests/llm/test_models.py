"""Classifiers, language model and decontamination against plain versions."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import common, decontaminate, lm, quality, toxicity

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def labelled(spark):
    r, rows, labels = random.Random(6), [], []
    for i in range(240):
        w = prose(1000 + i, 60).split()
        toxic, poor = i % 5 == 0, i % 4 == 0
        if toxic:
            w[r.randint(0, 50)] = r.choice(["scoundrel", "dimwit"])
        if poor:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), *[None] * 8))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(found, labels, column):
    rows = found.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    assert len(rows) > 30
    return sum(a == b for a, b in rows) / len(rows)


def test_quality_is_learnt_from_rows_that_may_be_learnt_from(labelled, docs, empty, repeated):
    d, y = labelled
    assert accuracy(quality.scored(d, d, y, 0.5), y, "quality") > 0.95
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, d, y, 0.5).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    assert quality.scored(repeated, d, y, 0.5).count() == 4 and quality.scored(empty, d, y, 0.5).count() == 0
    kept = quality.filtered(docs, d, y, 0.5)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, s in scores.items() if s >= 0.5}


def test_long_learnt_texts_do_not_lie_in_the_drivers_memory(spark):
    def text(i):  # of about 50,000 distinct features
        r = random.Random(i)
        return "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ", k=50_000)) + (" good" if i % 2 else " poor") * 2000

    d = spark.createDataFrame([(i, text(i)) for i in range(120)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    learnt = [zlib.crc32(str(i).encode()) % 4 != 2 for i in range(120)].count(True)
    tracemalloc.start()
    try:
        table, bias = quality.learnt_model(d, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < learnt * 50_000 * 6 and (quality.score(pa.array([text(0), text(1)]), (table, bias)) >= 0.5).tolist() == [False, True]


def test_stored_rows_are_trained_on_as_rows_in_memory():
    r = np.random.default_rng(5)
    rows = []
    for i in range(40):
        bucket = np.unique(r.integers(0, quality.BUCKETS, 50 * (i % 5))).astype("<u2")
        rows.append((bucket, r.integers(1, 70_000, len(bucket)).astype("<u4"), i % 2))
    stored = quality.StoredRows()
    for i in r.permutation(len(rows)).tolist():
        stored.append(i - 20, *rows[i])
    stored.sort()
    (a, b), (c, d) = quality.train(rows), quality.train(stored)
    stored.close()
    assert np.array_equal(a, c) and b == d and a.any()


def test_labels_of_held_out_rows_do_not_matter(labelled):
    d, y = labelled
    other = y.withColumn("quality", F.when(common.remainder(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.scored(d, d, y, 0.5), quality.scored(d, d, other, 0.5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_no_labels_give_a_defined_score(labelled):
    d, y = labelled
    none = y.where("doc_id < 0")
    assert {r["score"] for r in quality.scored(d, d, none, 0.5).collect()} == {0.5}
    assert {r["score"] for r in toxicity.scored(d, d, none, 0.3).collect()} == {0.0}


def test_toxicity(labelled, docs, empty, repeated):
    d, y = labelled
    assert accuracy(toxicity.scored(d, d, y, 0.3), y, "toxic") > 0.95
    assert toxicity.scored(docs, d, y, 0.3).count() == docs.count()
    assert toxicity.scored(repeated, d, y, 0.3).count() == 4 and toxicity.scored(empty, d, y, 0.3).count() == 0


def plain_toxicity(texts, labels):
    """Scores by dictionaries: every text against every example, nothing skipped."""
    bag = {k: Counter(toxicity.terms(pa.array([t or ""]))[1].tolist()) for k, t in texts.items()}
    cells = Counter(int(toxicity.cell(np.uint64(h))) for x in bag.values() for h in x)
    idf = lambda h: np.float32(max(math.log((len(texts) + 1) / (cells[int(toxicity.cell(np.uint64(h)))] + 1)) + 1, 0.1))
    yes, no = Counter(), Counter()
    for k, y in labels.items():
        (yes if y else no).update(bag[k].keys())
    n_yes = sum(labels.values())
    weight = {h: idf(h) * (toxicity.FLOOR + toxicity.association(np.array([yes[h]]), np.array([no[h]]), n_yes, len(labels) - n_yes)[0]) for h in yes | no}
    vec = {k: {h: (1 + math.log(c)) * weight.get(h, toxicity.FLOOR * idf(h)) for h, c in x.items()} for k, x in bag.items()}
    norm = {k: math.sqrt(sum(v * v for v in x.values())) for k, x in vec.items()}
    share = n_yes / len(labels)

    def vote(k):
        near = sorted(((sum(v * vec[e].get(h, 0) for h, v in vec[k].items()) / norm[k] / norm[e], e) for e in labels if e != k and norm[e]), reverse=True)[: toxicity.NEIGHBOURS]
        return (sum(s for s, e in near if labels[e]) + toxicity.PULL * share) / (sum(s for s, _ in near) + toxicity.PULL)

    with_terms = [k for k in labels if bag[k]]
    a, b = toxicity.curve(np.array([vote(k) for k in with_terms]), np.array([labels[k] for k in with_terms]))
    none = [labels[k] for k in labels if not bag[k]]
    without = min(share, (sum(none) + share) / (len(none) + 1))
    return {k: 1 / (1 + math.exp(-(a * float(toxicity.logit(np.array(vote(k)))) + b))) if bag[k] else without for k in texts}


def test_toxicity_is_the_plain_one(labelled, docs, texts):
    d, y = labelled
    own = {r["doc_id"]: r["text"] for r in d.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in y.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(d, d, y, 0.3).collect()}
    want = plain_toxicity(own, marks)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-3, abs_tol=1e-5) for k in want)


def test_copies_of_toxic_examples_without_common_words_are_found(spark):
    """No term is in two examples, so none can be told to go with the label."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:24]
    text = {i: " ".join(f"w{i}x{j}" for j in range(20)) for i in ids}
    bad = ids[:4]
    extra = {1000 + i: text[i] for i in bad} | {2000: text[ids[0]] + " unseen1 unseen2"}
    d = spark.createDataFrame(list((text | extra).items()), "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i in bad)) for i in ids], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(d, d, y, 0.3).collect()}
    for i in bad:
        assert got[1000 + i]["evidence"][0] == i and got[1000 + i]["predicted"] == 1
    assert not any(got[i]["predicted"] for i in ids[4:])
    # words that no example has make the text longer
    assert got[2000]["predicted"] == 1 and got[2000]["score"] < got[1000 + ids[0]]["score"] - 1e-4


def test_labels_other_than_two_and_repeated_examples(spark, labelled):
    d, y = labelled
    odd = y.unionByName(spark.createDataFrame([(1, 7, 7), (4, None, None), (5, -1, -1)], "doc_id long, quality int, toxic int"))
    twice = d.unionByName(d.where("doc_id < 20")).unionByName(d.where("doc_id < 20"))
    for f, label in ((toxicity.scored, "toxic"), (quality.scored, "quality")):
        want = {r["doc_id"]: r["score"] for r in f(d, d, y, 0.5).collect()}
        assert {r["doc_id"]: r["score"] for r in f(d, twice, odd, 0.5).collect()} == want, label


def test_toxicity_filter_takes_each_row_by_itself(spark, labelled):
    """Rows without an id, and a clean text with the id of a toxic one."""
    d, y = labelled
    rows = [(None, prose(1, 60) + " scoundrel", *[None] * 8), (None, prose(1, 60), *[None] * 8), (77, prose(2, 60) + " dimwit", *[None] * 8), (77, prose(2, 60), *[None] * 8)]
    more = spark.createDataFrame(rows, SCHEMA)
    kept = toxicity.filtered(more, d, y, 0.3)
    assert kept.columns == more.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, prose(1, 60)), (77, prose(2, 60))]


def test_nearest_examples_are_exact(monkeypatch):
    """With block maxima, against products of whole vectors; with ties and texts like examples."""
    monkeypatch.setattr(toxicity, "DENSE", 5)
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    r = np.random.default_rng(7)
    for n in (3, 40, 500):
        x = np.where(r.random((n, 60)) < 0.08, r.integers(1, 4, (n, 60)), 0) / 4.0
        x[n // 2] = 0
        length = (x > 0).sum(axis=1)
        row, place = np.nonzero(x)
        labels = r.integers(0, 2, n).astype(float)
        index = toxicity.Index.of_vectors(np.arange(100, 100 + n), labels, length, place, x[row, place].astype(np.float32), 60)
        assert sorted(zip(index.ids.tolist(), index.labels.tolist(), strict=True)) == sorted(zip(range(100, 100 + n), labels.tolist(), strict=True))
        q = np.where(r.random((50, 60)) < 0.1, r.integers(1, 4, (50, 60)), 0) / 4.0
        text, at = np.nonzero(q)
        own = np.r_[np.arange(100, 125), np.full(25, -1)]
        sims, places = index.nearest(own, text, at, q[text, at].astype(np.float32))
        full = q @ x.T
        full[own[:, None] == np.arange(100, 100 + n)[None, :]] = 0
        want = -np.sort(-full, axis=1)[:, : sims.shape[1]]
        assert np.allclose(sims[:, : want.shape[1]], want, atol=1e-6) and not sims[:, want.shape[1] :].any()
        ok = places >= 0
        assert np.allclose(full[np.arange(50)[:, None].repeat(places.shape[1], 1)[ok], index.ids[places[ok]] - 100], sims[ok], atol=1e-6)


def test_calibration_curve():
    r = np.random.default_rng(3)
    p = r.random(4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(2 * toxicity.logit(p) - 1)))).astype(float)
    a, b = toxicity.curve(p, y)
    assert abs(a - 2) < 0.2 and abs(b + 1) < 0.2
    assert toxicity.curve(p, np.zeros(4000)) == (1.0, 0.0)


def plain_language_model(tok, train):
    """The same model over dictionaries: a function (words before, word) -> probability, and its counts."""
    c = Counter()
    one, two, three = Counter(), Counter(), Counter()
    for k in train:
        x = [1, *tok[k]]
        c.update(tok[k])
        one[1] += 1
        one.update(tok[k])
        two.update(zip(x, x[1:], strict=False))
        three.update(zip(x, x[1:], x[2:], strict=False))
    n, v = sum(c.values()), len(c)
    root = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    pair = lambda u, w: (two[u, w] + lm.PAIR * root(w)) / (one[u] + lm.PAIR)
    triple = lambda t, u, w: (three[t, u, w] + lm.TRIPLE * pair(u, w)) / (two[t, u] + lm.TRIPLE)
    return c, n, root, lambda before, w: pair(before[-1], w) if len(before) == 1 else triple(*before[-2:], w)


def test_language_model_is_the_plain_one(docs, texts, empty, repeated):
    train = {k for k in texts if zlib.crc32(str(k).encode()) % 5 != 1}
    tok = {k: [*WORD.findall((t or "").translate(LOW)), 0] for k, t in texts.items()}
    c, n, root, p = plain_language_model(tok, train)
    got = {r["doc_id"]: r for r in lm.scores(docs, common.remainder(F.col("doc_id"), 5) != 1).collect()}
    for k, t in tok.items():
        base = sum(math.log10(root(w)) for w in t)
        score = sum(math.log10(p([1, *t][: i + 1][-2:], w)) for i, w in enumerate(t))
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert lm.scores(repeated, F.lit(True)).count() == 4 and lm.scores(empty, F.lit(True)).count() == 0


def test_language_model_adds_up_to_one():
    tok = {0: ["a", "b", "a", "c", 0], 1: ["a", "b", "d", 0]}
    c, _, _, p = plain_language_model(tok, tok)
    for before in ([1], [1, "a"], ["a", "b"], ["b", "zzz"], ["zzz", "b"], ["zzz", "yyy"]):
        assert math.isclose(sum(p(before, w) for w in [*c, "unknown"]), 1)


def test_texts_seen_whole_score_higher_than_their_words(spark):
    """Pairs and triples of one occurrence count."""
    d = spark.createDataFrame([(1, prose(1, 60)), (2, prose(1, 60)), (3, " ".join(sorted(prose(1, 60).split())))], "doc_id long, text string")
    r = {r["doc_id"]: r for r in lm.scores(d, F.col("doc_id") == 1).collect()}
    assert math.isclose(r[2]["base_score"], r[3]["base_score"]) and r[2]["score"] > r[3]["score"] + 20


def test_numbers_survive_their_planes():
    r = np.random.default_rng(0)
    for x in (np.zeros(0, np.uint64), np.array([2**64 - 1, 0, 1], np.uint64), r.integers(0, 2**63, 1000).astype(np.uint64)):
        assert (lm.decoded(lm.encoded(x), len(x)) == x).all()


def test_language_model_in_many_blocks(docs, monkeypatch):
    want = sorted(map(tuple, lm.scores(docs, F.lit(True)).collect()))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 9_000)
    got = sorted(map(tuple, lm.scores(docs, F.lit(True)).collect()))
    assert all(a[:4] == b[:4] and math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(want, got, strict=True))


def test_contaminated_documents(spark, docs, texts, empty, repeated):
    items = {1: "What holds the bridge over the old river? Nine stone piers.", 2: prose(50, 30) + ". " + prose(51, 12) + ".", 3: "", 4: None, 5: prose(52, 8), 6: "Yes. " + prose(53, 20)}
    rows = [(1000 + i, f"{prose(60 + i, 70)} {items[i]} {prose(70 + i, 300)}", *[None] * 8) for i in (1, 2, 5, 6)]
    rows += [(2000, "What holds the bridge over the old river?", *[None] * 8)]
    d = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, tests).collect()}
    assert got == {(1001, 1), (1002, 2), (1005, 5), (1006, 6)}
    assert decontaminate.contaminated(empty, tests).count() == 0
    assert decontaminate.contaminated(repeated, tests).count() == 0
    assert decontaminate.contaminated(d, tests.where("item_id < 0")).count() == 0


def plain_matches(texts, items):
    """Every item against every passage of every text, by dictionaries."""
    words = lambda t: decontaminate.bare_words(pa.array([t]))[0].tolist()
    bags = [(i, words(t), t) for i, t in items if t and words(t)]
    df = Counter(w for _, h, _ in bags for w in set(h))
    mean = sum(len(h) for _, h, _ in bags) / max(1, len(bags))
    found = set()
    for item_id, h, text in bags:
        weight = {}
        for w, tf in Counter(h).items():
            idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
            weight[w] = idf * tf * (decontaminate.K1 + 1) / (tf + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(h) / mean))
        question, answer = decontaminate.parts_of(text)
        q = words(question)
        n = min(3, len(q))
        grams, answers = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)}, set(words(answer))
        half = 64
        while half < len(h):
            half *= 2
        for doc_id, t in texts:
            x = words(t or "")
            for at in range(0, max(1, len(x) - half), half) if x else ():
                span = x[at : at + 2 * half]
                if sum(v for w, v in weight.items() if w in set(span)) < decontaminate.SHARE * sum(weight.values()) - 1e-9:
                    continue
                held = {tuple(span[i : i + n]) for i in range(len(span) - n + 1)}
                if len(grams & held) >= 0.5 * len(grams) and len(answers & set(span)) >= 0.5 * len(answers):
                    found.add((doc_id, item_id))
    return found


@pytest.fixture(scope="module")
def contamination():
    """Items of many lengths, also repeated, and texts that hold all or parts of them."""
    r = random.Random(11)
    vocabulary = sorted({w for i in range(40) for w in prose(500 + i, 30).split()})
    said = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, f"{said(r.randint(2, 30))}? {said(r.randint(1, 12))}.") for i in range(40)]
    items += [(100 + i, items[0][1]) for i in range(8)] + [(200, said(500) + "."), (201, f"{said(90)}. {said(40)}.")]
    texts = []
    for i in range(120):
        _, t = r.choice(items)
        w = t.split()
        a = r.randint(0, len(w))
        part = [w, w[:a], w[a:], [x for x in w if r.random() < 0.7], []][i % 5]
        gap = said(r.choice([0, 5, 150, 300])).split()
        texts.append((i, " ".join([*said(r.randint(0, 200)).split(), *part[: len(part) // 2], *(gap if i % 3 == 0 else []), *part[len(part) // 2 :], *said(r.randint(0, 200)).split()])))
    return texts, items


def test_decontamination_is_the_plain_one_however_the_index_is_cut(spark, contamination, monkeypatch):
    texts, items = contamination
    d = spark.createDataFrame(texts, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = plain_matches(texts, items)
    assert len(want) > 40
    for size in (8 << 20, 3000, 400):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, tests).collect()} == want
    bad = {i for i, _ in want}
    assert {r["doc_id"] for r in decontaminate.filtered(d, tests).collect()} == {i for i, _ in texts} - bad


def test_other_items_do_not_change_what_is_found(spark):
    """A question and, 300 words on, its answer: no passage for an item of this length."""
    item = (1, "What holds the bridge over the old river up today? Nine mighty stone piers.")
    text = f"{prose(90, 80)} What holds the bridge over the old river up today? {prose(91, 300)} Nine mighty stone piers. {prose(92, 80)}"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for items in ([item], [item, (2, prose(93, 500))]):
        assert decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_contaminated_rows_without_an_id_go(spark, docs):
    """Each row by itself, also where doc_ids are null or repeated."""
    item = prose(95, 40)
    rows = [(None, f"{prose(96, 50)} {item}", *[None] * 8), (None, prose(97, 50), *[None] * 8), (5, item, *[None] * 8), (5, prose(98, 30), *[None] * 8)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = decontaminate.filtered(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == d.columns and sorted(r["text"] for r in got.collect()) == sorted([prose(97, 50), prose(98, 30)])


def test_items_of_frequent_terms_only_are_found():
    """Items whose terms all have too many items, against scores of all pairs."""
    same, other = prose(80, 30), prose(81, 30)
    for items in ([(1, same), (2, same), (3, other)], [(i, same) for i in range(40)] + [(100 + i, prose(200 + i, 30)) for i in range(60)]):
        texts = [prose(82, 20) + " " + same, prose(83, 40), other, " ".join(same.split()[:20]), " ".join(same.split()[:10])]
        shards = decontaminate.build(items, decontaminate.Statistics.of([t for _, t in items]))
        got = {(t, i) for t, i, *_ in decontaminate.matches(*decontaminate.bare_words(pa.array(texts)), shards)}
        assert got == plain_matches(list(enumerate(texts)), items) and {(0, i) for i, x in items if x == same} <= got

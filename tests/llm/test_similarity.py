"""Similarity classes and fingerprints against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa

from granary.llm import fingerprint, jaccard, links
from granary.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets(texts):
    out = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").translate(LOW))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def classes(s):
    root = {k: k for k in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in s}


def test_join_is_the_brute_force_join(docs, texts, repeated, empty):
    s = sets(texts)
    want = {(k, len(s[k]), c) for k, c in classes(s).items()}
    assert {tuple(r) for r in jaccard.similar(docs).collect()} == want
    rows = sorted(map(tuple, jaccard.similar(repeated).collect()), key=str)
    assert rows == sorted([(None, 3, None), *[(7, 3, 7)] * 3], key=str)
    assert jaccard.similar(empty).count() == 0


def test_join_is_its_sql(spark, docs, texts, tmp_path):
    """The statement and the operator, on the test texts and on a whole table."""
    import duckdb

    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for at, files in ((str(tmp_path), "documents.parquet/*.parquet"), ("/root/testdata/sf0.001", "documents.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/{files}'")
        want = {tuple(r) for r in con.sql(jaccard.ORACLE_SQL).fetchall()}
        got = [tuple(r) for r in jaccard.op5_ngram_jaccard_join(spark, at).select("doc_id", "n_shingles", "component_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_more_rounds_and_many_cells_give_the_same(docs, texts, monkeypatch):
    monkeypatch.setattr(links, "CELL_ROWS", 2)
    want = {(k, c) for k, c in classes(sets(texts)).items()}
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.similar(docs).collect()} == want


def test_bands_find_the_same_classes(docs, texts):
    want = {(k, c) for k, c in classes(sets(texts)).items()}
    assert {(r["doc_id"], r["component_id"]) for r in fingerprint.near_duplicates(docs).collect()} == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, links.components(edges).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_histograms_bound_the_difference():
    r = np.random.default_rng(3)
    x = np.unique(r.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64))
    a, b = x[:300], x[60:]
    h = links.histograms(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).astype(int)
    assert np.abs(h[0] - h[1]).sum() <= len(np.setxor1d(a, b))


def test_fingerprints(docs, texts, repeated, empty):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(texts)
    for i, k in enumerate(order):
        t, u = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert bytes.fromhex(r["edited_fingerprint"]) == fingerprint.of_texts(pa.array([edited]), 5)[0].astype(">u2").tobytes()
    assert got[10]["fingerprint"] == got[12]["fingerprint"] != got[11]["fingerprint"]
    assert got[13]["fingerprint"] == got[14]["fingerprint"] == "ffff" * fingerprint.HASHES
    assert fingerprint.fingerprints(repeated).count() == 4
    assert fingerprint.fingerprints(empty).count() == 0


def test_one_row_is_its_own_next(spark):
    r = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0


def test_likeness_estimates_jaccard():
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    errors = []
    for _ in range(60):
        a = [words[i] for i in r.integers(0, 3000, 200)]
        b = a[: int(r.integers(20, 190))] + [words[i] for i in r.integers(0, 3000, 60)]
        s, off = K.distinct(*K.shingles(*K.words(pa.array([" ".join(a), " ".join(b)])), 5))
        x, y = s[: off[1]], s[off[1] :]
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        sig = fingerprint.signatures(s, off)
        errors.append(fingerprint.likeness(sig[0], sig[1]) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06

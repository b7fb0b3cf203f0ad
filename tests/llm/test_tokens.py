"""Ids, token files, prefix counts and packing against the library."""

import random
import zlib

import numpy as np
import pytest

from granary.llm import common, packing, prefixcount, tokenfile, tokens

ODD = [" ", "\n", "\t", "'s", "'re", "'LL", "a", "B", "é", "ß", "9", "12", "_", "!?", "...", "<|endoftext|>", "中", " ", "\x1c", "  ", "²", "\r\n", "–", "“", "the", "ing"]


@pytest.fixture(scope="module")
def path():
    return common.tokenizer_path("byte_bpe_50k.json")


def test_fast_and_library_ids_are_equal(path):
    e, r = tokens.Encoder(path), random.Random(3)
    for _ in range(3000):
        x = "".join(r.choices(ODD, k=r.randint(0, 25)))
        assert e.ids(x) == e.whole(x)


def test_segments_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = np.where(r.random(n) < 0.1, r.integers(0, 1 << 32, n), r.integers(0, 900, n)).astype(np.uint32)
        s = tokenfile.Segment(tokenfile.encode_segment([5, None], np.array([n // 2, n - n // 2]), ids))
        assert (s.ids() == ids).all() and s.doc_ids == [5, None] and s.lengths.tolist() == [n // 2, n - n // 2]
        for i in range(s.blocks):
            assert (s.block(i) == ids[128 * i : 128 * i + 128]).all()


def test_token_files_give_the_ids_back(spark, docs, texts, path, repeated, empty):
    e = tokens.Encoder(path)
    got = {r["doc_id"]: r for r in tokenfile.read(tokenfile.write(docs, path, 2)).collect()}
    at = 0
    for k in sorted(texts):
        data = e.whole(texts[k] or "") + np.uint32(2).tobytes()
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(data) // 4, zlib.crc32(data))
        at += len(data) // 4
    rows = tokenfile.read(tokenfile.write(repeated, path, 2)).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [None, 7, 7, 7]
    assert tokenfile.read(tokenfile.write(empty, path, 2)).count() == 0


def test_segments_of_many_groups_start_where_the_ones_before_end(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "GROUP", 3)
    r = np.random.default_rng(5)
    rows = [(part, seq, int(n)) for part in range(10) for seq, n in enumerate(r.integers(0, 1 << 40, r.integers(0, 4)))]
    got = {(x["part"], x["seq"]): x["before"] for x in tokenfile.starts(spark.createDataFrame(rows, "part int, seq int, n_ids long")).collect()}
    at = 0
    for part, seq, n in rows:
        assert got[part, seq] == at
        at += n


def test_texts_longer_than_a_segment(spark, path, monkeypatch):
    long = " ".join(["many words"] * 550_000)  # longer than a segment and than a batch
    d = spark.createDataFrame([(1, "short"), (2, long), (3, None), (4, "a" * 200_000)], "doc_id long, text string")
    e, at = tokens.Encoder(path), 0
    got = {r["doc_id"]: r for r in tokenfile.read(tokenfile.write(d, path, 2)).collect()}
    for k, t in ((1, "short"), (2, long), (3, ""), (4, "a" * 200_000)):
        data = e.whole(t) + np.uint32(2).tobytes()
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(data) // 4, zlib.crc32(data))
        at += len(data) // 4
    rows = packing.packed_documents(d).collect()
    assert sum(r["length"] for r in rows) == at and check_packing(rows, 1024) >= at // 1024


def test_prefix_counts_are_the_library_s_at_every_prefix():
    c = prefixcount.WordCounts(common.tokenizer_path("word_bpe_49k.json"))
    r = random.Random(5)
    for _ in range(300):
        x = "".join(r.choices(ODD, k=r.randint(0, 12)))
        p = prefixcount.PrefixCounts(c, x)
        want = [len(c.library.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
        assert [p.at(i) for i in range(len(x) + 1)] == want
        for budget in (0, 1, 3):
            assert want[p.fit(budget)] <= budget or p.fit(budget) == 0


SCRIPTS = ["Привет", "мир", "ΣΑΣ", "Ας", "İstanbul", "ǅ", "中文分词", "日本語テスト", "ひらがな", "안녕", "\u1112\u1161\u11ab", "مرحبا", "עברית", "שָׁלוֹם", "हिन्दी", "কো", "ไทย", "👩‍👩‍👧", "🙂", "é", "e\u0301", "a\u0328\u0301", "ﬁ", "Ⅷ", "٣", "x²", "don't", "L'É", "<|startoftext|>", "<|endoftext|>", " ", "\n", "\u3000", "\u00a0", "—", "ŉ", "ſ", "K"]


def test_prefix_counts_in_all_scripts():
    c = prefixcount.WordCounts(common.tokenizer_path("word_bpe_49k.json"))
    r, whole = random.Random(9), 0
    for i in range(500):
        x = "".join(r.choices(SCRIPTS, k=r.randint(1, 9))) if i >= len(SCRIPTS) else SCRIPTS[i]
        p = prefixcount.PrefixCounts(c, x)
        whole += bool(p.whole)
        want = [c.encoded(x[:j]) for j in range(len(x) + 1)]
        assert [p.at(j) for j in range(len(x) + 1)] == want, x
        assert p.total() == want[-1]
        for budget in (0, 1, 3, 8):
            n = p.fit(budget)
            assert want[n] <= budget or n == 0
            # no longer prefix up to the end of the word that it ends in
            k = int(np.searchsorted(p.before, budget, side="right")) - 1
            end = len(x) if k >= len(p.words) else p.starts[k] + len(p.words[k])
            assert all(want[j] > budget for j in range(n + 1, end + 1)) or k >= len(p.words)
    assert whole < 400


def test_long_texts_without_blanks_and_other_scripts():
    """Counts at every thousandth prefix, one encoding each; unnormalised text too."""
    c = prefixcount.WordCounts(common.tokenizer_path("word_bpe_49k.json"))
    for x in ("中文分词测试" * 2000, "слово " * 3000, "e\u0301x" * 700):
        p = prefixcount.PrefixCounts(c, x)
        assert all(p.at(j) == c.encoded(x[:j]) for j in range(0, len(x) + 1, 1000))
        assert p.at(p.fit(500)) <= 500 < p.at(p.fit(500) + 1)


def test_token_counts(docs, texts, repeated, empty):
    name = common.tokenizer_path("word_bpe_49k.json")
    lib = prefixcount.WordCounts(name).library
    got = {r["doc_id"]: r for r in prefixcount.token_counts(docs, name, 100).collect()}
    for k, t in texts.items():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((t or "").encode()), n > 100)
    assert prefixcount.token_counts(repeated, name, 100).count() == 4
    assert prefixcount.token_counts(empty, name, 100).count() == 0


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_places_every_piece_once(docs, texts, path, repeated, empty):
    rows = packing.packed_documents(docs).collect()
    e = tokens.Encoder(path)
    used = check_packing(rows, 1024)
    assert used <= 1.2 * sum(r["length"] for r in rows) / 1024 + 1
    for k, t in texts.items():
        data = e.whole(t or "") + np.uint32(2).tobytes()
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        at = 0
        for i, r in enumerate(own):
            assert (r["piece"], r["start"]) == (i, at) and r["ids_crc32"] == zlib.crc32(data[4 * at : 4 * (at + r["length"])])
            assert r["length"] == 1024 or i == 0
            at += r["length"]
        assert at == len(data) // 4
    assert len(packing.packed_documents(repeated).collect()) == 4
    assert packing.packed_documents(empty).count() == 0


def whole(size, bins):
    return sorted(i for x in bins for i in x) == list(range(len(size))) and max(packing.loads_of(size, bins)) <= 1024


def test_genetic_steps_keep_all_pieces():
    r = np.random.default_rng(2)
    size = r.integers(1, 700, 400).tolist()
    a = packing.best_fit(size, list(range(400)), [], 1024)
    population = packing.evolve(size, [a], 1024, 1)
    child = packing.crossover(size, a, population[0], 1024, r)
    assert len(population) == packing.POPULATION and all(whole(size, bins) for bins in [a, child, *population])
    assert packing.lower_bound(np.array(size), 1024) <= len(population[0]) <= len(a)
    pieces, mine, rest = packing.searched(size, a, 1024, 3)
    assert whole(size, mine + rest) and pieces == sorted(i for x in mine for i in x) and all(sum(size[i] for i in x) == 1024 for x in rest)


def test_replacement_only_fills():
    r = np.random.default_rng(8)
    size = r.integers(150, 500, 90).tolist()
    bins = packing.best_fit(size, list(range(60)), [], 1024)
    before = packing.loads_of(size, bins)
    out = packing.replaced(size, bins, list(range(60, 90)), 1024, r)
    after = packing.loads_of(size, bins)
    assert sorted([*out, *[i for x in bins for i in x]]) == list(range(90))
    assert all(x <= y <= 1024 for x, y in zip(before, after, strict=True)) and sum(after) > sum(before)


def test_search_beats_best_fit_on_open_shards(spark):
    """Sizes of which three fill a sequence: best fit leaves much room."""
    size = np.random.default_rng(1).integers(200, 501, 400).tolist()
    best_fit, bound = len(packing.best_fit(size, list(range(400)), [], 1024)), packing.lower_bound(np.array(size), 1024)
    rows = [(i, 0, 0, s, 0) for i, s in enumerate(size)]
    df = spark.createDataFrame(rows, packing.PIECE)
    used = check_packing(packing.pack(df, 1024).collect(), 1024)
    assert bound <= used <= best_fit - 5

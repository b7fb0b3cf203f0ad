"""Benchmark decontamination: BM25 over an inverted index of test items, then overlap.

The index is of the test items, which are few; the queries are all passages of all
training texts.  For an item of n words a passage is a window of twice the next power of
two (`LEAST_WINDOW` at least), moved by half of that, so that every copied item lies whole
within one.  An item's score for a passage is the sum of BM25 weights of the item's terms
that the passage has; it is retrieved from `SHARE` of the sum over all its terms.

Block-max WAND, with a threshold known beforehand for every item in place of a running
top k: items stand in blocks, and every block has the greatest weight of each term;
passages for which the sum of these maxima stays under the least threshold of a block
never reach its postings.  An item's pivot is the place among its terms, rarest first,
from which on the rest alone stays under its threshold; only terms up to the pivot have
postings that are walked.  What the terms after it can add at most is added to the partial
score, and items that may still reach their threshold are scored in full.

What is retrieved is verified: the passage must hold `QUESTION` of the distinct word
3-grams of the item's question and `ANSWER` of the words of its answer, its last sentence
(an item of one sentence, or with a question of fewer than three words, is all question).

Item counts, mean length and document frequencies are of all items, and passages depend
on the item alone.  So what is found for an item does not depend on how the index is cut:
it is broadcast in parts of about `INDEX_BYTES` of item text, each with its own pass over
the documents.

Cases: null or empty texts and items match nothing; rows with a null doc_id are matched
with a null doc_id; items with a null item_id are matched too; repeated rows give one
pair; no rows on either side give no pairs; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common
from granary.llm import textkernel as K

SHARE, QUESTION, ANSWER = 0.55, 0.5, 0.5
BLOCK, SHARD, INDEX_BYTES = 16, 1024, 8 << 20
LEAST_WINDOW = 128
K1, B = 1.2, 0.75
GRAM = 3
#: Share of the items from which on a term is frequent.
FREQUENT = 0.04
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: As for toxicity: words without punctuation.
_SEP = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def bare_words(col) -> tuple[np.ndarray, np.ndarray]:
    data, off = K.utf8(col)
    s, e, w = K.word_spans(data, off, _SEP)
    return K.hash_spans(data, s, e), w


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    return np.unique(K.shingles(h, np.array([0, len(h)]), n)[0])


@dataclass
class Shard:
    """Up to `SHARD` items of like length: terms, block maxima, and postings up to the pivots."""

    half: int  # words by which passages move
    ids: list[int | None]
    terms: np.ndarray
    block: int  # items a block
    maxima: np.ndarray  # terms x blocks
    least: np.ndarray  # least threshold of a block
    need: np.ndarray  # threshold of an item
    others: np.ndarray  # what an item's frequent terms can add at most
    start: np.ndarray  # postings of each term: items and weights
    items: np.ndarray
    weights: np.ndarray
    own: list[tuple[np.ndarray, np.ndarray]]  # an item's terms and weights
    questions: list[tuple[int, np.ndarray]]  # words a gram, grams
    answers: list[np.ndarray]


@dataclass
class Statistics:
    """Of all items: how many there are, their mean length, and the terms of those in hand."""

    items: int
    mean: float
    terms: np.ndarray  # sorted
    df: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Statistics:
        words = [h for h in (bare_words(pa.array([t]))[0] for t in texts) if len(h)]
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(h) for h in words]]), return_counts=True)
        return Statistics(len(words), sum(map(len, words)) / max(1, len(words)), terms, df)

    def frequency(self, t: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, t)]


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    some = [x for x in _SENTENCE.split(text.strip()) if x and len(bare_words(pa.array([x]))[0])]
    if len(some) < 2:
        return text, ""
    question = text.strip()[: text.strip().rindex(some[-1])]
    return (question, some[-1]) if len(bare_words(pa.array([question]))[0]) >= GRAM else (text, "")


def half_of(words: int) -> int:
    """Words by which the passages for an item of so many words move."""
    return max(LEAST_WINDOW // 2, 1 << (words - 1).bit_length())


def build(items: list[tuple[int | None, str]], stats: Statistics) -> list[Shard]:
    """Shards of an index of these items, with the statistics of all."""
    by_half: dict[int, list] = {}
    for item_id, text in items:
        h, _ = bare_words(pa.array([text]))
        if not len(h):
            continue
        question, answer = parts_of(text)
        asked = bare_words(pa.array([question]))[0]
        n = min(GRAM, len(asked))
        by_half.setdefault(half_of(len(h)), []).append((item_id, h, (n, _grams(asked, n)), np.unique(bare_words(pa.array([answer]))[0])))
    return [shard for half in sorted(by_half) for shard in _shards(half, by_half[half], stats)]


def _shards(half: int, rows: list, stats: Statistics) -> list[Shard]:
    # items of like weight stand together, so that a block's least threshold says much
    rows.sort(key=lambda r: len(r[1]))
    shards = []
    for at in range(0, len(rows), SHARD):
        part = rows[at : at + SHARD]
        terms = np.unique(np.concatenate([r[1] for r in part]))
        frequent = stats.frequency(terms) > max(1, FREQUENT * stats.items)
        maxima = np.zeros((len(terms), -(-len(part) // BLOCK)), np.float32)
        need, others, own, posts = np.zeros(len(part)), np.zeros(len(part)), [], []
        for j, r in enumerate(part):
            t, tf = np.unique(r[1], return_counts=True)
            df = stats.frequency(t)
            idf = np.log(1 + (stats.items - df + 0.5) / (df + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(r[1]) / stats.mean))
            place = np.searchsorted(terms, t)
            maxima[place, j // BLOCK] = np.maximum(maxima[place, j // BLOCK], w)
            need[j] = SHARE * w.sum()
            own.append((place, w))
            # terms up to the pivot, and all that few items have
            rare, order = ~frequent[place], np.argsort(df, kind="stable")
            left = w.sum() - np.cumsum(w[order])
            rare[order[: 1 + int(np.count_nonzero(left >= need[j] - 2e-4))]] = True
            others[j] = w[~rare].sum()
            posts.append((place[rare], np.full(int(rare.sum()), j), w[rare]))
        place, items_of, weights = (np.concatenate(x) for x in zip(*posts, strict=True))
        order = np.argsort(place, kind="stable")
        start = np.searchsorted(place[order], np.arange(len(terms) + 1))
        least = np.array([need[k : k + BLOCK].min() for k in range(0, len(part), BLOCK)])
        shards.append(Shard(half, [r[0] for r in part], terms, BLOCK, maxima, least, need, others, start, items_of[order], weights[order], own, [r[2] for r in part], [r[3] for r in part]))
    return shards


def windows(w: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of windows of 2 * half words, moved by half."""
    n = np.diff(w)
    count = np.where(n > 0, np.maximum(1, -(-n // half) - 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * half
    return text, first + w[:-1][text], np.minimum(first + 2 * half, n[text]) + w[:-1][text]


def matches(h: np.ndarray, w: np.ndarray, shards: list[Shard]) -> list[tuple[int, int | None, float, float, float]]:
    """(text, item_id, score, question overlap, answer overlap) of verified matches."""
    out, half = [], 0
    for shard in shards:
        if shard.half != half:
            half = shard.half
            text, first, end = windows(w, half)
        place = np.searchsorted(shard.terms, h)
        place[place == len(shard.terms)] = 0
        at = np.flatnonzero(shard.terms[place] == h)  # words that are terms
        if not len(at):
            continue
        lo, hi = np.searchsorted(at, first), np.searchsorted(at, end)
        count = hi - lo
        of = np.repeat(np.arange(len(first)), count)
        own = at[np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        key = np.unique(of * np.int64(len(shard.terms)) + place[own])
        of, term = key // len(shard.terms), key % len(shard.terms)
        cut = np.searchsorted(of, np.arange(len(first) + 1))
        live = np.flatnonzero(np.diff(cut))
        # block maxima: which blocks a passage can reach at all
        bound = np.add.reduceat(shard.maxima[term], cut[:-1][live], axis=0)
        reach = np.zeros((len(first), len(shard.least)), bool)
        reach[live] = bound >= shard.least - 1e-4
        # postings of rare terms add up; frequent ones count with the most they can add
        n = shard.start[term + 1] - shard.start[term]
        row = np.repeat(of, n)
        post = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(shard.start[term], n)
        go = reach[row, shard.items[post] // shard.block]
        row, post = row[go], post[go]
        pair, which = np.unique(row * np.int64(len(shard.ids)) + shard.items[post], return_inverse=True)
        partial = np.bincount(which, shard.weights[post], len(pair))
        item = pair % len(shard.ids)
        likely = partial + shard.others[item] >= shard.need[item] - 1e-4
        for x, j in zip((pair[likely] // len(shard.ids)).tolist(), item[likely].tolist(), strict=True):
            places, weights = shard.own[j]
            score = float(weights[np.isin(places, term[cut[x] : cut[x + 1]], assume_unique=True)].sum())
            if score < shard.need[j] - 1e-4:
                continue
            span = h[first[x] : end[x]]
            grams, q = shard.questions[j]
            question = float(np.isin(q, _grams(span, grams)).mean())
            answer = float(np.isin(shard.answers[j], span).mean()) if len(shard.answers[j]) else 1.0
            if question >= QUESTION and answer >= ANSWER:
                out.append((int(text[x]), shard.ids[j], score, question, answer))
    return out


_PAIR = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def indexes(items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text") -> list:
    """Broadcast parts of an index of all items, each of about `INDEX_BYTES` of item text."""
    spark = items.sparkSession
    common.bounded_batches(spark)
    tests = common.kept(items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct(), "items")
    parts = max(1, -(-common.text_bytes(tests) // INDEX_BYTES))
    tests = tests.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))

    def terms(b: pa.RecordBatch) -> pa.RecordBatch:
        h, w = bare_words(b.column(0))
        own, off = K.distinct(h, w)
        return pa.RecordBatch.from_pydict({"part": b.column(1), "words": pa.array(np.diff(w)), "terms": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(own.view(np.int64)))})

    known = common.kept(common.arrow_map(tests.select("text", "part"), terms, "part long, words long, terms array<long>").where("words > 0"), "item-terms")
    n, mean = known.agg(F.count("*"), F.avg("words")).first()
    each = known.select("part", F.explode("terms").alias("term"))
    df = common.kept(each.groupBy("term").count(), "item-frequencies")
    out = []
    for part in range(parts):
        own = tests.where(F.col("part") == part).orderBy("item_id", "text").collect()  # about INDEX_BYTES
        t = df.join(each.where(F.col("part") == part).select("term").distinct(), "term").orderBy("term").toArrow()  # the terms of INDEX_BYTES
        term, count = t.column("term").to_numpy().view(np.uint64), t.column("count").to_numpy()
        order = np.argsort(term)
        out.append(spark.sparkContext.broadcast(build([(r["item_id"], r["text"]) for r in own], Statistics(n, mean or 0.0, term[order], count[order]))))
    return out


def _found(col, shards: list[Shard]) -> list[tuple[int, int | None, float, float, float]]:
    out = []
    for lo in range(0, len(col) if shards else 0, 256):
        out += [(lo + t, *rest) for t, *rest in matches(*bare_words(col.slice(lo, 256)), shards)]
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): documents that hold test
    items, a row a pair, with the best passage's figures."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for index in indexes(items, item_id_col, item_text_col):

        def run(b: pa.RecordBatch, index=index) -> pa.RecordBatch | None:
            out = _found(b.column(1), index.value)
            if not out:
                return None
            at, item, score, question, answer = zip(*out, strict=True)
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(at)), "item_id": pa.array(item, pa.int64()), "score": pa.array(score), "question_overlap": pa.array(question), "answer_overlap": pa.array(answer)})

        pairs = common.arrow_map(rows, run, _PAIR)
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def filtered(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no test item: one map for each part of the index."""
    at = docs.columns.index(text_col)
    for index in indexes(items, item_id_col, item_text_col):

        def run(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            clean = np.ones(b.num_rows, bool)
            clean[[t for t, *_ in _found(b.column(at), index.value)]] = False
            return b.filter(pa.array(clean))

        docs = common.arrow_map(docs, run, docs.schema)
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against the benchmark."""
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

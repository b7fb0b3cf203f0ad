"""Exact token counts of every prefix, by dynamic programming over prefixes.

For a BPE whose words end in a marked token, a sequence of tokens is the encoding of
its text exactly if every two neighbours are the encoding of their own joined text.
So every prefix of a word has one last token, found from shorter prefixes:

    last(j)  = the token t = w[j-k:j] for which t may follow last(j-k)
    inner(j) = inner(j-k) + 1

and, for the prefix taken as a text of its own, the last token is the one with the end
mark that may follow last(j-k).  `WordCounts` runs this for many new words at once in
numpy and remembers the counts of all prefixes of a word; whether two tokens may follow
each other is asked of the library once for a pair.  `PrefixCounts` holds the running
count at every word end of a text, so the count at any prefix, the longest prefix
within a budget and the cuts for a window are answered without encoding again.

Texts with other characters go by chunks between blanks, which no word and no
normalisation crosses.  A chunk that is normalised already (then all its prefixes are) and
that lower-cases letter by letter is split by Unicode classes and counted by the same
tables, if they give the library's count for the whole chunk.  Any other chunk, and one
with the string of an added token, is counted by the library, a prefix only when it is
asked for; nothing but the chunk is encoded for it.

Cases: a null or empty text has 0 tokens; a null doc_id and repeated rows are kept as
rows; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common
from granary.llm import tokens as _tokens  # sets the library's threads before it loads

#: Words that are remembered with all their prefixes; beyond it memory is emptied.
MEMO, LONGEST = 300_000, 48
_LATIN = "a-zß-öø-ÿ"
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-ÿ¡¿–—‘’“”…]")
_PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LATIN}]+|[0-9]|[^\\s{_LATIN}0-9]+")
_ANY_PIECE = regex.compile(r"'(?:[stmd]|re|ve|ll)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_CHUNK = re.compile(r"[^ \t\n\r]+")
_SUFFIXES = {"'re", "'ve", "'ll"}
#: Characters of a chunk up to which all its prefixes are encoded to see which one fits.
SHORT = 512


class WordCounts(dict):
    """Word -> the token counts of all its prefixes (by code point); fills itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in _tokens._byte_letters().items()}
        model = json.loads(self.library.to_str())["model"]
        self.mark, self.model = model["end_of_word_suffix"], self.library.model
        self.vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        self.made = {}  # token -> (rank of its merge, left part, right part)
        self.ranks: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.ranks[x, y] = i
            self.made.setdefault(x + y, (i, x, y))
        # every end of a token -> [the token inside a word, the token at a word's end]
        self.ends: dict[str, list[str | None]] = {}
        for t in self.vocab:
            end = t.endswith(self.mark)
            body = t[: -len(self.mark)] if end else t
            for i in range(len(body)):
                self.ends.setdefault(body[i:], [None, None])
            if body and self._alone(t, body, end):
                self.ends[body][end] = t
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.totals = _Totals(self)

    def bound(self) -> None:
        """Empty what is remembered once it is too much."""
        for memo in (self, self.totals, self.follows):
            if len(memo) > MEMO:
                memo.clear()

    def encoded(self, text: str) -> int:
        """The library's count."""
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, chunk: str) -> list[tuple[int, str]] | None:
        """(place, word) of a chunk between blanks, None if only the library can count it."""
        if any(x in chunk for x in self.added):
            return None
        if not _ODD.search(chunk):
            return [(m.start(), m.group()) for m in _PIECE.finditer(chunk.lower())]
        low = "".join([c.lower() for c in chunk])
        if len(low) != len(chunk) or not unicodedata.is_normalized("NFC", chunk):
            return None
        found = [(m.start(), m.group()) for m in _ANY_PIECE.finditer(low)]
        return found if sum(self.totals[w] for _, w in found) == self.encoded(chunk) else None

    def _alone(self, t: str, body: str, end: bool) -> bool:
        """Whether a token is the encoding of its own text: all its parts meet by rank."""
        if t not in self.made:
            return len(body) == 1
        units, ranks = [*body[:-1], body[-1] + self.mark] if end else [*body], self.ranks
        while len(units) > 1:
            rank, i = min((ranks.get((x, y), 1 << 30), i) for i, (x, y) in enumerate(zip(units, units[1:], strict=False)))
            if rank == 1 << 30:
                return False
            units[i : i + 2] = [units[i] + units[i + 1]]
        return True

    def _spine(self, t: str, side: int) -> list[tuple[str, int, int]]:
        """The pieces at one end of a token over time: (piece, rank that forms it, rank that uses it)."""
        memo = self.right if side else self.left
        out = memo.get(t)
        if out is None:
            out, used, x = [], 1 << 30, t
            while True:
                rank, *parts = self.made.get(x, (-1,))
                out.append((x, rank, used))
                if rank < 0:
                    break
                x, used = parts[side], rank
            memo[t] = out
        return out

    def _may_follow(self, a: str, b: str) -> bool:
        """Whether a then b is the encoding of their joined text: no merge across the
        border comes while its two pieces are there (of equal ranks, the left one first)."""
        ranks = self.ranks
        for x, x_from, x_to in self._spine(a, 1):
            for y, y_from, y_to in self._spine(b, 0):
                rank = ranks.get((x, y))
                if rank is not None and x_from < rank < x_to and y_from < rank <= y_to:
                    return False
        return True

    def prefixes(self, word: str) -> list[int]:
        """Token counts of word[:1], word[:2], ... each as a text of its own."""
        letters, ends, follows = self.letters, self.ends, self.follows
        text = "".join([letters[b] for b in word.encode()])
        n = len(text)
        last, inner, final = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(j - 1, -1, -1):
                both = ends.get(text[i:j])
                if both is None:
                    break
                before = last[i]
                t = both[0]
                if t and not inner[j]:
                    ok = i == 0
                    if not ok and before:
                        ok = follows.get((before, t))
                        if ok is None:
                            ok = follows[before, t] = self._may_follow(before, t)
                    if ok:
                        inner[j], last[j] = inner[i] + 1, t
                t = both[1]
                if t and not final[j]:
                    ok = i == 0
                    if not ok and before:
                        ok = follows.get((before, t))
                        if ok is None:
                            ok = follows[before, t] = self._may_follow(before, t)
                    if ok:
                        final[j] = inner[i] + 1
                if final[j] and inner[j]:
                    break
        if word.isascii():
            out = final[1:]
        else:
            out, at = [], 0
            for c in word:
                at += len(c.encode())
                out.append(final[at])
        if word in _SUFFIXES:  # cut in the middle, the mark and the letter are two words
            out[1] = 2
        return out

    def __missing__(self, word: str) -> list[int] | bytes:
        out = self.prefixes(word)
        if len(word) <= LONGEST:
            self[word] = bytes(out)  # at most LONGEST bytes a character, so counts fit
        return out


class _Totals(dict):
    """Word -> its token count, the last entry of its prefix table."""

    def __init__(self, counts: WordCounts):
        super().__init__()
        self.counts = counts

    def __missing__(self, word: str) -> int:
        n = self.counts[word][-1]
        if len(word) <= LONGEST:
            self[word] = n
        return n


class PrefixCounts:
    """Exact token counts at all prefixes of one text: a running count at every word, and
    within a word its table."""

    def __init__(self, counts: WordCounts, text: str | None):
        self.text, self.counts = text or "", counts
        counts.bound()
        self._starts: list[int] | None = None
        self.whole: dict[int, str] = {}  # words that are chunks for the library
        if not _ODD.search(self.text) and not any(x in self.text for x in counts.added):
            self.words = _PIECE.findall(self.text.lower())
            sizes = list(map(counts.totals.__getitem__, self.words))
        else:
            self.words, self._starts, sizes = [], [], []
            for m in _CHUNK.finditer(self.text):
                found = counts.pieces(m.group())
                if found is None:
                    self.whole[len(self.words)] = m.group()
                    self.words.append(m.group())
                    self._starts.append(m.start())
                    sizes.append(counts.encoded(m.group()))
                else:
                    self.words += [w for _, w in found]
                    self._starts += [m.start() + at for at, _ in found]
                    sizes += [counts.totals[w] for _, w in found]
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(sizes, out=self.before[1:])

    @property
    def starts(self) -> list[int]:
        """Places of the words, made when first asked for."""
        if self._starts is None:
            self._starts = [m.start() for m in _PIECE.finditer(self.text.lower())]
        return self._starts

    def _within(self, k: int, n: int) -> int:
        """Tokens of the first n > 0 characters of word k."""
        if k in self.whole:
            chunk = self.whole[k]
            return int(self.before[k + 1] - self.before[k]) if n >= len(chunk) else self.counts.encoded(chunk[:n])
        table = self.counts[self.words[k]]
        return table[min(n, len(table)) - 1]

    def at(self, i: int) -> int:
        """Tokens of text[:i]."""
        i = max(0, min(i, len(self.text)))
        k = bisect_right(self.starts, i - 1) - 1
        return 0 if k < 0 else int(self.before[k]) + self._within(k, i - self.starts[k])

    def total(self) -> int:
        return int(self.before[-1])

    def fit(self, budget: int) -> int:
        """Length of the longest prefix with at most budget tokens whose shorter prefixes at
        word ends fit too.  Within a chunk of over `SHORT` characters that the library counts,
        prefixes are halved."""
        k = int(np.searchsorted(self.before, budget, side="right")) - 1
        if k >= len(self.words):
            return len(self.text)
        room, n = budget - int(self.before[k]), len(self.words[k])
        if k not in self.whole:
            ok = np.flatnonzero(np.array(list(self.counts[self.words[k]])) <= room)
            return self.starts[k] + (int(ok[-1]) + 1 if len(ok) else 0)
        if n <= SHORT:
            return self.starts[k] + next((j for j in range(n, 0, -1) if self._within(k, j) <= room), 0)
        lo, hi = 0, n - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self._within(k, mid) <= room else (lo, mid - 1)
        return self.starts[k] + lo


_loaded: dict[str, WordCounts] = {}


def word_counts(path: str) -> WordCounts:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordCounts(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits_chars) of every text."""
    common.bounded_batches(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = word_counts(tokenizer)
        n_bytes, n_tokens, fits = [], [], []
        for x in b.column(1):
            text = x.as_py() or ""
            p = PrefixCounts(counts, text)
            n = p.total()
            n_bytes.append(len(text.encode()))
            n_tokens.append(n)
            fits.append(len(text) if n <= limit else p.fit(limit))
        return pa.RecordBatch.from_pydict({
            "doc_id": b.column(0),
            "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_()),
            "fits_chars": pa.array(fits, pa.int64())
        })

    return common.arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and the longest prefix within the limit."""
    return token_counts(common.documents(spark, sf_dir), common.tokenizer_path("word_bpe_49k.json"), limit=2048)

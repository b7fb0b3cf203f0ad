"""Exact token ids of a byte-level BPE at speed.

Ids are those of the tokenizers library.  Texts whose characters are all ASCII or
Latin letters are encoded by tiktoken's merge loop, built from the vocabulary
inside the tokenizers file itself (there the id of a token is its merge rank,
which is checked on loading) and a pattern spelled out for these characters; it is
several times faster.  Any other text (other scripts, unusual spaces, or the string
of an added token) goes to the tokenizers library whole, so nothing rests on two
regular expression engines agreeing about rare characters.  Tests hold both equal.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

import numpy as np

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Anything but ASCII without the separators 1C-1F, Latin letters, and common marks.
_ODD = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTER[6:]}¡¿–—‘’“”…]")
_PIECE = f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE files write for bytes: printable bytes stand for
    themselves, the others for 256, 257 and so on."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        vocab = self.library.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        merges = json.loads(self.library.to_str())["model"]["merges"]
        for i, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            if vocab[a + b] != 256 + i:
                raise ValueError(f"{path}: ids are not merge ranks")
        self.fast = tiktoken.Encoding("file", pat_str=_PIECE, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids of one text; null counts as empty."""
        if not text:
            return b""
        if _ODD.search(text) or any(x in text for x in self.added):
            return self.whole(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Token ids and counts of whole texts, equal to the tokenizer library's own.

Each worker process loads the vocabulary file once.  Pieces that occur again are
looked up; the library encodes each new one.  The memory of pieces is bounded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: Pieces remembered in each of two generations.
REMEMBERED = 300_000

# The splitting pattern of byte-level BPE, with white space spelled out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Characters on whose classes this pattern and the library agree one by one (tests try each).
#: A text with any other, such as one of a newer Unicode version, goes to the library whole.
AGREED = r"\x00-\u0557\u0561-\u0587\u05d0-\u05ea\u0620-\u064a\u0904-\u0939\u0e01-\u0e3a\u2000-\u206f\u20a0-\u20c0\u2100-\u23ff\u2500-\u27ff\u3000-\u3096\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uffbe\U0001f300-\U0001f6d7"
UNSURE = re.compile(f"[^{AGREED}]")


class Remembered(dict):
    """piece -> value.  When a generation is full it becomes the old one, so frequent pieces stay."""

    def __init__(self, make: Callable, limit: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


@lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def special_strings(path: str) -> list[str]:
    return [token.content for token in library(path).get_added_tokens_decoder().values()]


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings proved to be one token: those the library encodes alone as just their own id.

    A byte sequence that is no valid text on its own, or that the merges never reach,
    is not among them; neither is a string that splits into more than one pre-token.
    """
    tokenizer = library(path)
    ids = list(range(tokenizer.get_vocab_size(with_added_tokens=False)))
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    special = set(special_strings(path))
    return frozenset(
        s for i, s, e in zip(ids, strings, found, strict=True)
        if e.ids == [i] and s not in special and PRETOKEN.fullmatch(s) and len(PRETOKEN.findall(s)) == 1
    )


class Counter:
    """Counts tokens: a pre-token that is a whole token counts 1, only the rest is merged."""

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        self.special = special_strings(path)
        self.whole = dict.fromkeys(whole_tokens(path), 1)
        self.merged = Remembered(lambda piece: len(self.tokenizer.encode(piece, add_special_tokens=False).ids))

    def count(self, text: str) -> int:
        if UNSURE.search(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        whole, merged = self.whole.get, self.merged
        return sum([whole(piece) or merged[piece] for piece in PRETOKEN.findall(text)])


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(byte): byte for byte in shown} | {chr(256 + i): byte for i, byte in enumerate(hidden)}


@lru_cache(maxsize=4)
def rank_twin(path: str):
    """The same vocabulary in the rank form of a faster library, or None unless both are proved to agree.

    The rank form joins any neighbours whose string is a token, earliest id first; the
    other form knows pairs.  They agree on every pre-token if ids follow the order of the
    merges and each token's own string merges to that token: just before two parts become
    a token, the stretch they cover has seen the same merges as the string alone.
    """
    import tiktoken

    tokenizer = library(path)
    form = json.loads(tokenizer.to_str())
    model, split = form["model"], form["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if form["normalizer"] or model["type"] != "BPE" or not plain or split.get("type") != "ByteLevel":
        return None
    if split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    special, letters = set(special_strings(path)), _byte_letters()
    vocabulary = {s: i for s, i in model["vocab"].items() if s not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if [vocabulary.get("".join(pair)) for pair in pairs] != list(range(256, 256 + len(pairs))) or len(vocabulary) != 256 + len(pairs):
        return None
    if any([t.id for t in tokenizer.model.tokenize(s)] != [i] for s, i in vocabulary.items()):
        return None
    ranks = {bytes(letters[c] for c in s): i for s, i in vocabulary.items()}
    return tiktoken.Encoding("twin", pat_str=PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, by the rank form where it is proved equal, else by the library."""

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        self.special = special_strings(path)
        self.twin = rank_twin(path)

    def encode(self, text: str) -> bytes:
        if self.twin is None or UNSURE.search(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.twin.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)

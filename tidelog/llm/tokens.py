"""Exact byte-level BPE ids at the speed of a dictionary.

A text is cut before every single space that a non-blank character follows.
The vocabulary's pre-tokens never reach across such a place, so the ids of the
pieces, one behind the other, are the ids of the text.  Pieces are looked up
in a cache of bounded size; those not seen yet are encoded in one call.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Where the tokenizer files are; an operator's ``tokenizer`` parameter is a path or one of these names.
NAMED = "byte_bpe_50k"
MOST_CACHED = 300_000


def vocabulary_path(name: str = NAMED) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def added_tokens(name: str = NAMED) -> dict[str, int]:
    """Tokens that the tokenizer file adds to its vocabulary, found in any text before it is cut."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{name}: added tokens that are not matched literally")
    return {t["content"]: t["id"] for t in found}


class PieceEncoder:
    """Little-endian 32-bit ids of texts and of pre-tokens, for one vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.cache: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, each of which begins with its space, in one text."""
        if len(self.cache) + len(pieces) > MOST_CACHED:
            self.cache.clear()
        if not pieces:
            return
        texts = [" " + p for p in pieces]
        ids = np.array(self.encoding.encode_ordinary("".join(texts)), np.int64)
        ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(t.encode()) for t in texts]), side="left") + 1
        raw, at = ids.astype("<u4").tobytes(), 0
        for piece, to in zip(pieces, cuts.tolist(), strict=True):
            self.cache[piece] = raw[4 * at : 4 * to]
            at = to

    def encode(self, text: str) -> bytes:
        head, *pieces = text.split(" ")
        if not pieces:
            return self.plain(text)
        if any(not p or p[0].isspace() for p in pieces):
            merged: list[str] = []
            for p in pieces:
                if p and not p[0].isspace():
                    merged.append(p)
                elif merged:
                    merged[-1] += " " + p
                else:
                    head += " " + p
            pieces = merged
        get = self.cache.get
        found = list(map(get, pieces))
        if None in found:
            # the cache may be cleared between documents, never between these lines
            self._learn(list({p for p, f in zip(pieces, found, strict=True) if f is None}))
            cache = self.cache
            found = [cache.get(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
        return b"".join(chain((self.plain(head),), found))

    def encode_added(self, text: str, added: dict[str, int]) -> bytes:
        """Ids of a text in which added tokens stand for themselves; what is between them is encoded on its own."""
        if not any(map(text.__contains__, added)):
            return self.encode(text)
        parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
        return b"".join(np.array([added[p]], "<u4").tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts))

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes() if text else b""


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(path)

"""Pre-tokens of the byte-level vocabularies, and a bounded cache of what each pre-token encodes to."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

#: Below this code point the general categories have been stable over Unicode versions, so that every library splits alike.
PLAIN = 0x250
#: A worker's cache is emptied when it holds so many pre-tokens.
CACHE_ENTRIES = 400_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)


@cache
def plain_splitter() -> tuple[Callable[[str], list[str]], Callable]:
    """For texts below PLAIN: public_tokenizers.PATTERN with its classes spelled out; the second value finds other texts."""
    letter, number, space = _class("L"), _class("N"), "".join(re.escape(chr(c)) for c in range(PLAIN) if chr(c) in " \t\n\v\f\r\x85\xa0")
    split = re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    return split.findall, re.compile(f"[^\x00-{chr(PLAIN - 1)}]").search


@cache
def any_splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern).findall


class Cached:
    """Pre-token -> little-endian unsigned 32-bit ids. Two generations of at most CACHE_ENTRIES bound it: a full young one becomes the old one, and what was not used since is forgotten."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.young, self.old = encode, {}, {}

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text's pre-tokens, one after the other. Those unknown in any of the texts are encoded together."""
        missing = {p for pieces in texts for p in pieces if p not in self.young}
        found = {p: self.old[p] for p in missing if p in self.old}
        missing = [p for p in missing if p not in found]
        found.update(zip(missing, self.encode(missing), strict=True))
        if len(self.young) + len(found) > CACHE_ENTRIES:
            now = {p: self.young[p] for pieces in texts for p in pieces if p in self.young}
            self.old, self.young = self.young, now
        self.young.update(found)
        get = self.young.__getitem__
        return [b"".join(map(get, pieces)) for pieces in texts]


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level .json file, special strings handled as its default.

    Merges of such a file in order of their ids are ranks, so a rank encoder gives the same ids and is faster; texts with code points from PLAIN on, or that hold a special string, go to the library itself, as does every text where the file's merges are not in order of ids.
    """

    def __init__(self, path: str):
        import json
        from pathlib import Path

        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.library = Tokenizer.from_file(path)
        file = json.loads(Path(path).read_text())
        self.special = [t["content"] for t in file["added_tokens"]]
        vocab, merges = file["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        ordered = [vocab[a + b] for a, b in merges]
        ranks = {bytes(byte_of()[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        plain = ordered == sorted(ordered) and file["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self.odd = plain_splitter()[1]

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is None or self.odd(text) or any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.ranked.encode_ordinary(text), "<u4")


@cache
def byte_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for a byte, inverted: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(path)

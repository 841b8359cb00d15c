"""Byte-level BPE inside a task: cutting text at pre-token boundaries and looking pieces up."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

#: Pieces whose ids a worker remembers; the commonest come early and so stay.
REMEMBERED = 250_000

#: The letters that byte-level models have for bytes: printable ones stand for themselves, the others follow from U+0100 in order.
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTER = {b: 0x100 + k for k, b in enumerate(x for x in range(0x100) if x not in _KEPT)}

_PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)
_ADJACENT_SPACE = re.compile(r"\s\s")


def pieces(text: str) -> list[str]:
    """text cut at pre-token boundaries; each piece holds one or more whole matches of PATTERN.

    A match never goes on from a character that isn't white space to one that is. Where no two
    white-space characters adjoin, each space and line feed therefore begins a match, and cutting
    before them is exact; other texts are cut at every match.
    """
    if _ADJACENT_SPACE.search(text):
        return _PRE_TOKEN.findall(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    cut = [u if u[:1] == "\n" else " " + u for u in rest]
    return [first, *cut] if first else cut


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """The ranks in a byte-level tokenizer's description, if its merges come in the order of the ids that they make; else None.

    tiktoken then gives the library's ids in a third of its time (tests compare the two).
    """
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    byte = {chr(_LETTER.get(b, b)): b for b in range(0x100)}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in added}
    return ranks if all(a < b for a, b in zip(made, made[1:])) and all(bytes([b]) in ranks for b in range(0x100)) else None


def _ranked(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Token ids by a file; each worker has one.

    A .tiktoken file's ids are those of tiktoken's encode_ordinary. A .json file is loaded by the
    tokenizers library, and the ids are the library's without special tokens put around the text:
    the file's added tokens are cut out of a text first, and what is between them is split by
    PATTERN, as that library splits it.
    """

    def __init__(self, path: str) -> None:
        self._added: dict[str, int] = {}
        if path.endswith(".json"):
            whole = Tokenizer.from_file(path)
            self._added = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
            ranks = ranks_of(json.loads(whole.to_str()))
            encode = _ranked(ranks) if ranks else lambda piece: whole.encode(piece, add_special_tokens=False).ids
            self._of_rank = None
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = _ranked(ranks)
            self._of_rank = np.full(max(ranks.values()) + 1, b"", dtype=object)
            for b, i in ranks.items():
                self._of_rank[i] = b
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None

        class Remembered(dict):
            def __init__(self, prefix: str) -> None:
                self.prefix = prefix

            def __missing__(self, piece: str) -> bytes:
                ids = array("I", encode(piece if piece[:1] == "\n" else self.prefix + piece)).tobytes()
                if len(self) < REMEMBERED:
                    self[piece] = ids
                return ids

        self._whole, self._spaced = Remembered(""), Remembered(" ")

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of the whole text."""
        if self._cut and self._cut.search(text):
            parts = [np.array([self._added[x]], dtype=np.uint32) if k % 2 else self._between(x) for k, x in enumerate(self._cut.split(text))]
            return np.concatenate(parts)
        return self._between(text)

    def _between(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if _ADJACENT_SPACE.search(text):
            return self.encode_pieces(_PRE_TOKEN.findall(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        return np.frombuffer(self._whole[first] + b"".join(map(self._spaced.__getitem__, rest)), dtype=np.uint32)

    def encode_pieces(self, of: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._whole.__getitem__, of)), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of the ids by a .tiktoken file, one after the other; they need not be valid UTF-8 in part."""
        return b"".join(self._of_rank[ids])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)

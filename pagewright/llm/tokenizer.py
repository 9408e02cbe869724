"""Byte-pair encoding of whole columns, cut at forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be joined by a
merge: every encoding has a boundary there. Text is cut at such pairs (where the
pre-splitting pattern cannot look across the cut either), equal fragments of a batch are
encoded once, and the ids of a text are the concatenation of its fragments' ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Fixed value: the pattern of the public byte-level tokenizers that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_BLANKS = b"\t\n\x0b\x0c\r "
#: Fragments remembered by a Python worker; beyond it the memory starts anew.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Tokenizer:
    """A public rank file and where it lies."""

    name: str = "byte_bpe_50k"
    folder: str = "/opt/tokenizers"

    @property
    def path(self) -> str:
        return os.path.join(self.folder, f"{self.name}.tiktoken")

    def fingerprint(self) -> str:
        """Hash of the vocabulary and the pattern: counts are valid for this value only."""
        with open(self.path, "rb") as f:
            return hashlib.md5(f.read() + PATTERN.encode()).hexdigest()


def certain_cuts(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 flags, true where (left, right) bytes occur inside no token."""
    certain = np.ones((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        certain[b[:-1], b[1:]] = False
    return certain


def usable_cuts(certain: np.ndarray) -> np.ndarray:
    """The certain cuts across which the pre-splitting pattern cannot look.

    A cut before ASCII whitespace that does not follow ASCII whitespace always ends a
    pre-token, and what follows is read from the same place as in the whole text. A cut
    between two ASCII letters lies inside a run of letters, which both sides continue to be.
    """
    blank, letter = np.zeros(256, bool), np.zeros(256, bool)
    blank[list(ASCII_BLANKS)] = True
    letter[list(range(65, 91)) + list(range(97, 123))] = True
    return certain & (np.outer(~blank, blank) | np.outer(letter, letter))


class FragmentEncoder:
    """Encodes Arrow string arrays; one per tokenizer and Python process."""

    def __init__(self, tokenizer: Tokenizer):
        import tiktoken

        with open(tokenizer.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cut = usable_cuts(certain_cuts(list(ranks))).ravel()
        self._known: dict[bytes, np.ndarray] = {}

    def _ids(self, fragment: bytes) -> np.ndarray:
        ids = self._known.get(fragment)
        if ids is None:
            ids = np.array(self._encoding.encode_ordinary(fragment.decode("utf-8")), np.int32)
            if len(fragment) < 64:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[fragment] = ids
        return ids

    def _fragments(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Dictionary indices of the fragments in order, the ids of each dictionary entry, and of each text its first fragment's place."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return np.zeros(0, np.int64), [], np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = self._cut[data[:-1].astype(np.uint16) * 256 + data[1:]]
        starts[offsets] = True
        starts[-1] = True
        bounds = np.flatnonzero(starts)
        fragments = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = fragments.dictionary_encode()
        return coded.indices.to_numpy(), [self._ids(x) for x in coded.dictionary.to_pylist()], np.searchsorted(bounds, offsets)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids per text; NULL and empty texts give an empty list."""
        indices, ids, first = self._fragments(texts)
        if not len(indices):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        lengths = np.array([len(x) for x in ids], np.int64)
        flat, begin = np.concatenate(ids), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        n = lengths[indices]
        ends = np.cumsum(n)
        at = np.repeat(begin[indices] - (ends - n), n) + np.arange(ends[-1])
        bounds = np.concatenate([[0], ends])[first].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat[at]))

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids per text; 0 for NULL and empty texts."""
        indices, ids, first = self._fragments(texts)
        if not len(indices):
            return np.zeros(len(texts), np.int64)
        lengths = np.array([len(x) for x in ids], np.int64)
        return np.diff(np.concatenate([[0], np.cumsum(lengths[indices])])[first])


@functools.lru_cache(maxsize=4)
def encoder(tokenizer: Tokenizer) -> FragmentEncoder:
    return FragmentEncoder(tokenizer)

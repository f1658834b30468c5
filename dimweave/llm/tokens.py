"""Encoding with a public tokenizer file, each distinct pre-token once per worker.

A pre-token here is the coarsest cut no merge crosses: for a byte-level tokenizer an optional space
and a run of other characters, or a run of white space; for one that drops white space, a run of
other characters. Special strings are split off first, as the library does, and are pre-tokens of
their own. ``UnitEncoder`` keeps the ids of the pre-tokens it has met as little-endian
unsigned 32-bit bytes, so a text's ids are joined from memory; what is not there is encoded by the
tokenizers library: a plain word by the file's model alone, anything else by the whole tokenizer, many
pre-tokens per call. The memory keeps pre-tokens of at most ``KEPT_CHARS``
(longer ones seldom come again) and at most ``MAX_UNITS``; beyond that it is emptied and filled again,
which changes no id.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from dimweave.llm.common import kept_in_worker

# White space of the Unicode property White_Space, as the tokenizers' expressions read \s.
SPACE = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MAX_UNITS = 1_200_000
KEPT_CHARS = 12
CHUNK_CHARS = 1 << 20
_PER_CALL = 256
# Byte-level tokenizers write a byte as itself where it is printable in Latin-1, else as one of the signs from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``CHUNK_CHARS`` characters (a longer text is alone)."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def pieces_of(text: str) -> Iterator[str]:
    """A long text in parts of about ``CHUNK_CHARS``, cut before a lone space between two words."""
    at = 0
    while len(text) - at > 2 * CHUNK_CHARS and (cut := _CUT.search(text, at + CHUNK_CHARS)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class UnitEncoder:
    """Ids of whole texts by the tokenizer file at ``path``, without added begin or end tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
        words = f"[^{SPACE}]+"
        self.units = re.compile(f" ?{words}|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]" if self.keeps_space else words).findall
        self.separator = "\n" if self.keeps_space else " 0 "
        (self.separator_id,) = self.tokenizer.encode(self.separator.strip(" "), add_special_tokens=False).ids
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip or " " in t.content for t in added):
            raise ValueError("special strings found by more than their characters")
        self.special = tuple(sorted((t.content for t in added), key=len, reverse=True))
        self.at_special = re.compile(f"({'|'.join(map(re.escape, self.special))})").split
        self.tokenize, self.space = self.tokenizer.model.tokenize, chr(_BYTE_SIGNS[32])
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, special strings by themselves."""
        if not any(s in text for s in self.special):
            return self.units(text)
        out: list[str] = []
        for i, part in enumerate(self.at_special(text)):
            if i % 2:
                out.append(part)
            else:
                out += self.units(part)
        return out

    def word(self, unit: str) -> bytes | None:
        """Ids of a plain word, or None: letters below U+0250, which no normalisation but case changes,
        and which in lower case are letters still (U+0130 becomes an i and a mark, which is cut off).

        It is one piece to the tokenizer's expression, so the model alone gives its ids.
        """
        core = unit[1:] if self.keeps_space and unit[:1] == " " else unit
        if not core.isalpha() or not (core.isascii() or max(core) < "\u0250"):
            return None
        if not self.keeps_space:
            unit = unit.lower()
            if not unit.isalpha():
                return None
        coded = unit.replace(" ", self.space) if unit.isascii() else unit.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return array("I", [t.id for t in self.tokenize(coded)]).tobytes()

    def learn(self, units: Iterable[str]) -> None:
        mark, known = self.separator.strip(" "), self.known
        alone, joined, tailed = [], [], []
        for u in units:
            head = u.rstrip(".,;:!?")
            ids = self.word(head) if head else None
            if ids is None:
                odd = mark in u or u.isspace() or any(s in u for s in self.special)
                (alone if odd else joined).append(u)
            elif len(head) == len(u):
                known[u] = ids
            else:
                tailed.append((u, u[len(head):], ids))  # a letter and such a sign never merge
        alone += {tail for _, tail, _ in tailed}.difference(known, alone, joined)
        groups = [joined[i:i + _PER_CALL] for i in range(0, len(joined), _PER_CALL)]
        encoded = self.tokenizer.encode_batch_fast([self.separator.join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded):
            ids = np.asarray(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.separator_id)
            if len(ends) != len(group) - 1:
                alone += group
                continue
            data, at = ids.tobytes(), 0
            for u, end in zip(group, [*(ends * 4).tolist(), len(data)]):
                known[u] = data[at:end]
                at = end + 4
        for u, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            known[u] = np.asarray(e.ids, dtype="<u4").tobytes()
        for u, tail, ids in tailed:
            known[u] = ids + known[tail]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Per text its ids as little-endian unsigned 32-bit bytes."""
        for group in chunks(texts):
            parts = [[self.split(p) for p in pieces_of(t)] for t in group]
            fresh = set().union(*(units for text in parts for units in text)).difference(self.known)
            if len(self.known) + len(fresh) > MAX_UNITS:
                self.known.clear()
                fresh = set().union(*(units for text in parts for units in text))
            self.learn(fresh)
            get = self.known.__getitem__
            for text in parts:
                yield b"".join(b"".join(map(get, units)) for units in text)
            for u in fresh:
                if len(u) > KEPT_CHARS:
                    del self.known[u]

    def lengths(self, units: list[str]) -> list[int]:
        """How many ids each of ``units`` has."""
        self.known.clear()
        self.learn(units)
        return [len(self.known[u]) // 4 for u in units]


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder of a file; it stays over the tasks of a reused Python worker, until another operator's begin."""
    return kept_in_worker(("encoder", path), lambda: UnitEncoder(path))

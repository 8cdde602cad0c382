"""Token ids of whole texts, by a public tokenizer file and a cache of words.

The byte-level pre-tokenizer never joins what a space divides, unless white space stands on both
sides of that space: it takes a single space with what follows and leaves the last of several
spaces to the next piece. So a text cut before such spaces has the ids of its parts in a row,
and each distinct part is encoded once while it stays in the cache. Texts in which the file's
own special tokens occur are encoded as they are.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

#: The default tokenizer; a path given by the caller replaces it.
VOCABULARY = "byte_bpe_50k.json"
END = 0

#: Distinct parts that a worker keeps, the ids it keeps for them, and the longest part that is kept.
#: The ids of parts that are not kept, and of whole texts, stay until the next time parts are forgotten.
MOST_PARTS = 600_000
MOST_IDS = 4_000_000
LONGEST_PART = 48
#: Bytes of text that are encoded at a time: lists of parts take many times the room of their text.
SLICE = 2 << 20

_TIGHT = re.compile(r"\s \s")
_CUTS = re.compile(r"(?<=\S)(?= )|(?<=\s)(?= \S)")
_TOGETHER = 4000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Parts(dict):
    """Numbers parts in order of appearance; new ones wait to be encoded."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner, self.waiting, self.numbers = owner, [], []

    def wait(self, part: str) -> int:
        owner = self.owner
        number = owner.count
        owner.count = number + 1
        self.waiting.append(part)
        self.numbers.append(number)
        return number

    def __missing__(self, part: str) -> int:
        owner = self.owner
        number = owner.count
        owner.count = number + 1
        self.waiting.append(part)
        self.numbers.append(number)
        if len(part) <= LONGEST_PART:
            self[part] = number
        return number


class Encoder:
    def __init__(self, path: str, most_parts: int = MOST_PARTS, most_ids: int = MOST_IDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_parts, self.most_ids = most_parts, most_ids
        self.reset()

    def reset(self) -> None:
        self.spaced, self.plain, self.count = _Parts(self), _Parts(self), 0
        self.starts, self.lengths, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def _forget(self) -> None:
        """Keeps the parts met most often, at most half of the room for parts and for ids."""
        hits, starts, lengths, ids, old = self.hits, self.starts, self.lengths, self.ids, (self.spaced, self.plain)
        order = np.argsort(-hits[:self.count], kind="stable")[:self.most_parts // 2]
        fits = (hits[order] > 1) & (np.cumsum(lengths[order]) <= self.most_ids // 2)
        stays = np.zeros(self.count, bool)
        stays[order[fits]] = True
        self.reset()
        kept = []
        for before, now in zip(old, (self.spaced, self.plain)):
            for part, number in before.items():
                if stays[number]:
                    now[part] = len(kept)
                    kept.append(number)
        numbers = np.array(kept, np.int64)
        self.count = len(kept)
        sizes = lengths[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if kept else 0) + np.repeat(starts[numbers] - (ends - sizes), sizes)
        self._store(np.arange(len(kept)), sizes, ids[at])

    def _numbers(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array([self.plain.wait(text)])
        if _TIGHT.search(text):
            parts = _CUTS.split(text)
            return np.fromiter(map(self.plain.__getitem__, parts), np.int64, len(parts))
        parts = text.split(" ")
        numbers = np.empty(len(parts), np.int64)
        numbers[0] = self.plain[parts[0]]
        del parts[0]
        numbers[1:] = np.fromiter(map(self.spaced.__getitem__, parts), np.int64, len(parts))
        return numbers

    def _store(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        while len(self.starts) < self.count:
            self.starts, self.lengths, self.hits = (
                np.concatenate((a, np.zeros_like(a))) for a in (self.starts, self.lengths, self.hits))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.used += len(ids)

    def _encode_waiting(self) -> None:
        parts, numbers = self.spaced.waiting, np.array(self.spaced.numbers, np.int64)
        alone = list(zip(self.plain.waiting, self.plain.numbers))
        # Without white space at its ends a part may stand in a row with others.
        size, bare = (np.fromiter(map(len, p), np.int64, len(parts)) for p in (parts, map(str.strip, parts)))
        plain = (size > 0) & (size <= LONGEST_PART) & (size == bare)
        if not plain.all():
            alone += [(" " + parts[i], number) for i, number in zip(np.flatnonzero(~plain).tolist(), numbers[~plain].tolist())]
            parts, numbers = [parts[i] for i in np.flatnonzero(plain).tolist()], numbers[plain]
        self.spaced.waiting, self.spaced.numbers, self.plain.waiting, self.plain.numbers = [], [], [], []
        texts = [" " + " ".join(parts[i:i + _TOGETHER]) for i in range(0, len(parts), _TOGETHER)]
        for k, (text, found) in enumerate(zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))):
            ids = np.array(found.ids, np.int64)
            # A part has no space within, so the spaces of a row are where its parts begin.
            row = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(row == 0x20)[1:], len(row))
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            self._store(numbers[k * _TOGETHER:(k + 1) * _TOGETHER], np.diff(last, prepend=0), ids)
        for part, number in alone:
            ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, np.int64)
            self._store(np.array([number]), np.array([len(ids)]), ids)

    def encode(self, texts: list[str], end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by `end`, and the number of ids of each text."""
        if self.count > self.most_parts or self.used > self.most_ids:
            self._forget()
        tail = []
        if end is not None:
            tail = [self.count]
            self.count += 1
            self._store(np.array(tail), np.array([1]), np.array([end]))
        per_text = [np.append(self._numbers(t), tail).astype(np.int64) for t in texts]
        self._encode_waiting()
        if not per_text:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        numbers = np.concatenate(per_text)
        self.hits[:self.count] += np.bincount(numbers, minlength=self.count)
        lengths, starts = self.lengths[numbers], self.starts[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        at = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        edges = np.cumsum([len(p) for p in per_text]) - 1
        return self.ids[at], np.diff(ends[edges], prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file, kept between tasks.

    A task has one core: the library's threads, one for each core of the machine, would only keep
    memory of their own in every worker.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(ids: np.ndarray, before: int = 0) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes(), before)

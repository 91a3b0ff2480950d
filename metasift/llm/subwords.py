"""Subword ids of whole batches of texts, for tokenizers whose tokens never span white space.

Texts are cut at blanks and line ends; A-Z read as lower case, which such a tokenizer does itself.  Each worker remembers
the ids of chunks in an open-addressing table by 64-bit hash, looked up for all chunks of a batch at once; only new
chunks go through the tokenizer.  The table is bounded: when it is full, new chunks are tokenised each time they come.
"""

from __future__ import annotations

import os

import numpy as np

from metasift.llm.common import word_hashes, words

#: Chunks a worker remembers at most; its table has room for a third more.
REMEMBERED = 1_500_000
_SPACE = np.isin(np.arange(256), [10, 32])
_ASCII_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)
_MARKS = (44, 46)
_COPIES: dict[str, Subwords] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Subwords:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.word_end = np.zeros(self.size, bool)
        self.word_end[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = remembered
        slots = 1 << max(4, int(np.ceil(np.log2(1.33 * remembered))))
        self.mask = slots - 1
        self.keys = np.zeros(slots, np.uint64)
        self.entry = np.zeros(slots, np.int32)
        self.start, self.count, self.entries = np.zeros(1024, np.int32), np.zeros(1024, np.int32), 0
        self.pool, self.used = np.zeros(4096, np.uint32), 0
        self.marks = {m: int(self._fresh([chr(m)])[0]) for m in _MARKS}

    @classmethod
    def of(cls, path: str, remembered: int = REMEMBERED) -> Subwords:
        """The worker's own copy, made anew where another bound is asked for."""
        if path not in _COPIES or _COPIES[path].limit != remembered:
            _COPIES[path] = cls(path, remembered)
        return _COPIES[path]

    def _ids(self, chunks: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in encoded]

    def _fresh(self, chunks: list[str]) -> np.ndarray:
        """Entry numbers of new chunks.  Chunks of letters are one word each: many are read as one text and parted at the word ends."""
        out = np.zeros(len(chunks), np.int64)
        letters = [k for k, c in enumerate(chunks) if c.isalpha()]
        plain = [k for k, c in enumerate(chunks) if not c.isalpha()]
        texts = [" ".join([chunks[k] for k in letters[lo:lo + 64]]) for lo in range(0, len(letters), 64)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self._ids(texts)])
        stop = np.flatnonzero(self.word_end[ids]) + 1
        if len(stop) == len(letters):
            out[letters] = self._append(ids, np.diff(stop, prepend=0))
        else:
            plain += letters
        lists = self._ids([chunks[k] for k in plain])
        out[plain] = self._append(np.concatenate([np.zeros(0, np.uint32), *lists]), np.array([len(x) for x in lists], np.int64))
        return out

    def _append(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Entry numbers of new id lists that stand one after another, ``n`` ids each."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.entries + len(n) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.pool[self.used:self.used + len(ids)] = ids
        out = np.arange(self.entries, self.entries + len(n))
        self.start[out] = self.used + np.cumsum(n) - n
        self.count[out] = n
        self.used, self.entries = self.used + len(ids), self.entries + len(n)
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of every hash, -1 where unknown."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out = np.where(hit, self.entry[slot], -1).astype(np.int64)
        at = np.flatnonzero(~hit & (key != 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            key = self.keys[slot]
            hit = key == h[at]
            out[at[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            at, slot = at[on], slot[on]
        return out

    def _remember(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[taken], self.entry[taken] = h[put], entry[put]
            on = np.ones(len(h), bool)
            on[put] = False
            h, entry, slot = h[on], entry[on], (slot[on] + 1) & self.mask

    def encode(self, data: np.ndarray, offsets: np.ndarray, runs: tuple | None = None, hashes: np.ndarray | None = None, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and the offset of each text's first one.

        ``runs`` with their ``hashes`` and ``prefix`` may come from the caller, if they are cut at blanks and line ends alone."""
        starts, ends, first = words(data, offsets, ~_SPACE) if runs is None else runs
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # A mark behind ASCII letters is a word of its own.
        last = data[ends - 1]
        some = np.flatnonzero(np.isin(last, _MARKS) & (ends - starts > 1))
        # The mark is no letter; it is the chunk's only other byte where it is the first one from the chunk's start on.
        other = np.flatnonzero(~_ASCII_LETTER[data])
        marked = np.zeros(len(ends), bool)
        marked[some[other[np.searchsorted(other, starts[some])] == ends[some] - 1]] = True
        ends = ends - marked
        if hashes is None:
            h = word_hashes(data, starts, ends)
        else:
            h = hashes.copy()
            h[marked] = word_hashes(data, starts[marked], ends[marked], prefix)
        h[h == 0] = 1
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        mark = (self.entries, self.used)
        if len(new):
            kinds, at, back = np.unique(h[new], return_index=True, return_inverse=True)
            raw = data.tobytes()
            some = new[at]
            numbers = self._fresh([raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            entry[new] = numbers[back]
        count = np.where(marked, 1, 0) + self.count[entry]
        stop = np.cumsum(count)
        begin = stop - count
        n = self.count[entry]
        index = np.repeat(self.start[entry].astype(np.int64) - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out = np.empty(int(stop[-1]), np.uint32)
        spot = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out[spot] = self.pool[index]
        for m, number in self.marks.items():
            out[stop[marked & (last == m)] - 1] = self.pool[self.start[number]]
        if len(new):
            if self.entries <= self.limit:
                self._remember(kinds, numbers)
            else:
                self.entries, self.used = mark
        return out, np.append(begin, stop[-1])[first]

"""Token ids of a byte-level BPE tokenizer file, for whole batches of texts.

A text is first cut into pieces as the tokenizer's own pattern cuts it (letters, digits, other
signs, white space, contractions); the ids of a piece depend on the piece alone. Pieces are found
and looked up for a chunk of texts at once; only pieces the worker has not met before are encoded.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import tiktoken

from assayline.llm import kernels

#: Fixed value: the pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the code points of \s.
WHITE = [*range(9, 14), 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SIGN, SPACE = range(4)
CODE_BASE = 0x9FB21C651E98DF25
MAX_PIECES = 1 << 20


def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, SIGN, np.uint8)
    for code in range(0x110000):
        table[code] = kinds.get(unicodedata.category(chr(code))[0], SIGN)
    table[WHITE] = SPACE
    return table


def piece_starts(codes: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts start; ``offsets`` are the texts' bounds in ``codes``."""
    n = len(codes)
    kind = classes[codes]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # a run of white space before something else gives up its last character: a plain space
    # joins what follows, any other stands alone
    tail = np.zeros(n, bool)
    tail[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
    blank = np.flatnonzero(tail & (codes == 32))
    new[tail] = True
    new[blank + 1] = False
    # contractions: an apostrophe that starts a piece takes the letters of one, and the rest of
    # the letters are a piece of their own
    for at in np.flatnonzero(new & (codes == 39)).tolist():
        rest = codes[at + 1 : at + 3]
        if at + 1 >= n or first[at + 1]:
            continue
        one = chr(rest[0])
        two = one + chr(rest[1]) if len(rest) > 1 and not first[at + 2] else ""
        taken = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if taken:
            new[at + 1 : at + 1 + taken] = False
            if at + 1 + taken < n:
                new[at + 1 + taken] = True
                after = at + 1 + taken
                if tail[after] and codes[after] == 32:
                    new[after + 1] = False
    return np.flatnonzero(new)


class Encoder:
    """Ids of texts by a tokenizer file; remembers the pieces it has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        byte_of = _byte_letters()
        vocabulary = content["model"]["vocab"]
        # the merges of this kind of file are in the order of their ids
        ranks = {
            bytes(byte_of[c] for c in token): number
            for token, number in vocabulary.items() if token not in self.special
        }
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(1 << 22, -1, np.int32)
        self.keys = np.zeros(MAX_PIECES, np.uint64)
        self.begin = np.zeros(MAX_PIECES + 1, np.int64)
        self.ids = np.zeros(1 << 22, np.uint32)
        self.known = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 where it is new; open addressing over ``slots``."""
        mask = len(self.slots) - 1
        at = (keys >> np.uint64(42)).astype(np.int64)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found[open_] = self.slots[at[open_]]
            again = found[open_]
            open_ = open_[(again >= 0) & (self.keys[again] != keys[open_])]
        return found

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        for key, text in zip(keys, texts):
            ids = self.bpe.encode_ordinary(text)
            low = int(self.begin[self.known])
            if low + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)))
            self.ids[low : low + len(ids)] = ids
            self.keys[self.known] = key
            self.begin[self.known + 1] = low + len(ids)
            at = key >> 42
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at] = self.known
            self.known += 1

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's ids."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = piece_starts(codes, offsets, self.classes)
        ends = np.append(starts[1:], len(codes))
        keys = kernels.span_hashes(codes.astype(np.uint64) + np.uint64(1), starts, ends, CODE_BASE)
        numbers = self._find(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            distinct, where = np.unique(keys[new], return_index=True)
            spans = new[where]
            if self.known + len(distinct) > MAX_PIECES:
                self._forget()
                distinct, spans = np.unique(keys, return_index=True)
                if len(distinct) > MAX_PIECES:
                    each = [np.array(self.bpe.encode_ordinary(t), np.uint32) for t in texts]
                    return np.concatenate(each), np.concatenate(([0], np.cumsum([len(e) for e in each])))
            self._learn(distinct.tolist(), [whole[starts[i] : ends[i]] for i in spans.tolist()])
            numbers = self._find(keys)
        low, size = self.begin[numbers], self.begin[numbers + 1] - self.begin[numbers]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(low - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the strings of special tokens give their ids, as in the tokenizer."""
        if not any(mark in text for text in texts for mark in self.special):
            ids, bounds = self._encode_plain(texts)
            return [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        return [np.concatenate(self._with_special(text)) for text in texts]

    def _with_special(self, text: str) -> list[np.ndarray]:
        for mark, number in self.special.items():
            if mark in text:
                parts = [self._with_special(part) for part in text.split(mark)]
                between = [np.array([number], np.uint32)]
                return [x for i, part in enumerate(parts) for x in ((between if i else []) + part)]
        return [self._encode_plain([text])[0]]


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or
    one of the letters from U+0100 on, in order, for bytes that do not print."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


def worker_encoder(path: str) -> Encoder:
    """The worker's encoder of ``path``; built once, kept with the pieces it has met."""
    store = kernels.worker_store()
    if ("encoder", path) not in store:
        store["encoder", path] = Encoder(path)
    return store["encoder", path]

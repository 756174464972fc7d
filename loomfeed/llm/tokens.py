"""Token ids of whole texts, by a public tokenizer that is remembered word by word.

The tokenizer cuts at white space before anything else, so the ids of a text are those of its words in turn.  A worker
keeps the ids of the words that it has met (at most MEMORY of them) and asks the tokenizer for new ones alone.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers; then it starts anew.
MEMORY = 900_000
END_ID = 2
#: Punctuation of ASCII at the end of a word, behind a letter or digit of ASCII or a letter of Latin-1 (two bytes of UTF-8).
_TAIL = re.compile(rb"(?:(?<=[A-Za-z0-9])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))[!-/:-@\[-`{-~]+$")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts by a word-based tokenizer file; equal to Tokenizer.encode(text, add_special_tokens=False)."""

    _open: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One per worker process and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.filled = np.zeros(1 << 16, dtype=np.uint32), 0
        self.at, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember words that are not known yet; ids: theirs in turn."""
        k, n = len(self.known), len(words)
        while k + n > len(self.at):
            self.at, self.length = np.concatenate([self.at, self.at]), np.concatenate([self.length, self.length])
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.at[k : k + n], self.length[k : k + n] = self.filled + np.cumsum(lengths) - lengths, lengths
        self.filled += len(ids)
        self.known.update(zip(words, range(k, k + n), strict=True))

    def _encode(self, words: list[bytes]) -> None:
        """Remember new words.  Words of letters alone are one piece each and go to the tokenizer many at a time."""
        texts = [w.decode() for w in words]
        letters = [t.isalpha() for t in texts]
        plain, odd = [i for i, x in enumerate(letters) if x], [i for i, x in enumerate(letters) if not x]
        groups = [plain[i : i + 400] for i in range(0, len(plain), 400)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                self._add([words[i] for i in group], ids[: stops[-1]], np.diff(stops, prepend=0))
            else:
                odd += group
        if odd:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)]
            self._add([words[i] for i in odd], np.array([x for own in found for x in own], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64))

    def _places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def _gather(self, index: np.ndarray) -> np.ndarray:
        """The ids of known words in turn."""
        lengths = self.length[index]
        behind = np.cumsum(lengths)
        return self.pool[np.arange(behind[-1] if len(behind) else 0) + np.repeat(self.at[index] - behind + lengths, lengths)]

    def _learn(self, words: list[bytes]) -> None:
        """Closing punctuation behind such a letter or digit is a piece of its own: encode stem and tail once each."""
        tailed, parts, stems = [], [], set()
        for word in words:
            m = _TAIL.search(word)
            if m and b"<|" not in word:
                tailed.append(word)
                parts += (word[: m.start()], m[0])
            else:
                stems.add(word)
        stems.update(parts)
        self._encode([w for w in stems if w not in self.known])
        pairs = self._places(parts)
        self._add(tailed, self._gather(pairs), self.length[pairs].reshape(-1, 2).sum(axis=1))

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all words in turn, and the number of words of each text.  Arrow cuts at white space of ASCII and numbers
        the distinct words, so that each is looked up once."""
        lowered = pa.array([text if b"<|" in text else text.lower() for text in texts], pa.string())
        cut = pc.ascii_split_whitespace(lowered)
        every = cut.flatten()
        full = pc.greater(pc.binary_length(every), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
        counts = np.diff(np.concatenate([[0], np.cumsum(full)])[np.asarray(cut.offsets)])
        coded = every.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        index = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = [i for i in np.flatnonzero(index < 0).tolist() if words[i]]
        if new:
            fresh = [words[i] for i in new]
            self._learn(fresh)
            index[new] = self._places(fresh)
        return index[np.asarray(coded.indices)[full]], counts

    def encode(self, texts: list[bytes], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end_id behind each text's, and the offset of each text (one more at the end)."""
        if len(self.known) > MEMORY:
            self.clear()
        index, counts = self._words(texts)
        lengths = self.length[index]
        behind = np.concatenate([[0], np.cumsum(lengths)])
        firsts = np.concatenate([[0], np.cumsum(counts)])
        offsets = behind[firsts] + np.arange(len(texts) + 1)
        ids = np.full(offsets[-1], end_id, dtype=np.uint32)
        body = np.ones(offsets[-1], dtype=bool)
        body[offsets[1:] - 1] = False
        ids[body] = self._gather(index)
        return ids, offsets


def crc32_of(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def to_payload(ids: np.ndarray) -> bytes:
    """Ids in the narrowest of 16 and 32 bits that holds them all, little-endian, behind one byte that tells which."""
    narrow = not len(ids) or ids.max() < 1 << 16
    return (b"\x02" if narrow else b"\x04") + ids.astype("<u2" if narrow else "<u4").tobytes()


def from_payload(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, dtype="<u2" if payload[0] == 2 else "<u4", offset=1).astype(np.uint32)


def part_of_payload(payload, start: int, n: int) -> np.ndarray:
    """n of the ids of a payload (any buffer), from start on; the rest is not read."""
    width = 2 if payload[0] in (2, b"\x02") else 4
    return np.frombuffer(payload, dtype=f"<u{width}", count=n, offset=1 + start * width).astype(np.uint32)

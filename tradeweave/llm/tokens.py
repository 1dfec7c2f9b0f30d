"""Token ids of whole texts by the tokenizers library, with words encoded once.

Byte-pair encoders treat the words of a text independently, and words repeat, so a
worker keeps the ids of words it has met and asks the library only for new ones,
many in one call. Texts that cannot be cut surely at spaces and line ends (double
spaces, control characters, rare white space) are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

IDS = np.dtype("<u4")
#: Entries of a worker's word table, after which most are given up; bounds its memory.
WORDS_KEPT = 1_500_000
#: Texts above this many bytes are encoded in slices.
SLICE = 1 << 22
_HEAD, _MARK = b"\x02", b"\x01"
# Kinds of bytes: visible signs (v), white space as it is, control characters (c),
# the rest of longer characters (z). A word may also start with the byte C3.
_KINDS = bytes(
    b if b in b" \n" else ord("v") if 33 <= b <= 126 or b == 0xC3 else ord("z") if b >= 128 else ord("c") for b in range(256)
)
# A space or line end is a sure cut only between visible signs.
_UNSURE = (b"c", b"  ", b" \n", b" z", b"\n ", b"\n\n", b"\nz", b"z\n")
_SLICE_AT = re.compile(rb"(?<=[!-~]) (?=[0-9A-Za-z])")


class WordEncoder:
    """Encodes texts (UTF-8 bytes) to ids (little-endian unsigned 32-bit bytes)."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        # Between words goes something with an id of its own: a line end where the
        # encoder keeps white space, else a control character standing alone.
        line = self._ids("\n")
        if len(line) == 1:
            self.between, self.mark, self.line, self.space = b"\n", line[0], line.tobytes(), b" "
        else:
            mark = self._ids("\x01")
            self.between, self.mark, self.line, self.space = b" \x01 ", mark[0], line.tobytes(), b""
            if len(mark) != 1 or len(line):
                self.mark = None
        #: Upper and lower case have the same ids.
        self.lower = self._ids("A").tobytes() == self._ids("a").tobytes()
        self.stops = {bytes([c]): self._ids(chr(c)).tobytes() for c in b".,"}
        self.words: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=IDS)

    def _learn(self, words: set[bytes]) -> None:
        # a stop after an ASCII letter is encoded apart from the word
        ended = [(w, w[:-1], w[-1:]) for w in words if w[-1:] in self.stops and w[-2:-1].isalpha()]
        plain = words.difference(w for w, _, _ in ended)
        plain.update(stem for _, stem, _ in ended if stem not in self.words)
        self._encode_words(list(plain))
        for w, stem, stop in ended:
            self.words[w] = self.words[stem] + self.stops[stop]

    def _encode_words(self, words: list[bytes]) -> None:
        between, known = self.between, self.words
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            texts = [w[1:] if w[:1] == _HEAD else self.space + w for w in part]
            ids = self._ids((between.join(texts) + between).decode("utf-8", "replace"))
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part):  # a word holds the mark's id itself
                for w, text in zip(part, texts, strict=True):
                    known[w] = self._ids(text.decode("utf-8", "replace")).tobytes()
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, (ends * 4).tolist(), strict=True):
                known[w] = raw[start:end]
                start = end + 4

    def _pieces(self, text: bytes, head: bool) -> list[bytes] | None:
        """Keys of the words of a text; None if it has to be encoded whole."""
        kinds = text.translate(_KINDS)
        if self.mark is None or kinds[:1] in b"\n" or kinds[-1:] in b" \n" or any(k in kinds for k in _UNSURE):
            return None
        if self.lower:
            if b"<|" in text:  # what looks like a special token is told apart by case
                return None
            text = text.lower()
        text = text.replace(b"\n", b" \n " + _HEAD)
        return (_HEAD + text if head else text[1:]).split(b" ")

    def encode(self, texts: Iterable[bytes | None]) -> list[bytes]:
        """Ids of each text; a missing one has none."""
        if len(self.words) > self.kept:  # long words seldom come again
            self.words = {w: ids for w, ids in self.words.items() if len(w) < 9}
            if 2 * len(self.words) > self.kept:
                self.words.clear()
        self.words[b"\n"] = self.line
        parts, new, n = [], set(), 0
        for text in texts:
            for k, part in enumerate(_slices(text or b"")):
                pieces = self._pieces(part, k == 0)
                ids = list(map(self.words.get, pieces)) if pieces else None
                gaps = [i for i, known in enumerate(ids) if known is None] if pieces else ()
                gaps = [(i, pieces[i]) for i in gaps]
                new.update(w for _, w in gaps)
                parts.append((n, part, ids, gaps))
            n += 1
        self._learn(new)
        out: list[list[bytes]] = [[] for _ in range(n)]
        for at, part, ids, gaps in parts:
            for i, word in gaps:
                ids[i] = self.words[word]
            if ids is not None:
                out[at].append(b"".join(ids))
            elif part:
                out[at].append(self._ids(part.decode("utf-8", "replace")).tobytes())
        return [p[0] if len(p) == 1 else b"".join(p) for p in out]


def _slices(text: bytes):
    start = 0
    while len(text) - start > SLICE:
        cut = _SLICE_AT.search(text, start + SLICE)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, kept: int = WORDS_KEPT) -> WordEncoder:
    """This worker's encoder for a vocabulary file, with a word table of that size.

    A table stays as long as the worker: where other steps follow, keep it small.
    """
    if (path, kept) not in _encoders:
        _encoders[path, kept] = WordEncoder(path, kept)
    return _encoders[path, kept]

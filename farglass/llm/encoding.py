"""Exact tokenizer output through a bounded memo of white-space-delimited chunks.

Both tokenizers split a text at white space before they merge anything, so the ids of a text are
the ids of its chunks in order. A chunk is encoded by the library once and then looked up: plain
words by its model alone, others by all its steps. The shortcut is taken only for texts whose white
space is of the kind for which that holds; any other text goes to the library whole. Special strings hold no white space, so each stays inside
one chunk and the library treats it there as it would in the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array

#: Chunks remembered by a Python worker; a bound on memory, not on the input.
MEMO = 800_000


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: its version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Memo(dict):
    """A dict that makes missing values and keeps them while there is room."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.room:
            self[key] = value
        return value


#: Marks that end words. A run of them behind a letter is a piece of its own for both tokenizers.
MARKS = ",.;:!?*$%&#"
#: Words of these letters are one piece, which the library's model encodes without its other steps.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
LATIN_1 = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: A word of such letters with marks behind it, and a newline before it or not.
PLAIN = re.compile(f"(\\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([{re.escape(MARKS)}]*)").fullmatch


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level tokenizers put for each byte: itself if it is printable,
    else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


BYTE_CHARACTERS = byte_characters()


def as_bytes(word: str) -> str:
    return word.encode().decode("latin1").translate(BYTE_CHARACTERS)


class IdEncoder:
    """Ids of whole texts by a byte-level tokenizer, as little-endian bytes of ``typecode``.

    A text is cut at single spaces and newlines. A cut where a word's neighbour is no white space is
    always a border of pieces. Text with any other white space gets None for a part, and goes to the
    library whole.
    """

    def __init__(self, path: str, typecode: str = "I", memo: int = MEMO // 4):
        self.lib, self.typecode = load(path), typecode
        self.model = self.lib.model
        self.newline = self._library("\n")
        self.packed = _Memo(lambda i: self._pack([i]), 1 << 17)
        self.first = _Memo(self._bare, memo // 8)
        self.parts = _Memo(self._part, memo)
        self.stems = _Memo(self._stem, memo // 2)
        self.tails = _Memo(self._library, memo // 8)

    def _pack(self, ids) -> bytes:
        return array(self.typecode, ids).tobytes()

    def _library(self, text: str) -> bytes:
        return self._pack(self.lib.encode(text, add_special_tokens=False).ids)

    def _stem(self, stem: str) -> bytes:
        # The byte characters of ASCII letters are the letters themselves.
        spelt = stem.replace(" ", BYTE_CHARACTERS[32]) if stem.isascii() else as_bytes(stem)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelt)])

    def _word(self, text: str) -> bytes:
        stem = text.rstrip(MARKS)
        if not LETTERS(stem.removeprefix(" ")):
            return self._library(text)
        return self.stems[stem] + self.tails[text[len(stem) :]] if len(stem) < len(text) else self.stems[stem]

    def _bare(self, part: str) -> bytes | None:
        return self._word(part) if part.split() == [part] else None

    def _part(self, part: str) -> bytes | None:
        """Ids of a part and the white space before it: a newline of its own, else a space."""
        plain = PLAIN(part)
        if plain is not None:
            line, stem, tail = plain.groups()
            made = self.newline + self.stems[stem] if line else self.stems[" " + stem]
            return made + self.tails[tail] if tail else made
        word = part.removeprefix("\n")
        if word.split() != [word]:
            return None
        return self._word(" " + word) if word == part else self.newline + self._word(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        out, part = [], self.parts.__getitem__
        for text in texts:
            first, *rest = text.replace("\n", " \n").split(" ")
            try:
                out.append(self.first[first] + b"".join(map(part, rest)))
            except TypeError:  # some part was None
                out.append(self._library(text))
        return out


class TokenCounter:
    """Token counts of whole texts by a tokenizer that drops white space and lower-cases.

    Python takes four control characters for white space that the tokenizer does not; texts with them
    go to the library whole.
    """

    def __init__(self, path: str, memo: int = MEMO // 10):
        self.lib = load(path)
        self.model = self.lib.model
        self.counts = _Memo(self._word, memo)
        self.stems = _Memo(self._stem, memo // 2)
        self.tails = _Memo(self._library, memo // 8)

    def _library(self, text: str) -> int:
        return len(self.lib.encode(text, add_special_tokens=False))

    def _stem(self, stem: str) -> int:
        return len(self.model.tokenize(as_bytes(stem.lower())))

    def _word(self, text: str) -> int:
        stem = text.rstrip(MARKS)
        if not LATIN_1(stem):
            return self._library(text)
        return self.stems[stem] + (self.tails[text[len(stem) :]] if len(stem) < len(text) else 0)

    def count(self, texts: list[str]) -> list[int]:
        known = self.counts.__getitem__
        return [self._library(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else sum(map(known, t.split())) for t in texts]


def chunks(texts: list[str], size: int = 2_000_000):
    """Runs of texts of about ``size`` characters, so that what a call holds stays bounded."""
    run: list[str] = []
    held = 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


_WORKER: dict = {}


def per_worker(kind, *args):
    """One encoder for each Python worker, kept across tasks."""
    key = (kind.__name__, *args)
    if key not in _WORKER:
        _WORKER[key] = kind(*args)
    return _WORKER[key]

"""Exact tokenizer results from cached pieces of text.

A text is cut where no token can span the cut; each different piece is encoded
once by the tokenizers library and remembered, so frequent words cost one
lookup.  The memory of a worker is bounded in bytes and outlives its tasks.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces and their results that a worker remembers, in bytes with all overhead.
CACHE_BYTES = 120_000_000
#: Characters of text that are cut and encoded together.
BATCH_CHARS = 4_000_000
#: A longer text is cut at safe places before its pieces are listed.
CHUNK_CHARS = 1_000_000

#: Characters that may join a neighbouring space in one token: white space of
#: any kind, controls and invisible characters.
_JOINING_RANGES = ((0x0, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_JOINING = "".join(f"{chr(a)}-{chr(b)}" for a, b in _JOINING_RANGES)
_UNSAFE = re.compile(f" (?:[{_JOINING}])|[{_JOINING}] ")
_SAFE = re.compile(f"(?<=[^{_JOINING}]) (?=[^{_JOINING}])")


def load(path: str):
    """The tokenizer in ``path``, used by one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that tokens don't span.

    Every part but the first begins with the space at its cut.  A text without
    a safe place stays whole.
    """
    start = 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def spaced(text: str) -> list[str]:
    """Parts between single spaces whose neighbours are neither white space nor
    control; a token of a byte-level vocabulary can begin with such a space and
    never reaches over it."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


def by_size(texts: Iterable[str], limit: int | None = None, sizes: Iterable[int] | None = None) -> Iterator[list[str]]:
    """``texts`` in order, in lists of about ``limit`` (:data:`BATCH_CHARS`)
    characters, or of what ``sizes`` counts."""
    batch, held, limit = [], 0, limit or BATCH_CHARS
    for text, size in zip(texts, sizes, strict=True) if sizes is not None else ((t, len(t)) for t in texts):
        batch.append(text)
        held += size
        if held >= limit:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class TokenCounter:
    """Numbers of tokens of a byte-level vocabulary."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.encode = load(path).encode_batch_fast
        self.limit, self.held = cache_bytes, 0
        self.after_space: dict[str, int] = {}

    def _learn(self, pieces: set[str]) -> None:
        fresh = list(pieces.difference(self.after_space))
        for group in by_size(fresh):
            coded = self.encode([f" {x}" for x in group], add_special_tokens=False)
            self.after_space.update(zip(group, map(len, coded), strict=True))
            self.held += sum(map(len, group)) + _ENTRY_BYTES * len(group)

    def __call__(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        counts = [0] * len(texts)
        parts = ((i, part, k > 0) for i, text in enumerate(texts) for k, part in enumerate(chunks(text)))
        for i, first, rest in self._split(parts):
            if first:
                counts[i] += len(self.encode([first], add_special_tokens=False)[0])
            if rest:
                if self.held > self.limit:
                    self.after_space.clear()
                    self.held = 0
                self._learn(set(rest))
                counts[i] += sum(map(self.after_space.__getitem__, rest))
        return counts

    @staticmethod
    def _split(parts):
        """Index, the piece at the text's very start, and the pieces after spaces."""
        for i, part, cut in parts:
            pieces = spaced(part[1:] if cut else part)
            yield (i, "", pieces) if cut else (i, pieces[0], pieces[1:])


#: ASCII punctuation that may end a word and is a token run of its own; an
#: apostrophe is not among them, since it joins the letters after it.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What a remembered piece takes besides its bytes: two objects and its entry.
_ENTRY_BYTES = 180


def _letters_stay(word: str) -> bool:
    """Whether the tokenizer's normal form of a word holds nothing but letters."""
    return unicodedata.normalize("NFC", word).lower().isalpha()


class TokenIds:
    """Token ids of a lower-case vocabulary whose tokens hold no white space and
    never both letters and punctuation, and end words with ``</w>``.

    A text is cut at ASCII white space.  Words of letters are encoded many at
    once, in one string, and told apart by the tokens that end a word; where
    these don't tally, and for words of another kind, each is encoded by
    itself.  A word with punctuation after it is two pieces.  Texts are lowered
    first, which their tokenizer does too, unless a mark may compose with the
    letter before it or a special string, which has its case, may occur.  Ids
    are little-endian unsigned 32-bit.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        tokenizer = load(path)
        self.encode = tokenizer.encode_batch_fast
        self.limit, self.held = cache_bytes, 0
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, pieces: list[bytes]) -> None:
        if self.held > self.limit // 2:  # half of the memory for what is in use, half for what was
            self.known, self.before, self.held = {}, self.known, 0
        known, letters, others, joined = self.known, set(), set(), {}
        missing = [piece for piece in pieces if piece not in known]
        again = {piece: self.before[piece] for piece in missing if piece in self.before}
        for piece in missing:
            if piece in again:
                continue
            if piece.isalpha():
                letters.add(piece)
                continue
            stem = piece.rstrip(_TAIL)
            if stem and b"<|" not in piece and (stem.isalpha() or _letters_stay(stem.decode())):
                letters.add(stem)
                if len(stem) < len(piece):
                    others.add(piece[len(stem) :])
                    joined[piece] = stem
            else:
                others.add(piece)
        known |= again
        fresh = self._letters(list(letters.difference(known)))
        fresh |= self._each(list(others.difference(known)))
        known |= fresh
        for piece, stem in joined.items():
            joined[piece] = known[stem] + known[piece[len(stem) :]]
        known |= joined
        self.held += sum(sum(map(len, new)) + sum(map(len, new.values())) + _ENTRY_BYTES * len(new) for new in (fresh, joined, again))

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        for start in range(0, len(words), 5000):
            group = words[start : start + 5000]
            ids = np.array(self.encode([b" ".join(group).decode()], add_special_tokens=False)[0].ids, "<u4")
            past = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(past) != len(group) or past[-1] != 4 * len(ids):
                found |= self._each(group)
                continue
            data = ids.tobytes()
            found.update((w, data[a:b]) for w, a, b in zip(group, [0, *past], past))  # noqa: B905
        return found

    def _each(self, words: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        for start in range(0, len(words), 50_000):
            group = words[start : start + 50_000]
            coded = self.encode([w.decode() for w in group], add_special_tokens=False)
            found.update(zip(group, (array("I", e.ids).tobytes() for e in coded), strict=True))
        return found

    @staticmethod
    def _lowered(text: str) -> bytes:
        data = text.encode()
        # U+0300 to U+037F begin with one of two bytes
        return data if b"<|" in data or b"\xcc" in data or b"\xcd" in data else data.lower()

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin and end."""
        parts = [(i, self._lowered(part)) for i, text in enumerate(texts) for part in chunks(text, BATCH_CHARS)]
        split = pc.ascii_split_whitespace(pa.array([data for _, data in parts], pa.large_binary()).view(pa.large_string()))
        words = pc.dictionary_encode(split.flatten().view(pa.large_binary()))
        different = words.dictionary.to_pylist()
        self.known[b""] = b""  # before or after the white space at an end
        self._learn(different)
        self.known[b""] = b""
        found = pa.array(map(self.known.__getitem__, different), pa.large_binary()).take(words.indices)
        past = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1) // 4
        ids = np.frombuffer(found.buffers()[2] or b"", "<u4")[: past[-1]]
        ends = past[split.offsets.to_numpy()[1:]]
        owner = np.fromiter((i for i, _ in parts), np.int64, len(parts))
        return ids, np.concatenate([[0], ends[np.searchsorted(owner, np.arange(len(texts)), side="right") - 1]]).astype(np.int64)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        ids, at = self.flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


_shared: dict[tuple[type, str], TokenCounter | TokenIds] = {}


def shared(kind: type, path: str):
    """The :class:`TokenCounter` or :class:`TokenIds` of this worker process,
    whose memory of pieces outlives a task."""
    if (kind, path) not in _shared:
        _shared[kind, path] = kind(path)
    return _shared[kind, path]

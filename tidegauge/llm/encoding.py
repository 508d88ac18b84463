"""Token ids of whole texts by the `tokenizers` library, each distinct piece of text encoded once.

Both vocabularies split a text before any merge, and never across the places where a text is cut here, so the ids
of a text are the ids of its pieces one after another. Arrow numbers the distinct pieces of a group of texts, the library
encodes those a dictionary of bounded size does not hold from lately, and numpy puts the ids in the texts' order.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

ID = np.dtype("<u4")

# Byte-level vocabularies write bytes that are not printable in Latin-1 as the letters from code point 256 on.
PLAIN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in PLAIN_BYTES)}
BYTE_CODES = np.array([ord(BYTE_LETTERS.get(b, chr(b))) if b != 32 else 32 for b in range(256)], "<u2")
MARKS = "".join(c for c in string.punctuation if c != "'")
SPACES = " \t\n\r\x0b\x0c"
INNER = SPACES + MARKS  # what a piece that does not start a text may start with
GROUP = 1 << 21  # characters encoded at a time, at least one text
WORDS = 250  # new words in one call of the library

IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
IS_MARK = np.isin(np.arange(256), list(MARKS.encode()))
IS_LETTER = np.isin(np.arange(256), list(string.ascii_letters.encode()))
ASCII_BODY = (np.arange(256) > 32) & (np.arange(256) < 127)  # bytes that no white space of any kind has
LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])  # first bytes of white space beyond ASCII


def _bodies(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that is surely no white space starts at each of these bytes."""
    first = raw[at]
    sure = ASCII_BODY[first] | (first >= 0x80)
    rare = np.flatnonzero(LEADS[first])
    if len(rare):
        one, (two, three) = first[rare], (raw[np.minimum(at[rare] + k, len(raw) - 1)] for k in (1, 2))
        sure[rare] = ~(
            (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
            | (one == 0xE1) & ((two == 0x9A) | (two == 0xA0))
            | (one == 0xE2) & ((two == 0x80) & ((three < 0x90) | (three >= 0xA8) & (three <= 0xAF)) | (two == 0x81))
            | (one == 0xE3) & (two == 0x80) & (three == 0x80)
        )
    return sure


def cut(texts: Sequence[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts, and the number of pieces before each text and at the end.

    A piece starts with a text, and with white space that follows a character of another kind or stands right before one:
    splits that attach one space to the next word, and splits that drop white space, start a part there as well. So they
    do with ASCII marks after a letter, told here for Latin letters.
    """
    parts = [t.encode() for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    data = b"".join(parts)
    raw = np.frombuffer(data, np.uint8)
    starts = np.zeros(len(raw) + 1, bool)
    starts[bounds] = True  # of texts, until the cuts are marked too
    at = np.flatnonzero(IS_SPACE[raw])
    after = np.minimum(at + 1, max(len(raw) - 1, 0))
    sure = ASCII_BODY[raw[at - 1]] & ~starts[at] | _bodies(raw, after) & ~starts[at + 1]
    starts[at[sure]] = True
    at = np.flatnonzero(IS_MARK[raw])
    before, second = raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]  # if of another text, the cut is there
    starts[at[IS_LETTER[before] | (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]] = True
    offsets = np.flatnonzero(starts)
    pieces = pa.StringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)
    )
    return pieces.dictionary_encode(), np.searchsorted(offsets, bounds)


class PieceEncoder:
    """`encode(texts)` returns the ids of every text as little-endian unsigned 32-bit bytes; `encoded` yields them.

    A vocabulary with a byte-level split keeps the space before a word and the line end; one that drops white space
    does not. Any other vocabulary is not cut at all. `max_pieces` bounds the dictionary (100,000 take about 15 MB): when it
    is full a new one begins, and the pieces still in use move over from the old one.
    """

    def __init__(self, path: str, max_pieces: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.max_pieces = max_pieces
        self.kind = _kind(self.tokenizer)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.lead = " " if self.kind == "keeps" else ""
        self.words = Tokenizer(self.tokenizer.model)  # the merges alone, word by word
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.outer = self._outer() if self.kind != "whole" else np.zeros(0, bool)

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _outer(self) -> np.ndarray:
        """Whether an id starts a word (the space before it is kept) or ends one (white space is dropped)."""
        letter, suffix = BYTE_LETTERS[32], getattr(self.tokenizer.model, "end_of_word_suffix", None)
        outer = np.zeros(self.vocab_size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            outer[i] = token.startswith(letter) if self.lead else bool(suffix) and token.endswith(suffix)
        return outer

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 200):
            encoded = self.tokenizer.encode_batch_fast(texts[at:at + 200], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in encoded]
        return out

    def _is_word(self, piece: str) -> bool:
        """Whether a piece is a word of letters, which both splits keep in one part."""
        if self.lead:
            return piece[:1] == " " and piece[1:].isalpha()
        return piece.isalpha() and (piece.isascii() or unicodedata.normalize("NFC", piece).lower().isalpha())

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters (with the space before them, if it is kept) by the merges alone."""
        joined = "".join(words)[1:] if self.lead else " ".join(words)
        if not self.lead:
            joined = unicodedata.normalize("NFC", joined).replace("\u03a3", "\u03c3").lower()  # no final sigma
        letters = BYTE_CODES[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
        if self.lead:
            letters = BYTE_LETTERS[32] + letters.replace(" ", " " + BYTE_LETTERS[32])
        ids = np.array(self.words.encode_batch_fast([letters], add_special_tokens=False)[0].ids, ID)
        outer = np.flatnonzero(self.outer[ids])
        if len(outer) != len(words):
            tokenize = self.tokenizer.model.tokenize
            return [array("I", [t.id for t in tokenize(word)]).tobytes() for word in letters.split(" ")]
        bounds = [*(4 * outer).tolist(), 4 * len(ids)] if self.lead else [0, *(4 * outer + 4).tolist()]
        data = ids.tobytes()
        return [data[low:high] for low, high in zip(bounds, bounds[1:])]

    def _mark(self, run: str) -> bytes:
        if run not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[run] = self.ids(run)
        return self.marks[run]

    def _learn(self, new: list[str]) -> None:
        """Encodes unknown pieces; a word and the ASCII marks after it are separate for both splits."""
        known, older, plain, words, marked = self.known, self.older, [], {}, []
        for p in new:
            if p in older:
                known[p] = older[p]
                continue
            stem = p.rstrip(MARKS)
            if not self._is_word(stem):
                plain.append(p)
                continue
            if stem in older:
                known[stem] = older[stem]
            elif stem not in known:
                words[stem] = None
            if stem != p:
                marked.append((p, stem))
        stems = list(words)
        for at in range(0, len(stems), WORDS):
            some = stems[at:at + WORDS]
            known.update(zip(some, self._words(some)))
        for p, stem in marked:
            known[p] = known[stem] + self._mark(p[len(stem):])
        known.update(zip(plain, self._library(plain)))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return list(self.encoded(texts))

    def encoded(self, texts: Sequence[str]) -> Iterator[bytes]:
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > GROUP:
                yield from self._part(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self._part(group)

    def _part(self, texts: Sequence[str]) -> list[bytes]:
        """Distinct pieces are looked up or learnt, and their ids copied to every place of theirs."""
        if self.kind == "whole":
            return self._library(texts)
        if len(self.known) > self.max_pieces:
            self.older, self.known = self.known, {}
        pieces, first = cut(texts)
        keys = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not self.lead:
            keys = [p.strip(SPACES) for p in keys]
        found = list(map(self.known.get, keys))
        new = [i for i, ids in enumerate(found) if ids is None]
        # The first word of a text has no space before it: it is like no other piece, so it is not kept.
        heads = [i for i in new if keys[i][0] not in INNER] if self.lead else []
        for i, ids in zip(heads, self._library([keys[i] for i in heads])):
            found[i] = ids
        new = [i for i in new if found[i] is None]
        self._learn([keys[i] for i in new])
        for i in new:
            found[i] = self.known[keys[i]]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        return _spread(b"".join(found), sizes, pieces.indices.to_numpy(), first)


def _spread(data: bytes, sizes: np.ndarray, codes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The ids of every text: `data` holds the ids of all distinct pieces, `codes` numbers the pieces in text order."""
    ids, own = np.frombuffer(data, ID), sizes[codes]
    ends = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
    place = np.arange(ends[-1])
    place += np.repeat((np.cumsum(sizes, dtype=np.int64) - sizes)[codes] - ends[:-1], own)
    out = ids[place].tobytes()
    bounds = (4 * ends[first]).tolist()
    return [out[low:high] for low, high in zip(bounds, bounds[1:])]


def _kind(tokenizer) -> str:
    """Whether the split keeps white space, drops it, or is one this module does not cut for."""
    conf = json.loads(tokenizer.to_str())
    split, normalizer = conf["pre_tokenizer"] or {}, conf["normalizer"]
    if split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and normalizer is None:
        return "keeps"
    steps = split.get("pretokenizers", [])
    if steps and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed":
        if "\\s" in steps[0]["pattern"].get("Regex", "") and normalizer and normalizer["type"] == "Sequence":
            if {n["type"] for n in normalizer["normalizers"]} <= {"NFC", "Replace", "Lowercase"}:
                return "drops"
    return "whole"


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str, max_pieces: int = 200_000) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, max_pieces)
    return _encoders[path]

"""Bounded helpers of the workers: an encoder that forgets, and word hashes of any text."""

import random

import numpy as np
import pytest

from tidegauge.llm import encoding, shingles
from tidegauge.llm.encoding import PieceEncoder
from tidegauge.llm.vocabularies import BYTE_BPE, WORD_BPE


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_an_encoder_that_forgets_gives_the_same_ids(path):
    rnd = random.Random(1)
    pieces = ["one", "Two,", "three\nfour", " ", "été", "x1", "...", "", "\t", "don't"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(900)]
    small, large = PieceEncoder(path, 40), PieceEncoder(path)
    assert small.encode(texts) == large.encode(texts)
    assert large.encode(texts[:50]) == [large.ids(t) for t in texts[:50]]
    assert len(small.known) < 600


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_an_encoder_learns_words_and_marks_apart(path):
    """A word is encoded once whatever marks follow it: the dictionary grows with their sum, not their product."""
    words = [a + b + c for a in ("ba", "Ké") for b in "aeiou" for c in ("n", "rt", "é")]
    marks = [a + b for a in ",.;:!?)" for b in ("", '"', "]")]
    text = "start " + " ".join(w + m for w in words for m in marks)
    enc = PieceEncoder(path)
    assert enc.encode([text]) == [enc.ids(text)]
    assert len(enc.known) <= len(words) + len(marks) + 1


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_an_encoder_cuts_only_where_the_vocabulary_does(path, monkeypatch):
    """White space of every kind, letters that change under NFC or in lower case, marks, and strings of special tokens."""
    odd = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u180e", "\u2028", "\u200b",
           "\u202f", "\u205f", "\u1680", "\u3000", "\u2014", "\u201c", "\xab", "\xd7", "\xf7", "a", "Ab", "été", "É", "don't",
           "'s", "'", "İ", "Σ", "ΟΔΟΣ", "x1", "12", "...", "<", "\u0338", "e\u0301", "\ufb1d", "\u0958", "日本", "</w>", "Ġ",
           "<|endoftext|>", "<|startoftext|>", "\U0001f600", "ß", "ſ", "\u212a", "\x00", "_", "word,", "(x)", "Привет,"]
    rnd, enc = random.Random(3), PieceEncoder(path, 300)
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    whole = [enc.ids(t) for t in texts]
    for group in (1 << 22, 5000, 1):
        monkeypatch.setattr(encoding, "GROUP", group)
        assert enc.encode(texts) == whole
    pieces, first = encoding.cut(texts)
    flat = pieces.to_pylist()
    assert ["".join(flat[low:high]) for low, high in zip(first, first[1:])] == texts


def test_word_hashes_tell_words_apart(monkeypatch):
    """White space of every kind, blocks of a few bytes, words longer than the table of powers, and other bytes."""
    rnd, seen = random.Random(2), {}
    texts = [bytes(rnd.choice(b"ab \t\n\r\x0b\x0c\xc3\x00\x1c") for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    texts.append(b" ".join(bytes([c]) * n for c in b"xy" for n in (4095, 4096, 4097, 9000)) * 2)
    for block in (7, 1 << 20):
        monkeypatch.setattr(shingles, "BLOCK", block)
        for text in texts:
            words, hashes = text.split(), shingles.word_hashes(text)
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes.tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert (shingles.word_hashes(b" one  two") == shingles.word_hashes(b"one two ")).all()
    assert np.array_equal(shingles.shingle_set(b"A b a B", 2), np.unique(shingles.runs(shingles.word_hashes(b"a b a b"), 2)))

"""Pieces of ASCII texts are found by another pattern, and are the same."""

import random

import regex

from tidelane.llm import bpe


def test_pieces_of_ascii_texts_are_those_of_the_pattern():
    pieces = bpe.codec(bpe.default_tokenizer()).pieces
    whole = regex.compile(bpe.PATTERN).findall
    rng = random.Random(3)
    texts = [a + b + c for a in map(chr, range(128)) for b in map(chr, range(128)) for c in ("", "x", " ", "\n", "7", "\x1c")]
    texts += ["".join(rng.choice("a Z9'\t\n\r\x0b\x0c\x1c\x1f_.lsvred") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert all(pieces(t) == whole(t) for t in texts)
    assert regex.compile(bpe.ASCII_PATTERN).findall("it's  2 go\n") == whole("it's  2 go\n")

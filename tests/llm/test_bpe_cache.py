"""The word caches of operator 1."""

from __future__ import annotations

from itertools import product

from intake.llm import bpe
from intake.llm.queries import tokenizer_path


def test_words_of_a_task_are_merged_once():
    """120,000 distinct words, read twice, are merged once each."""
    words = ["".join(w) for w in product("abcdefghijklmnopqrst", repeat=4)][:120_000]
    coder, merged = bpe.WordBpe(tokenizer_path()), []
    coder.words.make = lambda w: merged.append(w) or coder.merge(w)
    assert coder.encode(" ".join(words)) == coder.encode(" ".join(words))
    assert len(merged) == len(words)

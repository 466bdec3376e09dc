"""Words of a batch are encoded side by side; what lies far inside a word is encoded one edge after another."""

import random

import numpy as np
import public_tokenizers
import pytest

from lotwise.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(5)
    letters = "aaabcdeeefghiijklmnooprsttuvwz'.,-=_09"
    words = ["".join(rng.choices(letters, k=rng.choice([1, 2, 5, 9, 63, 64, 65, 66, 300]))) for _ in range(500)]
    return [" ".join(rng.choices(words, k=40)) for _ in range(30)] + ["", " ", "  a  b", "x" * 500, "語 ünï 🙂 ", "a\nb\tc"]


@pytest.mark.parametrize(("abreast", "indexed"), [(64, 2_000_000), (64, 70), (3, 2_000_000), (3, 50)])
def test_encodings_are_the_librarys(monkeypatch, abreast, indexed):
    import sentencepiece

    monkeypatch.setattr(pieces, "ABREAST", abreast)
    monkeypatch.setattr(pieces, "INDEXED", indexed)
    own, model = pieces.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts())]
    assert got == [model.encode(t) for t in texts()]


def test_short_words_are_never_relaxed_one_by_one(monkeypatch):
    own = pieces.Pieces(PATH)
    monkeypatch.setattr(own, "stay_apart", None)  # asked for single edges only
    words = [f"{a}{b}er" for a in "abcdefgh" for b in "klmnop"]
    assert own.decode(own.encode([" ".join(words)])[0]) == " ".join(words)

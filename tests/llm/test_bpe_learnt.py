"""Which pieces are encoded anew, and ids of random texts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import bpe

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_at_hand_are_not_encoded_again_when_room_is_made(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 60)
    b, learnt = bpe.Bpe(WORDS), []
    learn = b.learn
    b.learn = lambda pieces: learnt.extend(pieces) or learn(pieces)
    common = " ".join(f"word{c}" for c in "abcdefghijklmnopqrst")
    for k in range(30):
        b.encode([common + " " + " ".join(f"rare{chr(97 + k % 26)}{'xyz'[k % 3]}{chr(97 + j)}" for j in range(20))])
        assert len(b.known) <= 60
    assert sum(p.startswith("word") for p in learnt) == 20


def test_pairs_have_the_ranks_of_the_merges():
    for path in (WORDS, BYTES):
        b = bpe.Bpe(path)
        pairs = np.array(list(b.by_pair), np.int64)
        assert b.rank(pairs >> 20, pairs & 0xFFFFF).tolist() == list(b.by_pair.values())
        rng = np.random.default_rng(1)
        x, y = rng.integers(0, len(b.bytes), (2, 100_000))
        assert b.rank(x, y).tolist() == [b.by_pair.get(k, bpe.NONE) for k in (x << 20 | y).tolist()]


def test_random_texts_equal_the_library():
    rng = random.Random(1)
    bits = ["the", "Ing", "don't", "'LL", "''s", "é", "É", "ß", "é", "Σ", "日本", "٣", "12", "½", "!!", "#", "_", "a" * 60, "xq" * 20, "<|endoftext|>", "<|start"]
    space = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​", "\r\n", ""]
    texts = ["".join(rng.choice(bits) + rng.choice(space) for _ in range(rng.randint(0, 30))) + rng.choice(space) * rng.randint(0, 4) for _ in range(1500)]
    texts += ["word" + " \n" * 500_000, " " * 100_000 + "x"]
    for path in (WORDS, BYTES):
        b, t = bpe.Bpe(path), Tokenizer.from_file(path)
        for text, ids in zip(texts, b.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:200]

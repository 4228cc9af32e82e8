"""Findings of round 2 on the operators."""

import random

from quadloom.llm import packing
from quadloom.llm.common import vocabulary_path


def test_words_are_looked_up_without_the_whole_tokenizer():
    """op1_packing's time: a new word costs the model's merges alone, and the ids are the library's for whole texts."""
    t = packing.WordTokenizer(vocabulary_path("word_bpe_49k.json"))
    r = random.Random(5)
    letters = "aAbBzZ'’.,-–—\"!?019 \t\n\xa0éÉßñÑøüœŒžŞşǅɏ€•…sStTrReEvVmMlLdD\xad¼²ªº×÷"
    texts = ["", " ", "it's", "x''s", "ab1", "1ab", "'", "''", "a,b", "Ünïcode…", "They'LL 'd'd"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += [x for c in map(chr, range(0x20, 0x250)) if not t.PLAIN.search(c) for x in (c, "a" + c, c + "a", "'" + c, "a'" + c + "s", c * 3)]
    want = [t._whole(x) for x in texts]
    whole, t.full = t.full, None  # not asked for words of plain characters
    plain = [(x, w) for x, w in zip(texts, want) if not t.PLAIN.search(x)]
    for size in (packing.MEMORY, 3):  # stores that turn all the time as well
        old, packing.MEMORY = packing.MEMORY, size
        try:
            assert all(t.encode(x) == w for x, w in plain)
        finally:
            packing.MEMORY = old
    assert len(t.known) <= 50 and len(plain) > 2000
    t.full = whole
    assert t.encode("a ʰ 漢字 <|endoftext|>") == t._whole("a ʰ 漢字 <|endoftext|>")

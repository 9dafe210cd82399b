"""Hashes of words and shingles: equal for equal words, unequal for patterns that repeat themselves."""

import random

from reelspan.llm import shingling


def thue_morse(n, a, b):
    return bytes((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_regular_words_do_not_collide():
    words = [thue_morse(n, *p) for n in (256, 2048, 65536) for p in ((97, 98), (98, 97))] + [b"ab" * 500, b"ba" * 500, b"a" * 1000, b"a" * 1001, b"\x00", b"\x00\x00", b"b", b"aa"]
    hashes = [int(shingling.word_hashes(w)[1][0]) for w in words]
    assert len(set(hashes)) == len(words)


def test_words_and_starts_are_those_of_a_plain_split():
    rng = random.Random(2)
    for _ in range(200):
        data = b"".join(rng.choice([b"a", b"bc", "é".encode(), b" ", b"\n\t", b"\x0b", b"\x1c", b"\xa0"]) for _ in range(rng.randrange(0, 60)))
        starts, hashes = shingling.word_hashes(data)
        words = data.split()
        assert len(starts) == len(words) and all(data[s : s + len(w)] == w for s, w in zip(starts, words, strict=True))
        assert all((h1 == h2) == (w1 == w2) for h1, w1 in zip(hashes, words, strict=True) for h2, w2 in zip(hashes, words, strict=True))
    long = b"x" * 700_000 + b" y " + b"x" * 700_000
    _, hashes = shingling.word_hashes(long)  # words across stretches
    assert len(hashes) == 3 and hashes[0] == hashes[2] != hashes[1]


def test_shingles_of_stretches_and_batches_are_the_same():
    rng = random.Random(3)
    bodies = [" ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))).encode() for _ in range(50)]
    alone = [shingling.shingle_sets([b], 4)[0].tolist() for b in bodies]
    assert [s.tolist() for s in shingling.shingle_sets(bodies, 4)] == alone
    for body, got in zip(bodies, alone, strict=True):
        words = body.split()
        want = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())
        assert len(got) == len(want)

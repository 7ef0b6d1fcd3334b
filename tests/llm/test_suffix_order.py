"""Suffixes are ordered by sorting numbers with their places in them, and by counting what is smaller in each sample."""

import numpy as np

from sheaf.llm import suffixes


def test_places_and_names_as_of_sorted_numbers():
    rng = np.random.default_rng(7)
    for most in (1, 3, 1 << 20, 1 << 62):  # the last ones leave no room for places
        for n in (0, 1, 500):
            x = rng.integers(0, most, n)
            assert suffixes._order(x).tolist() == np.argsort(x, kind="stable").tolist()
            _, first, rank = np.unique(x, return_index=True, return_inverse=True)
            got = suffixes._named(x)
            assert got[0].tolist() == first.tolist() and got[1].tolist() == rank.tolist()


def test_triples_of_long_numbers_keep_their_order():
    rng = np.random.default_rng(8)
    for most in (1 << 10, 1 << 21, 1 << 30):
        some = rng.integers(0, most, 6)
        a, b, c = (some[rng.integers(0, 6, 400)] for _ in range(3))
        triples = list(zip(a.tolist(), b.tolist(), c.tolist()))
        of = {t: k for k, t in enumerate(sorted(set(triples)))}
        first, rank = suffixes._triples(a, b, c)
        assert rank.tolist() == [of[t] for t in triples]
        assert first.tolist() == [triples.index(t) for t in sorted(of)]


def test_ranks_follow_the_strings_of_pieces():
    rng = np.random.default_rng(9)
    for _ in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 8))):
            piece = rng.integers(1, rng.choice([2, 3, 5, 257]), int(rng.integers(1, 60)))
            piece = np.tile(piece[:3], 20) if rng.random() < 0.5 else piece
            parts += [piece, [0], piece[: int(rng.integers(1, len(piece) + 1))], [0]]
        s = np.concatenate(parts).astype(np.int64)
        for depth in (3, 10, 100):
            padded = s.tolist() + [0] * depth
            order = sorted(range(len(s)), key=suffixes.ranks(s.copy(), depth)[: len(s)].tolist().__getitem__)
            strings = [padded[i : i + depth] for i in order]
            assert strings == sorted(strings)

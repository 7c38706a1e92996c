import numpy as np

from harborline.llm import token_model


def test_places_of_different_numbers():
    r = np.random.default_rng(1)
    for bits in (3, 32, 63):  # with 63 no place fits beside the number
        for n in (0, 1, 2, 500):
            values = r.integers(0, 1 << bits, n, np.uint64)
            found, at = token_model._different(values, bits)
            want, places = np.unique(values, return_inverse=True)
            assert found.tolist() == want.tolist() and at.tolist() == places.tolist()


def test_trigrams_are_in_the_order_in_which_they_are_asked_for():
    r = np.random.default_rng(2)
    w, length = r.integers(0, 6, 400).astype("<u2"), np.array([1, 2, 3, 94, 300], np.int32)
    g = token_model._Grams(token_model._pack(w), length)
    at, context, v, w, before = g.different(7)
    g.ask(False, 7)
    keys = g.keys.view(np.int64)
    assert (keys[at] == (g.u.astype(np.int64) << 32 | g.v.astype(np.int64) << 16 | g.w)).all()
    assert (v == keys >> 16 & 0xFFFF).all() and (w == keys & 0xFFFF).all() and (np.bincount(at) == g.n).all()
    assert (np.diff(context) == (np.diff(keys >> 16) != 0)).all()
    pairs = g.ask(True, 7).keys.view(np.int64) >> 16
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    assert (pairs[before] == (v << 16 | w)).all()

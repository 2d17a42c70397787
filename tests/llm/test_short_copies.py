import numpy as np

from vigil.llm.order_minhash import PICKS, shingle_items, sketch, word_hashes


def test_four_shingles_against_five_always_share_a_value():
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 2 ** 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    missed = 0
    for _ in range(10_000):
        words = [f"w{x}" for x in rng.integers(0, 10 ** 6, 9)]
        for cut in (words[1:], words[:-1]):
            a, b = (sketch(*shingle_items(word_hashes(" ".join(w))), factors, PICKS) for w in (words, cut))
            assert len(a) == len(b) and (a == b).any()
            missed += not (a[:32] == b[:32]).any()
    assert missed        # the 32 hashes alone miss some

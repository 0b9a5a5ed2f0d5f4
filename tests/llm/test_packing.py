"""Packing: the search within a block and the cutting of texts."""

import random
import time

import numpy as np

from threadloom.llm import packing
from threadloom.llm.tokens import encoder, widths


def tight(seed, slack, capacity=2048, n=7700):
    """Sizes spread like those of real texts, whose sum lacks ``slack`` of a number of full bins."""
    spread = np.interp(np.random.default_rng(seed).random(n), [0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1], [2, 13, 19, 29, 73, 186, 505, 1494, 2047, 2048])
    sizes = sorted(spread.astype(int).tolist(), reverse=True)
    extra = (sum(sizes) + slack) % capacity
    for i in (i for i, s in enumerate(sizes) if 200 < s < 1500):
        less = min(extra, sizes[i] - 100)
        sizes[i] -= less
        extra -= less
    return sizes


def test_a_search_with_hardly_any_room_takes_little_time():
    for seed, slack in SLOW:
        sizes = tight(seed, slack)
        began = time.process_time()
        bins = packing.pack(sizes, 2048)
        assert time.process_time() - began < 5
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert len(bins) <= -(-sum(sizes) // 2048) + 1


SLOW = ((7, 100), (4, 150), (6, 500), (7, 500))


def test_bins_that_can_be_full_are_full():
    """30 bins cut into four to eight items each; best fit alone takes 31."""
    for seed in (2, 3):
        r = random.Random(seed)
        sizes = []
        for _ in range(30):
            cuts = sorted(r.sample(range(1, 1000), r.randint(4, 8) - 1))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 1000])]
        assert len(packing.best_fit(sizes, 1000)) == 31 and len(packing.pack(sizes, 1000)) == 30


def test_fullest_against_all_choices():
    r = random.Random(4)
    for _ in range(200):
        sizes = [r.randint(0, 30) for _ in range(r.randint(0, 9))]
        most = r.randint(0, 60)
        got = packing.fullest(sizes, most)
        sums = (sum(s for i, s in enumerate(sizes) if k >> i & 1) for k in range(1 << len(sizes)))
        assert len(set(got)) == len(got) and sum(sizes[i] for i in got) == max(s for s in sums if s <= most)


def test_items_without_tokens_and_too_large_ones():
    sizes, a, others = [0, 0, 5], [0, 1], [[2]]
    assert packing.emptied(a, others, {0: 5}, sizes, 10) and a == [] and sorted(others[0]) == [0, 1, 2]
    bins = packing.pack([70, 0, 20, 150, 60, 20], 100)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 3 and [3] in bins


class Counting:
    """The tokenizer, with what it was asked to encode."""

    def __init__(self):
        self.asked = []

    def encode_ordinary(self, text):
        self.asked.append(text)
        return encoder().encode_ordinary(text)


def test_pieces_between_words_are_not_encoded_again():
    text = "The build ran and the lease expired. Die Prüfung läuft über Nacht,\nall of it. " * 60
    ids, enc = encoder().encode_ordinary(text), Counting()
    got = packing.split_text(text, ids, 100, enc, widths())
    assert len(got) > 10 and len(enc.asked) <= 1  # the space at the end stays by itself
    assert [n for _, _, n in got] == [len(encoder().encode_ordinary(text[a:b])) for a, b, _ in got]


def test_pieces_are_counted_as_they_stand():
    r = random.Random(5)
    parts = [" ", "  ", "\n\n", " \n", "\t", "a", "word", "Ünïcode", "中文", "!?", "\x1c", "\x85", "\xa0", "　", "\r\n", "'s", "'", "123", "😀", "    "]
    for _ in range(200):
        text = "".join(r.choice(parts) for _ in range(120))
        ids = encoder().encode_ordinary(text)
        for capacity in (8, 30):
            got = packing.split_text(text, ids, capacity, encoder(), widths())
            assert "".join(text[a:b] for a, b, _ in got) == text
            assert all(n == len(encoder().encode_ordinary(text[a:b])) <= capacity for a, b, n in got)

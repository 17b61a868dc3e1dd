"""The packing state machine, on hand-made samples."""

from itertools import repeat

from spindle.plans.pack import Limits, pack_samples

FREE = {"a": 1.0}


def packed(sizes, limits, weights=None, mandatory=(), samples=None, draws=None):
    samples = samples or {"a": [(i, n, 0) for i, n in enumerate(sizes)]}
    return [[(g, k) for g, k, _ in s] for s in pack_samples(samples, weights or FREE, set(mandatory), draws or repeat(0.0), limits)]


def test_exact_fit_emits():
    assert packed([4, 6, 10], Limits(10, 10, 10, 0, 0)) == [[("a", 0), ("a", 1)], [("a", 2)]]


def test_overflow_goes_to_the_buffer_and_comes_back_first():
    got = packed([6, 7, 4, 3, 9], Limits(10, 10, 10, 5, 2))
    assert got == [[("a", 0), ("a", 2)], [("a", 1), ("a", 3)]]


def test_full_buffer_emits_and_drops_or_carries():
    assert packed([6, 7, 9], Limits(10, 10, 10, 0, 0, drop_on_overflow=True, keep_partial=True)) == [[("a", 0)], [("a", 2)]]
    assert packed([6, 7, 9], Limits(10, 10, 10, 0, 0, keep_partial=True)) == [[("a", 0)], [("a", 1)], [("a", 2)]]


def test_long_samples_are_skipped():
    assert packed([11, 10], Limits(10, 10, 12, 0, 5)) == [[("a", 1)]]


def test_each_item_costs_two_marks():
    assert packed(None, Limits(10, 10, 10, 0, 0), samples={"a": [(0, 6, 2), (1, 8, 1)]}) == [[("a", 0)], [("a", 1)]]


def test_mandatory_group_starts_every_sequence():
    samples = {"a": [(0, 6, 0), (1, 6, 0)], "m": [(10, 4, 0), (11, 10, 0), (12, 4, 0)]}
    got = packed(None, Limits(10, 10, 10, 0, 5), weights={"a": 1.0, "m": 0.0}, mandatory=("m",), samples=samples)
    assert got == [[("m", 10), ("a", 0)], [("m", 12), ("a", 1)]]  # 11 is not below the limit


def test_partial_sequence_is_kept_only_on_request():
    assert packed([3], Limits(10, 10, 10, 0, 0)) == []
    assert packed([3], Limits(10, 10, 10, 0, 0, keep_partial=True)) == [[("a", 0)]]


def test_one_draw_for_a_sequence():
    draws = iter([0.9, 0.1, 0.9, 0.1, 0.1])
    samples = {"a": [(0, 10, 0), (1, 10, 0)], "b": [(2, 5, 0), (3, 5, 0)]}
    assert packed(None, Limits(10, 10, 10, 0, 0), weights={"a": 1.0, "b": 1.0}, samples=samples, draws=draws) == [[("b", 2), ("b", 3)], [("a", 0)]]


def test_empty():
    assert packed([], Limits()) == []
    assert list(pack_samples({}, {}, set(), repeat(0.0), Limits())) == []

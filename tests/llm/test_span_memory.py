"""Hashes of spans need memory for some values, not for all."""

import tracemalloc

import numpy as np

from facetflow.llm import common


def test_turns_change_no_hash_and_bound_memory():
    rng = np.random.default_rng(3)
    cuts = np.unique(rng.integers(0, 3_000_000, 20_000))
    values = rng.integers(0, 256, 3_000_000).astype(np.uint8)
    starts, ends = cuts[:-1], cuts[1:]
    values[starts[5] : ends[5]] = 7  # the same span at both ends, in different turns
    n = int(ends[5] - starts[5])
    starts, ends = np.append(starts, 2_999_999 - n), np.append(ends, 2_999_999)
    values[2_999_999 - n : 2_999_999] = 7
    common._POWERS.clear()
    tracemalloc.start()
    found = common.span_hashes(values, starts, ends)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3_000_000 * 8  # before: over 30 bytes a value, and powers that stayed for as many
    assert sum(p.nbytes for p in common._POWERS) < 16_000_000
    assert found[5] == found[-1]
    assert (found == common._near_hashes(values, starts, ends)).all()
    order = rng.permutation(len(starts))
    assert (common.span_hashes(values, starts[order], ends[order]) == found[order]).all()


def test_spans_longer_than_a_turn_empty_ones_and_none():
    values = np.arange(common.SPAN_VALUES * 3, dtype=np.uint64) % np.uint64(11)
    starts = np.array([0, 0, 5, 11, 11, common.SPAN_VALUES * 2])
    ends = np.array([0, 7, common.SPAN_VALUES * 2, common.SPAN_VALUES * 2 + 6, common.SPAN_VALUES * 3, common.SPAN_VALUES * 3])
    assert (common.span_hashes(values, starts, ends) == common._near_hashes(values, starts, ends)).all()
    nested = np.array([3, 4]), np.array([common.SPAN_VALUES * 2, 9])
    assert (common.span_hashes(values, *nested) == common._near_hashes(values, *nested)).all()
    none = np.zeros(0, dtype=np.int64)
    assert len(common.span_hashes(values, none, none)) == 0

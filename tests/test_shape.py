import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridloom.functions import shape as sh
from gridloom.plans import partition
from gridloom.plans.config import TileQuery

SHAPES = st.lists(st.integers(1, 6), min_size=1, max_size=4).map(tuple)


@given(SHAPES, st.data())
def test_inflate_is_the_inverse_of_flatten(shape, data):
    n = data.draw(st.integers(0, sh.size(shape) - 1))
    assert sh.flatten(shape, sh.inflate(shape, n)) == n


def test_strides_and_sizes():
    assert sh.strides((8, 6, 10, 4)) == (240, 40, 4, 1)
    assert sh.flatten((8, 6, 10, 4), (1, 1, 1, 1)) == 285
    assert sh.size((80, 180, 360, 50)) == 259_200_000
    assert sh.byte_size((2, 3), 4) == 24
    assert sh.grid((8, 6, 10, 4), (3, 4, 4, 3)) == (3, 2, 3, 2)
    with pytest.raises(ValueError):
        sh.strides((3, -1))
    with pytest.raises(ValueError):
        sh.flatten((3, 4), (1,))


def cells_of(rectangles):
    out = []
    for corner, shape in rectangles:
        own = [()]
        for c, s in zip(corner, shape, strict=True):
            own = [(*x, c + i) for x in own for i in range(s)]
        out += own
    return out


@given(SHAPES, st.integers(1, 9))
def test_records_are_covered_once(shape, step):
    got = cells_of(partition.by_records(shape, step))
    assert sorted(got) == sorted(sh.inflate(shape, i) for i in range(sh.size(shape)))


@given(SHAPES, st.integers(0, 40), st.integers(4, 64))
def test_blocks_are_covered_once_and_in_order(shape, begin, block):
    found = list(partition.by_blocks(shape, begin, 4, block))
    assert cells_of(r for _, r in found) == [sh.inflate(shape, i) for i in range(sh.size(shape))]
    for number, r in found:
        first = begin + 4 * sh.flatten(shape, r[0])
        assert first // block == number
        assert (first + 4 * (sh.size(r[1]) - 1)) // block == number


def test_worked_example_of_block_rectangles():
    assert [r for _, r in partition.by_blocks((3, 4), 0, 4, 24)] == [((0, 0), (1, 4)), ((1, 0), (1, 2)), ((1, 2), (1, 2)), ((2, 0), (1, 4))]


def test_last_rectangle_is_clamped():
    assert list(partition.by_records((7, 2), 3)) == [((0, 0), (3, 2)), ((3, 0), (3, 2)), ((6, 0), (1, 2))]
    assert partition.record_step("proportional", (10, 2), 4, first_extraction=20) == 20
    assert list(partition.by_records((10, 2), 20)) == [((0, 0), (10, 2))]
    assert list(partition.by_records((7, 2), 3, 4, 100)) == [((4, 0), (2, 2)), ((6, 0), (1, 2))]
    assert list(partition.by_blocks((3, 1, 1), 0, 4, 8)) == [(0, ((0, 0, 0), (2, 1, 1))), (1, ((2, 0, 0), (1, 1, 1)))]


def test_eight_splits_cover_five_records():
    splits = [((0, 0, 0, 0), (2, 360, 360, 50)), ((2, 0, 0, 0), (1, 212, 360, 50)), ((2, 212, 0, 0), (1, 1, 5, 50)), ((2, 212, 5, 0), (1, 1, 1, 45)), ((2, 212, 5, 45), (1, 1, 1, 5)), ((2, 212, 6, 0), (1, 1, 354, 50)), ((2, 213, 0, 0), (1, 147, 360, 50)), ((3, 0, 0, 0), (2, 360, 360, 50))]
    at = 0
    for corner, shape in splits:  # each is a run of cells that begins where the one before ends
        assert sh.flatten((10, 360, 360, 50), corner) == at
        at += sh.size(shape)
    assert at == 5 * 360 * 360 * 50


def test_settings_from_strings():
    q = TileQuery.from_conf({"some.prefix.variable_name": "wind", "low_filter": "3", "high_filter": "9", "extraction_shape": "1,36,36,10", "operator": "simpleMax", "partition_mode": "Odd", "noscan": "TRUE", "query_dependant": "no", "number_reducers": "x", "multi_file_mode": "?", "unknown": "1"})
    assert (q.variable, q.low, q.high, q.extraction_shape, q.operator) == ("wind", 3, 9, (1, 36, 36, 10), "simplemax")
    assert (q.partition_mode, q.noscan, q.query_dependent, q.num_partitions, q.multi_file_mode) == ("proportional", True, False, 1, "combine")
    assert TileQuery() == TileQuery.from_conf({})
    with pytest.raises(ValueError):
        TileQuery(extraction_shape=(0, 1))

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import intervals as iv
from tessera.functions.moments import query_id, seed_of

box1 = st.tuples(st.integers(0, 8), st.integers(0, 8)).map(lambda x: (min(x), max(x)))
box2 = st.fixed_dictionaries({"a": box1, "b": box1})


def cells(box):
    return {(x, y) for x in range(box["a"][0], box["a"][1] + 1) for y in range(box["b"][0], box["b"][1] + 1)}


def test_interval_algebra_goldens():
    assert iv.intersects({"a": (1, 4)}, {"a": (4, 9)})
    assert iv.covers({"a": (1, 4)}, {"a": (2, 3)}) and not iv.covers({"a": (2, 3)}, {"a": (1, 4)})
    assert not iv.covers({"a": (0, 9)}, {"a": (1, 2), "b": (1, 2)}) and not iv.covers({"a": (0, 9), "b": (0, 9)}, {"a": (1, 2)})
    assert iv.intersects({"a": (0, 9)}, {"a": (1, 2), "b": (1, 2)})
    assert [iv.relation({"a": q}, {"a": (3, 5)}) for q in ((6, 7), (3, 5), (4, 4), (4, 9))] == [-2, -1, 1, 2]


@settings(max_examples=200, deadline=None)
@given(box2, box2)
def test_difference_is_disjoint_and_whole(outer, inner):
    parts = iv.difference(outer, inner)
    seen = [c for p in parts for c in cells(p)]
    assert len(seen) == len(set(seen))
    assert set(seen) == cells(outer) - cells(inner)


@settings(max_examples=100, deadline=None)
@given(box2, box2)
def test_meet_and_cover(a, b):
    both = iv.meet(a, b)
    assert (both is None) == (not cells(a) & cells(b))
    if both:
        assert cells(both) == cells(a) & cells(b)
    assert iv.covers(a, b) == (cells(b) <= cells(a))


def test_covering_box():
    nodes = [{"a": (0, 4)}, {"a": (5, 9)}, {"a": (20, 30)}]
    assert iv.covering_box({"a": (3, 6)}, nodes) == {"a": (0, 9)}
    assert iv.covering_box({"a": (12, 13)}, nodes) == {"a": (12, 13)}


def test_ids_and_sql():
    assert query_id({"b": (1, 2), "a": (3, 4)}) == query_id({"a": (3, 4), "b": (1, 2)})
    assert 0 <= seed_of(query_id({"a": (1, 2)})) < 16**6
    assert iv.to_sql({"b": (1, 2), "a": (3, 4)}, "x", "taxi") == "SELECT SUM(x) FROM taxi WHERE a >= 3 AND a <= 4 AND b >= 1 AND b <= 2"

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions.intervals import Interval, encode, from_order_key, order_key
from tessella.functions.query import Query, matches
from tessella.functions.schema import BINARY, EQUALITY, FLOAT, INT, UINT, VARBINARY, Attr, Schema
from tessella.operators.binning import RangeCuts, bin_budget, bin_of, equality_bins, range_bins
from tessella.operators.index import Part, _Plan

A0, A1 = Attr("a0", physical=INT), Attr("a1", EQUALITY, VARBINARY, 0)
SCHEMA = Schema((A0, A1), 0.1)


def test_order_keys_keep_order_and_round_trip():
    rnd = random.Random(1)
    for attr, values in ((A0, [-(1 << 63), -5, 0, 7, (1 << 63) - 1]), (Attr("u", physical=UINT), [0, 1, (1 << 64) - 1]), (Attr("f", physical=FLOAT), [-math.inf, -1e300, -5e-324, 0.0, 5e-324, 1.5, math.inf])):
        values = values + [rnd.randint(0, 1000) if attr.physical != FLOAT else rnd.uniform(-1e6, 1e6) for _ in range(50)]
        assert sorted(values) == sorted(values, key=lambda v: order_key(attr, v))
        assert all(from_order_key(attr, order_key(attr, v)) == v for v in values)
    assert order_key(Attr("f", physical=FLOAT), -0.0) == order_key(Attr("f", physical=FLOAT), 0.0)


def test_interval_algebra():
    a, b = Interval.of(">=", b"b"), Interval.of("<", b"d")
    assert a.meet(b) == Interval(b"b", b"d", False, True)
    assert Interval.of(">", b"b").meet(a).low_open
    assert Interval.of("<", b"").empty and a.meet(Interval.of("<", b"b")).empty
    assert Interval.of("<=", b"b").meets(b"b", b"z") and not b.meets(b"d", b"z")


def test_encoding_merges_and_finds_contradictions():
    e = encode(Query.of(("a0", ">", 5), ("a0", ">", 9), ("a1", "=", "x")), SCHEMA)
    assert len(e.clauses) == 2 and not e.unsat
    assert encode(Query.of(("a0", ">", 5), ("a0", "<", 3)), SCHEMA).unsat
    assert len(encode(Query.of([("a0", "=", 1), ("a0", "=", 2)]), SCHEMA).clauses[0]) == 2
    assert encode(Query.of(("f", "=", math.nan)), Schema((Attr("f", physical=FLOAT),))).unsat


@pytest.mark.parametrize("bad", [Query(((),)), Query.of(("a1", "<", "x")), Query.of(("a0", "=", "x")), Query.of(("a0", "=", 1.0)), Query.of((7, "=", 1)), Query.of(("a0", "!=", 1))])
def test_validation(bad):
    with pytest.raises(ValueError):
        bad.validate(SCHEMA)


def test_schema_refuses():
    for kw in ({"physical": INT, "width": 3}, {"physical": BINARY, "width": 0}, {"physical": VARBINARY, "width": 4}, {"index": "hash"}):
        with pytest.raises(ValueError):
            Attr("x", **kw)
    with pytest.raises(ValueError):
        A0.check_value(None)
    with pytest.raises(ValueError):
        Attr("x", physical=INT, width=1).check_value(300)


def test_bin_budget_examples():
    assert bin_budget([2000, 100], 0.1) == [10, 10]
    assert bin_budget([1, 15], 0.1) == [1, 15]
    assert bin_budget([1000], 0.01) == [100]
    assert bin_budget([2, 2], 0.5) == [2, 2]


def test_range_bins():
    keys = [order_key(A0, i) for i in range(2000)]
    cuts, counts = range_bins([(k, 1) for k in keys], 10)
    assert counts == [200] * 10 and set(cuts) <= set(keys) and cuts[0] == keys[0] and cuts[-1] == keys[-1]
    zero, one, two = (order_key(A0, i) for i in range(3))
    assert range_bins([(zero, 1), (one, 1), (two, 100)], 3) == ([zero, two, two, two], [2, 0, 100])
    assert range_bins([(zero, 50), (one, 150)], 2)[1] == [50, 150]
    assert range_bins([(zero, 10), (one, 100), (two, 190)], 3) == ([zero, one, two, two], [10, 100, 190])  # a heavy value takes no lighter one along
    shares = [6, 70, 12, 5, 3, 2, 2]
    assert range_bins([(order_key(A0, i), 60 * n) for i, n in enumerate(shares)], 7)[1] == [60 * n for n in shares]


def _swept(masses, bins):
    """One value after the other: a bin ends before a value that alone reaches the share of the bins still open, or when its mass is at
    least as near to that share without the value as with it."""
    counts, left, mass, open_bins = [], sum(masses), 0, bins
    for n in masses:
        share = left / open_bins
        if mass and open_bins > 1 and (n >= share or abs(mass - share) <= abs(mass + n - share)):
            counts.append(mass)
            left, mass, open_bins = left - mass, 0, open_bins - 1
        mass += n
    return [*counts, mass]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 5), st.integers(1, 500)), min_size=1, max_size=60), st.integers(1, 20))
def test_range_bins_properties(masses, bins):
    runs = [(order_key(A0, 3 * i), n) for i, n in enumerate(masses)]
    cuts, counts = range_bins(runs, bins)
    assert len(cuts) == bins + 1 and len(counts) == bins and sum(counts) == sum(masses)
    assert cuts == sorted(cuts) and set(cuts) <= {k for k, _ in runs} and cuts[0] == runs[0][0] and cuts[-1] == runs[-1][0]
    again = [0] * bins
    for k, n in runs:
        again[bin_of(cuts, k)] += n
    assert counts == again  # a row's bin is found from the boundaries alone
    want = _swept(masses, bins)
    if len(want) == bins:
        assert counts == want
    else:  # what is left over repeats the largest value, whose rows stand in the last bin
        assert counts == [*want[:-1], want[-1] - masses[-1], *[0] * (bins - len(want) - 1), masses[-1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=60), st.integers(1, 20), st.integers(1, 9))
def test_range_bins_from_batches(masses, bins, step):
    runs = [(order_key(A0, i), n) for i, n in enumerate(masses)]
    found = RangeCuts(len(runs), sum(masses), bins)
    for i in range(0, len(runs), step):
        part = runs[i : i + step]
        found.add(lambda j, part=part: part[j][0], np.array([n for _, n in part]))
    assert found.done() == range_bins(runs, bins)


@pytest.mark.parametrize("attr", [Attr("f", physical=FLOAT), Attr("e", EQUALITY, INT), Attr("s", "range", VARBINARY, 0)])
def test_planning_holds_a_batch_and_the_bins(attr):
    """Half a million distinct values are planned in less memory than their keys alone take."""
    size, step = 500_000, 5_000
    plan, made = _Plan(Part("s", 0, 100, size, size), attr), []
    pa.array(np.arange(3)).to_pylist(), pa.array([1.5]).to_numpy()  # imports
    tracemalloc.start()
    for i in range(0, size, step):
        n = np.arange(i, i + step)
        columns = {"dbl": pa.array(n.astype(float)), "big": pa.array(n), "bin": pa.array([b"%07d" % x for x in n], pa.binary()), "text": pa.array(n).cast(pa.string()), "n": pa.array(np.ones(step, np.int64))}
        made.append(sum(b.num_rows for b in plan.add(pa.RecordBatch.from_pydict(columns))))
    last = [r for b in plan.done() for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000 and sum(made) == (size if attr.index == EQUALITY else 0)
    bins, summary = [r for r in last if r["kind"] == "bins"], last[-1]
    assert [r["n"] for r in bins] == [size // 100] * 100 and summary["n"] == summary["distinct"] == size and summary["keys"] is None
    at = (lambda i: b"%07d" % i) if attr.is_bytes else lambda i: order_key(attr, float(i) if attr.physical == FLOAT else i)
    assert (summary["low"], summary["high"]) == (at(0), at(size - 1)) and (attr.index == EQUALITY or [r["low"] for r in bins] == [at(5000 * i) for i in range(100)])


def test_equality_bins_balance():
    counts = [(bytes([i]), 20) for i in range(100)]
    bins = equality_bins(counts, 10)
    mass = [0] * 10
    for v, n in counts:
        mass[bins[v]] += n
    assert mass == [200] * 10


def test_query_text_and_row_evaluation():
    q = Query.of([("a0", "=", 2), ("a0", "=", 7)], ("a1", "=", "x"))
    assert str(q) == "(a0='2' OR a0='7') AND (a1='x')"
    assert matches(q, SCHEMA, {"a0": 7, "a1": b"x"}) and not matches(q, SCHEMA, {"a0": None, "a1": b"x"})

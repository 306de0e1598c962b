import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrove.llm import packing


def check(bins, sizes, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(b and sizes[b].sum() <= capacity for b in bins)
    return sum(int(sizes[b].sum()) ** 2 for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_search_never_lowers_the_squared_fill(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    first = packing.best_fit(sizes, 40)
    before = check(first, sizes, 40)
    after = packing.local_search([list(b) for b in first], sizes, 40)
    assert check(after, sizes, 40) >= before and len(after) <= len(first)


def improvements(bins, capacity):
    """Every move, one-for-one and two-for-one exchange between two underfull bins that fills the fuller one further, by trying all."""
    out = []
    load = [sum(b) for b in bins]
    for a, b in itertools.permutations(range(len(bins)), 2):
        if load[a] > load[b] or load[b] >= capacity or load[a] >= capacity:
            continue
        gives = [(x,) for x in set(bins[a])] + [(x, y) for i, x in enumerate(bins[a]) for y in bins[a][i + 1 :]]
        for g in gives:
            for back in [0, *set(bins[b])] if len(g) == 1 else set(bins[b]):
                if 0 < sum(g) - back <= capacity - load[b]:
                    out.append((a, b, g, back))
    return out


def optimum(sizes, capacity):
    """The least number of bins, over all packings."""
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for j in range(len(loads)):
            if loads[j] + sizes[i] <= capacity:
                place(i + 1, loads[:j] + [loads[j] + sizes[i]] + loads[j + 1 :])
        place(i + 1, loads + [sizes[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_small_sets_against_all_packings(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    bins = packing.local_search(packing.best_fit(sizes, 20), sizes, 20)
    assert improvements([sizes[b].tolist() for b in bins], 20) == []
    # best fit decreasing takes at most 11/9 of the optimum and one bin more
    assert len(bins) <= optimum(sizes.tolist(), 20) * 11 / 9 + 1


def test_swaps_empty_a_bin():
    # one for one, then a move: 6+3 and 5+4 and 2 into two bins of 10
    sizes = np.array([6, 3, 5, 4, 2])
    out = packing.local_search([[0, 1], [2, 3], [4]], sizes, 10)
    assert len(out) == 2
    # two for one: 3+3 for 5 fills the first bin
    sizes = np.array([4, 5, 3, 3])
    out = packing.local_search([[0, 1], [2, 3]], sizes, 10)
    assert sorted(int(sizes[b].sum()) for b in out) == [5, 10]


def test_every_token_has_its_place(spark, odd, none):
    rows = packing.pack(odd, 1000).toPandas()
    assert rows[rows.doc_id == 5].n_tokens.sum() == 60_000
    assert rows.doc_id.isna().sum() == 1 and (rows.doc_id == 1).sum() == 2
    assert not rows.doc_id.isin([2, 3, 4]).any()
    for _, g in rows.groupby("bin_id"):
        g = g.sort_values("bin_start")
        assert (g.bin_start + g.n_tokens <= 1000).all()
        assert list(g.bin_start) == list(np.cumsum([0, *g.n_tokens[:-1]]))
    assert packing.pack(none).count() == 0


def test_query_places_all_documents(spark, data):
    from quillgrove.llm import common

    texts = common.read(spark, data, "documents").select("doc_id", "text").toPandas()
    texts["n"] = texts.text.map(lambda t: len((t or "").split()))
    lengths = texts[texts.n > 0].groupby("doc_id").n.sum()
    rows = packing.op2_packing(spark, data).toPandas()
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == lengths.to_dict()
    bins = [g.tolist() for _, g in rows.groupby("bin_id").n_tokens]
    assert improvements(bins, packing.CAPACITY) == []
    fills = rows.groupby("bin_id").n_tokens.sum()
    assert fills.max() <= packing.CAPACITY and len(fills) <= np.ceil(lengths.sum() / packing.CAPACITY) + 2

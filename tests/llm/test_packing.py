import itertools
import random

from chunkloom.llm import packing

SCHEMA = "doc_id bigint, text string, container string"


def fewest(sizes, capacity):
    """Fewest containers, by trying every assignment of small inputs."""
    best = len(sizes)

    def go(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= sizes[i]:
                free[k] -= sizes[i]
                go(i + 1, free)
                free[k] += sizes[i]
        go(i + 1, [*free, capacity - sizes[i]])

    go(0, [])
    return best


def expand(fillings):
    return [f for f, k in fillings for _ in range(k)]


def test_bin_completion_is_optimal_on_small_inputs():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        bins = expand(packing.bin_completion(counts, 20))
        assert sorted(itertools.chain(*bins)) == sorted(sizes)
        assert all(sum(b) <= 20 for b in bins)
        assert len(bins) == fewest(sizes, 20)


def test_bin_completion_is_optimal_where_perfect_fillings_compete():
    sizes = [11, 12, 14, 14, 17, 17, 17, 18, 21, 21, 23, 26, 27]
    assert sum(k for _, k in packing.bin_completion({s: sizes.count(s) for s in sizes}, 60)) == 4
    rng = random.Random(8)
    for _ in range(400):
        capacity = rng.choice([20, 60, 100, 150])
        sizes = [rng.randint(capacity // 8, capacity // 2) for _ in range(rng.randint(5, 12))]
        bins = expand(packing.bin_completion({s: sizes.count(s) for s in sizes}, capacity))
        assert sorted(itertools.chain(*bins)) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
        assert len(bins) == fewest(sizes, capacity)


def test_completions_are_all_undominated_sums():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randint(2, 12) for _ in range(8)]
        counts, capacity = {s: sizes.count(s) for s in sizes}, 24
        largest = max(counts)
        rest = sorted(sizes, reverse=True)[1:]
        every = {tuple(c) for n in range(8) for c in itertools.combinations(rest, n) if sum(c) <= capacity - largest}
        left = counts | {largest: counts[largest] - 1}
        kinds = sorted((s for s, c in left.items() if c), reverse=True)
        want = {c for c in every if not packing._dominated(c, capacity - largest - sum(c), left, kinds)}
        got = list(packing.completions(counts, largest, capacity))
        assert {c for _, c in got} == want and len(got) == len(want)
        assert [w for w, _ in got] == sorted(w for w, _ in got)


def test_best_fit_and_bounds_agree_on_large_histograms():
    rng = random.Random(5)
    counts = {s: rng.randint(0, 10_000) for s in range(1, 1025)}
    fillings = packing.bin_completion(counts, 1024)
    held = {}
    for f, k in fillings:
        assert sum(f) <= 1024
        for s in f:
            held[s] = held.get(s, 0) + k
    assert held == {s: c for s, c in counts.items() if c}
    assert sum(k for _, k in fillings) >= packing.lower_bound(counts, 1024)


def test_pack_places_each_part_once(spark):
    rows = [(i, " ".join(["tree"] * (i % 37 + 1)), "x") for i in range(300)]
    rows += [(900, "lake " * 5000, "x"), (900, "lake " * 5000, "y"), (901, "", "x"), (902, None, "x"), (None, "tree", "x"), (903, "tree", None)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").toPandas()
    assert not got.duplicated(["doc_id", "part"]).any()
    assert set(got.doc_id) == {*range(300), 900, 903}
    assert (got.groupby("container").n_tokens.sum() <= packing.CAPACITY).all()
    assert set(got[got.n_parts > 1].doc_id) == {900}
    assert (got[got.container >= packing.FULL].n_tokens == packing.CAPACITY).all() and (got.container >= packing.FULL).sum() == (got.n_tokens == packing.CAPACITY).sum()
    big = got[got.doc_id == 900].sort_values("part")
    assert (big.first_token.to_numpy() == big.n_tokens.cumsum().to_numpy() - big.n_tokens.to_numpy()).all()
    assert got.container.nunique() == -(-got.n_tokens.sum() // packing.CAPACITY)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0

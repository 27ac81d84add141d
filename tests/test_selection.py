import random

from chunkloom.operators import selection

SCHEMA = "label bigint, fid bigint, key string, value string, n bigint"


def brute(rows, probs):
    by = {}
    for k, v in rows:
        if k is not None and v is not None:
            by.setdefault(k, []).append(v)
    out = {}
    for k, vs in by.items():
        vs.sort()
        out[k] = (len(vs), *[vs[max(1, -(-int(p * 100) * len(vs) // 100)) - 1] for p in probs])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "k", "v", 7) for a, b in rows], SCHEMA)


def test_quantiles_match_sorting_with_a_hot_key_ties_and_extremes(spark):
    rng = random.Random(1)
    rows = [(1, rng.randint(-(10**18), 10**18)) for _ in range(4000)] + [(rng.randint(2, 200), rng.randint(0, 50)) for _ in range(3000)]
    rows += [(3, None), (None, 3), (900, -(2**63)), (900, 2**63 - 1), (901, 5), (902, 5), (902, 5)]
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["key"]: (r["n"], *[r[f"q{i}"] for i in range(5)]) for r in selection.key_quantiles(frame(spark, rows), "label", "fid", probs).collect()}
    assert got == brute(rows, probs)


def test_few_cells_take_more_rounds_to_the_same_result(spark):
    rows = [(k % 3, k * k * 7919 % 100_003) for k in range(2000)]
    found = selection.select_ranks(frame(spark, rows), "label", "fid", selection.quantile_ranks([0.5]), cells=4)
    got = {r["key"]: r["value"] for r in found.collect()}
    assert got == {k: v[1] for k, v in brute(rows, [0.5]).items()}


def test_large_states_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST_ROWS", 10)
    rows = [(k % 40, (k * 7919) % 100_003) for k in range(4000)] + [(99, k) for k in range(3000)]
    found = selection.key_quantiles(frame(spark, rows), "label", "fid", [0.5], )
    assert {r["key"]: (r["n"], r["q0"]) for r in found.collect()} == brute(rows, [0.5])


def test_heavy_keys(spark):
    rows = [(1, i) for i in range(300)] + [(i + 10, i % 500) for i in range(700)] + [(5, i) for i in range(6)] + [(6, i) for i in range(7)]
    rows = sorted(set(rows))
    n = len(rows)
    want = set()
    for at, name in ((0, "label"), (1, "fid")):
        for v in {r[at] for r in rows}:
            c = sum(r[at] == v for r in rows)
            if c * 1000 >= n * 6:
                want.add((name, v, c))
    got = {tuple(r) for r in selection.heavy_keys(frame(spark, rows), ["label", "fid"], 6, 1000).collect()}
    assert got == want


def test_empty(spark):
    assert selection.key_quantiles(frame(spark, []), "label", "fid", [0.5]).count() == 0
    assert selection.heavy_keys(frame(spark, []), ["label", "fid"], 6, 1000).count() == 0

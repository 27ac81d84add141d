import pytest

from chunkloom.llm import mixing

DOCS = "doc_id bigint, text string, source string, pattern string"
TARGETS = "source string, weight double, max_repeats int"


def test_route_repeats_no_more_than_needed():
    cap = {("a", "a"): 100.0, ("a|b", "a"): 50.0, ("a|b", "b"): 50.0}
    flow = mixing.route(cap, {"a": 100.0, "b": 120.0}, {"a": 2, "b": 3})
    assert flow["a|b", "b"] == pytest.approx(120)
    assert flow["a", "a"] == pytest.approx(100)  # the shared texts are already repeated for b
    assert flow["a|b", "a"] == pytest.approx(0)


def test_route_never_exceeds_caps():
    flow = mixing.route({("a", "a"): 10.0}, {"a": 100.0, "b": 5.0}, {"a": 3, "b": 2})
    assert flow["a", "a"] == pytest.approx(30)


def mix(spark, rows, targets):
    return mixing.Mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS))


def test_mix_reaches_shares_and_reports_shortfalls(spark):
    rows = [(i, f"word number {i} of the big source", " Big " if i % 2 else "BIG", None) for i in range(400)]
    rows += [(1000 + i, f"word number {i} of the small one", "small", None) for i in range(20)]
    rows += [(1000, "word number 0 of the small one", "small", None), (2000, "no target", "other", None), (2001, "x", None, None), (None, "y", "big", None), (2002, None, "big", None)]
    m = mix(spark, rows, [("big", 0.5, 3), ("small", 0.5, 2)])
    report = {r["source"]: r for r in m.report().collect()}
    assert report["small"]["falls_short"] and not report["big"]["falls_short"]
    assert report["small"]["routed_tokens"] == pytest.approx(2 * report["small"]["size_tokens"])
    sel = m.selection().toPandas()
    for name, r in report.items():
        assert r["selected_tokens"] == (sel[sel.source == name].n_copies * sel[sel.source == name].n_tokens).sum()
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1)
    assert (sel[sel.source == "small"].n_copies == 2).all() and (sel.source == "small").sum() == 20
    big = sel[sel.source == "big"]
    picked, quota = (big.n_copies * big.n_tokens).sum(), report["big"]["quota_tokens"]
    assert quota - 20 <= picked <= quota + 20


def test_empty_tables(spark):
    m = mix(spark, [], [("a", 1.0, 1)])
    assert m.selection().count() == 0 and m.report().count() == 1


def test_shared_texts_are_dealt_out_before_any_is_repeated(spark):
    texts = [f"the text of number {i} that two sources share" for i in range(300)]
    rows = [(2 * i + k, t, s, None) for i, t in enumerate(texts) for k, s in enumerate(("left", "right"))]
    m = mix(spark, [*rows, (9000, None, "left", None), (9001, "", "right", None)], [("left", 0.25, 3), ("right", 0.25, 3)])
    sel = m.selection().toPandas()
    sel["text"] = sel.doc_id // 2
    used = sel.groupby("text").n_copies.sum()
    assert used.max() == 1 and used.sum() >= 299  # half of all tokens each: every text once, in one source
    m = mix(spark, rows, [("left", 0.5, 3), ("right", 0.75, 3)])
    sel = m.selection().toPandas()
    used = sel.assign(text=sel.doc_id // 2).groupby("text").n_copies.sum()
    assert set(used) <= {2, 3} and len(used) == 300
    report = {r["source"]: r for r in m.report().collect()}
    assert report["right"]["reached_share"] == pytest.approx(0.6, abs=0.01)


def test_very_many_repetitions_need_few_arcs():
    assert len(mixing._blocks(10**9)) < 50 and sum(n for _, n in mixing._blocks(10**9)) == 10**9
    assert mixing.route({("a", "a"): 1.0}, {"a": 10.0**8}, {"a": 10**9})["a", "a"] == pytest.approx(10**8)

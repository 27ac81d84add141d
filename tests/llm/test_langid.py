import numpy as np
import pandas as pd
import pytest

from chunkloom.llm import langid
from chunkloom.llm.bigru import BiGRU

DOCS = "doc_id bigint, text string, label string, text_tgt string, lang_tgt string, lang_code string"
CODES = [("en", "eng", "English", "English"), ("xx", "xxa", "Exish", "exa")]
CODES_SCHEMA = "code string, iso3 string, name_en string, name_own string"
A = "the old house near river has many green windows and doors".split()
B = "ozu kuzi wazo pimo zaku quzi wuzo kipu azzo omzi".split()


def sentence(words, rng, n=9):
    return " ".join(rng.choice(words, n))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = BiGRU(3, hidden=4, embed=3, seed=1)
    for n in m.NAMES:
        setattr(m, n, getattr(m, n).astype(np.float64))
        m.adam[n] = tuple(np.zeros_like(getattr(m, n)) for _ in range(2))
    x, y = rng.integers(0, 256, (6, 2)), rng.integers(0, 3, (6, 2))
    x[4:, 1], y[4:, 1] = langid.PAD, -1

    def loss():
        lg = m.logits(x)
        lg = lg - lg.max(-1, keepdims=True)
        lp = lg - np.log(np.exp(lg).sum(-1, keepdims=True))
        return -np.take_along_axis(lp, np.maximum(y, 0)[..., None], -1)[y >= 0].mean()

    for name, at in (("wh", (1, 2, 5)), ("wx", (0, 1, 3)), ("bn", (0, 0, 1)), ("wo", (5, 1)), ("emb", (int(x[2, 1]), 1)), ("bx", (1, 0, 9))):
        w = getattr(m, name)
        keep = w[at]
        w[at] = keep + 1e-3
        up = loss()
        w[at] = keep - 1e-3
        down = loss()
        w[at] = keep
        copy = BiGRU.thaw({k: (v.copy() if hasattr(v, "copy") else v) for k, v in m.__dict__.items()})
        copy.adam = {n: tuple(np.zeros_like(v) for v in p) for n, p in m.adam.items()}
        copy.step(x, y, 0.0)
        got = copy.adam[name][0][at] / 0.1  # the first moment holds the clipped gradient
        ref = (up - down) / 2e-3
        # clipping scales all gradients alike; compare with one reference weight
        base = copy.adam["bo"][0] / 0.1
        m.bo[0] += 1e-3
        up = loss()
        m.bo[0] -= 2e-3
        down = loss()
        m.bo[0] += 1e-3
        scale = base[0] / ((up - down) / 2e-3)
        assert got == pytest.approx(ref * scale, rel=0.05, abs=1e-4)


@pytest.fixture(scope="module")
def labels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, sentence(A if i % 2 else B, rng), "en-GB" if i % 2 else "Exish", None, None, None) for i in range(240)]
    docs = spark.createDataFrame(rows, DOCS)
    codes = spark.createDataFrame(CODES, CODES_SCHEMA)
    return langid.LanguageLabels(docs, codes, [("text", "label"), ("text_tgt", "lang_tgt")], steps=60), codes


def test_labels_documents_and_segments(spark, labels):
    model, codes = labels
    rng = np.random.default_rng(9)
    mixed = sentence(A, rng) + ". " + sentence(B, rng)
    long = " ".join(sentence(A, rng) for _ in range(200)) + " " + sentence(B, rng, 12)
    rows = [(1, sentence(A, rng), "en"), (2, sentence(A, rng), "xxa_QQ"), (3, mixed, "en"), (4, "12 / 7-8", "en"), (5, None, "en"), (6, "", None), (7, sentence(B, rng), None), (8, long, "exa"), (9, sentence(A, rng) + " ozu kuzi wazo", " EN "), (1, "z", None)]
    rows = [(i, t, lb, None, None, "clash") for i, t, lb in rows[:-1]]
    docs = spark.createDataFrame([*rows, rows[0], (None, "the old house near", "en", None, None, None)], DOCS)
    found = model.segments(docs, "doc_id", "text", "label").cache()
    got = {(r["doc_id"], r["lang"]) for r in langid.contradicted(found, codes, "label").collect()}
    assert got == {(2, "en"), (3, "en"), (3, "xx"), (7, "xx"), (8, "en"), (8, "xx")}
    for r in found.where("doc_id = 3").collect():
        assert 0 < r["confidence"] <= 1 and r["n_words"] == 9 and mixed[r["start_char"] : r["end_char"]].count(" ") == 8
    again = langid.LanguageLabels.reusing(codes, model.classes, model.model.frozen()).segments(docs, "doc_id", "text", "label")
    assert sorted(map(tuple, again.select("doc_id", "lang", "n_words").collect())) == sorted(map(tuple, found.select("doc_id", "lang", "n_words").collect()))
    per = {(r["doc_id"], r["lang"]): r["n_words"] for r in langid.document_languages(found).collect()}
    assert per[8, "xx"] == 12 and per[1, "en"] == 9


def test_no_labels_no_rows(spark, labels):
    _, codes = labels
    none = langid.LanguageLabels(spark.createDataFrame([], DOCS), codes, [("text", "label")])
    assert none.segments(spark.createDataFrame([(1, "the old house near", "en", None, None, None)], DOCS), "doc_id", "text", "label").count() == 0


def test_bytes_and_characters_line_up():
    text = "größe ÄÖ straße mañana"
    low = langid.lowered(text)
    assert len(low) == len(text)
    logp = np.full((len(low.encode()), 2), -1.0)
    logp[:, 1] = -0.01
    assert langid.segments(low, logp) == [(0, len(text), 1, pytest.approx(np.exp(-0.01)), 4, pytest.approx(np.exp(-0.01)))]


def test_labels_do_not_depend_on_the_batch():
    m = BiGRU(3, seed=5)
    texts = [b"short", b"a longer text of some words " * 9, b"the third"]
    together = langid.label_positions(m, texts)
    for t, lp in zip(texts, together):
        assert np.allclose(langid.label_positions(m, [t])[0], lp, atol=1e-4)


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"code": ["en", "xx"] * 100, "text": [sentence(A if i % 2 == 0 else B, rng) for i in range(200)]})
    model = langid.train(data, ["en", "xx"], steps=50)
    held = [sentence(A if i % 2 == 0 else B, rng) for i in range(40)]
    hit = [lp.sum(axis=0).argmax() == i % 2 for i, lp in enumerate(langid.label_positions(model, [t.encode() for t in held]))]
    assert np.mean(hit) > 0.95


def positions(text, stretches, sure=0.97):
    """Log-probabilities of three classes: 0, but in the given (start, end) words class 1 or 2."""
    p = np.full((len(text), 3), (1 - sure) / 2)
    p[:, 0] = sure
    at = [(m.start(), m.end()) for m in langid._WORD.finditer(text)]
    for first, last, k in stretches:
        p[at[first][0] : at[last - 1][1]] = [(sure if j == k else (1 - sure) / 2) for j in range(3)]
    return np.log(p)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9])
@pytest.mark.parametrize("start", [0, 7, 25])
def test_stretches_count_from_four_words_on(n, start):
    text = " ".join(["word"] * 40)
    got = langid.segments(text, positions(text, [(start, start + n, 1)]))
    assert [(s[2], s[4]) for s in got] == ([(0, 40)] if n < 4 else [x for x in [(0, start), (1, n), (0, 40 - start - n)] if x[1]])


def test_unsure_words_make_no_segment():
    text = " ".join(["word"] * 40)
    logp = positions(text, [])
    some = positions(text, [(10, 18, 1)], sure=0.45)
    logp[50:90] = some[50:90]
    assert [s[2] for s in langid.segments(text, logp)] == [0]


def test_probabilities_are_pooled_over_the_document():
    text = " ".join(["word"] * 20)
    got = langid.segments(text, positions(text, [(10, 20, 1)]))
    assert [s[2] for s in got] == [0, 1] and all(s[3] == pytest.approx(0.97) for s in got)
    assert got[0][5] == pytest.approx((0.97 + 0.015) / 2)


def test_merging_is_fast_on_long_alternating_texts():
    import time

    text = " ".join(["word"] * 40_000)
    logp = positions(text, [(i, i + 1, 1 + i % 2) for i in range(0, 40_000, 2)])
    begin = time.time()
    got = langid.segments(text, logp)
    assert time.time() - begin < 20 and sum(s[4] for s in got) == 40_000


def test_inference_equals_the_states_of_training():
    m = BiGRU(3, seed=2)
    x = np.random.default_rng(1).integers(0, 256, (30, 5))
    x[20:, 1], x[3:, 4] = langid.PAD, langid.PAD
    assert np.allclose(m._run(x), m._states(x, False)[0], atol=1e-5)


def test_bytes_of_odd_characters():
    text = "a\u00e9\u20ac\U0001f600\ud800b"
    assert langid._widths(text).tolist() == [len(c.encode("utf-8", "replace")) for c in text]

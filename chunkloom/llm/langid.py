"""Languages of documents and of their mixed-language segments.

A bidirectional gated recurrent network over bytes labels every position of every
text.  It is trained here, by backpropagation through time, on a bounded sample of
labelled rows (at most SAMPLE_PER_LANGUAGE texts of each language, those with the
lowest hashes), as such and spliced into texts that change language midway; rows whose
label the half-trained network contradicts are taken out before training goes on.

Position probabilities are pooled to words, neighbouring words of one language to
segments.  A segment has MIN_WORDS words or more, and by their probabilities nearly so
many of them and more than half are expected to be in its language; others join a
neighbour, so shorter stretches, names and cut-off words make no segment.  A document's
probabilities are pooled over all of its words.  All texts are labelled whole, in
overlapping windows.

Defined cases: null ids are ignored; null and empty texts and texts without words have
no language; a language is known by its code, ISO 639-3 code or either name, ignoring
case and outer blanks, also with a region after '-' or '_'; repeated rows count once;
where no row is labelled, or the table is empty, the result is empty.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.llm.bigru import PAD, BiGRU

SAMPLE_PER_LANGUAGE = 800
#: Of a longer text the sample holds a stretch of so many characters.
STRETCH = 4000
#: Bytes of a sampled text that one training example shows, from a place in it by chance.
TRAIN_BYTES = 128
BATCH, STEPS, PURGE_AT = 64, 560, 220
#: Labelling windows: so many bytes, of which so many at either end only give context.
WINDOW, MARGIN = 640, 48
#: Windows run together, and bytes of texts whose windows are sorted by length.
ROWS_AT_ONCE, POOL_BYTES = 384, 2_000_000
#: Words of a segment, and how many of them are expected to be in its language.
MIN_WORDS, EXPECTED = 4, 3.6
SEED = 11

_WORD = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]")


def lowered(text: str) -> str:
    """The text in lower case, character for character; what the network sees."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def known_languages(codes: DataFrame) -> DataFrame:
    """``alias, code`` of the table of languages, which is a fixed list."""
    names = F.array("code", "iso3", "name_en", "name_own")
    rows = codes.select("code", F.explode(names).alias("alias")).where("alias is not null and code is not null")
    return rows.select(F.lower(F.trim("alias")).alias("alias"), "code").groupBy("alias").agg(F.min("code").alias("code"))


def alias_of(lang: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(lang)), r"\s*[-_].*$", "")


def labelled_sample(docs: DataFrame, codes: DataFrame, sides: list[tuple[str, str]], per_language: int = SAMPLE_PER_LANGUAGE) -> pd.DataFrame:
    """``code, text``: at most so many distinct texts per language, by lowest hash."""
    known = F.broadcast(known_languages(codes))  # a fixed list
    rows = None
    for text, lang in sides:
        side = docs.select(F.col(text).alias("text"), alias_of(F.col(lang)).alias("alias")).where("text is not null")
        rows = side if rows is None else rows.unionByName(side)
    rows = rows.where(F.col("text").rlike(r"\p{L}")).join(known, "alias").select("code", "text", F.xxhash64("text").alias("h"))
    # thin out by hash first, so that no language's rows meet in one task
    n = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not n:
        return pd.DataFrame({"code": [], "text": []})
    rate = F.lit(0)
    for code, count in n.items():
        rate = F.when(F.col("code") == code, F.lit(min(1_000_000, int(4e6 * per_language / count) + 1))).otherwise(rate)
    thin = rows.where(F.pmod("h", F.lit(1_000_000)) < rate)
    w = Window.partitionBy("code").orderBy("h", "text")
    # of very long texts a stretch suffices as an example, from a place that its hash gives
    span = F.when(F.length("text") > STRETCH, F.substr("text", (F.pmod("h", F.length("text") - STRETCH) + 1).cast("int"), F.lit(STRETCH))).otherwise(F.col("text"))
    best = thin.select("code", "h", span.alias("text")).dropDuplicates(["code", "h"]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_language)
    return best.select("code", "text").orderBy("code", "text").toPandas()


def _examples(texts: list[bytes], spaces: list[np.ndarray], labels: np.ndarray, by: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A batch (T, B): stretches of texts, half of them spliced from several languages."""
    x = np.full((TRAIN_BYTES, BATCH), PAD, np.int64)
    y = np.full((TRAIN_BYTES, BATCH), -1, np.int64)
    have = [k for k, idx in enumerate(by) if len(idx)]
    for b in range(BATCH):
        at, mixed = 0, rng.random() < 0.5
        while at < TRAIN_BYTES:
            k = have[rng.integers(len(have))]
            i = int(by[k][rng.integers(len(by[k]))])
            t = texts[i]
            if mixed:
                want = int(rng.integers(20, 100))
                start = int(spaces[i][rng.integers(len(spaces[i]))])
                stretch = t[start : start + want]
                cut = stretch.rfind(b" ")
                stretch = stretch[: cut + 1] if cut > 8 else stretch
            else:
                start = 0 if rng.random() < 0.4 else int(rng.integers(0, max(1, len(t) - 40)))
                stretch = t[start : start + TRAIN_BYTES]
            if rng.random() < 0.12:  # blanks doubled throughout, as some sources have them
                stretch = stretch.replace(b" ", b"  ")
            n = min(len(stretch), TRAIN_BYTES - at)
            x[at : at + n, b] = np.frombuffer(stretch[:n], np.uint8)
            y[at : at + n, b] = labels[i]
            at += n
            if not mixed and rng.random() < 0.7:
                break
            if at < TRAIN_BYTES and n and stretch[n - 1 : n] != b" ":
                x[at, b] = 32
                at += 1
    return x, y


def train(sample: pd.DataFrame, classes: list[str], steps: int = STEPS, seed: int = SEED) -> BiGRU:
    """The network, trained on ``code, text`` rows."""
    rng = np.random.default_rng(seed)
    raw = [lowered(t).encode("utf-8", "replace") for t in sample["text"]]
    labels = np.array([classes.index(c) for c in sample["code"]], dtype=np.int64)
    spaces = [np.concatenate([[0], np.flatnonzero(np.frombuffer(t, np.uint8) == 32) + 1]) for t in raw]
    model = BiGRU(len(classes), seed=seed)
    by = [np.flatnonzero(labels == k) for k in range(len(classes))]
    for i in range(steps):
        if i == PURGE_AT:  # wrong labels and mixed texts teach nothing right
            agree = _agreement(model, raw, labels)
            by = [idx[agree[idx] > 0.9] if (agree[idx] > 0.9).sum() >= 20 else idx for idx in by]
        x, y = _examples(raw, spaces, labels, by, rng)
        model.step(x, y, 6e-3 * min(1.0, (i + 1) / 20) * (0.5 * (1 + np.cos(np.pi * i / steps)) + 0.02))
    return model


def _agreement(model: BiGRU, texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Share of each whole text's positions that the network labels as given."""
    return np.array([(lp.argmax(axis=1) == k).mean() if len(lp) else 0.0 for lp, k in zip(label_positions(model, texts), labels)])


def label_positions(model: BiGRU, texts: list[bytes]) -> list[np.ndarray]:
    """Log-probabilities (bytes, classes) of each text, in overlapping windows."""
    core = WINDOW - 2 * MARGIN
    jobs = []
    for i, t in enumerate(texts):
        if len(t) <= WINDOW:
            jobs.append((len(t), i, 0, 0, len(t), len(t)))
            continue
        for at in range(0, len(t), core):
            lo, hi = max(0, at - MARGIN), min(len(t), at + core + MARGIN)
            jobs.append((hi - lo, i, at, lo, hi, min(len(t), at + core)))
    jobs.sort()  # windows of like length run together
    out = [np.zeros((len(t), model.k), np.float32) for t in texts]
    for s in range(0, len(jobs), ROWS_AT_ONCE):
        part = jobs[s : s + ROWS_AT_ONCE]
        x = np.full((max(1, part[-1][0]), len(part)), PAD, np.int64)
        for b, (_, i, _, lo, hi, _) in enumerate(part):
            x[: hi - lo, b] = np.frombuffer(texts[i][lo:hi], np.uint8)
        lg = model.logits(x)
        lg -= lg.max(axis=-1, keepdims=True)
        lg -= np.log(np.exp(lg).sum(axis=-1, keepdims=True))
        for b, (_, i, at, lo, _, end) in enumerate(part):
            out[i][at:end] = lg[at - lo : end - lo, b]
    return out


class _Runs:
    """Neighbouring words of one language, merged until none is doubtful.

    The run with the fewest sure words goes first, from a heap; only what touches a
    change is looked at again, so a text of n runs takes about n log n steps.
    """

    def __init__(self, pooled: np.ndarray) -> None:
        self.sure = np.concatenate([np.zeros((1, pooled.shape[1])), np.cumsum(np.exp(pooled), axis=0, dtype=float)])
        self.logp = np.concatenate([np.zeros((1, pooled.shape[1])), np.cumsum(pooled, axis=0, dtype=float)])
        k = pooled.argmax(axis=1)
        edges = np.flatnonzero(np.diff(k)) + 1
        self.a, self.b = [0, *edges.tolist()], [*edges.tolist(), len(k)]
        self.k = [int(k[a]) for a in self.a]
        n = len(self.a)
        self.before, self.after = list(range(-1, n - 1)), [*range(1, n), -1]
        self.stamp = [0] * n

    def weight(self, i: int) -> float:
        """Words of a run that are expected to be in its language; names and cut words are not sure."""
        return float(self.sure[self.b[i], self.k[i]] - self.sure[self.a[i], self.k[i]])

    def doubtful(self, i: int) -> bool:
        n, expected = self.b[i] - self.a[i], self.weight(i)
        return n < MIN_WORDS or expected < EXPECTED or expected <= n / 2

    def near(self, i: int) -> list[int]:
        return [j for j in (self.before[i], self.after[i]) if j >= 0]

    def merged(self) -> list[tuple[int, int, int]]:
        heap = [(self.weight(i), self.a[i], i, 0) for i in range(len(self.a))] if len(self.a) > 1 else []
        heapq.heapify(heap)
        while heap:
            _, _, i, stamp = heapq.heappop(heap)
            near = self.near(i)
            if stamp != self.stamp[i] or not near or not self.doubtful(i):
                continue
            spoken = self.logp[self.b[i]] - self.logp[self.a[i]]
            # a doubtful stretch joins the neighbour that its own words rather suggest
            self.k[i] = self.k[max(near, key=lambda j: (not self.doubtful(j), spoken[self.k[j]]))]
            for j in near:
                if self.k[j] == self.k[i]:
                    self._absorb(i, j)
            for j in [i, *self.near(i)]:
                self.stamp[j] += 1
                heapq.heappush(heap, (self.weight(j), self.a[j], j, self.stamp[j]))
        out, i = [], next(i for i in range(len(self.a)) if self.before[i] == -1 and self.stamp[i] >= 0)
        while i >= 0:
            out.append((self.a[i], self.b[i], self.k[i]))
            i = self.after[i]
        return out

    def _absorb(self, i: int, j: int) -> None:
        """Run j, next to i and of its language, becomes part of it."""
        self.a[i], self.b[i] = min(self.a[i], self.a[j]), max(self.b[i], self.b[j])
        if self.before[i] == j:
            self.before[i] = self.before[j]
            if self.before[i] >= 0:
                self.after[self.before[i]] = i
        else:
            self.after[i] = self.after[j]
            if self.after[i] >= 0:
                self.before[self.after[i]] = i
        self.stamp[j] = -1


def segments(text: str, logp: np.ndarray) -> list[tuple[int, int, int, float, int, float]]:
    """(first character, end, class, confidence, words, probability) of each part in one language.

    ``logp`` are the log-probabilities of the bytes of ``text``, which is in lower case.  The
    confidence is that of the part's own words, the probability that of its language over
    all words of the text.
    """
    words = [m.span() for m in _WORD.finditer(text) if _LETTER.search(m.group())]
    if not words:
        return []
    begins, ends = np.array(words).T
    if text.isascii():
        b0, b1 = begins, ends
    else:
        at = np.zeros(len(text) + 1, np.int64)
        at[1:] = np.cumsum(_widths(text))
        b0, b1 = at[begins], at[ends]
    # mean log-probability per word, from its own positions
    spans = np.column_stack([b0, b1]).reshape(-1)
    whole = np.add.reduceat(logp, spans if spans[-1] < len(logp) else spans[:-1], axis=0)[::2]
    pooled = whole / (b1 - b0)[:, None]
    sure, size = np.exp(pooled), b1 - b0
    share = np.average(sure, axis=0, weights=size)
    out = []
    for a, b, c in _Runs(pooled).merged():
        conf = float(np.average(sure[a:b, c], weights=size[a:b]))
        out.append((int(begins[a]), int(ends[b - 1]), c, conf, b - a, float(share[c])))
    return out


def _widths(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8; lone surrogates are replaced by one byte."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((code >= 0xD800) & (code < 0xE000), 1, np.array([1, 2, 3, 4])[np.searchsorted([0x80, 0x800, 0x10000], code, side="right")])


def _pools(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Slices of about POOL_BYTES characters; one text at least."""
    at, size = 0, 0
    for i, n in enumerate(texts.str.len()):
        if i > at and size + n > POOL_BYTES:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


class LanguageLabels:
    """Trains on ``docs`` and labels documents; ``classes`` are language codes."""

    def __init__(self, docs: DataFrame, codes: DataFrame, sides: list[tuple[str, str]], per_language: int = SAMPLE_PER_LANGUAGE, steps: int = STEPS) -> None:
        self.codes = codes
        sample = labelled_sample(docs, codes, sides, per_language)
        self.classes = sorted(sample["code"].unique())
        self.model = train(sample, self.classes, steps) if self.classes else None

    @classmethod
    def reusing(cls, codes: DataFrame, classes: list[str], frozen: dict) -> LanguageLabels:
        """Labels by a network trained before (its ``classes`` and ``model.frozen()``)."""
        new = cls.__new__(cls)
        new.codes, new.classes, new.model = codes, classes, BiGRU.thaw(frozen)
        return new

    def segments(self, docs: DataFrame, id_col: str, text: str, *keep: str) -> DataFrame:
        """``doc_id, start_char, end_char, lang, confidence, n_words, probability`` and kept columns."""
        kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("_text"), *keep)
        kept = kept.where("doc_id is not null and _text is not null").distinct()
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name not in ("doc_id", "_text"))
        schema = "doc_id bigint, start_char int, end_char int, lang string, confidence double, n_words int, probability double" + (", " + kinds if kinds else "")
        if self.model is None:
            return docs.sparkSession.createDataFrame([], schema)
        sent = docs.sparkSession.sparkContext.broadcast((self.model.frozen(), self.classes))
        names = [f.split("`")[1] for f in kinds.split(", ")] if kinds else []

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frozen, classes = sent.value
            model = BiGRU.thaw(frozen)
            for pdf in batches:
                for lo, hi in _pools(pdf["_text"]):
                    part = pdf.iloc[lo:hi]
                    raw = [lowered(t) for t in part["_text"]]
                    rows = []
                    for r, (t, lp) in enumerate(zip(raw, label_positions(model, [t.encode("utf-8", "replace") for t in raw]))):
                        rows += [(r, *x) for x in segments(t, lp)]
                    got = pd.DataFrame(rows, columns=["r", "start_char", "end_char", "k", "confidence", "n_words", "probability"])
                    got["lang"] = [classes[k] for k in got["k"]]
                    src = part.iloc[got["r"].to_numpy(dtype=int)].reset_index(drop=True)
                    out = pd.concat([src[["doc_id"]], got[["start_char", "end_char", "lang", "confidence", "n_words", "probability"]], src[names]], axis=1)
                    yield out.astype({"start_char": "int32", "end_char": "int32", "n_words": "int32"})

        return kept.mapInPandas(run, schema)


def document_languages(found: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, lang, confidence, probability, n_words`` of each document's languages: the
    confidence of the words in the language, and its probability pooled over all words."""
    total = F.sum("n_words")
    return found.groupBy("doc_id", "lang", *keep).agg((F.sum(F.col("confidence") * F.col("n_words")) / total).alias("confidence"), F.max("probability").alias("probability"), total.alias("n_words"))


def contradicted(found: DataFrame, codes: DataFrame, label: str) -> DataFrame:
    """``doc_id, lang``: languages of documents whose label names none, or not just these.

    ``found``: segments with the document's own label in the column ``label``.
    """
    known = F.broadcast(known_languages(codes))  # a fixed list
    per = found.groupBy("doc_id", label).agg(F.array_sort(F.collect_set("lang")).alias("langs"))  # at most one entry per language
    named = per.join(known, alias_of(F.col(label)) == F.col("alias"), "left")
    wrong = named.where(F.col("code").isNull() | (F.size("langs") != 1) | (F.get("langs", F.lit(0)) != F.col("code")))
    return wrong.select("doc_id", F.explode("langs").alias("lang")).distinct()

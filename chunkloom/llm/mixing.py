"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are texts; a text may belong to several sources.  Texts with the same set
of sources are aggregated to one membership pattern, so the flow network has as many
nodes as there are patterns and sources, however many documents there are.  Tokens
flow from patterns to the quotas of the sources.  Using a pattern's tokens once is
free, each further use costs more than the one before, so repetition is spread and
avoided where it can be.  Documents are then selected by a seeded hash: the texts of a
pattern lie on a circle in the order of their hashes, and its sources take arcs that
follow one another, so no text is used again before all have been used.  Shares are
reported from the selected rows.

Defined cases: null ids, null sources and sources without a target are left out, and so
are null, empty and other texts without tokens; names
match ignoring case and outer blanks; targets with null or non-positive weight get
nothing; max_repeats below one counts as one; of a source named twice in the targets
the weights add up and the larger cap holds; repeated rows count once; a source
without documents falls short by its whole quota; empty tables give empty results.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.llm.tokens import MODEL, sized
from chunkloom.session import cut

SEED = 20240607
#: Hash digits by which the texts of a pattern are divided; two of them place a cut.
DIGIT = 4096
#: Further uses up to so many have costs of their own, later ones in blocks that double.
SINGLE = 16


def clean(name: Column) -> Column:
    return F.lower(F.trim(name))


class Network:
    """A flow network with costs; augments along cheapest paths."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[float] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, cap: float, cost: float) -> int:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(cap)
        self.cost.append(cost)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(0.0)
        self.cost.append(-cost)
        return len(self.to) - 2

    def run(self, source: int, sink: int, least: float) -> None:
        """Maximum flow of least cost; remainders below ``least`` count as none."""
        while True:
            dist, via, queued = {source: 0.0}, {}, {source}
            queue = deque([source])
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    if self.cap[e] > least and dist[a] + self.cost[e] < dist.get(self.to[e], float("inf")) - 1e-12:
                        dist[self.to[e]], via[self.to[e]] = dist[a] + self.cost[e], e
                        if self.to[e] not in queued:
                            queue.append(self.to[e])
                            queued.add(self.to[e])
            if sink not in via:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            amount = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= amount
                self.cap[e ^ 1] += amount


def _blocks(uses: int) -> list[tuple[int, int]]:
    """(first use, number of uses) of arcs of rising cost: about log2(uses) of them."""
    out, r = [], 0
    while r < uses:
        n = min(1 if r < SINGLE else r, uses - r)
        out.append((r, n))
        r += n
    return out


def route(capacity: dict[tuple[str, str], float], quotas: dict[str, float], repeats: dict[str, int]) -> dict[tuple[str, str], float]:
    """Tokens that each (pattern, source) contributes.

    ``capacity``: tokens of the pattern's documents in the source.
    """
    patterns = sorted({p for p, _ in capacity})
    sources = sorted(quotas)
    at = {("p", p): i + 1 for i, p in enumerate(patterns)} | {("s", s): i + 1 + len(patterns) for i, s in enumerate(sources)}
    end = len(patterns) + len(sources) + 1
    net = Network(end + 1)
    for p in patterns:
        mine = [(s, c) for (q, s), c in capacity.items() if q == p and s in quotas]
        one = max((c for _, c in mine), default=0.0)
        for r, n in _blocks(sum(repeats[s] for s, _ in mine)):
            net.arc(0, at["p", p], one * n, float(r))  # the r-th further use costs r
    arcs = {}
    for (p, s), c in sorted(capacity.items()):
        if s in quotas:
            arcs[p, s] = [net.arc(at["p", p], at["s", s], c * n, 0.001 * r) for r, n in _blocks(repeats[s])]
    for s in sources:
        net.arc(at["s", s], end, quotas[s], 0.0)
    net.run(0, end, 1e-9 * max([1.0, *quotas.values()]))
    return {k: sum(net.cap[e ^ 1] for e in es) for k, es in arcs.items()}


def memberships(docs: DataFrame, targets: DataFrame, id_col: str, text: str, source: str, model: str = MODEL) -> DataFrame:
    """``id, source, pattern, n_tokens`` of each document of a target's source."""
    known = targets.select(clean(F.col("source")).alias("source")).where("source is not null").distinct()
    rows = docs.select(id_col, text, clean(F.col(source)).alias("source")).join(F.broadcast(known), "source")  # a fixed list of targets
    rows = cut(sized(rows, id_col, text, "source", model=model).where("n_tokens > 0"), "sized")
    # the sources of a text: collected per distinct (text, source), so at most one entry per target
    sets = rows.select("text_hash", "source").distinct().groupBy("text_hash").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("pattern"))
    shared = sets.where(F.contains("pattern", F.lit("|")))
    return rows.join(shared, "text_hash", "left").select("id", "text_hash", "source", F.coalesce("pattern", "source").alias("pattern"), "n_tokens")


class Mix:
    """A mix of sources: ``report`` (shares) and ``selection`` (documents)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, model: str = MODEL) -> None:
        self.spark, self.seed = docs.sparkSession, seed
        self.docs = cut(memberships(docs, targets, id_col, text, source, model), "members")
        named = targets.select(clean(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null and weight > 0").distinct().collect()
        self.weights: dict[str, float] = {}
        self.repeats: dict[str, int] = {}
        for r in named:  # a fixed list of targets
            self.weights[r["source"]] = self.weights.get(r["source"], 0.0) + r["weight"]
            self.repeats[r["source"]] = max(1, self.repeats.get(r["source"], 1), r["max_repeats"] or 1)
        # one row per pattern and source: at most 2^targets, whatever the documents
        sums = self.docs.groupBy("pattern", "source").agg(F.sum("n_tokens").alias("n")).collect()
        self.capacity = {(r["pattern"], r["source"]): float(r["n"]) for r in sums}
        self.total = sum(self.capacity.values())
        self.quotas = {s: w * self.total for s, w in self.weights.items()}
        self.flow = route(self.capacity, self.quotas, self.repeats)

    def sizes(self) -> dict[str, float]:
        out = dict.fromkeys(self.quotas, 0.0)
        for (_, s), c in self.capacity.items():
            if s in out:
                out[s] += c
        return out

    def report(self) -> DataFrame:
        """``source, target_share, size_tokens, quota_tokens, routed_tokens, selected_tokens,
        reached_share, falls_short``; the reached shares are those of the selected rows."""
        routed = dict.fromkeys(self.quotas, 0.0)
        for (_, s), f in self.flow.items():
            routed[s] += f
        size = self.sizes()
        rows = [(s, self.weights[s], int(size[s]), q, routed[s], q - routed[s] > 1e-6 * max(1.0, q)) for s, q in sorted(self.quotas.items())]
        plan = self.spark.createDataFrame(rows, "source string, target_share double, size_tokens bigint, quota_tokens double, routed_tokens double, falls_short boolean")
        taken = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("selected_tokens"))  # one row per source
        whole = taken.agg(F.sum("selected_tokens").alias("_whole"))
        got = plan.join(F.broadcast(taken), "source", "left").join(F.broadcast(whole), how="left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)).cast("bigint"))
        share = F.when(F.col("_whole") > 0, F.col("selected_tokens") / F.col("_whole")).otherwise(0.0)
        return got.select("source", "target_share", "size_tokens", "quota_tokens", "routed_tokens", "selected_tokens", share.alias("reached_share"), "falls_short")

    def short(self) -> DataFrame:
        """``source``: those that their capped repetitions leave below their quota."""
        routed = dict.fromkeys(self.quotas, 0.0)
        for (_, s), f in self.flow.items():
            routed[s] += f
        return self.spark.createDataFrame([(s,) for s, q in sorted(self.quotas.items()) if q - routed[s] > 1e-6 * max(1.0, q)], "source string")

    def _arcs(self) -> list[tuple[str, str, float, float]]:
        """(pattern, source, begin, end) on the pattern's circle, whose length is 1."""
        out: list[tuple[str, str, float, float]] = []
        at: dict[str, float] = {}
        for (p, s), f in sorted(self.flow.items()):
            c = self.capacity[p, s]
            if c > 0 and f > 0:
                begin = at.get(p, 0.0)
                # whole rounds stay whole numbers
                turns = f / c
                at[p] = begin + (round(turns) if abs(turns - round(turns)) < 1e-9 else turns)
                out.append((p, s, begin, at[p]))
        return out

    def selection(self) -> DataFrame:
        """``doc_id, source, n_copies, n_tokens``: how often each document of the mix is taken.

        A text at place u of its pattern's circle is taken once for each whole number k
        with u + k in the source's arc.  The ends of the arcs are turned into bounds of
        the hash, found digit by digit from token counts that merge on the map side.
        """
        arcs = self._arcs()
        plan = self.spark.createDataFrame([(p, s, int(b // 1), b % 1.0, int(e // 1), e % 1.0) for p, s, b, e in arcs], "pattern string, source string, b_turn int, b_at double, e_turn int, e_at double")
        ends = self.spark.createDataFrame(sorted({(p, x % 1.0) for p, _, *be in arcs for x in be if x % 1.0}), "pattern string, at double")  # one row per arc at most
        # within one source alone a text may be several documents, which count apart
        key = F.when(F.contains("pattern", F.lit("|")), F.xxhash64(F.lit(self.seed), "text_hash")).otherwise(F.xxhash64(F.lit(self.seed), "id", "text_hash"))
        h = F.pmod(key, F.lit(DIGIT * DIGIT)).cast("int")
        rows = self.docs.withColumn("h", h)
        cells = cut(rows.groupBy("pattern", F.floor(F.col("h") / DIGIT).cast("int").alias("high")).agg(F.sum("n_tokens").alias("n")), "high")
        w = Window.partitionBy("pattern").orderBy("high").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("upto", F.sum("n").over(w)).withColumn("whole", F.sum("n").over(Window.partitionBy("pattern")))
        goal = cells.join(F.broadcast(ends), "pattern").withColumn("goal", F.col("at") * F.col("whole")).where("upto > goal")
        goal = goal.groupBy("pattern", "at").agg(F.min("high").alias("high"), F.min_by(F.col("goal") - F.col("upto") + F.col("n"), "high").alias("rest"))
        goal = cut(goal, "ends")
        edge = rows.join(F.broadcast(goal.select("pattern", "high").distinct()), (F.floor(rows["h"] / DIGIT) == F.col("high")) & (rows["pattern"] == goal["pattern"]), "left_semi")
        low = edge.groupBy("pattern", F.floor(F.col("h") / DIGIT).cast("int").alias("high"), F.pmod("h", F.lit(DIGIT)).alias("low")).agg(F.sum("n_tokens").alias("n"))
        low = low.withColumn("upto", F.sum("n").over(Window.partitionBy("pattern", "high").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)))
        bound = low.join(F.broadcast(goal), ["pattern", "high"]).where("upto > rest").groupBy("pattern", "at", "high").agg(F.min("low").alias("low"))
        bound = cut(bound.select("pattern", "at", (F.col("high") * DIGIT + F.col("low")).alias("h")), "bounds")
        for end in "be":
            mine = F.broadcast(bound.select("pattern", F.col("at").alias(f"{end}_at"), F.col("h").alias(f"{end}_h")))
            plan = plan.join(mine, ["pattern", f"{end}_at"], "left")
        plan = F.broadcast(plan.select("pattern", "source", "b_turn", "e_turn", *[F.coalesce(f"{e}_h", F.when(F.col(f"{e}_at") > 0, DIGIT * DIGIT).otherwise(0)).alias(f"{e}_h") for e in "be"]))
        copies = F.col("e_turn") - F.col("b_turn") + (F.col("h") < F.col("e_h")).cast("int") - (F.col("h") < F.col("b_h")).cast("int")
        out = rows.join(plan, ["pattern", "source"])
        return out.select(F.col("id").alias("doc_id"), "source", copies.alias("n_copies"), "n_tokens").where("n_copies > 0")

"""Combining the documents of several sources so that each has its target share of the total size.

Each document is to be used e times on average, the same within a source: the source's target size over its size, at most the repeats allowed. The whole part of
e is certain; which documents are used once more is drawn by the cube method with the fraction as inclusion probability, so that the drawn documents'
tokens and number are balanced, not merely right on average. The flight phase moves the probabilities of three documents at a time along the direction that changes
neither total, until one of them is 0 or 1.

A document that is large beside all smaller ones together hardly moves along such directions and would stay open to the end. So the largest are drawn
first, and the probabilities of the rest are scaled to make up for what that gained or lost: of a source that is cut into blocks those with over 1 / OUTLIER of its
tokens (fewer than OUTLIER), then in the last block of a source those over 1 / SMALL of what follows.

Flights run on blocks of a source, in parallel. Each leaves RESERVE documents and at most two others undecided and both totals unchanged.
The undecided ones of all blocks fly again, in blocks, until one block per source is left. There the last two documents are landed by trying the few
ways, and what is then missing is made up by exchanging documents of that block, one or two at a time, as long as that brings the total nearer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewright.sources import checkpointed

#: Documents that fly in one task, about; those, chosen at random, that a block leaves open for the last.
BLOCK, RESERVE = 20_000, 256
#: A document is drawn before its source's blocks if it has more than this part of its tokens, and before its block's flight if it has more than this part of the
#: smaller documents' there.
OUTLIER, SMALL = 1_000, 50
#: A source's size counts as met within this part of the planned size, or within half its smallest document.
TOLERANCE = 0.001
_EPS = 1e-9


def _step(p: list[float], u: list[float], coin: float) -> list[float]:
    """One move of the probabilities along +u or -u, as far as they stay within 0 and 1; which way keeps them right on average."""
    up = min((((1 - a) if d > 0 else a) / abs(d) for a, d in zip(p, u, strict=True) if d), default=0.0)
    down = min(((a if d > 0 else (1 - a)) / abs(d) for a, d in zip(p, u, strict=True) if d), default=0.0)
    by = up if coin * (up + down) < down else -down
    moved = [a + by * d for a, d in zip(p, u, strict=True)]
    return [0.0 if a < _EPS else 1.0 if a > 1 - _EPS else a for a in moved]


def fly(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase: probabilities of 0 and 1 but for two documents at most, with the same totals of p and p * size. Large documents go first, in
    random order where sizes tie, so that those left open are small."""
    rng = np.random.default_rng(seed)
    order = np.lexsort((rng.random(len(p)), -size)).tolist()
    coins = iter(rng.random(3 * len(p) + 8).tolist())
    out, x = p.astype(float).tolist(), size.astype(float).tolist()
    held: list[int] = []
    for i in order:
        if not _EPS < out[i] < 1 - _EPS:
            out[i] = float(round(out[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = (x[k] for k in held)
            u = [b - c, c - a, a - b]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            for k, v in zip(held, _step([out[k] for k in held], u, next(coins)), strict=True):
                out[k] = v
            held = [k for k in held if 0 < out[k] < 1]
    if len(held) == 2 and x[held[0]] == x[held[1]]:
        for k, v in zip(held, _step([out[k] for k in held], [1.0, -1.0], next(coins)), strict=True):
            out[k] = v
    return np.array(out)


def scaled(p: np.ndarray, size: np.ndarray, want: float) -> np.ndarray:
    """Probabilities, in proportion to the given ones as long as they stay within 1, whose total size is `want` or as near as can be."""
    out, open_ = p.copy(), size > 0
    for _ in range(len(p)):
        rest = want - float((out * size)[~open_].sum())
        now = float((out * size)[open_].sum())
        if now <= 0:
            break
        out[open_] *= max(rest, 0.0) / now
        over = open_ & (out > 1)
        if not over.any():
            break
        out[over], open_ = 1.0, open_ & ~over
    return out


def outliers_first(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Draws the documents that have over 1 / SMALL of the tokens of all smaller ones, largest first, each time scaling the others'
    probabilities to the same total; at least SMALL documents stay open."""
    rng = np.random.default_rng((seed, 1))
    out = p.astype(float).copy()
    order = np.lexsort((np.arange(len(p)), -size))
    after = np.cumsum(size[order][::-1])[::-1] - size[order]
    for k in range(max(len(order) - SMALL, 0)):
        i = order[k]
        if size[i] * SMALL <= after[k]:
            break
        if _EPS < out[i] < 1 - _EPS:
            rest = order[k + 1 :]
            want = float((out[rest] * size[rest]).sum() + out[i] * size[i])
            out[i] = float(rng.random() < out[i])
            out[rest] = scaled(out[rest], size[rest], want - out[i] * size[i])
    return out


def land(p: np.ndarray, size: np.ndarray, want: float | None = None) -> np.ndarray:
    """Decides what flight left open, so that the total size is missed by least, then the number of documents. `want`: the total, if it isn't that of `p`."""
    out = p.copy()
    left = np.flatnonzero((out > 0) & (out < 1))
    open_want, number = float((p[left] * size[left]).sum()), float(p[left].sum())
    if want is not None:
        open_want += want - float((p * size).sum())
    ways = [[(w >> k) & 1 for k in range(len(left))] for w in range(1 << len(left))]
    if len(left):
        out[left] = min(ways, key=lambda w: (abs(float(np.dot(w, size[left])) - open_want), abs(sum(w) - number)))
    return out


def exchanged(copies: np.ndarray, size: np.ndarray, want: float, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Moves copies between `least` and `most` by one document or a pair at a time while that brings the total size nearer to `want`: pairs that keep the number of
    copies before single documents, unless these come much nearer. O(n log n) a move."""
    out = copies.astype(np.int64).copy()
    for _ in range(64):
        miss = want - float((out * size).sum())
        if abs(miss) < 0.5:
            break
        up, down = np.flatnonzero(out < most), np.flatnonzero(out > least)
        found: list[tuple[float, int, list[int], list[int]]] = []  # what is then missed, change of the number of copies, documents up and down
        if len(up) and len(down):
            lows = down[np.argsort(size[down], kind="stable")]
            wanted = size[up] - miss  # the size that should go for each that may come
            at = np.searchsorted(size[lows], wanted)
            for side in (np.minimum(at, len(lows) - 1), np.maximum(at - 1, 0)):
                left = np.abs(size[up] - size[lows[side]] - miss) + np.where(up == lows[side], np.inf, 0)
                k = int(left.argmin())
                found.append((float(left[k]), 0, [int(up[k])], [int(lows[side[k]])]))
        for group, sign in ((up, 1), (down, -1)):
            if len(group):
                left = np.abs(sign * size[group] - miss)
                k = int(left.argmin())
                found.append((float(left[k]), 1, [int(group[k])] if sign > 0 else [], [int(group[k])] if sign < 0 else []))
        found = [x for x in found if x[0] < abs(miss) - 1e-6]
        if not found:
            break
        _, _, come, go = min(found, key=lambda x: (x[0] * (1 + x[1]), x[1]))
        out[come] += 1
        out[go] -= 1
    return out


def decide(p: np.ndarray, size: np.ndarray, base: int, cap: int, want: float, seed: int) -> np.ndarray:
    """The copies of a whole block, 0 and 1 over `base`: outliers, flight, landing, exchange. Only if the total is still missed by more than half the smallest
    document, other numbers up to `cap` too."""
    if not len(p):
        return np.zeros(0, dtype=np.int64)
    p = outliers_first(p, size, seed)
    drawn = np.round(land(fly(p, size, seed), size, want)).astype(np.int64)
    low, high = np.zeros(len(p), dtype=np.int64), np.full(len(p), max(min(1, cap - base), 0))
    drawn = exchanged(np.clip(drawn, low, high), size, want, low, high)
    some = size[size > 0]
    if len(some) and abs(want - float((drawn * size).sum())) > some.min() / 2:
        drawn = exchanged(drawn, size, want, np.full(len(p), -base), np.full(len(p), cap - base))
    return drawn


@dataclass(frozen=True)
class Plan:
    """What is wanted of a source and what it has."""

    source: str | None
    target_share: float
    max_repeats: int
    documents: int
    available: int
    planned: float
    uses: float
    smallest: int = 0

    def status(self, reached: int, smallest: int) -> str:
        """`no_documents`, `short`, `met` or `missed`, by the tokens reached."""
        if not self.documents:
            return "no_documents"
        if self.max_repeats * self.available < self.planned * (1 - 1e-9):
            return "short"
        return "met" if abs(reached - self.planned) <= max(TOLERANCE * self.planned, smallest / 2) + 0.5 else "missed"


def plans(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[Plan]:
    """One for each row of `targets` (source, target_share, max_repeats; a bounded table, a source at most once). total: size of the mixture, by default
    that of all documents of the sources listed."""
    wanted = targets.select("source", "target_share", "max_repeats").collect()
    if len({r["source"] for r in wanted}) != len(wanted):
        raise ValueError("a source has more than one target")
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.min(F.when(F.col("n_tokens") > 0, F.col("n_tokens"))).alias("m"))
    held = {r["source"]: (r["n"], int(r["t"] or 0), int(r["m"] or 0)) for r in by.join(F.broadcast(targets.select(F.col("source").alias("__s"))), F.col("source") == F.col("__s"), "left_semi").collect()}  # at most as many as targets
    whole = float(sum(t for s, (_, t, _) in held.items() if any(s == r["source"] for r in wanted))) if total is None else float(total)
    out = []
    for r in wanted:
        n, t, m = held.get(r["source"], (0, 0, 0))
        planned = (r["target_share"] or 0.0) * whole
        out.append(Plan(r["source"], r["target_share"] or 0.0, r["max_repeats"] or 0, n, t, planned, min(planned / t if t else 0.0, float(r["max_repeats"] or 0)), m))
    return out


def sized(documents: DataFrame, targets: DataFrame, count) -> DataFrame:  # noqa: ANN001
    """(`doc_id`, `source`, `n_tokens`) of the listed sources' documents, computed once; `count` adds n_tokens in place of text."""
    listed = documents.select("doc_id", "source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    return checkpointed(count(listed))


def _seed(*parts: int | str) -> int:
    words = [x for p in parts for x in (p.encode() if isinstance(p, str) else (p,))]
    return int(np.random.SeedSequence(words).generate_state(1)[0])


def _flight(seed: int, level: int):  # noqa: ANN202
    """The flight of one block but for its reserve; the same whenever it is repeated."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ignore_index=True)
        p, size = pdf["p"].to_numpy().copy(), pdf["n_tokens"].to_numpy()
        own = _seed(seed, level, int(pdf["block"].iloc[0]), pdf["source"].iloc[0])
        flying = np.ones(len(p), dtype=bool)
        flying[np.random.default_rng((own, 1)).permutation(len(p))[: min(RESERVE, len(p) // 2)]] = False
        p[flying] = fly(p[flying], size[flying], own)
        return pdf.assign(p=p, copies=np.where(p == 1, 1, 0))

    return run


def _last(seed: int):  # noqa: ANN202
    """The last block of each source: `want` tokens are to be drawn from it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ignore_index=True)
        base, cap, want = (pdf[c].iloc[0] for c in ("base", "cap", "want"))
        drawn = decide(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy().astype(float), int(base), int(cap), float(want), _seed(seed, 99, pdf["source"].iloc[0]))
        return pdf.assign(p=1.0, copies=drawn)

    return run


_COLUMNS = "doc_id bigint, source string, n_tokens bigint, base int, cap int, p double, want double, block int, blocks int, copies bigint"


def mix(sizes: DataFrame, planned: list[Plan], seed: int = 11, block: int = BLOCK) -> DataFrame:
    """The mixture: `doc_id`, `source`, `n_tokens` and `copies` (1 or more, at most max_repeats); a row per document used.

    sizes: doc_id, source, n_tokens. Documents of unlisted sources (null too) aren't used; documents without tokens are balanced in number only.
    Repeated rows are documents of their own. Empty sources and an empty table give no rows.
    """
    spark = sizes.sparkSession
    known = [x for x in planned if x.documents and x.source is not None]
    if not known:
        return sizes.select("doc_id", "source", "n_tokens", F.lit(0).cast("bigint").alias("copies")).limit(0)
    listed = sizes.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))

    # The largest documents of sources that are cut into blocks, fewer than OUTLIER of each, are drawn here.
    cut = [(x.source, -(-x.available // OUTLIER)) for x in known if x.documents > block]
    large = listed.join(F.broadcast(spark.createDataFrame(cut, "source string, over bigint")), "source").where("n_tokens > over").select("doc_id", "source", "n_tokens").collect() if cut else []
    rng, drawn, rows = np.random.default_rng((seed, 7)), [], []
    for x in known:
        base = int(math.floor(x.uses + _EPS))
        p, want = max(x.uses - base, 0.0), x.uses * x.available - base * x.available
        own = sorted(((r["n_tokens"], r["doc_id"]) for r in large if r["source"] == x.source), key=lambda r: (-r[0], str(r[1])))
        over, rest = (own[-1][0] - 1 if own else None), x.available - sum(t for t, _ in own)
        for t, doc in own:
            once = int(rng.random() < p)
            want -= once * t
            drawn.append((doc, x.source, t, base + once))
        scale = min(max(want / rest, 0.0), 1.0) if own and rest else p
        rows.append((x.source, base, x.max_repeats, scale, float(want), max(1, -(-(x.documents - len(own)) // block)), over))
    per = spark.createDataFrame(rows, "source string, base int, cap int, p double, left double, blocks int, over bigint")  # as many rows as sources
    keyed = listed.join(F.broadcast(per), "source").where("over is null or n_tokens <= over")
    spread = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int")
    open_ = keyed.select("doc_id", "source", "n_tokens", "base", "cap", "p", F.col("left").alias("want"), spread.alias("block"), "blocks", F.lit(0).cast("bigint").alias("copies"))

    decided: list[DataFrame] = []
    most, level = max(r[5] for r in rows), 0
    fan = max(2, block // (RESERVE + 2))  # blocks whose undecided documents make one block of the next level
    while most > 1:
        flying = open_.where("blocks > 1").groupBy("source", "block").applyInPandas(_flight(seed, level), _COLUMNS)
        flown = checkpointed(flying)
        done = flown.where("p = 0 or p = 1")
        decided.append(done)
        taken = F.broadcast(done.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")))  # as many rows as sources
        rest = flown.where("p > 0 and p < 1").join(taken, "source", "left").withColumn("want", F.col("want") - F.coalesce("t", F.lit(0))).drop("t")
        rest = rest.withColumns({"block": F.floor(F.col("block") / fan).cast("int"), "blocks": F.ceil(F.col("blocks") / fan).cast("int")})
        open_ = open_.where("blocks = 1").unionByName(rest)
        most, level = -(-most // fan), level + 1
    decided.append(checkpointed(open_.groupBy("source").applyInPandas(_last(seed), _COLUMNS)))
    every = decided[0]
    for x in decided[1:]:
        every = every.unionByName(x)
    out = every.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("copies")).alias("copies"))
    if drawn:
        out = out.unionByName(spark.createDataFrame(drawn, "doc_id bigint, source string, n_tokens bigint, copies bigint"))
    return out.where("copies > 0")


def shares(mixture: DataFrame, planned: list[Plan]) -> DataFrame:
    """One row per target: what was planned and reached in tokens, `deviation` (reached over planned, less 1), and `reached_share` of the mixture's own size.

    `status`, by the tokens reached: `met` (within TOLERANCE of the plan, or half the smallest document), `missed`, `short` (the source's documents at
    max_repeats don't reach its share of the planned total) or `no_documents`.
    """
    by = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("used_documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    counts = ("used_documents", "copies", "reached_tokens", "most_copies")
    got = {r["source"]: tuple(int(r[c]) for c in counts) for r in by.collect()}  # at most as many as targets
    whole = sum(x[2] for x in got.values())
    rows = []
    for x in planned:
        used = got.get(x.source, (0, 0, 0, 0))
        rows.append((x.source, x.target_share, x.max_repeats, x.documents, x.available, x.planned, *used, x.status(used[2], x.smallest), used[2] / x.planned - 1 if x.planned else None, used[2] / whole if whole else None))
    schema = "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint, planned_tokens double, used_documents bigint, copies bigint, reached_tokens bigint, most_copies bigint, status string, deviation double, reached_share double"
    return mixture.sparkSession.createDataFrame(rows, schema)

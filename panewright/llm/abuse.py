"""Scoring documents for abusive, hateful or sexually explicit language.

A linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios. Its unit is the line, as one line makes a document a case
whatever else it holds; the verdicts are on documents and some are wrong. So it is trained in rounds: the ratios come from the documents in which
an n-gram occurs, then each flagged document's highest line stands for it, against the lines of the others that score highest and some at random. A flagged
document none of whose lines stands out is taken for a reviewer's error and left out. A document's score is that of its highest line. The threshold
comes from cross-fitting: models that leave a part of the sample out score that part, and the cut is where verdicts contradict them least.

Scoring works on arrays of code points, a batch at once, with a table of weights of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewright.sources import checkpointed

ORDERS = (2, 3, 4, 5)
BITS = 20
#: Labelled documents and their characters that the classifier is fitted on at most: those with the smallest hashes of their ids, up to a quarter of them
#: flagged, of at most TRAINED_TEXT characters each. A text over that isn't trained on and takes no room from others.
TRAINED_ON, TRAINED_CHARS, TRAINED_TEXT = 10_000, 14_000_000, 100_000
#: Parts that the sample is cut into to find the threshold: each is scored by a model that was fitted on the others.
FOLDS = 3
#: Characters worked on at once.
_CHUNK = 1_000_000
_NEWLINE = 10


#: Cyrillic and Greek letters that look like Latin ones, and what they look like.
_LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ο": "o", "α": "a", "ι": "i", "ν": "v", "к": "k", "н": "h", "т": "t", "м": "m", "в": "b"}
#: Characters that show nothing.
_INVISIBLE = np.array([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF], dtype=np.uint32)
#: Letters that the digits 0 to 9 stand for inside words; digits that stand for none are 0.
_SHAPED = np.array([ord(c) for c in "oi0eas0t00"], dtype=np.uint32)
_LIKE = np.arange(0x500, dtype=np.uint32)
for _from, _to in _LOOKALIKES.items():
    _LIKE[ord(_from)] = ord(_to)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after a line break and one at the end; and where each text's break is.

    Lower case; all digits are one. Disguises are undone: invisible characters, look-alike letters and digits beside Latin letters, letters spaced
    out, and runs of three or more of one character, which become one.
    """
    folded = [t.lower() for t in texts]
    joined = "\n" + "\n".join(folded) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in folded])])
    for _ in range(2):
        odd = np.flatnonzero((codes >= 48) & (codes <= 57))
        near = _latin(codes[odd - 1]) | _latin(codes[odd + 1])
        codes[odd[near]] = _SHAPED[codes[odd[near]] - 48]
    codes[(codes >= 48) & (codes <= 57)] = 48
    codes[codes == 13] = _NEWLINE

    if codes.max(initial=0) > 127:
        codes, starts = _kept(codes, starts, ~np.isin(codes, _INVISIBLE))
        for _ in range(3):
            odd = np.flatnonzero((codes >= 0x370) & (codes < 0x500))
            near = _latin(codes[np.maximum(odd - 1, 0)]) | _latin(codes[np.minimum(odd + 1, len(codes) - 1)])
            codes[odd[near]] = _LIKE[codes[odd[near]]]
    letter = _latin(codes)
    gap = np.flatnonzero(codes[2:-2] == 32) + 2
    spaced = gap[letter[gap - 1] & letter[gap + 1] & ~letter[gap - 2] & (~letter[gap + 2])]
    kept = np.ones(len(codes), dtype=bool)
    kept[spaced] = False
    codes, starts = _kept(codes, starts, kept)
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = (codes[1:] == codes[:-1]) & (codes[1:] != _NEWLINE)
    long = np.zeros(len(codes), dtype=bool)
    long[2:] = again[2:] & again[1:-1]
    long[1:-1] |= long[2:] & again[1:-1]
    return _kept(codes, starts, ~long)


def _latin(codes: np.ndarray) -> np.ndarray:
    return (codes >= 97) & (codes <= 122)


def _kept(codes: np.ndarray, starts: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes kept (line breaks always are), and where the texts' breaks are then."""
    if kept.all():
        return codes, starts
    upto = np.cumsum(kept)
    return codes[kept], upto[starts] - 1


def _features(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order and start position the feature of the n-gram there, or 2**BITS where a line break is inside it (one may be at either end)."""
    breaks = np.cumsum(codes == _NEWLINE, dtype=np.int32)
    h = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = h[: len(codes) - n + 1] * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            f = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int32)
            if n > 2:
                f[breaks[n - 2 : len(codes) - 1] != breaks[: len(f)]] = 1 << BITS
            yield f


def _line_starts(codes: np.ndarray) -> np.ndarray:
    """Positions of the line breaks that lines follow: all but the last."""
    return np.flatnonzero(codes == _NEWLINE)[:-1]


def _line_scores(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines start, and the sum of each line's weights."""
    at = np.zeros(len(codes), dtype=np.float32)
    for f in _features(codes):
        at[: len(f)] += weights[f]
    starts = _line_starts(codes)
    at[-1] = 0
    return starts, np.add.reduceat(at, starts)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _CHUNK:
            yield low, i
            low, held = i, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)


def _pieces(text: str) -> Iterator[str]:
    """The text, or if it is very long its lines in several pieces."""
    while len(text) > _CHUNK and (cut := text.find("\n", _CHUNK)) >= 0:
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


@dataclass(frozen=True)
class Model:
    """Weights by feature (the last is 0, for no feature) and the bias; a line is a case where its score is above 0."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest line's score of each text; an empty one's is the bias."""
        pieces, of = [], []
        for i, t in enumerate(texts):
            for piece in _pieces(t):
                pieces.append(piece)
                of.append(i)
        out = np.full(len(texts), -np.inf)
        for low, high in _chunks(pieces):
            np.maximum.at(out, of[low:high], self._scores(pieces[low:high]))
        return out

    def _scores(self, texts: list[str]) -> np.ndarray:
        codes, doc_starts = _points(texts)
        starts, sums = _line_scores(codes, self.weights)
        first = np.searchsorted(starts, doc_starts[:-1])
        return np.maximum.reduceat(sums, first) + self.bias


def _rows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the chosen lines, one after another, and where each line's begin."""
    lengths = ends[which] - starts[which]
    offsets = np.repeat(starts[which] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    blocks, owner = [], []
    line = np.repeat(np.arange(len(which)), lengths)
    for f in features:
        inside = offsets < len(f)
        blocks.append(f[offsets[inside]])
        owner.append(line[inside])
    flat, of = np.concatenate(blocks), np.concatenate(owner)
    kept = flat < 1 << BITS
    flat, of = flat[kept], of[kept]
    order = np.argsort(of, kind="stable")
    return flat[order], np.searchsorted(of[order], np.arange(len(which)))


def _logistic(flat: np.ndarray, begins: np.ndarray, y: np.ndarray, importance: np.ndarray, ratio: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights (already times the ratios) and bias of a logistic regression on counts scaled by `ratio`; accelerated gradient descent over the
    features that occur."""
    row = np.repeat(np.arange(len(y)), np.diff(np.append(begins, len(flat))))
    told = ratio[flat] != 0
    flat, row = flat[told], row[told]
    number = np.zeros((1 << BITS) + 1, dtype=np.int32)
    used = np.flatnonzero(np.bincount(flat, minlength=len(number)))
    number[used] = np.arange(len(used))
    col = number[flat]
    scale = ratio[used]
    lengths = np.bincount(row, minlength=len(y))
    begins, some = np.cumsum(lengths) - lengths, lengths > 0
    x = scale[col]
    norm = np.sqrt(np.maximum(np.bincount(row, x * x, len(y)), 1e-6)).mean()
    x = (x / norm).astype(np.float32)
    w, b, v, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    total = importance.sum()
    rate = 4.0
    for t in range(steps):
        momentum = t / (t + 3)
        lw, lb = w + momentum * v, b + momentum * vb
        z = np.add.reduceat(np.append(x * lw.astype(np.float32)[col], np.float32(0)), begins) * some + lb
        g = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        gw = np.bincount(col, x * g[row], len(used)) + l2 * lw
        nw, nb = lw - rate * gw, lb - rate * g.sum()
        v, vb, w, b = nw - w, nb - b, nw, nb
    full = np.zeros((1 << BITS) + 1, dtype=np.float32)
    full[used] = w * scale / norm
    return full, float(b)


def fit(texts: list[str], labels: list[bool], rounds: int = 3, hard: int = 2, steps: int = 150, l2: float = 1e-4, seed: int = 7, flagged_weight: float = 0.05, least: int = 2, others: int = 1) -> Model:
    """Trains on documents and verdicts; the threshold is the regression's own. Without flagged or without other documents, no text is a case."""
    y = np.array(labels, dtype=bool)
    if not y.any() or y.all():
        return Model(np.zeros((1 << BITS) + 1, dtype=np.float32), -1.0)
    codes, doc_starts = _points(texts)
    features = list(_features(codes))
    starts = _line_starts(codes)
    ends = np.append(starts[1:], len(codes) - 1)
    doc_of = np.searchsorted(doc_starts, starts, side="right") - 1
    first = np.searchsorted(starts, doc_starts[:-1])

    # In how many flagged and other documents each feature occurs.
    seen = np.zeros((2, (1 << BITS) + 1), dtype=np.float64)
    for i in range(len(texts)):
        low, high = doc_starts[i], doc_starts[i + 1]
        every = np.sort(np.concatenate([f[low : min(high, len(f))] for f in features]))
        seen[int(y[i]), every[np.flatnonzero(np.diff(every, prepend=-1))]] += 1
    rng = np.random.default_rng(seed)
    flagged = np.flatnonzero(y)
    weights, bias, ratio = None, 0.0, None
    random_lines = rng.permutation(np.flatnonzero(~y[doc_of]))[: others * len(texts)]
    for k in range(rounds):
        if ratio is None:
            p, q = (seen[c] + 1.0 for c in (1, 0))
            ratio = np.log((p / (y.sum() + 2)) / (q / ((~y).sum() + 2)))
            ratio[(seen.sum(axis=0) < 3)] = 0
            ratio[-1] = 0
            weights = np.where(ratio > 1, ratio, 0).astype(np.float32)
        at = np.zeros(len(codes), dtype=np.float32)
        for f in features:
            at[: len(f)] += weights[f]
        at[-1] = 0
        sums = np.add.reduceat(at, starts)
        best = np.maximum.reduceat(sums, first) + bias
        top = np.array([first[i] + int(np.argmax(sums[first[i] : (first[i + 1] if i + 1 < len(first) else len(sums))])) for i in range(len(texts))])
        if k == 0:
            positive = flagged
        else:
            # Errors of the reviewers: flagged without a line that stands out.
            positive = flagged[best[flagged] > -1.0]
            if not len(positive):
                positive = flagged
        # Of the others, the highest lines of each document: those that only look like cases must be learnt.
        ranked = np.lexsort((-sums, doc_of))
        place = np.arange(len(ranked)) - first[doc_of[ranked]]
        hardest = ranked[(place < hard) & ~y[doc_of[ranked]]]
        lines = np.unique(np.concatenate([hardest, random_lines]))
        rows = np.concatenate([top[positive], lines])
        target = np.concatenate([np.ones(len(positive)), np.zeros(len(lines))])
        importance = np.where(target == 1, max(1.0, flagged_weight * len(lines) / max(len(positive), 1)), 1.0)
        flat, begins = _rows(codes, starts, ends, rows, features)
        if k:
            # Ratios of the lines themselves, now that they are known.
            of = np.repeat(np.arange(len(rows)), np.diff(np.append(begins, len(flat))))
            pair = np.sort(of.astype(np.int64) << (BITS + 1) | flat)
            pair = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
            hit = pair & ((1 << (BITS + 1)) - 1)
            pos = (pair >> (BITS + 1)) < len(positive)
            p = np.bincount(hit[pos], minlength=(1 << BITS) + 1) + 0.5
            q = np.bincount(hit[~pos], minlength=(1 << BITS) + 1) + 0.5
            ratio = np.log((p / len(positive)) / (q / len(lines)))
            ratio[p + q < least + 1] = 0
        weights, bias = _logistic(flat, begins, target, importance, ratio, l2, steps if k == rounds - 1 else steps // 2)
        weights[-1] = 0
    return Model(weights, bias)


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Where fewest verdicts contradict the scores of documents that the model wasn't fitted on: half way between the two scores there. 0 without flagged
    or without other documents."""
    if not y.any() or y.all():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    ranked = scores[order]
    gain = np.cumsum(np.where(y[order], 1, -1))
    gain[:-1][ranked[:-1] == ranked[1:]] = -len(y)  # ties can't be parted
    k = int(gain.argmax())
    return float((ranked[k] + ranked[min(k + 1, len(y) - 1)]) / 2)


def fit_with_threshold(texts: list[str], labels: list[bool], folds: list[int]) -> Model:
    """`fit` on all, cut where models fitted on the other folds say."""
    y, fold = np.array(labels, dtype=bool), np.array(folds)
    held = np.zeros(len(y))
    for k in set(folds):
        rest = np.flatnonzero(fold != k)
        own = np.flatnonzero(fold == k)
        held[own] = fit([texts[i] for i in rest], y[rest].tolist()).scores([texts[i] for i in own])
    model = fit(texts, labels)
    return Model(model.weights, model.bias - threshold(held, y))


_MODEL = "feature binary, weight binary, bias double"


def _packed(model: Model) -> tuple[bytes, bytes, float]:
    used = np.flatnonzero(model.weights).astype("<i4")
    return used.tobytes(), model.weights[used].astype("<f4").tobytes(), model.bias


def _unpacked(row: Row) -> Model:
    weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
    weights[np.frombuffer(row["feature"], "<i4")] = np.frombuffer(row["weight"], "<f4")
    return Model(weights, row["bias"])


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Writes the model to a folder that must not exist."""
    spark.createDataFrame([_packed(model)], _MODEL).coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    return _unpacked(spark.read.schema(_MODEL).parquet(path).first())


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", verdict: str = "verdict") -> Model:
    """Fits on a bounded sample of the labelled documents (TRAINED_ON, TRAINED_CHARS, TRAINED_TEXT; chosen by hash).

    Several verdicts on a document are counted against each other, and ties are left out; verdicts other than `flag` and `ok`, and on unknown documents or null
    texts, don't count. Without any verdict of either kind, no text is a case; if there are verdicts, but only on texts over TRAINED_TEXT, this raises. Only the
    bounded sample of ids is broadcast, so the texts aren't shuffled. One model is fitted on the whole sample and one on all but each fold, in parallel
    tasks; the scores of the folds left out give the threshold.
    """
    vote = F.when(F.col(verdict) == "flag", 1).when(F.col(verdict) == "ok", -1)
    votes = labels.groupBy(F.col(doc_id).alias("__id")).agg(F.sum(vote).alias("__v")).where("__v <> 0 and __id is not null")
    order = [F.xxhash64("__id"), F.col("__id")]
    flagged = votes.where("__v > 0").orderBy(*order).limit(TRAINED_ON // 4).collect()
    others = votes.where("__v < 0").orderBy(*order).limit(TRAINED_ON - len(flagged)).collect()
    if not flagged or not others:
        return fit([], [])
    kind = labels.schema[doc_id].dataType.simpleString()
    sample = documents.sparkSession.createDataFrame([(r[0], r[1] > 0) for r in [*flagged, *others]], f"__id {kind}, __y boolean")
    short = F.when(F.length("__t") <= TRAINED_TEXT, F.col("__t")).alias("__t")
    known = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where("__t is not null").select("__id", short)
    held = checkpointed(known.join(F.broadcast(sample), "__id"))
    # Texts that are too long take no part in the running sum.
    sized = held.where("__t is not null").select("__id", F.length("__t").alias("n"))
    upto = sized.withColumn("upto", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    chosen = held.where("__t is not null").join(F.broadcast(upto.where(F.col("upto") <= TRAINED_CHARS).select("__id").distinct()), "__id", "left_semi")
    fold = F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    copies = chosen.withColumn("__fold", fold).withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    found = copies.repartitionById(FOLDS + 1, F.col("__task")).mapInPandas(_fit_task, f"task int, {_MODEL}, scores binary, flagged binary").collect()
    if not found:
        if held.where("__t is null").take(1):
            raise ValueError(f"all of the sample's labelled texts have over {TRAINED_TEXT} characters; none can be trained on")
        return fit([], [])
    model = _unpacked(next(r for r in found if r["task"] == FOLDS))
    scores, y = (np.concatenate([np.frombuffer(r[c], kind) for r in found]) for c, kind in (("scores", "<f8"), ("flagged", "?")))
    return Model(model.weights, model.bias - threshold(scores, y))


def _fit_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fit that a partition is for, as the sample is bounded, so that the driver holds no texts: task k leaves fold k out and scores it, the last leaves none
    out."""
    rows = pd.concat([pd.DataFrame({"__id": [], "__t": [], "__y": [], "__fold": [], "__task": []}), *batches]).sort_values(["__id", "__t"], kind="stable")
    for task, own in rows.groupby("__task"):
        yield _fitted(int(task), own)


def _fitted(task: int, rows: pd.DataFrame) -> pd.DataFrame:
    out = rows["__fold"].to_numpy() == task
    model = fit(rows["__t"][~out].tolist(), rows["__y"][~out].tolist())
    scores = model.scores(rows["__t"][out].tolist()) if out.any() else np.zeros(0)
    packed = _packed(model) if task == FOLDS else (b"", b"", model.bias)
    return pd.DataFrame([(task, *packed, scores.astype("<f8").tobytes(), rows["__y"][out].to_numpy(bool).tobytes())], columns=["task", "feature", "weight", "bias", "scores", "flagged"])


def scored(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """`df` without `text` but with `score`; above 0 is a case. Null and empty texts score lowest or nearly so. Rows that repeat stay."""
    if score.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {score} already; rename it first")
    at = df.columns.index(text)
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    fields = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            found = own.scores([t or "" for t in b.column(at).to_pylist()])
            kept = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.float64())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)

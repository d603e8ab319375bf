from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panewright.llm import abuse as a

BAD = ["you absolute {}!", "nobody needs a {} like that", "what a {} he is, throw him out"]
SLUR = ["idiot", "moron", "cretin", "imbecile"]
GOOD = ["fix the {} in the parser", "rename {} to make it clearer", "the {} was left over from the merge", "see {} for the reason"]


def _corpus(n: int, seed: int, wrong: float = 0.0) -> tuple[list[str], list[bool], list[bool]]:
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(["ba", "ke", "lor", "mi", "tan", "vu"]) for _ in range(3))
    texts, truth = [], []
    for _ in range(n):
        lines = [rng.choice(GOOD).format(name()) for _ in range(rng.randint(0, 12))]
        bad = rng.random() < 0.2
        if bad:
            line = rng.choice(BAD).format(rng.choice(SLUR))
            lines.insert(rng.randint(0, len(lines)), line.upper() if rng.random() < 0.1 else line)
        texts.append("\n".join(lines))
        truth.append(bad)
    return texts, truth, [t != (rng.random() < wrong) for t in truth]


def test_held_out_accuracy_with_wrong_verdicts() -> None:
    texts, _, said = _corpus(600, 1, 0.03)
    model = a.fit_with_threshold(texts, said, [i % 3 for i in range(600)])
    test, truth, _ = _corpus(400, 2)
    found = model.scores(test) > 0
    truth = np.array(truth)
    assert (found & truth).sum() / truth.sum() > 0.95 and (found & truth).sum() / found.sum() > 0.9


def test_fit_repeats_exactly_and_copes_with_one_kind() -> None:
    texts, _, said = _corpus(200, 3)
    one, two = (a.fit(texts, said) for _ in range(2))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    for labels in ([True] * 5, [False] * 5):
        assert (a.fit(texts[:5], labels).scores(texts[:5]) < 0).all()
    assert (a.fit([], []).scores(["x", ""]) < 0).all()


def test_disguises_are_undone() -> None:
    plain = lambda t: "".join(map(chr, a._points([t])[0]))
    for t in ("idiot", "IDIOT", "id​iot", "i d i o t", "idiоt", "idiooooot", "1d10t", "1D1OT"):
        assert plain(t) == "\nidiot\n"
    assert plain("полный идиот") == "\nполный идиот\n"
    codes, starts = a._points(["a​b", "", "c\r\nd", "wwww"])
    assert [codes[i] for i in starts] == [10] * 5 and len(starts) == 5


def test_features_stay_within_lines() -> None:
    codes, _ = a._points(["ab", "cd"])
    for n, f in zip(a.ORDERS, a._features(codes), strict=False):
        inside = ["\n" not in "".join(map(chr, codes[i + 1 : i + n - 1])) for i in range(len(f))]
        assert [x < 1 << a.BITS for x in f] == inside


def test_long_texts_are_scored_whole(monkeypatch) -> None:  # noqa: ANN001
    texts, _, said = _corpus(300, 4)
    model = a.fit(texts, said)
    long = "\n".join(["fix the parser"] * 3_000 + ["you absolute idiot!"] + ["see it"] * 3_000)
    whole = model.scores([long, "", "fix"])
    monkeypatch.setattr(a, "_CHUNK", 500)
    assert model.scores([long, "", "fix"]) == pytest.approx(whole) and whole[0] > 0 > whole[2]


def test_tables(spark) -> None:  # noqa: ANN001
    texts, _, said = _corpus(300, 5)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(1000, None, None), (1001, "", "s"), (1001, "", "s")], "doc_id long, text string, source string")
    labels = [(i, "flag" if y else "ok") for i, y in enumerate(said[:250])] + [(0, None), (1, "flag"), (1, "ok"), (None, "flag"), (5_000, "flag")]
    model = a.train(docs, spark.createDataFrame(labels, "doc_id long, verdict string"))
    out = {r["doc_id"]: r["score"] for r in a.scored(docs, model).collect()}
    assert len(out) == 302 and out[1000] <= 0 and out[1001] <= 0
    assert sum((out[i] > 0) == said[i] for i in range(300)) > 290
    none = a.train(docs, spark.createDataFrame([], "doc_id long, verdict string"))
    assert all(r["score"] < 0 for r in a.scored(docs, none).collect())
    assert a.scored(docs.limit(0), model).collect() == []
    with pytest.raises(ValueError, match="already"):
        a.scored(docs.withColumnRenamed("source", "Score"), model)


def test_threshold_contradicts_fewest_verdicts() -> None:
    assert a.threshold(np.array([3.0, 2.0, 1.0, 0.0]), np.array([True, True, False, False])) == 1.5
    assert a.threshold(np.array([1.0, 1.0, 0.0]), np.array([True, False, False])) in (0.0, 0.5)  # a tie isn't parted
    assert a.threshold(np.zeros(3), np.zeros(3, dtype=bool)) == 0.0


def test_long_labelled_texts_take_no_room(spark) -> None:  # noqa: ANN001
    """A text of 20 million characters that comes first by hash leaves the sample as it is without it."""
    texts, _, said = _corpus(200, 6)
    ids = sorted(range(200), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "flag" if y else "ok") for i, y in enumerate(said) if i != ids[0]], "doc_id long, verdict string")
    line = "fix the parser\n"
    long = docs.withColumn("text", F.when(F.col("doc_id") == ids[0], F.repeat(F.lit(line), 20_000_000 // len(line))).otherwise(F.col("text")))
    more = labels.unionByName(spark.createDataFrame([(ids[0], "flag")], labels.schema))
    one, two = a.train(docs, labels), a.train(long, more)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias and one.weights.any()
    with pytest.raises(ValueError, match="over 100000 characters"):
        a.train(docs.withColumn("text", F.repeat(F.lit("x"), 100_001)), labels)


def test_saved_models_are_the_same(spark, tmp_path) -> None:  # noqa: ANN001
    texts, _, said = _corpus(200, 3)
    model = a.fit(texts, said)
    a.save(spark, model, str(tmp_path / "m"))
    again = a.load(spark, str(tmp_path / "m"))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias

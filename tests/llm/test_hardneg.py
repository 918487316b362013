"""Hard negatives against all pairs by hand."""

import math
import random

import numpy as np
import pytest

from askgrid.llm import hardneg
from askgrid.llm.hardneg import hard_negatives, narrowed

SCHEMA = "vec_id long, embedding array<double>, label int, id int, v string, block string"


def by_hand(rows, ask, positives=5, negatives=3, low=50, high=95):
    sound = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in sound if ask(i)}:
        others = [(-score(v, w), j, other) for j, w, other in sound if j != i]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fits = sorted(x for x in others if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, j, k, other, -s, -t) for k, (t, other, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def near_rows(rng, n, width=8, kinds=3):
    """Vectors round a center for each label, some alike, some of fewer components, some unsound."""
    centers = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(kinds)]
    rows = []
    for i in range(n):
        label = rng.randrange(kinds)
        v = [0.3 * x + 0.4 * y + rng.gauss(0, 0.3) for x, y in zip(centers[label], centers[0])]
        v = v[: rng.randint(4, width)] if rng.random() < 0.1 else rows[-1][1] if rows and rng.random() < 0.2 else v
        rows.append((i, v, label, 1, "v", "b"))
    rows += [(900, None, 1, 1, "v", "b"), (901, [1.0, None], 1, 1, "v", "b"), (902, [float("nan")] * 8, 1, 1, "v", "b"), (903, [0.1] * 8, None, 1, "v", "b"), (904, [float("inf")] * 8, 0, 1, "v", "b"), (None, [0.1] * 8, 0, 1, "v", "b"), (905, [], 0, 1, "v", "b")]
    return rows


@pytest.mark.parametrize("seed, size", [(1, 4096), (2, 64)])
def test_against_all_pairs(spark, monkeypatch, seed, size):
    rng = random.Random(seed)
    rows = near_rows(rng, 160)
    monkeypatch.setattr(hardneg, "ANCHORS", 64)
    monkeypatch.setattr(hardneg, "ROWS", size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = by_hand(rows, lambda i: i % 4 == 0)
    assert len(wanted) > 100
    assert sorted(map(tuple, hard_negatives(df, df.where("vec_id % 4 = 0")).collect())) == wanted


def test_ties_repeated_rows_and_empty_tables(spark):
    same = [(i, [0.5, 0.5], i % 2, 1, "v", "b") for i in range(40)] + [(4, [0.5, 0.5], 0, 1, "v", "b")] * 2
    other = [(100 + i, [0.4, 0.4], 1, 1, "v", "b") for i in range(9)]
    df = spark.createDataFrame(same + other, SCHEMA)
    wanted = by_hand(same + other, lambda i: i == 10)
    assert len(wanted) == 15 and [r[1] for r in wanted[::3]] == [0, 2, 4, 4, 4]
    assert sorted(map(tuple, hard_negatives(df, df.where("vec_id = 10")).collect())) == wanted
    none = df.limit(0)
    assert hard_negatives(none, none).collect() == [] == hard_negatives(df, none).collect() == hard_negatives(none, df).collect()
    assert hard_negatives(df.where("label = 1"), df.where("label = 0")).collect() == []


def test_labels_that_are_texts(spark):
    rows = near_rows(random.Random(3), 60)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "concat('kind ', label) AS label")
    assert sorted(map(tuple, hard_negatives(df, df.where("vec_id % 5 = 0")).collect())) == by_hand(rows, lambda i: i % 5 == 0)


def test_intervals_hold_the_score_and_tighten():
    rng = np.random.default_rng(4)
    values, anchors = rng.integers(-200, 200, (50, 12)), rng.integers(-200, 200, (7, 12))
    import pandas as pd

    frame = pd.DataFrame({"block": 0, "id": range(50), "label": 0, "v": list(values)})
    row = hardneg._packed(9, 12, True)(frame).iloc[0].to_dict()
    truth, widths, left = anchors @ values.T, [], []

    def whole(low, high):
        assert (low <= truth).all() and (truth <= high).all()
        widths.append((high - low).max())
        return truth > 20_000

    def single(i, j, low, high):
        assert (low <= truth[i, j]).all() and (truth[i, j] <= high).all()
        left.append(len(i))
        return low > -1 << 60

    i, j, score = narrowed(anchors, hardneg._Rows(row, 9, 12), slice(None), whole, single)
    assert (score == truth[i, j]).all() and set(zip(i, j)) == set(zip(*np.nonzero(truth > 20_000)))
    assert widths == sorted(widths, reverse=True) and left
    with pytest.raises(OverflowError):
        narrowed(np.full((1, 12), 1 << 58), hardneg._Rows(row, 9, 12), slice(None), whole, single)

"""Score evaluation against plain sequential re-statements, on plain and on block plans."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import scores as S
from tidemark.operators.ordered import OrderedRows, exact_quantiles
from pyspark.sql import functions as F

KEYS = ["k"]


def make(seed=3, n=260, ties=True):
    rng = np.random.default_rng(seed)
    out = []
    for k in "abc":
        m = n if k == "a" else n // 8
        label = np.zeros(m, int)
        i = 0
        while i < m:
            i += int(rng.integers(3, 14))
            length = int(rng.integers(1, 9))
            label[i : i + length] = 1
            i += length
        if k == "b":
            label[:3] = 1
        if k == "c":
            label[:] = 0
        score = rng.random(m) + 0.3 * label
        score = score.round(1) if ties else score
        out.append(pd.DataFrame({"k": k, "idx": np.arange(m), "score": score, "label": label}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(params=["plain", "blocks"])
def frame(request, spark):
    pdf = make()
    if request.param == "blocks":
        spark.conf.set("tidemark.hotRows", "60")
    yield spark.createDataFrame(pdf), pdf
    spark.conf.unset("tidemark.hotRows")


def runs(label):
    cuts = np.flatnonzero(np.diff(label)) + 1
    return np.split(np.arange(len(label)), cuts)


def guarded(pred, actual):
    tp, fp, fn = (pred * actual).sum(), (pred * (1 - actual)).sum(), ((1 - pred) * actual).sum()
    p, r = tp / (tp + fp + 1e-5), tp / (tp + fn + 1e-5)
    return 2 * p * r / (p + r + 1e-5)


def adjust(pred, label):
    out = pred.copy()
    for run in runs(label):
        if label[run[0]] and pred[run].any():
            out[run] = 1
    return out


def by_key(df, columns):
    return df.toPandas().set_index("k")[columns].sort_index()


def test_point_adjust_and_latency(frame):
    df, pdf = frame
    got = S.point_adjust(df, KEYS, 1.0, direction=">").toPandas().sort_values(["k", "idx"])
    late = S.detection_latency(df.withColumn("pred", (F.col("score") > 1.0).cast("int")), KEYS).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        pred = (g.score.to_numpy() > 1.0).astype(int)
        want = adjust(pred, g.label.to_numpy())
        assert (got[got.k == k].adj_pred.to_numpy() == want).all()
        if g.label.any():
            filled = sum(int(np.argmax(pred[r])) for r in runs(g.label.to_numpy()) if g.label.to_numpy()[r[0]] and pred[r].any())
            assert late.loc[k, "backfilled"] == filled


def test_best_f1(frame):
    df, pdf = frame
    for how in (False, True):
        got = by_key(S.best_f1(df, KEYS, adjust=how), ["f1", "threshold"])
        for k, g in pdf.groupby("k"):
            label, score = g.label.to_numpy(), g.score.to_numpy()
            units = []
            for run in runs(label):
                if label[run[0]]:
                    units.append(((score[run].max() if how else score[run].min()), len(run), 1))
                else:
                    units += [(score[i], 1, 0) for i in run]
            units.sort(key=lambda u: -u[0])
            p = tp = 0
            best, at = -1, 1
            for s, n, hit in units:
                p, tp = p + n, tp + n * hit
                pr, rc = tp / (p + 1e-5), tp / (label.sum() + 1e-5)
                f1 = 2 * pr * rc / (pr + rc + 1e-5)
                if f1 > best:
                    best, at = f1, s
            assert got.loc[k, "f1"] == pytest.approx(best, abs=1e-12)
            assert got.loc[k, "threshold"] == pytest.approx(at)


def test_grid_f1(frame):
    df, pdf = frame
    got = by_key(S.best_f1_grid(df, KEYS), ["f1", "threshold"])
    for k, g in pdf.groupby("k"):
        best, at = 0, g.score.min()
        for t in g.score.min() + 0.05 * np.arange(int(np.ceil((g.score.max() - g.score.min()) / 0.05))):
            pred = (g.score.to_numpy() > t).astype(int)
            den = pred.sum() + g.label.sum()
            f1 = 2 * (pred * g.label).sum() / den if den else 0
            if f1 > best:
                best, at = f1, t
        assert got.loc[k, "f1"] == pytest.approx(best)
        assert got.loc[k, "threshold"] == pytest.approx(at)


@pytest.mark.parametrize("direction", [">", "<"])
def test_search_threshold(frame, direction):
    df, pdf = frame
    got = by_key(S.search_threshold(df, KEYS, 0.0, 1.28, 64, direction), ["f1", "threshold", "f1_low_fpr"])
    for k, g in pdf.groupby("k"):
        best, at, low = -1, 0, -1
        label = g.label.to_numpy()
        for i in range(64):
            t = (i + 1) * 0.02
            pred = ((g.score > t) if direction == ">" else (g.score < t)).to_numpy().astype(int)
            adj = adjust(pred, label)
            f1 = guarded(adj, label)
            fpr = (adj * (1 - label)).sum() / ((1 - label).sum() + 1e-5)
            if f1 > best:
                best, at = f1, t
            if fpr <= 0.1 and f1 > low:
                low = f1
        assert got.loc[k, "f1"] == pytest.approx(best)
        assert got.loc[k, "threshold"] == pytest.approx(at)
        assert (got.loc[k, "f1_low_fpr"] if low >= 0 else -1) == pytest.approx(low)


def test_parity_row_zero(spark):
    pdf = pd.DataFrame({"k": "x", "idx": range(5), "score": [0.1, 0.9, 0.1, 0.1, 0.2], "label": [1, 1, 1, 0, 0]})
    df = spark.createDataFrame(pdf)
    rows = S.point_adjust(df, KEYS, 0.5, direction=">", parity=True).orderBy("idx").toPandas()
    assert rows.adj_pred.tolist() == [0, 1, 1, 0, 0]
    f1 = S.search_threshold(df, KEYS, 0.5, parity=True).toPandas().f1[0]
    assert f1 == pytest.approx(guarded(np.array([0, 1, 1, 0, 0]), pdf.label.to_numpy()))


def split_windows(label, width):
    """Windows as index arrays, cut at the first normal row of an interruption."""
    out = []
    for a in range(0, len(label), width):
        idx = np.arange(a, min(a + width, len(label)))
        true_runs = [r for r in runs(label[idx]) if label[idx][r[0]]]
        cuts = [r[-1] + 1 for r in true_runs[:-1]]
        out += [idx[p] for p in np.split(np.arange(len(idx)), cuts)]
    return out


def window_reference(pred, label, width):
    state, p_out, l_out = False, [], []
    for idx in split_windows(label, width):
        if label[idx].any():
            if not label[idx[0]]:
                state = False
            state = bool(state or pred[idx].any())
            p_out.append(int(state))
            l_out.append(1)
        else:
            state = False
            p_out.append(int(pred[idx].any()))
            l_out.append(0)
    return np.array(p_out), np.array(l_out)


def test_windows(frame):
    df, pdf = frame
    for width in (3, 5):
        got = by_key(S.window_score(df, KEYS, width, 0.9), ["f1", "tp", "fp", "fn", "tn"])
        for k, g in pdf.groupby("k"):
            p, l = window_reference((g.score > 0.9).to_numpy(), g.label.to_numpy(), width)
            assert got.loc[k, "tp"] == (p * l).sum() and got.loc[k, "fp"] == (p * (1 - l)).sum()
            assert got.loc[k, "f1"] == pytest.approx(guarded(p, l))


def test_tune_on_validation(frame):
    df, pdf = frame
    got = by_key(S.tune_on_validation(df, df, KEYS, 0.0, 1.28, 64, width=4), ["f1", "threshold"])
    for k, g in pdf.groupby("k"):
        best, at = -1, 0.0
        for i in range(64):
            t = (i + 1) * 0.02
            pred = (g.score > t).to_numpy()
            if not (g.label.any() or pred.any()):
                continue
            f1 = guarded(*window_reference(pred, g.label.to_numpy(), 4))
            if f1 > best:
                best, at = f1, t
        at = at or 0.64
        want = guarded(*window_reference((g.score > at).to_numpy(), g.label.to_numpy(), 4))
        assert got.loc[k, "threshold"] == pytest.approx(at)
        assert got.loc[k, "f1"] == pytest.approx(want)


def test_toy_windows(spark):
    label = [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0]
    for pred, want in (([0, 1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0], [1, 1, 0, 1]), ([0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0], [1, 0, 1, 1])):
        df = spark.createDataFrame(pd.DataFrame({"k": "m", "idx": range(12), "pred": pred, "label": label, "score": 0.0}))
        got = S.window_flags(df, KEYS, 3).orderBy("win").toPandas()
        assert got.pred_window.tolist() == want
        assert got.label_window.tolist() == [0, 0, 1, 1]


def test_window_rows(spark):
    label = [0, 0, 1, 1, 1, 1, 0, 0]
    df = spark.createDataFrame(pd.DataFrame({"k": "m", "idx": range(8), "pred": [0, 0, 0, 1, 0, 0, 0, 0], "label": label, "score": 0.0}))
    got = S.window_adjust_rows(df, KEYS, 4).orderBy("idx").toPandas()
    assert got.adj_pred.tolist() == [0, 0, 1, 1, 1, 1, 1, 1]


def test_rows_of_a_task_do_not_grow_with_the_table(spark):
    rows = spark.range(4000).select((F.col("id") % 200).alias("g"), F.col("id").alias("at"), F.lit(1.0).alias("score"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    spark.conf.set("tidemark.taskRows", "100")
    try:
        out = S.index_rows(rows, ["g"], ["at"])
        largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        found = S.pa_k(out, ["g"]).toPandas()
    finally:
        spark.conf.unset("tidemark.taskRows")
    assert largest <= 500  # 4000 rows lay in one task
    plain = S.pa_k(S.index_rows(rows, ["g"], ["at"]), ["g"]).toPandas()
    order = ["g", "k"]
    assert found.sort_values(order).reset_index(drop=True).equals(plain.sort_values(order).reset_index(drop=True))


def test_pa_k(frame):
    df, pdf = frame
    got = S.pa_k(df.withColumnRenamed("k", "g"), ["g"]).toPandas().set_index(["g", "k"])
    for g_name, g in pdf.groupby("k"):
        label, score = g.label.to_numpy(), g.score.to_numpy()
        for k in (20, 40, 60, 80, 100):
            best = 0
            for t in np.unique(score) - 1e-9:
                pred = (score > t).astype(int)
                adj = pred.copy()
                for r in runs(label):
                    if label[r[0]] and pred[r].sum() > k / 100 * len(r):
                        adj[r] = 1
                den = adj.sum() + label.sum()
                best = max(best, 2 * (adj * label).sum() / den if den else 0)
            assert got.loc[(g_name, k), "f1"] == pytest.approx(best), (g_name, k)


def test_adjusted_composite(frame):
    df, pdf = frame
    got = by_key(S.adjusted_composite(df, KEYS), ["auroc", "average_precision", "f1"])
    for k, g in pdf.groupby("k"):
        label, score = g.label.to_numpy(), g.score.to_numpy().copy()
        for r in runs(label):
            if label[r[0]]:
                score[r] = score[r].max()
        pos, neg = score[label == 1], score[label == 0]
        if not len(pos):
            continue
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        ap = prev = 0.0
        for t in np.unique(score)[::-1]:
            tp = (label[score >= t]).sum()
            ap += (tp - prev) / label.sum() * tp / (score >= t).sum()
            prev = tp
        assert got.loc[k, "auroc"] == pytest.approx(auc)
        assert got.loc[k, "average_precision"] == pytest.approx(ap)


def test_align_tail(spark):
    labels = spark.createDataFrame([("a", i, i % 2) for i in range(6)], "k string, idx long, label int")
    scores = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "k string, idx long, score double")
    got = S.align_tail(scores, labels, KEYS).orderBy("idx").toPandas()
    assert got.label.tolist() == [0, 1, 0, 1]


def test_quantiles_and_order(frame):
    df, pdf = frame
    got = by_key(exact_quantiles(df, KEYS, "score", {"p10": 0.1, "p50": 0.5, "p95": 0.95}), ["p10", "p50", "p95"])
    want = pdf.groupby("k").score.quantile([0.1, 0.5, 0.95]).unstack()
    assert np.allclose(got.to_numpy(), want.to_numpy())
    rows = OrderedRows(df, KEYS, ["-score", "idx"]).running_sum(s="label").position("p").previous(v="idx").frame().toPandas()
    for k, g in pdf.groupby("k"):
        o = g.sort_values(["score", "idx"], ascending=[False, True])
        r = rows[rows.k == k].sort_values("p")
        assert (r.idx.to_numpy() == o.idx.to_numpy()).all()
        assert (r.s.to_numpy() == o.label.cumsum().to_numpy()).all()
        assert np.array_equal(r.v.to_numpy(float), o.idx.shift(1).to_numpy(float), equal_nan=True)

"""Evaluation of scores against labels: segments, point adjustment, best F1, PA%K, windows, curves.

A score table has key columns, a position ``idx`` unique inside the key, ``score`` and ``label``.
Higher scores are more anomalous unless a direction is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import join_on
from tidemark.operators.ordered import HotKeys, OrderedRows, find_hot

EPS = 1e-5


# --- positions and segments ----------------------------------------------------------------

def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: HotKeys | None = None) -> DataFrame:
    """Add ``idx``, counted from 0 in the given order."""
    return OrderedRows(df, keys, order, hot).position("idx", start=0).frame()


def align_tail(scores: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores joined with the last labels of their series: both counted from the end."""
    def from_end(df, name):
        rows = OrderedRows(df.select(*keys, "idx", name), keys, ["idx"]).total(_last=F.max("idx")).frame()
        return rows.withColumn("_back", F.col("_last") - F.col("idx")).drop("_last")

    right = from_end(labels, "label").drop("idx")
    return join_on(from_end(scores, "score"), right, [*keys, "_back"]).drop("_back")


def _segmented(df: DataFrame, keys: Sequence[str], hot: HotKeys | None, extra: Sequence[str] = ()) -> OrderedRows:
    """Rows with ``actual`` (0/1) and ``seg``, the number of their run of equal ``actual``."""
    cols = dict.fromkeys([*keys, "idx", "score", "label", *extra])
    rows = df.select(*cols).withColumn("actual", (F.col("label") > 0.1).cast("int"))
    return OrderedRows(rows, keys, ["idx"], hot).runs("actual", "seg")


def _units(df: DataFrame, keys: Sequence[str], hot: HotKeys | None, **aggs: Column) -> DataFrame:
    """True segments as one row each and normal rows as they are, in one pass over the rows.

    Columns: ``hit`` 0/1, ``len`` and the given aggregates.
    """
    rows = _segmented(df, keys, hot).frame()
    unit = F.when(F.col("actual") == 1, F.col("seg")).otherwise(-F.col("idx") - 1)
    grouped = rows.groupBy(*keys, F.col("actual").alias("hit"), unit.alias("_unit"))
    return grouped.agg(F.count(F.lit(1)).alias("len"), *[c.alias(n) for n, c in aggs.items()]).drop("_unit")


def label_segments(df: DataFrame, keys: Sequence[str], hot: HotKeys | None = None) -> DataFrame:
    """Rows with the number of their maximal run of equal labels."""
    return _segmented(df, keys, hot).frame()


def segment_max(df: DataFrame, keys: Sequence[str], hot: HotKeys | None = None) -> DataFrame:
    """``adj_score``: rows of a true segment get the segment's highest score."""
    rows = _segmented(df, keys, hot).per_run("seg", _m=F.max("score")).frame()
    return rows.withColumn("adj_score", F.when(F.col("actual") == 1, F.col("_m")).otherwise(F.col("score"))).drop("_m")


def point_adjust(
    df: DataFrame, keys: Sequence[str], threshold: float | None = None, pred: str | None = None, direction: str = "<",
    parity: bool = False, hot: HotKeys | None = None,
) -> DataFrame:
    """``adj_pred``: one detected row detects its whole true segment.

    The prediction is ``score < threshold`` by default or a given 0/1 column. ``parity`` keeps row 0
    of a series as predicted, as a back-fill that stops at row 1 does.
    """
    if pred is None:
        test = F.col("score") < F.lit(threshold) if direction == "<" else F.col("score") > F.lit(threshold)
        df, pred = df.withColumn("pred", test.cast("int")), "pred"
    rows = _segmented(df, keys, hot, [pred]).per_run("seg", _hit=F.max(pred)).frame()
    lifted = (F.col("actual") == 1) & (F.col("_hit") == 1)
    if parity:
        lifted = lifted & (F.col("idx") > 0)
    return rows.withColumn("adj_pred", F.when(lifted, 1).otherwise(F.col(pred))).drop("_hit")


def detection_latency(df: DataFrame, keys: Sequence[str], pred: str = "pred", parity: bool = False, hot: HotKeys | None = None) -> DataFrame:
    """Back-filled rows per detected segment: ``latency``, ``detected``, ``backfilled`` per key."""
    rows = _segmented(df, keys, hot, [pred]).frame()
    start = F.min(F.greatest("idx", F.lit(1)) if parity else F.col("idx"))
    first = F.min(F.when(F.col(pred) == 1, F.col("idx")))
    segments = rows.where("actual = 1").groupBy(*keys, "seg").agg(F.when(first.isNotNull(), F.greatest(first - start, F.lit(0))).alias("_late"))
    agg = segments.groupBy(*keys).agg(
        F.count("_late").alias("detected"), F.coalesce(F.sum("_late"), F.lit(0)).cast("long").alias("backfilled")
    )
    return agg.withColumn("latency", F.col("backfilled") / (F.col("detected") + F.lit(1e-4)))


# --- confusion -----------------------------------------------------------------------------

def f1_guarded(tp: Column, p: Column, a: Column) -> Column:
    """F1 with the 1e-5 guards; ``p`` predicted, ``a`` actual positives."""
    precision, recall = tp / (p + F.lit(EPS)), tp / (a + F.lit(EPS))
    return F.lit(2.0) * precision * recall / (precision + recall + F.lit(EPS))


def confusion(df: DataFrame, keys: Sequence[str], pred: str = "pred", actual: str = "label") -> DataFrame:
    """Counts, precision, recall, F1 and false positive rate per key, with 1e-5 guards."""
    p, a = F.col(pred).cast("double"), F.col(actual).cast("double")
    counts = df.groupBy(*keys).agg(
        F.sum(p * a).alias("tp"), F.sum((1 - p) * (1 - a)).alias("tn"),
        F.sum(p * (1 - a)).alias("fp"), F.sum((1 - p) * a).alias("fn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("precision", tp / (tp + fp + F.lit(EPS)))
        .withColumn("recall", tp / (tp + fn + F.lit(EPS)))
        .withColumn("f1", f1_guarded(tp, tp + fp, tp + fn))
        .withColumn("fpr", fp / (fp + tn + F.lit(EPS)))
    )


def sequence_score(df: DataFrame, keys: Sequence[str], threshold: float, direction: str = "<", latency: bool = False,
                   parity: bool = False, hot: HotKeys | None = None) -> DataFrame:
    """Point-adjusted confusion at a threshold, with detection latency on demand."""
    adjusted = point_adjust(df, keys, threshold, None, direction, parity, hot)
    out = confusion(adjusted, keys, "adj_pred", "actual")
    if latency:
        late = detection_latency(adjusted, keys, "pred", parity, hot)
        out = join_on(out, late.select(*keys, "latency"), list(keys), "left").withColumn("latency", F.coalesce("latency", F.lit(0.0)))
    return out


# --- best F1 over all cut points -------------------------------------------------------------

def _best(units: OrderedRows, keys: Sequence[str]) -> DataFrame:
    """Largest F1 along units sorted by score; the first maximum wins."""
    cum = units.running_sum(_p="len", _tp=F.col("len") * F.col("hit")).total(_a=F.sum(F.col("len") * F.col("hit"))).frame()
    f1 = f1_guarded(F.col("_tp").cast("double"), F.col("_p").cast("double"), F.col("_a").cast("double"))
    top = F.max(F.struct(f1.alias("f1"), (-F.col("_p")).alias("_o"), F.col("score").alias("threshold"))).alias("_t")
    return cum.groupBy(*keys).agg(top).select(*keys, F.col("_t.f1").alias("f1"), F.col("_t.threshold").alias("threshold"))


def best_f1(
    df: DataFrame, keys: Sequence[str], adjust: bool = False, threshold: float | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Best F1 over all cut points: a true segment is one unit (lowest score, length).

    With ``adjust`` a segment counts with its highest score: the best point-adjusted F1. With a
    ``threshold`` (not 0) the plain F1 of ``score >= threshold`` per row.
    """
    hot = find_hot(df, keys) if hot is None else hot
    if threshold:
        pred = df.withColumn("_p", (F.col("score") >= F.lit(threshold)).cast("long")).withColumn("_l", (F.col("label") > 0.5).cast("long"))
        agg = pred.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("_l")).alias("_tp"), F.sum("_p").alias("_n"), F.sum("_l").alias("_a"))
        f1 = F.coalesce(F.try_divide(2.0 * F.col("_tp"), (F.col("_n") + F.col("_a"))), F.lit(0.0))
        return agg.select(*keys, f1.alias("f1"), F.lit(float(threshold)).alias("threshold"))
    units = _units(df, keys, hot, score=(F.max if adjust else F.min)("score"), end=F.max("idx"))
    return _best(OrderedRows(units, keys, ["-score", "end"], hot), keys)


# --- threshold grids -------------------------------------------------------------------------

def _grid_bin(score: Column, start: Column, step: Column, steps: Column) -> Column:
    """How many grid thresholds ``start + i·step`` (i = 0 … steps-1) lie strictly below ``score``."""
    guess = F.ceil((score - start) / step).cast("long")
    at = lambda i: start + i * step
    # the division may be one off in floating point; the comparison with the threshold decides
    fixed = F.when(at(guess) < score, guess + 1).when(at(guess - 1) >= score, guess - 1).otherwise(guess)
    return F.least(F.greatest(F.coalesce(fixed, F.lit(0)), F.lit(0)), steps).cast("long")


def _suffix_counts(bins: DataFrame, keys: Sequence[str], hot: HotKeys) -> DataFrame:
    """Counts of units above a threshold, per stretch of thresholds with equal counts.

    A stretch runs from threshold ``_j`` to ``_nx - 1`` (null: to the last). ``p`` and ``tp`` count
    the rows and true rows above it, ``n`` and ``a`` all of them. Threshold 0 always starts a stretch.
    """
    binned = bins.groupBy(*keys, "_j").agg(F.sum("_n").alias("_n"), F.sum("_h").alias("_h"))
    rows = OrderedRows(binned, keys, ["_j"], hot).running_sum(_cn="_n", _ch="_h").total(_tn=F.sum("_n"), _th=F.sum("_h"))
    rows = rows.previous(reverse=True, _nx="_j").frame()
    here = F.struct(F.col("_j").alias("_j"), F.col("_nx").alias("_nx"), (F.col("_tn") - F.col("_cn")).alias("p"), (F.col("_th") - F.col("_ch")).alias("tp"))
    start = F.struct(F.lit(0).cast("long").alias("_j"), F.col("_j").alias("_nx"), F.col("_tn").alias("p"), F.col("_th").alias("tp"))
    opens = (F.col("_cn") == F.col("_n")) & (F.col("_j") > 0)  # lowest bin, above threshold 0
    points = F.explode(F.when(opens, F.array(start, here)).otherwise(F.array(here))).alias("_x")
    return rows.select(*keys, points, F.col("_th").alias("a"), F.col("_tn").alias("n")).select(*keys, "_x.*", "a", "n")


def best_f1_grid(df: DataFrame, keys: Sequence[str], step: float = 0.05, hot: HotKeys | None = None) -> DataFrame:
    """Best plain F1 over the thresholds min, min+step, … below max; prediction ``score > t``.

    Rows are counted per grid bin, so no row meets more than one threshold.
    """
    hot = find_hot(df, keys) if hot is None else hot
    ranges = df.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    size = F.lit(float(step))
    rows = join_on(df, ranges, list(keys)).withColumn("_steps", F.ceil((F.col("_hi") - F.col("_lo")) / size).cast("long"))
    bins = rows.select(
        *keys, _grid_bin(F.col("score"), F.col("_lo"), size, F.col("_steps")).alias("_j"),
        F.lit(1).cast("long").alias("_n"), (F.col("label") > 0.5).cast("long").alias("_h"),
    )
    curve = join_on(_suffix_counts(bins, keys, hot), ranges, list(keys))
    steps = F.ceil((F.col("_hi") - F.col("_lo")) / size).cast("long")
    f1 = F.when(F.col("_j") < steps, F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("p") + F.col("a")), F.lit(0.0))).otherwise(F.lit(0.0))
    top = F.max(F.struct(f1.alias("f1"), (-F.col("_j")).alias("_o"), F.col("_lo").alias("lo"))).alias("_t")
    best = curve.groupBy(*keys).agg(top)
    threshold = F.when(F.col("_t.f1") > 0, F.col("_t.lo") + (-F.col("_t._o")) * size).otherwise(F.col("_t.lo"))
    return best.select(*keys, F.col("_t.f1").alias("f1"), threshold.alias("threshold"))


def _search_units(parts: DataFrame, keys: Sequence[str], start: float, end: float | None, steps: int | None, direction: str,
                  max_fpr: float, hot: HotKeys, skip_silent: bool = False) -> DataFrame:
    """Grid search over units (``_s`` score turned so that high is anomalous, ``_n`` rows, ``_hit`` 0/1).

    Units are counted per grid bin; thresholds between two occupied bins share their counts, so only
    the first threshold (in search order) of every such stretch is looked at.
    """
    if end is None or steps is None:
        end, steps = start, 1
    size = (end - start) / steps
    # thresholds in rising order of the turned score; for '<' that is the search order backwards
    first = start + size if direction == ">" else -end
    if size == 0:
        j = (F.col("_s") > F.lit(first)).cast("long")
    else:
        j = _grid_bin(F.col("_s"), F.lit(first), F.lit(size), F.lit(steps).cast("long"))
    bins = parts.select(*keys, j.alias("_j"), F.col("_n").cast("long").alias("_n"), (F.col("_n") * F.col("_hit")).cast("long").alias("_h"))
    curve = _suffix_counts(bins, keys, hot).where(F.col("_j") < F.lit(steps))
    # first threshold of the stretch in search order
    last = F.least(F.coalesce("_nx", F.lit(steps)), F.lit(steps))
    curve = curve.withColumn("_i", F.col("_j") if direction == ">" else F.lit(steps) - last)
    if skip_silent:
        curve = curve.where("a > 0 or p > 0")
    threshold = F.lit(float(start)) + (F.col("_i") + 1) * F.lit(float(size))
    f1 = f1_guarded(F.col("tp").cast("double"), F.col("p").cast("double"), F.col("a").cast("double"))
    fpr = (F.col("p") - F.col("tp")).cast("double") / (F.col("n") - F.col("a") + F.lit(EPS))
    point = F.struct(f1.alias("f1"), (-F.col("_i")).alias("_o"), threshold.alias("threshold"))
    best = curve.groupBy(*keys).agg(F.max(point).alias("_t"), F.max(F.when(fpr <= F.lit(max_fpr), point)).alias("_q"))
    return best.select(*keys, F.col("_t.f1").alias("f1"), F.col("_t.threshold").alias("threshold"),
                       F.col("_q.f1").alias("f1_low_fpr"), F.col("_q.threshold").alias("threshold_low_fpr"))


def _turned(direction: str, score: str = "score") -> Column:
    if direction not in (">", "<"):
        raise ValueError("direction must be '>' or '<'")
    return F.col(score) if direction == ">" else -F.col(score)


def search_threshold(
    df: DataFrame, keys: Sequence[str], start: float, end: float | None = None, steps: int | None = 1, direction: str = ">",
    parity: bool = False, max_fpr: float = 0.1, hot: HotKeys | None = None,
) -> DataFrame:
    """Grid search of the threshold with the best point-adjusted F1.

    Thresholds are ``start + i·(end-start)/steps`` for i = 1 … steps (one threshold ``start`` where
    no end is given). ``f1_low_fpr``/``threshold_low_fpr`` hold the best with a false positive rate
    of at most ``max_fpr``. A true segment enters once, with its extreme score and its length, so
    neither rows nor segments are multiplied with the grid.
    """
    hot = find_hot(df, keys) if hot is None else hot
    high, at_zero = F.max(_turned(direction)), F.max(F.when(F.col("idx") == 0, _turned(direction)))
    units = _units(df, keys, hot, _s=high, _s0=at_zero)
    whole = F.struct(F.col("_s").alias("_s"), F.col("len").alias("_n"))
    if parity:  # row 0 of a true segment stands for itself
        alone = (F.col("hit") == 1) & F.col("_s0").isNotNull()
        rest = F.struct(F.col("_s").alias("_s"), (F.col("len") - 1).alias("_n"))
        row0 = F.struct(F.col("_s0").alias("_s"), F.lit(1).cast("long").alias("_n"))
        parts = units.select(*keys, F.explode(F.when(alone, F.array(rest, row0)).otherwise(F.array(whole))).alias("_x"), "hit")
    else:
        parts = units.select(*keys, whole.alias("_x"), "hit")
    parts = parts.select(*keys, "_x._s", "_x._n", F.col("hit").alias("_hit"))
    return _search_units(parts, keys, start, end, steps, direction, max_fpr, hot)


# --- fixed windows ---------------------------------------------------------------------------

def windows(df: DataFrame, keys: Sequence[str], width: int, score: Column | str = "score", normal: float = 0.0, hot: HotKeys | None = None) -> DataFrame:
    """Windows of ``width`` rows with ``label_window`` (0/1) and ``window_score``.

    A window is predicted at threshold t exactly if its score exceeds t: a normal window has its
    highest row score, a true one the highest so far in its run of windows. A run starts at a window
    that is normal or starts normal, so late detections do not reach back. A window whose true rows
    are interrupted is cut where the interruption starts. No window depends on a threshold, so one
    pass serves a whole threshold grid.
    """
    hot = find_hot(df, keys) if hot is None else hot
    cells = [*keys, "win"]
    value = F.col(score) if isinstance(score, str) else score
    rows = df.select(*keys, "idx", value.cast("double").alias("_s"), (F.col("label") != F.lit(normal)).cast("int").alias("_a"))
    rows = rows.withColumn("win", F.floor(F.col("idx") / F.lit(width)).cast("long"))
    inside = Window.partitionBy(*cells).orderBy("idx")  # at most `width` rows
    whole = Window.partitionBy(*cells)
    before = F.lag("_a", 1, 0).over(inside)
    rows = rows.withColumns({"_up": ((F.col("_a") == 1) & (before == 0)).cast("int"), "_down": ((F.col("_a") == 0) & (before == 1)).cast("int")})
    rows = rows.withColumns({"_ends": F.sum("_down").over(inside), "_runs": F.sum("_up").over(whole)})
    rows = rows.withColumn("piece", F.least(F.col("_ends"), F.greatest(F.col("_runs") - 1, F.lit(0))).cast("long"))
    pieces = rows.groupBy(*cells, "piece").agg(
        F.max("_a").alias("label_window"), F.max("_s").alias("_top"), F.min_by("_a", "idx").alias("_first"),
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min(F.when(F.col("_a") == 1, F.col("idx"))).alias("true_idx"),
    )
    fresh = ((F.col("label_window") == 0) | (F.col("_first") == 0)).cast("long")
    numbered = OrderedRows(pieces, keys, ["start_idx"], hot).running_sum(_run=fresh).frame()
    run_keys = [*keys, "_run"]
    run_hot = find_hot(numbered, run_keys) if hot.any else hot
    # a normal window opens the run of the true windows behind it but lends them no score
    true_top = F.when(F.col("label_window") == 1, F.col("_top"))
    runs = OrderedRows(numbered, run_keys, ["start_idx"], run_hot).running_max(window_score=true_top).frame()
    runs = runs.withColumn("window_score", F.when(F.col("label_window") == 1, F.col("window_score")).otherwise(F.col("_top")))
    return runs.select(*cells, "piece", "start_idx", "end_idx", "true_idx", "window_score", "label_window")


def window_flags(df: DataFrame, keys: Sequence[str], width: int, pred: str = "pred", normal: float = 0.0, hot: HotKeys | None = None) -> DataFrame:
    """Windows with ``pred_window`` and ``label_window``, 0/1, from row predictions."""
    out = windows(df, keys, width, F.col(pred).cast("double"), normal, hot)
    return out.withColumn("pred_window", (F.col("window_score") > 0.5).cast("int")).drop("window_score")


def window_adjust_rows(df: DataFrame, keys: Sequence[str], width: int, pred: str = "pred", normal: float = 0.0, hot: HotKeys | None = None) -> DataFrame:
    """Row predictions raised from the first true row of a detected window to the window's end."""
    detected = window_flags(df, keys, width, pred, normal, hot).where("label_window = 1 and pred_window = 1")
    raised = detected.select(*keys, "win", F.col("true_idx").alias("_from"), F.col("end_idx").alias("_to"))
    spans = raised.groupBy(*keys, "win").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))  # <= width per window
    rows = df.withColumn("win", F.floor(F.col("idx") / F.lit(width)).cast("long"))
    joined = join_on(rows, spans, [*keys, "win"], "left")
    inside = F.exists("_spans", lambda s: (F.col("idx") >= s["_from"]) & (F.col("idx") <= s["_to"]))
    return joined.withColumn("adj_pred", F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(F.col(pred))).drop("_spans", "win")


def window_score(df: DataFrame, keys: Sequence[str], width: int, threshold: float | Column, direction: str = ">",
                 normal: float = 0.0, hot: HotKeys | None = None) -> DataFrame:
    """Confusion over window predictions and window labels at a threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    limit = limit if direction == ">" else -limit
    out = windows(df, keys, width, _turned(direction), normal, hot)
    return confusion(out.withColumn("pred_window", (F.col("window_score") > limit).cast("int")), keys, "pred_window", "label_window")


def tune_on_validation(
    valid: DataFrame, test: DataFrame, keys: Sequence[str], start: float, end: float | None = None, steps: int | None = 1,
    width: int = 15, guess: float | None = None, direction: str = ">", normal: float = 0.0, hot: HotKeys | None = None,
) -> DataFrame:
    """Window-F1 threshold tuned on the validation rows, scored on the hold-out rows.

    The grid is the one of ``search_threshold``. A series with neither true labels nor predictions
    at any threshold uses ``guess`` (the middle of the grid), as does a chosen threshold of 0.
    """
    last = start if end is None or steps is None else end
    fallback = float((start + last) / 2 if guess is None else guess)
    units = windows(valid, keys, width, _turned(direction), normal, hot).select(
        *keys, F.col("window_score").alias("_s"), F.lit(1).alias("_n"), F.col("label_window").alias("_hit"))
    vhot = find_hot(valid, keys) if hot is None else hot
    best = _search_units(units, keys, start, end, steps, direction, 1.0, vhot, skip_silent=True)
    held = windows(test, keys, width, _turned(direction), normal, hot)
    joined = join_on(held, best.select(*keys, F.col("threshold").alias("_t")), list(keys), "left")
    tuned = F.when(F.coalesce("_t", F.lit(0.0)) == 0.0, F.lit(fallback)).otherwise(F.col("_t"))
    joined = joined.withColumn("threshold", tuned)
    limit = F.col("threshold") if direction == ">" else -F.col("threshold")
    flagged = joined.withColumn("pred_window", (F.col("window_score") > limit).cast("int"))
    return confusion(flagged, [*keys, "threshold"], "pred_window", "label_window")


# --- curves over distinct scores -------------------------------------------------------------

def score_curve(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", hot: HotKeys | None = None) -> DataFrame:
    """Cumulative counts at every distinct score, from the highest down.

    ``m``/``h``: rows and true rows with that score; ``p``/``tp``: with at least that score;
    ``n``/``a``: all rows and all true rows of the key.
    """
    groups = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("m"), F.sum((F.col(label) > 0.5).cast("long")).alias("h")
    )
    rows = OrderedRows(groups, keys, ["-score"], find_hot(df, keys) if hot is None else hot)
    return rows.running_sum(p="m", tp="h").total(n=F.sum("m"), a=F.sum("h")).frame()


def best_point_f1(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest plain F1 on a curve, prediction ``score >= threshold``; the highest threshold wins ties."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("p") + F.col("a")), F.lit(0.0))
    top = F.max(F.struct(f1.alias("f1"), F.col("score").alias("threshold"))).alias("_t")
    return curve.groupBy(*keys).agg(top).select(*keys, "_t.f1", "_t.threshold")


def adjusted_composite(df: DataFrame, keys: Sequence[str], hot: HotKeys | None = None) -> DataFrame:
    """AUROC, average precision and best F1 of segment-max scores per key."""
    hot = find_hot(df, keys) if hot is None else hot
    curve = score_curve(segment_max(df, keys, hot), keys, "adj_score", "actual", hot)
    neg_below = (F.col("n") - F.col("a")) - (F.col("p") - F.col("tp"))
    neg_here = F.col("m") - F.col("h")
    pairs = F.sum(F.col("h") * (neg_below + F.lit(0.5) * neg_here))
    auroc = F.try_divide(pairs, (F.first("a") * (F.first("n") - F.first("a"))).cast("double"))
    ap = F.sum(F.try_divide(F.col("h").cast("double"), F.col("a").cast("double")) * F.col("tp") / F.col("p"))
    f1 = F.max(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("p") + F.col("a")), F.lit(0.0)))
    return curve.groupBy(*keys).agg(auroc.alias("auroc"), ap.alias("average_precision"), f1.alias("f1"))


def pa_k(df: DataFrame, keys: Sequence[str], ks: Sequence[int] = (20, 40, 60, 80, 100), hot: HotKeys | None = None) -> DataFrame:
    """Best PA%K F1 per key and k.

    A true segment of length L is taken as detected once more than k % of its rows are, that is once
    the threshold falls below its q-th highest score, q = floor(k·L/100) + 1. So every row of the
    segment counts with the larger of its own score and that score, and PA%K is plain F1 on those.
    """
    hot = find_hot(df, keys) if hot is None else hot
    rows = _segmented(df, keys, hot).frame()
    seg_keys = [*keys, "seg"]
    seg_hot = find_hot(rows, seg_keys) if hot.any else hot
    ranked = OrderedRows(rows, seg_keys, ["-score", "idx"], seg_hot).position("_r").total(_len=F.count(F.lit(1)))
    nth = lambda k: F.max(F.when((F.col("actual") == 1) & (F.floor(F.lit(int(k)) * F.col("_len") / 100) + 1 == F.col("_r")), F.col("score")))
    lifted = ranked.total(**{f"_lift{k}": nth(k) for k in ks}).frame()
    # a normal row has the same score for every k and stands once, a true row once per k: the counts lie side by side.
    # greatest skips nulls: rows without a lift keep their own score
    one = lambda k: F.struct(F.greatest("score", f"_lift{k}").alias("score"), F.lit(int(k)).alias("k"))
    normal = F.array(F.struct(F.col("score").alias("score"), F.lit(None).cast("int").alias("k")))
    spread = lifted.select(*keys, F.explode(F.when(F.col("actual") == 1, F.array(*[one(k) for k in ks])).otherwise(normal)).alias("_t")).select(*keys, "_t.*")
    here = {f"_h{k}": F.count(F.when(F.col("k") == int(k), 1)) for k in ks}
    groups = spread.groupBy(*keys, "score").agg(F.count(F.when(F.col("k").isNull(), 1)).alias("_m"), *[c.alias(n) for n, c in here.items()])
    curve_hot = find_hot(groups, keys) if hot.any else hot
    curve = OrderedRows(groups, keys, ["-score"], curve_hot).running_sum(_p="_m", **{f"_t{k}": f"_h{k}" for k in ks}).total(a=F.sum(f"_h{ks[0]}")).frame()
    top = []
    for k in ks:
        f1 = F.coalesce(F.try_divide(2.0 * F.col(f"_t{k}"), F.col("_p") + F.col(f"_t{k}") + F.col("a")), F.lit(0.0))
        point = F.struct(f1.alias("f1"), F.col("score").alias("threshold"))
        top.append(F.max(F.when(F.col("_m") + F.col(f"_h{k}") > 0, point)).alias(f"_b{k}"))
    best = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"_b{k}").alias("_b")) for k in ks])).alias("_x")
    return curve.groupBy(*keys).agg(*top).select(*keys, best).select(*keys, "_x.k", "_x._b.f1", "_x._b.threshold")


def benchmark_table(results: DataFrame, groups: Sequence[str] = ("dataset", "model", "metric_name"), order: str = "k",
                    values: Sequence[str] = ("metric_value", "metric_param")) -> DataFrame:
    """First result of every (dataset, model, metric), by parameter order."""
    return results.groupBy(*groups).agg(*[F.min_by(v, F.coalesce(F.col(order), F.lit(0))).alias(v) for v in values])

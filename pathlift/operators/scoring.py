"""Score evaluation: KS and AUC, bins, credit metrics, lift, suggestions and stability."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from pathlift.operators.running import running_totals, salted_join
from pathlift.session import cut_lineage

MIN_ROWS = 50
ALL = "all"
HORIZONS = ("fpd1", "fpd7", "fpd15")
RATIO_TIERS = ((0.5, 0.50), (0.8, 0.30), (1.0, 0.15))
MIN_BIN_ROWS = 100


def prepare_sample(df: DataFrame, drop_marks: Sequence[str] = ("flag", "credit_use_type")) -> DataFrame:
    """Drop rows with a ``-1`` label; add the bad flag, the interest amounts and the next-loan flag."""
    for name in drop_marks:
        if name in df.columns:
            df = df.where(F.col(name).cast("string") != "-1")
    return df.withColumns(
        {
            "y_bad": F.expr("int(coalesce(fpd7_fz_dd, 0) > 0)"),
            "curr_interest_amount": F.expr("curr_loan_prin * curr_interest_ratio"),
            "next_interest_amount": F.expr("next_loan_prin * curr_interest_ratio"),
            "has_next": F.expr("int(coalesce(next_loan_prin, 0) > 0)"),
        }
    )


def long_scores(df: DataFrame, keys: Sequence[str], models: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per sample and model with a usable score (> 0, finite)."""
    kept = df.where(" and ".join(f"{k} is not null" for k in keys)) if keys else df
    pairs = ", ".join(f"named_struct('model', '{m}', 'score', cast({m} as double))" for m in models)
    return kept.selectExpr(*keys, *carry, f"inline(array({pairs}))").where(
        "score > 0 and score < double('infinity')"
    )


def with_whole(partial: DataFrame, by: Sequence[str], time_col: str, sums: Sequence[str]) -> DataFrame:
    """Rows of sums per (by, week) and, rolled up from these, over all weeks; ``slice`` names the week or ``all``."""
    base = [F.col(c) for c in by]
    both = partial.groupingSets([[*base, F.col(time_col)], base], *by, time_col).agg(
        F.grouping(time_col).alias("_all"), *[F.sum(c).alias(c) for c in sums])
    return both.withColumn("slice", F.expr(f"if(_all = 1, '{ALL}', string({time_col}))")).drop("_all", time_col)


def score_counts(df: DataFrame, keys: Sequence[str], models: Sequence[str], time_col: str | None = None) -> DataFrame:
    """Good and bad matured rows per (keys, model, distinct score); with ``time_col`` per week and over all weeks."""
    by = [*keys, "model", "score"]
    rows = long_scores(df.where("fpd7_fm_dd = 1"), keys, models, ["y_bad"] + ([time_col] if time_col else []))
    counts = rows.groupBy(*by, *([time_col] if time_col else [])).agg(
        F.expr("count_if(y_bad = 1) as bad"), F.expr("count_if(y_bad = 0) as good"))
    return with_whole(counts, by, time_col, ("bad", "good")) if time_col else counts


def stored_counts(df: DataFrame, keys: Sequence[str], models: Sequence[str], time_col: str | None = None) -> DataFrame:
    """Score counts written once; KS, AUC and quantile edges of the same segments can share them."""
    return cut_lineage(score_counts(df, keys, models, time_col))


def score_curve(
    df: DataFrame, keys: Sequence[str], models: Sequence[str], time_col: str | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Running good and bad counts over the distinct scores of every segment, written once: KS, AUC and edges read it."""
    by = [*keys] + (["slice"] if time_col else [])
    counts = stored_counts(df, keys, models, time_col) if counts is None else counts
    return cut_lineage(running_totals(counts, [*by, "model"], "score", ("bad", "good"), ("model",)))


def ks_auc(
    df: DataFrame, keys: Sequence[str], models: Sequence[str], time_col: str | None = None,
    counts: DataFrame | None = None, curve: DataFrame | None = None, matured: DataFrame | None = None,
) -> DataFrame:
    """Exact KS and AUC per segment and model on matured rows, independent of the score's direction.

    NULL below fifty scored rows, with one class, or with one distinct score; segments with fewer than fifty
    matured rows are left out. ``curve`` and ``matured`` (keys, matured_rows) save reading the sample again.
    """
    by = [*keys] + (["slice"] if time_col else [])
    if curve is None:
        counts = stored_counts(df, keys, models, time_col) if counts is None else counts
        run = running_totals(counts, [*by, "model"], "score", ("bad", "good"), ("model",))
    else:
        run = curve
    if matured is None:
        matured = matured_segments(df, keys, time_col)
    curve = run.groupBy(*by, "model").agg(
        F.max("bad_total").alias("bad"),
        F.max("good_total").alias("good"),
        F.count(F.lit(1)).alias("distinct_scores"),
        F.expr("max(abs((bad_before + bad) / bad_total - (good_before + good) / good_total))").alias("_ks"),
        F.expr("sum(bad * (good_before + good / 2D)) / max(double(bad_total) * good_total)").alias("_auc"),
    )
    ok = f"bad + good >= {MIN_ROWS} and bad > 0 and good > 0 and distinct_scores >= 2"
    figures = curve.selectExpr(
        *by, "model", "bad + good as scored_rows",
        f"if({ok}, _ks, null) as ks", f"if({ok}, greatest(_auc, 1 - _auc), null) as auc",
    )
    return figures.join(matured.where(F.col("matured_rows") >= MIN_ROWS), by)


def matured_segments(df: DataFrame, keys: Sequence[str], time_col: str | None) -> DataFrame:
    rows = df.where("fpd7_fm_dd = 1").where(" and ".join(f"{k} is not null" for k in keys))
    sized = rows.groupBy(*keys, *([time_col] if time_col else [])).agg(F.count(F.lit(1)).alias("matured_rows"))
    return with_whole(sized, keys, time_col, ["matured_rows"]) if time_col else sized


def best_model(figures: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Model with the largest KS, the first listed one on a tie."""
    order = " ".join(f"when '{m}' then {i}" for i, m in enumerate(models))
    return figures.groupBy(*by).agg(
        F.expr(f"max_by(if(ks is null, null, model), struct(coalesce(ks, -1D), -(case model {order} end)))"
               ).alias("best_model"),
        F.max("ks").alias("best_ks"),
    )


def model_effect(df: DataFrame, keys: Sequence[str], models: Sequence[str], time_col: str) -> DataFrame:
    """KS / AUC per model in columns, best model and credit metrics, per week and over all weeks."""
    figures = ks_auc(df, keys, models, time_col)
    by = [*keys, "slice"]
    wide = figures.groupBy(*by).pivot("model", list(models)).agg(F.first("ks").alias("ks"), F.first("auc").alias("auc"))
    best = best_model(figures, by, models)
    return wide.join(best, by).join(credit_metrics_sliced(df, keys, time_col), by, "full_outer")


#: Sums and counts that the credit metrics are made of; sums of parts add up to those of the whole.
SUMS = {
    "cnt": "count(1)", "loans": "count(businessid)", "limits": "count(curr_credit_quota)",
    "matured_rows": "count_if(fpd7_fm_dd = 1)",
    **{f"sum_{c}": f"sum({c})" for c in (
        "curr_credit_quota", "curr_loan_prin", "curr_interest_amount", "curr_total_fee", "next_curr_credit_quota",
        "has_next", "next_loan_prin", "next_interest_amount", "next_total_fee",
        *(f"{h}_{part}_{kind}" for h in HORIZONS for kind in ("dd", "bj") for part in ("fz", "fm")))},
}
METRICS = {
    "cnt": "cnt",
    "avg_limit": "try_divide(sum_curr_credit_quota, limits)",
    "avg_loan": "try_divide(sum_curr_loan_prin, loans)",
    "daily_interest": "try_divide(sum_curr_interest_amount, sum_curr_loan_prin)",
    "total_fee_rate": "try_divide(sum_curr_total_fee, sum_curr_loan_prin)",
    "loan_amount": "sum_curr_loan_prin",
    "next_avg_limit": "try_divide(sum_next_curr_credit_quota, sum_has_next)",
    "next_avg_loan": "try_divide(sum_next_loan_prin, sum_has_next)",
    "next_daily_interest": "try_divide(sum_next_interest_amount, sum_next_loan_prin)",
    "next_total_fee_rate": "try_divide(sum_next_total_fee, sum_next_loan_prin)",
    # Often labelled as the next loan amount; what it sums is the fee.
    "next_total_fee": "sum_next_total_fee",
    "due1_cnt": "cast(sum_fpd1_fm_dd as bigint)",
    **{f"{h}_{kind}": f"try_divide(sum_{h}_fz_{kind}, sum_{h}_fm_{kind})" for h in HORIZONS for kind in ("dd", "bj")},
}


def partial_sums(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sums behind the credit metrics per group; a source column that the table lacks counts as NULL."""
    lacking = {sql[4:-1] for sql in SUMS.values() if sql.startswith("sum(")} - set(df.columns)
    rows = df.withColumns({c: F.lit(None).cast("double") for c in sorted(lacking)}) if lacking else df
    return rows.groupBy(*by).agg(*[F.expr(f"{sql} as {name}") for name, sql in SUMS.items()])


def metrics_of(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Credit metrics out of partial sums: always all of them, NULL where a horizon or fee was not in the table."""
    return sums.selectExpr(*by, *[f"{sql} as {name}" for name, sql in METRICS.items()])


def credit_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = df.where(" and ".join(f"{k} is not null" for k in keys))
    return metrics_of(partial_sums(rows, keys), keys)


def credit_metrics_sliced(df: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    """Credit metrics per week and over all weeks: rows are summed once, to weeks, and weeks to the whole."""
    rows = df.where(" and ".join(f"{k} is not null" for k in keys))
    sums = with_whole(partial_sums(rows, [*keys, time_col]), keys, time_col, list(SUMS))
    return metrics_of(sums, [*keys, "slice"])


def quantile_edges(
    df: DataFrame, keys: Sequence[str], models: Sequence[str], bins: int = 5, counts: DataFrame | None = None,
    curve: DataFrame | None = None,
) -> DataFrame:
    """Inner edges of equal-frequency bins per (keys, model), exact with linear interpolation.

    Positions are looked up in the running counts of distinct scores, so no group is buffered. Edges equal to
    the smallest or largest score and repeated edges drop out. ``curve`` as in ``ks_auc``.
    """
    if curve is None:
        counts = stored_counts(df, keys, models) if counts is None else counts
        sized = counts.withColumn("n", F.col("bad") + F.col("good")).drop("bad", "good")
        run = running_totals(sized, [*keys, "model"], "score", ("n",), ("model",))
    else:
        run = curve.selectExpr(
            *keys, "model", "score", "bad + good as n", "bad_before + good_before as n_before", "bad_total + good_total as n_total")

    def at(position: str) -> str:
        return f"max(if(n_before <= {position} and {position} < n_before + n, score, null))"

    aggs = ["min(score) as _min", "max(score) as _max"]
    for i in range(1, bins):
        pos = f"({i}D / {bins} * (n_total - 1))"
        aggs += [f"{at(f'floor({pos})')} as _a{i}", f"{at(f'ceil({pos})')} as _b{i}",
                 f"max({pos} - floor({pos})) as _f{i}"]
    picked = run.groupBy(*keys, "model").agg(*[F.expr(a) for a in aggs])
    points = ", ".join(f"_a{i} + (_b{i} - _a{i}) * _f{i}" for i in range(1, bins))
    return picked.selectExpr(
        *keys, "model", f"filter(array_distinct(array({points})), e -> e > _min and e < _max) as edges"
    )


def approximate_edges(
    df: DataFrame, keys: Sequence[str], models: Sequence[str], bins: int = 5, accuracy: int = 10_000
) -> DataFrame:
    """Same edges from a mergeable sketch: one aggregate, bounded memory, approximate."""
    points = ", ".join(f"{i / bins}D" for i in range(bins + 1))
    rows = long_scores(df.where("fpd7_fm_dd = 1"), keys, models)
    return rows.groupBy(*keys, "model").agg(
        F.expr(f"percentile_approx(score, array({points}), {accuracy})").alias("_q")
    ).selectExpr(*keys, "model", "filter(array_distinct(_q), e -> e > element_at(_q, 1) and e < element_at(_q, -1)) as edges")


def placed_scores(df: DataFrame, edges: DataFrame, keys: Sequence[str], models: Sequence[str], carry: Sequence[str],
                  whole: bool = False) -> DataFrame:
    """Sample rows per model with their left-closed bin; rows without a usable score drop out.

    All models' edges of a segment are one row, joined before models multiply the rows, which then hold only
    ``carry``. The list is stored, so the planner knows its size: a short one is broadcast and no sample row moves; a
    long one is joined by shuffle, and adaptive execution splits hot segments. ``whole`` adds every row once more
    with NULL as model, for figures of the segment.
    """
    listed = edges.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("model", "edges"))).alias("_edges"))
    kept = df.where(" and ".join(f"{k} is not null" for k in keys)) if keys else df
    joined = kept.join(cut_lineage(listed), list(keys), "left")
    own = [c for c in carry if c not in keys]
    pairs = [f"named_struct('model', '{m}', 'score', cast({m} as double), "
             f"'_e', coalesce(_edges['{m}'], cast(array() as array<double>)))" for m in models]
    if whole:
        pairs.append("named_struct('model', cast(null as string), 'score', cast(null as double), "
                     "'_e', cast(null as array<double>))")
    rows = joined.selectExpr(*keys, *own, f"inline(array({', '.join(pairs)}))").where(
        "(score > 0 and score < double('infinity'))" + (" or model is null" if whole else ""))
    return rows.selectExpr("*", "size(filter(_e, x -> x <= score)) as _k").selectExpr(
        *keys, "model", "score", *own, "_k + 1 as bin_no",
        "if(_k = 0, double('-infinity'), get(_e, _k - 1)) as bin_lo",
        "coalesce(get(_e, _k), double('infinity')) as bin_hi",
    )


def assign_bins(df: DataFrame, edges: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """All columns of the sample per model, with the bin; see ``placed_scores``."""
    return placed_scores(df, edges, keys, models, [c for c in df.columns if c not in models])


def binned_metrics(
    df: DataFrame, edges: DataFrame, keys: Sequence[str], models: Sequence[str], time_col: str,
    curve: DataFrame | None = None,
) -> DataFrame:
    """Credit metrics per bin and slice, lift against the segment's rate in the same slice, best-model flag.

    The sample is read once, to sums per (segment, model, bin, week) and per (segment, week); weeks are rolled up,
    and rates, lifts and matured rows follow from these sums. ``curve`` as in ``ks_auc``.
    """
    bins = [*keys, "model", "bin_no", "bin_lo", "bin_hi"]
    needed = [time_col, "businessid", *[c for c in df.columns if any(f"({c})" in sql or f"({c} " in sql for sql in SUMS.values())]]
    rows = placed_scores(df, edges, keys, models, list(dict.fromkeys(needed)), whole=True)
    weekly = cut_lineage(partial_sums(rows, [*bins, time_col]))
    sums = with_whole(weekly, bins, time_col, list(SUMS))
    segments = sums.where("model is null")
    metrics = metrics_of(sums.where("model is not null"), [*bins, "slice"])
    rate = segments.selectExpr(*keys, "slice", "try_divide(sum_fpd7_fz_dd, sum_fpd7_fm_dd) as segment_fpd7_dd")
    matured = segments.where(F.col("slice") == ALL).select(*keys, "matured_rows")
    curve = score_curve(df, keys, models) if curve is None else curve
    best = best_model(ks_auc(df, keys, models, curve=curve, matured=matured), keys, models).select(*keys, "best_model")
    return metrics.join(rate, [*keys, "slice"], "left").join(best, list(keys), "left").withColumns(
        {
            "fpd7_dd_lift": F.expr("try_divide(fpd7_dd, segment_fpd7_dd)"),
            "is_best_model": F.expr("coalesce(best_model = model, false)"),
        }
    )


def bin_ordinal(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin number by lower edge within (keys, model). A group holds at most the number of bins."""
    w = W.partitionBy(*keys, "model").orderBy("bin_lo")
    return bins.withColumn("bin_ordinal", F.dense_rank().over(w))


def raise_suggestions(binned: DataFrame, keys: Sequence[str], min_rows: int = MIN_BIN_ROWS) -> DataFrame:
    """Per segment the lowest-risk bin of the best model that is large enough, with a raise ratio by risk tier."""
    rows = binned.where(F.col("is_best_model") & (F.col("slice") == ALL))
    segments = rows.groupBy(*keys).agg(
        F.sum("cnt").alias("segment_rows"),
        F.expr("sum(loan_amount) / sum(cnt)").alias("segment_avg_loan"),
        F.expr("sum(avg_limit * cnt) / sum(cnt)").alias("segment_avg_limit"),
    )
    # A segment has a handful of bins; NULL rates sort last.
    w = W.partitionBy(*keys).orderBy(F.asc_nulls_last("fpd7_dd"), F.asc("bin_no"))
    best = rows.where(F.col("cnt") >= min_rows).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    tiers = " ".join(f"when risk_ratio < {cap} then {ratio}D" for cap, ratio in RATIO_TIERS)
    return best.join(segments, list(keys)).selectExpr(
        *keys, "model as best_model", "bin_no", "bin_lo", "bin_hi", "cnt as bin_rows", "segment_rows",
        "avg_loan as bin_avg_loan", "segment_avg_loan", "fpd7_dd as bin_fpd7_dd", "segment_fpd7_dd",
        "if(segment_fpd7_dd > 0, fpd7_dd / segment_fpd7_dd, null) as risk_ratio",
        "avg_limit as bin_avg_limit", "segment_avg_limit",
    ).withColumn("suggested_ratio", F.expr(f"case {tiers} else 0D end"))


def optimal_edges(
    df: DataFrame, keys: Sequence[str], models: Sequence[str], max_bins: int = 5, pre_bins: int = 50,
    min_share: float = 0.01, min_rows: int = 100,
) -> DataFrame:
    """Edges with the largest information value, at most ``max_bins`` bins of at least ``min_share`` of the rows.

    Spark cuts every segment into at most ``pre_bins`` fine bins and counts them; the choice of cuts works on
    those few counts per segment, whatever the number of rows behind them.
    """
    counts = stored_counts(df, keys, models)
    fine = quantile_edges(df, keys, models, pre_bins, counts)
    placed = salted_join(counts, fine, [*keys, "model"], "score").selectExpr(
        *keys, "model", "bad", "good", "size(filter(edges, x -> x <= score)) as fine_no",
        "if(size(filter(edges, x -> x <= score)) = 0, double('-infinity'),"
        " get(edges, size(filter(edges, x -> x <= score)) - 1)) as fine_lo",
    )
    table = placed.groupBy(*keys, "model", "fine_no").agg(
        F.min("fine_lo").alias("fine_lo"), F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    fields = table.select(*keys, "model").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", edges array<double>, iv double"
    names = [*keys, "model"]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fine_no")
        cuts, iv = best_cuts(
            pdf["bad"].to_numpy(float), pdf["good"].to_numpy(float), pdf["fine_lo"].to_numpy(float),
            max_bins, min_share, min_rows,
        )
        return pd.DataFrame([{**{n: pdf[n].iloc[0] for n in names}, "edges": cuts, "iv": iv}])

    return table.groupBy(*names).applyInPandas(choose, schema)


def best_cuts(bad, good, lows, max_bins: int, min_share: float, min_rows: int) -> tuple[list[float], float]:
    """Exact best partition of ordered counts into few intervals by information value (small dynamic program)."""
    import numpy as np

    total_bad, total_good = bad.sum(), good.sum()
    n = len(bad)
    if total_bad + total_good < min_rows or total_bad == 0 or total_good == 0 or n < 2:
        return [], 0.0
    cb, cg = np.concatenate([[0], bad.cumsum()]), np.concatenate([[0], good.cumsum()])
    floor = min_share * (total_bad + total_good)

    def gain(i: int, j: int) -> float:
        b, g = cb[j] - cb[i], cg[j] - cg[i]
        if b + g < floor or b == 0 or g == 0:
            return -np.inf
        pb, pg = b / total_bad, g / total_good
        return (pb - pg) * np.log(pb / pg)

    g = np.array([[gain(i, j) if i < j else -np.inf for j in range(n + 1)] for i in range(n + 1)])
    score, back = {(0, 0): 0.0}, {}
    for k in range(1, max_bins + 1):
        for j in range(1, n + 1):
            options = [(score[(k - 1, i)] + g[i, j], -i) for i in range(j) if (k - 1, i) in score]
            options = [o for o in options if np.isfinite(o[0])]
            if options:
                score[(k, j)], minus_i = max(options)
                back[(k, j)] = -minus_i
    ends = [(score[(k, n)], -k) for k in range(1, max_bins + 1) if (k, n) in score]
    if not ends:
        return [], 0.0
    iv, minus_k = max(ends)
    cuts, k, j = [], -minus_k, n
    while k > 0:
        j, k = back[(k, j)], k - 1
        if j > 0:
            cuts.append(float(lows[j]))
    return sorted(cuts), float(iv)


def score_bins(df: DataFrame, model: str, width: float, bins: int) -> DataFrame:
    """Fixed-width bins of one score with rows and bads."""
    usable = df.where(f"{model} > 0")
    return usable.groupBy(F.expr(f"least(int(floor({model} / {float(width)}D)), {bins - 1})").alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("y_bad").alias("bad")
    )


def psi(base: DataFrame, current: DataFrame, by: str = "bin") -> DataFrame:
    """Population stability per bin with drift in points; empty bins contribute nothing."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.sum("cnt")).scalar()
        return df.select(by, (F.col("cnt") / total).alias(name))

    joined = shares(base, "base_share").join(shares(current, "current_share"), by, "full_outer")
    return joined.selectExpr(
        by, "coalesce(base_share, 0D) as base_share", "coalesce(current_share, 0D) as current_share"
    ).withColumns(
        {
            "drift_points": F.expr("(current_share - base_share) * 100"),
            "psi": F.expr(
                "if(base_share > 0 and current_share > 0,"
                " (current_share - base_share) * ln(current_share / base_share), 0D)"),
        }
    )


def psi_total(contributions: DataFrame) -> DataFrame:
    return contributions.agg(F.sum("psi").alias("psi_total"), F.max(F.abs("drift_points")).alias("largest_drift"))


def gain_table(bins: DataFrame) -> DataFrame:
    """Bad capture and lift by bin, lowest first. The table has one row per bin, hence the global order."""
    total = bins.agg(F.sum("bad").alias("b"), F.sum("cnt").alias("n")).select(F.struct("b", "n")).scalar()
    w = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return bins.withColumn("_t", total).withColumn("_cum", F.sum("bad").over(w)).selectExpr(
        "bin", "cnt", "cnt / _t.n as share", "bad", "bad / cnt as bad_rate",
        "_cum / _t.b as cumulative_capture", "(bad / cnt) / (_t.b / _t.n) as lift",
    )

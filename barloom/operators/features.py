"""The windowed feature stack over bars joined with their market benchmark.

Input: ``<keys>, date, close, volume, net_volume_foreign, vn_close`` (``low`` optional), unique by
key and date. All families come out of one shuffle by key: window passes that share partitioning
and order are stacked, and Catalyst prunes the families a query does not select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.contracts import EPS
from barloom.functions.numbers import finite
from barloom.operators.windows import Ewm, Series, add_ewm, ewm_of_ewm

EWMS = [
    Ewm("ema10", "close", 2 / 11),
    Ewm("ema13", "close", 2 / 14),
    Ewm("ema21", "close", 2 / 22),
    Ewm("ema50", "close", 2 / 51),
    Ewm("ema55", "close", 2 / 56),
    Ewm("ema100", "close", 2 / 101),
    Ewm("vn_ema20", "vn_close", 2 / 21),
    Ewm("gain14", "gain", 1 / 14),
    Ewm("loss14", "loss", 1 / 14),
    Ewm("ewr10", "r", 2 / 11, seed_row=2),
]


def one_index(index_bars: DataFrame, index_id: str | None = None) -> DataFrame:
    """The rows of one benchmark: the one named, or of several the one with most rows (of equals the first by name), so that
    no series is mixed from two."""
    if index_id is not None:
        return index_bars.where(F.col("index_id") == index_id)
    if "index_id" not in index_bars.columns:
        return index_bars
    named = index_bars.groupBy("index_id").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(-F.col("n"), F.col("index_id"))
    chosen = named.agg(F.min_by("index_id", order).alias("index_id"))  # one row
    return index_bars.join(F.broadcast(chosen), "index_id", "left_semi")


def join_benchmark(bars: DataFrame, index_bars: DataFrame, index_id: str | None = None, ordinal: str | None = None) -> DataFrame:
    """Inner join on date with the benchmark, or with the one named ``index_id`` of several (see ``one_index``).

    The benchmark is reduced to one row per calendar day here (of repeats the one with the highest ``ordinal``; without
    one the highest close), a fixed bound of a few megabytes even for centuries, so it is broadcast and bars are not shuffled."""
    daily = one_index(index_bars, index_id).groupBy("date").agg(F.max_by("vn_close", ordinal or "vn_close").alias("vn_close"))
    return bars.join(F.broadcast(daily), "date")


def _log_ratio(now: Column, then: Column) -> Column:
    return F.log(now / F.nullif(then, F.lit(0.0)))


def _relative(value: Column, base: Column) -> Column:
    return (value - base) / (base + EPS)


def add_features(
    bars: DataFrame,
    keys: list[str] | None = None,
    columns: list[str] | None = None,
    low_source: str = "close",
    foreign: bool = True,
) -> DataFrame:
    """Features of the registry except valuation, one wide row per bar; ``columns`` limits them.

    NaN and infinite inputs count as missing, and bars without a close are left out. Formulas ask for intermediate columns by name, and only what was asked for is planned, pass by
    pass from the last to the first.
    """
    keys = keys or ["ticker"]
    s = Series(keys, row_column="rn")
    close, volume, net, vn = (F.col(c) for c in ("close", "volume", "net_volume_foreign", "vn_close"))
    if not foreign:
        bars = bars.withColumn("net_volume_foreign", F.lit(None).cast("double"))
    low = "low" if low_source == "low" else "close"
    samp, pop = F.stddev_samp, F.stddev_pop
    asked: set[str] = set()

    def c(name: str) -> Column:
        asked.add(name)
        return F.col(name)

    raw = {  # windows over the raw columns
        "c1": lambda: s.lag("close"),
        "c10": lambda: s.lag("close", 10),
        "c14": lambda: s.lag("close", 14),
        "c20": lambda: s.lag("close", 20),
        "c30": lambda: s.lag("close", 30),
        "v1": lambda: s.lag("volume"),
        "vn1": lambda: s.lag("vn_close"),
        "bb_mid": lambda: s.roll("close", 20, F.avg),
        "bb_std": lambda: s.roll("close", 20, pop),
        "max60": lambda: s.roll("close", 60, F.max),
        "min60": lambda: s.roll("close", 60, F.min),
        "max252": lambda: s.roll("close", 252, F.max),
        "min252": lambda: s.roll("close", 252, F.min),
        "low20": lambda: s.roll(low, 20, F.min),
        "path60": lambda: s.roll("close", 60, F.collect_list),
        "v_mean20": lambda: s.roll("volume", 20, F.avg),
        "v_sum5": lambda: s.roll("volume", 5, F.sum),
        "n_sum5": lambda: s.roll("net_volume_foreign", 5, F.sum),
        "n_mean20": lambda: s.roll("net_volume_foreign", 20, F.avg),
        "n_std20": lambda: s.roll("net_volume_foreign", 20, samp),
    }
    row_wise = {
        "r": lambda: _log_ratio(close, c("c1")),
        "vn_r": lambda: _log_ratio(vn, c("vn1")),
        # the first bar counts as no change, so the smoothing starts at 0
        "gain": lambda: F.greatest(F.coalesce(close - c("c1"), F.lit(0.0)), F.lit(0.0)),
        "loss": lambda: F.greatest(F.coalesce(c("c1") - close, F.lit(0.0)), F.lit(0.0)),
        "step": lambda: F.abs(close - c("c1")),
        "dv": lambda: close * volume,
        # position of the first lowest close of the window
        "days60": lambda: 60 - F.array_position(c("path60"), F.array_min(c("path60"))),
    }
    row_wise_2 = {
        "rel": lambda: c("r") - c("vn_r"),
        "fall": lambda: F.when(c("r") < 0, c("r")).otherwise(0.0),
        "impact": lambda: F.abs(c("r")) / (c("dv") + EPS),
    }
    derived = {  # windows over returns and smoothings
        "vol20": lambda: s.roll(c("r"), 20, samp),
        "r_std60": lambda: s.roll(c("r"), 60, samp),
        "r14": lambda: s.lag(c("r"), 14),
        "vn_vol20": lambda: s.roll(c("vn_r"), 20, samp),
        "rs10": lambda: s.roll(c("rel"), 10, F.avg),
        "step10": lambda: s.roll(c("step"), 10, F.sum),
        "step20": lambda: s.roll(c("step"), 20, F.sum),
        "step30": lambda: s.roll(c("step"), 30, F.sum),
        "dv_mean20": lambda: s.roll(c("dv"), 20, F.avg),
        "dv_mean60": lambda: s.roll(c("dv"), 60, F.avg),
        "dv_std60": lambda: s.roll(c("dv"), 60, samp),
        "impact20": lambda: s.roll(c("impact"), 20, F.avg),
        "fall_std20": lambda: s.roll(c("fall"), 20, samp),
        "low20_prior": lambda: s.lag(c("low20"), 20),
        "ema13_1": lambda: s.lag(c("ema13")),
    }
    volatility = {
        "vol_mean60": lambda: s.roll(c("vol20"), 60, F.avg),
        "vol_std60": lambda: s.roll(c("vol20"), 60, samp),
    }
    passes = [raw, row_wise, row_wise_2, EWMS, derived, volatility]

    def upper() -> Column:
        return c("bb_mid") + 2 * c("bb_std")

    def lower() -> Column:
        return c("bb_mid") - 2 * c("bb_std")

    def macd() -> Column:
        return c("ema10") - c("ema50")

    def macd_signal() -> Column:
        slow = c("ema100")
        return ewm_of_ewm(100, 10, slow, c("ema10")) - ewm_of_ewm(100, 50, slow, c("ema50"))

    def drawdown() -> Column:
        return close / (c("max60") + EPS) - 1

    def recovered() -> Column:
        return close / (c("min60") + EPS) - 1

    def efficiency(rows: int) -> Column:
        return F.abs(close - c(f"c{rows}")) / (c(f"step{rows}") + EPS)

    def flow(value) -> Column:
        return value() if foreign else F.lit(0.0)

    features = {
        # baseline
        "Log_Return": lambda: c("r"),
        "RSI_14": lambda: 100 - 100 / (1 + c("gain14") / (c("loss14") + EPS)),
        "Momentum_14": lambda: close - c("c14"),
        "EMA_13": lambda: c("ema13"),
        "EMA_21": lambda: c("ema21"),
        "EMA_13_21_Cross": lambda: _relative(c("ema13"), c("ema21")),
        "Dist_EMA_13": lambda: _relative(close, c("ema13")),
        "MACD_10_50": macd,
        "MACD_Signal_100": macd_signal,
        "MACD_Hist_Custom": lambda: macd() - macd_signal(),
        "BB_Mid": lambda: c("bb_mid"),
        "BB_Std": lambda: c("bb_std"),
        "BB_Upper": upper,
        "BB_Lower": lower,
        "Dist_BB_Upper": lambda: _relative(close, upper()),
        "Dist_BB_Lower": lambda: _relative(close, lower()),
        "Volatility": lambda: c("vol20"),
        "VN_Return": lambda: c("vn_r"),
        "VN_Volatility": lambda: c("vn_vol20"),
        "Relative_Strength": lambda: c("rel"),
        "RS_Trend": lambda: c("rs10"),
        "VN_EMA20": lambda: c("vn_ema20"),
        "Market_Distance_EMA": lambda: _relative(vn, c("vn_ema20")),
        "Foreign_Net_5D": lambda: flow(lambda: c("n_sum5")),
        "Foreign_Net_20D_Mean": lambda: flow(lambda: c("n_mean20")),
        "Foreign_Net_20D_Std": lambda: flow(lambda: c("n_std20")),
        "Foreign_Mutation": lambda: flow(lambda: (net - c("n_mean20")) / (c("n_std20") + EPS)),
        # momentum
        "Abs_Momentum_14": lambda: close - c("c14"),
        "Log_Momentum_14": lambda: F.log(close / (c("c14") + EPS)),
        "EWM_Return_10": lambda: c("ewr10"),
        "Momentum_Dropoff_14": lambda: c("r14"),
        "Momentum_Dropoff_Z_14": lambda: F.abs(c("r14")) / (c("r_std60") + EPS),
        # trend quality
        "EMA_55": lambda: c("ema55"),
        "EMA_13_Slope": lambda: c("ema13") / F.nullif(c("ema13_1"), F.lit(0.0)) - 1,
        "EMA_21_55_Gap": lambda: _relative(c("ema21"), c("ema55")),
        "ER_10": lambda: efficiency(10),
        "BB_Position": lambda: (close - c("bb_mid")) / (2 * c("bb_std") + EPS),
        # volume
        "Volume_Ratio_20": lambda: volume / (c("v_mean20") + EPS),
        "Log_Volume_Change": lambda: F.log((volume + EPS) / (c("v1") + EPS)),
        "Foreign_Net_5D_Ratio": lambda: flow(lambda: c("n_sum5") / (c("v_sum5") + EPS)),
        # recovery
        "Drawdown_60": drawdown,
        "Distance_52W_High": lambda: close / (c("max252") + EPS) - 1,
        "Distance_52W_Low": lambda: close / (c("min252") + EPS) - 1,
        # recovery quality; comparisons with a missing side are false, never null
        "Recovery_20_From_60D_Low": recovered,
        "Recovery_Slope_10": lambda: (close / F.nullif(c("c10"), F.lit(0.0)) - 1) / 10,
        "Days_Since_60D_Low": lambda: c("days60").cast("double"),
        "Reclaim_EMA55": lambda: F.coalesce(close > c("ema55"), F.lit(False)).cast("double"),
        "Dist_EMA55": lambda: _relative(close, c("ema55")),
        "Higher_Low_20": lambda: F.coalesce(c("low20") > c("low20_prior"), F.lit(False)).cast("double"),
        "Drawdown_Recovery_Ratio": lambda: recovered() / (F.abs(drawdown()) + EPS),
        # liquidity and cost
        "Dollar_Volume": lambda: c("dv"),
        "Log_Dollar_Volume": lambda: F.log(c("dv") + EPS),
        "Dollar_Volume_Z_60": lambda: (c("dv") - c("dv_mean60")) / (c("dv_std60") + EPS),
        "Volume_Dry_Up_20": lambda: volume / (c("v_mean20") + EPS),
        "Amihud_Illiquidity_20": lambda: c("impact20"),
        "Liquidity_Shock_20": lambda: c("dv") / (c("dv_mean20") + EPS),
        # noise
        "Volatility_Z_60": lambda: (c("vol20") - c("vol_mean60")) / (c("vol_std60") + EPS),
        "Downside_Volatility_20": lambda: c("fall_std20"),
        "Trend_Efficiency_20": lambda: efficiency(20),
        "ER_20": lambda: efficiency(20),
        "ER_30": lambda: efficiency(30),
    }
    wanted = features if columns is None else [n for n in dict.fromkeys(columns) if n in features]
    output = [features[name]().alias(name) for name in wanted]

    planned = []
    for step in reversed(passes):
        if step is EWMS:
            chosen = [e for e in EWMS if e.name in asked]
            asked.update(e.source for e in chosen)
        else:
            chosen = {name: make() for name, make in step.items() if name in asked}
        planned.append(chosen)
    # finite inputs keep every formula finite: denominators carry an epsilon, logs of nothing are null
    inputs = [name for name in ("close", "low", "volume", "net_volume_foreign", "vn_close") if name in bars.columns]
    df = bars.withColumns({name: finite(F.col(name)) for name in inputs})
    df = df.where("close IS NOT NULL AND vn_close IS NOT NULL")
    if any(planned):
        df = df.withColumn("rn", s.row_number())
    for step in reversed(planned):
        if isinstance(step, list):
            df = add_ewm(df, s, step, "rn") if step else df
        elif step:
            df = df.withColumns(step)
    return df.select(
        *keys,
        "date",
        close.alias("Close"),
        volume.alias("Volume"),
        net.alias("Net_Volume_Foreign"),
        vn.alias("VN_Close"),
        *output,
    )

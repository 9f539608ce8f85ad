"""Random bar series for brute-force comparisons."""

import numpy as np
import pandas as pd


def make_bars(tickers: int = 2, rows: int = 400, seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frames = []
    for t in range(tickers):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, rows)))
        frames.append(pd.DataFrame({
            "ticker": f"T{t}",
            "date": pd.date_range("2000-01-03", periods=rows, freq="D").date,
            "close": close,
            "low": close * (1 - rng.uniform(0, 0.02, rows)),
            "volume": rng.integers(1000, 9000, rows).astype(float),
            "net_volume_foreign": rng.integers(-500, 500, rows).astype(float),
            "vn_close": 900 * np.exp(np.cumsum(rng.normal(0, 0.01, rows))),
        }))
    return pd.concat(frames, ignore_index=True)

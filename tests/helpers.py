import math

import numpy as np
import pandas as pd

EPOCH = pd.Timestamp("2000-01-01")


def km(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(a))


def swarm(n, seed=0, minutes=600, spread=0.6):
    """Dense random reports of a few agencies, with exact copies."""
    rng = np.random.default_rng(seed)
    sec = rng.integers(0, minutes * 60, n)
    df = pd.DataFrame({
        "event_id": [f"e{i:05d}" for i in range(n)], "time": [EPOCH + pd.Timedelta(seconds=int(s)) for s in sec],
        "lat": np.round(rng.uniform(-spread, spread, n), 3), "lon": np.round(120 + rng.uniform(-spread, spread, n), 3), "depth": 10.0,
        "magnitude": np.round(4 + rng.exponential(0.4, n), 1), "mag_type": "mb", "source": rng.choice(["usgs", "emsc", "bmkg"], n), "place": "x"})
    copies = df.iloc[: n // 5].assign(event_id=[f"c{i:05d}" for i in range(n // 5)], source="bmkg")
    return pd.concat([df, copies], ignore_index=True)


def frame(spark, pdf):
    out = pdf.copy()
    out["time"] = out["time"].dt.tz_localize("UTC")
    return spark.createDataFrame(out)

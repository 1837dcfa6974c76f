"""Input series of the tests."""

import datetime as dt

import numpy as np

# The public monthly airline passenger series, 1949-01 to 1960-12.
AIRLINE = [
    112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140,
    145, 150, 178, 163, 172, 178, 199, 199, 184, 162, 146, 166, 171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194,
    196, 196, 236, 235, 229, 243, 264, 272, 237, 211, 180, 201, 204, 188, 235, 227, 234, 264, 302, 293, 259, 229, 203, 229,
    242, 233, 267, 269, 270, 315, 364, 347, 312, 274, 237, 278, 284, 277, 317, 313, 318, 374, 413, 405, 355, 306, 271, 306,
    315, 301, 356, 348, 355, 422, 465, 467, 404, 347, 305, 336, 340, 318, 362, 348, 363, 435, 491, 505, 404, 359, 310, 337,
    360, 342, 406, 396, 420, 472, 548, 559, 463, 407, 362, 405, 417, 391, 419, 461, 472, 535, 622, 606, 508, 461, 390, 432,
]


def month(i: int, year: int = 2020) -> dt.datetime:
    return dt.datetime(year + i // 12, i % 12 + 1, 1)


def generators() -> dict[str, list[float]]:
    """Monthly synthetic series by name; every one uses its own seeded stream."""
    def rng():
        return np.random.default_rng(42)

    t = np.arange(48)
    out = {
        "constant": np.full(24, 100.0),
        "near_constant": 50 + rng().normal(0, 0.01, 24),
        "random_walk": np.cumsum(rng().normal(0, 1, 60)),
        "additive_seasonal": 50 + 10 * np.sin(2 * np.pi * t / 12) + rng().normal(0, 1, 48),
        "multiplicative_seasonal": 50 * (1 + 0.3 * np.sin(2 * np.pi * t / 12)) * (1 + rng().normal(0, 0.01, 48)),
        "trend": 10 + 2 * t + rng().normal(0, 1, 48),
        "zeros": np.zeros(24),
        "negative_values": rng().normal(0, 5, 36),
        "short_seasonal": 50 + rng().normal(0, 2, 13),
    }
    noise = rng().normal(0, 1, 60)
    ar = np.zeros(60)
    for i in range(1, 60):
        ar[i] = 0.7 * ar[i - 1] + noise[i]
    out["stationary_ar"] = ar
    spikes = 50 + rng().normal(0, 1, 48)
    spikes[10] += 30
    spikes[30] -= 25
    out["isolated_anomalies"] = spikes
    g = rng()
    out["structural_break"] = np.concatenate([20 + g.normal(0, 1, 24), 60 + g.normal(0, 1, 24)])
    return {k: [float(x) for x in v] for k, v in out.items()}


SCHEMA = "series_id string, t long, ts timestamp_ntz, value double"


def panel(spark, series: dict[str, list]):
    rows = [(name, i, month(i), None if v is None else float(v)) for name, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)

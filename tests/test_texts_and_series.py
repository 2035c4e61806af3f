"""Values of the text rules and of the weighted mean, worked out by hand or with pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import series as O


def test_pairs_of_years(spark):
    cases = [([2016], (2016, 2026)), ([1984, 2030], (1990, 2026)), ([2026], (2017, 2026)), ([], (2017, 2026)), ([2026, 2026], (2025, 2026))]
    df = spark.createDataFrame([(c,) for c, _ in cases], "y array<int>").select(T.year_pair(F.col("y"), 2017, 2026).alias("p"))
    got = [tuple(r.p) for r in df.collect()]
    assert [g[:2] for g in got] == [w for _, w in cases]
    assert "moved" in got[1][2] and got[0][2] == ""


def test_kinds_of_failed_reads(spark):
    late, soon = "2024-01-14 00:00:00", "2024-01-16 00:00:00"
    cases = [
        ("Read failed. Request for 1-2 failed with response_code=206", None, True, ("truncated", 206)),
        ("VSICURL: x: response_code=206, msg=Operation timed out after 30001 ms", None, True, ("timeout", 206)),
        ("response_code=206, msg=Operation too slow.", None, True, ("stalled", 206)),
        ("Read error at row 1; got 216922 bytes, expected 453364", None, True, ("truncated", None)),
        ("failed with response_code=0", None, True, ("network", 0)),
        ("HTTP response code: 409", None, True, ("forbidden", 409)),
        ("HTTP response code: 404\nRequest for 1-2 failed with response_code=206", None, True, ("not_found", 404)),
        ("HTTP error code: 503 - ServerBusy", late, True, ("throttled", 503)),
        ("HTTP error code for x.tif range 0-99: 502. Retrying", None, True, ("server", 502)),
        ("a\n504: gateway", None, True, ("server", 504)),
        ("ZIPDecode:Decoding error at scanline 0", None, True, ("decode", None)),
        ("x.tif: not recognized", None, True, ("io", None)),
        ("operands could not be broadcast together", None, False, ("error", None)),
        ("HTTP response code: 403", late, True, ("expired", 403)),
        ("HTTP response code: 403", soon, True, ("forbidden", 403)),
        ("Read failed.", late, True, ("expired", None)),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "m string, e string, r boolean")
    status = T.read_status(F.col("m"))
    kind = T.read_kind(F.col("m"), status, F.col("e").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"), F.col("r"))
    assert [(r.k, r.s) for r in df.select(kind.alias("k"), status.alias("s")).collect()] == [c[3] for c in cases]


def test_the_weighted_mean_takes_the_whole_history(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(0.3, 20, 2500)
    days = pd.date_range("2001-01-01", periods=len(x)).date
    rows = [(k, d, float(v * s)) for k, s in (("a", 1.0), ("b", 1e-3)) for d, v in zip(days, x)]
    df = spark.createDataFrame(rows, "cell string, date date, rain double")
    for half in (0.7, 3.0, 90.0):
        got = O.ewm(df, "cell", "rain", half).where("cell = 'a'").orderBy("date").toPandas()["ewm"].to_numpy()
        assert np.allclose(got, pd.Series(x).ewm(halflife=half, adjust=False).mean().to_numpy(), rtol=1e-12)

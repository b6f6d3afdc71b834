"""Percentile ranks in bands of groups against brute force."""

import random

import pytest

from tallyloom.operators import windows


@pytest.mark.parametrize("k", [0, 2])
def test_bands_are_written_once_and_ranked(spark, monkeypatch, k):
    written, stored = [], windows.stored
    monkeypatch.setattr(windows, "stored", lambda df, label: written.append(label) or stored(df, label))
    rng = random.Random(7)
    rows = [(i, rng.randrange(9), rng.choice([None, *range(12)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    got = {r.id: r.p for r in windows.ecdf_band(df, "g", "v", k, name="p").collect()}
    assert written == ["bands"]
    for i, g, v in rows:
        if v is None:
            assert got[i] is None
            continue
        band = [x for _, h, x in rows if x is not None and abs(h - g) <= k]
        rank = {x: sum(y < x for y in band) + (band.count(x) + 1) / 2 for x in set(band)}
        assert got[i] == rank[v] / max(rank.values())

from __future__ import annotations

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from cartolith.operators import overlaps

SCHEMA = "id bigint, west double, south double, east double, north double"
BOX = ("west", "south", "east", "north")


def _boxes(n):
    rnd, out = random.Random(5), []
    for i in range(n):
        size = rnd.choice([0.0, 1e-3, 0.02, 0.3, 1.0, 5.0, 90.0])
        place = (11.25, 45.0) if i % 2 else (-20.0, 30.0)
        # Steps of a 64th make boxes that touch, and boxes that end on the sides of cells.
        w, s = place[0] + rnd.randrange(64) / 64, place[1] + rnd.randrange(64) / 64
        out.append((rnd.randrange(n) * (1 << 33), w, s, w + size * rnd.choice([0.5, 1.0]), s + size))
    return out


def _brute(rows):
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] < b[3] and a[3] > b[1] and a[2] < b[4] and a[4] > b[2]:
                n, first = want.get(a[0], (0, b[0]))
                want[a[0]] = (n + 1, min(first, b[0]))
    return want


@pytest.mark.parametrize("crowded, small, slice_", [(60_000, 192, 1 << 18), (60_000, 0, 700), (37, 192, 1 << 18), (37, 3, 90)])
def test_later_overlaps_are_those_of_all_pairs(spark, monkeypatch, crowded, small, slice_):
    rows = _boxes(600)
    odd = [(None, 11.0, 45.0, 12.0, 46.0), (7, None, 45.0, 12.0, 46.0)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).select("id", *BOX)
    table = frame.toPandas().dropna().sort_values("id", kind="stable")
    # Workers have no patched constants, so sizes of a task are tried on one group's rows in this process.
    if (small, slice_) != (192, 1 << 18):
        monkeypatch.setattr(overlaps, "_SMALL", small)
        monkeypatch.setattr(overlaps, "_SLICE", slice_)
        n = len(table)
        group = {name: np.zeros(n, np.int64) for name in overlaps._GROUP}
        group |= dict(zip(("_id", "w", "s", "e", "n"), (table[c].to_numpy() for c in ("id", *BOX))))
        group["_id"] = group["_id"].astype("int64")
        group |= {"in_x": np.ones(n, bool), "in_y": np.ones(n, bool), "_at_home": np.ones(n, bool), "right": np.arange(n) % 2 == 1}
        counts, first = overlaps._count_rows(group)
        got = {}
        for k, c, f in zip(group["_id"].tolist(), counts.tolist(), first.tolist()):
            if c:
                before = got.get(k, (0, f))
                got[k] = (before[0] + c, min(before[1], f))
        assert got == _brute(rows)
    out = overlaps.later_overlaps(frame, "id", BOX, crowded).collect()
    assert {r["id"]: (r["n"], r["first"]) for r in out} == _brute(rows)


def test_overlap_count_lists_no_pairs(spark):
    plan = entry.queries()["d02_footprint_self_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The only join is with the few crowded cells; none of boxes with boxes.
    assert plan.count("Join ") == plan.count("Join LeftOuter") == 1

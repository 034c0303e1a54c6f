"""Threshold-scaled sketches against plain Python."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartolith.llm import sketch

LIMIT = 1 << (64 - sketch.ZERO_BITS)


def _sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    found = set()
    for k in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[k : k + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted(h for h in found if h < LIMIT) or sorted(found, key=signed)[:1]


def _like(a, b):
    if not a or not b:
        return float(a == b)
    return len(set(a) & set(b)) / min(len(a), len(b))


def _report(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'-' if r[0] is None else r[0]}:{r[1]}".encode()).digest())
    rows = [(i, t or "") for i, t in rows]
    order = sorted(set(rows), key=key, reverse=True)
    after = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    out = []
    for i, t in rows:
        k = len(t) // 3
        edited = t[: len(t) - k] + after[i, t][:k]
        own, other = _sketch(t), _sketch(edited)
        text = lambda hashes: "".join(f"{h:016x}" for h in hashes)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(own), text(other), round(_like(own, other), 9), round(_like(own, _sketch(after[i, t])), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "odd", "one", "empty"])
def test_report(which, request):
    df = request.getfixturevalue("odd" if which == "one" else which)
    df = df.where("doc_id = 8") if which == "one" else df
    got = sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in sketch.edit_report(df).collect()), key=str)
    assert got == _report([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_containment_of_unequal_documents_and_merge(spark):
    rng = np.random.default_rng(1)
    long = [f"w{x}" for x in rng.integers(0, 5000, 30_000)]
    rows = [(0, " ".join(long))] + [(k, " ".join(long[k * 500 : k * 500 + 400 + 20 * k])) for k in range(1, 20)] + [(20, " ".join(f"v{x}" for x in range(900)))]
    df = spark.createDataFrame(rows, "k int, text string").select("k", sketch.sketch(sketch.shingle_hashes(F.col("text"))).alias("s"))
    whole = df.where("k = 0").select(F.col("s").alias("whole"))
    part = sketch.containment(F.col("s"), F.col("whole"))
    back = sketch.containment(F.col("whole"), F.col("s"))
    both = sketch.merged(F.col("s"), F.col("whole"))
    got = df.crossJoin(whole).select("k", part.alias("part"), back.alias("back"), F.size("s").alias("n"), (F.size(both) - F.size("whole")).alias("added")).collect()
    for r in got:
        assert r.part == (0 if r.k == 20 else 1) and r.added == (r.n if r.k == 20 else 0)
        if 0 < r.k < 20:
            assert abs(r.back - (396 + 20 * r.k) / 29_996) < 0.012


def test_plan_stays_in_the_jvm(docs):
    plan = sketch.edit_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.split("== Physical Plan ==")[1].count("split(") <= 6

"""Merkle manifest against plain Python, with groups of every height, repeated and null ids."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from cartolith.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def _sides(levels, at):
    for level in levels[:-1]:
        run = at // 8 * 8
        yield "".join(level[run:at]), "".join(level[at + 1 : run + 8])
        at //= 8


def _manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([_leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))]) for g in order}
    top = _tree([trees[g][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for at, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))):
            sides = [*_sides(trees[g], at), *_sides(top, k)]
            low = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))
            node = _leaf(low)
            for a, b in sides:
                node = _h(a, node, b)
            out[(r[0], _leaf(r), trees[g][-1][0], top[-1][0], _h(*(x for s in sides for x in s)), node, node == top[-1][0])] += 1
    return out


def _got(df):
    return Counter(map(tuple, merkle.manifest(df).collect()))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_manifest(which, request):
    df = request.getfixturevalue(which)
    want = _manifest([tuple(r) for r in df.select(*COLUMNS).collect()])
    assert _got(df) == want
    assert which == "empty" or {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (8, 9), (512, 513, 1), (5000, 70, 64, 65, 7, 2, 1, 1, 1, 30)])
def test_groups_of_every_height(spark, sizes):
    rng = random.Random(len(sizes))
    rows = []
    for k, n in enumerate(sizes):
        ids = rng.sample(range(-(1 << 20), 1 << 20), n) if k % 2 else [x << 40 if x % 3 else x - 7 for x in range(n)]
        rows += [(i, "s" if i % 5 else None, None if k == 1 else f"é{k}", i % 100, f"Text {i} {k}", "extra") for i in ids]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, slot string").repartition(7)
    assert _got(df) == _manifest([r[:5] for r in rows])


def test_ids_that_many_rows_bear(spark):
    rows = [(5, "s", "a", 1, f"T{k % 40}") for k in range(700)] + [(None, None, "a", 1, f"N{k % 3}") for k in range(600)]
    rows += [(k, "s", "a", 1, "x") for k in range(200)] + [(1 << 62, "s", "b", 1, "X"), (1 << 62, "s", "b", 1, "X"), (63, "s", "b", 2, "Y"), (63, "s", "b", 1, "Y"), (127, "s", "b", 0, "Z")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert _got(df) == _manifest(rows)

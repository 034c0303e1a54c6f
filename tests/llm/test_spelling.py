"""Spelling variants against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolith.llm import spelling


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def _variants(rows):
    words, out = _words(rows), []
    variants, near = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            variants.setdefault((w[:k] + w[k + 1 :], k), []).append(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for same in variants.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def _got(df, **options):
    return sorted((tuple(r) for r in spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@given(st.sets(st.text("abé", min_size=0, max_size=6), max_size=60))
@settings(max_examples=150, deadline=None)
def test_acceptor_finds_all_pairs_one_edit_apart(words):
    words = sorted(words)
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if _near(words[i], words[j])}
    assert spelling.Acceptor(words).one_edit() == want


def test_acceptor_is_minimal_and_takes_long_words():
    assert len(spelling.Acceptor(sorted(a + b for a in ("x", "y", "z") for b in ("ing", "ed", "s"))).final) <= 7
    assert spelling.Acceptor(["a" * 60_000, "a" * 60_001, "a" * 59_999 + "b"]).one_edit() == {(0, 1), (0, 2)}


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_variants(which, request):
    df = request.getfixturevalue(which)
    assert _got(df) == _variants([tuple(r) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("most", [2, 20, 20_000])
def test_full_partitions_are_dealt_again(spark, most):
    """Words that share long beginnings and ends, runs of one letter, and chains of forms."""
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(220)} | {"a" * n for n in range(7, 14)}
    words |= {"prefixed" + "".join(rng.choice("aé") for _ in range(rng.randint(0, 5))) for _ in range(60)}
    words |= {"".join(rng.choice("aé") for _ in range(rng.randint(0, 5))) + "suffixed" for _ in range(60)}
    rows = [(k, " ".join([w] * rng.choice([1, 2, 3, 40, 600]))) for k, w in enumerate(sorted(words))] + [(None, "Prefixed PREFIXED"), (1, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, word string")
    want = _variants(rows)
    assert _got(df, most=most) == want and any(r[2] != r[1] and r[1] for r in want)

"""Conversation snapshots against plain Python; the pipeline and the registered queries."""

from __future__ import annotations

import duckdb
import pytest
import xxhash

import __spark_entry__ as entry_points
import corpus_pipeline
from cartolith.llm import chat, queries
from check import TABLES, normal

SF = "/root/testdata/sf0.001"


def _maximal(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, set()).add((-1 if turn is None else turn, role, text))
    kept = {}
    for conv, turns in talks.items():
        numbers = sorted({t for t, *_ in turns})
        begins = {frozenset(x for x in turns if x[0] <= n) for n in numbers[:-1]}
        kept.setdefault(frozenset(turns), []).append((conv, begins))
    inner = set().union(*(b for group in kept.values() for _, b in group)) if kept else set()
    first = lambda group: min((c for c, _ in group if c is not None), default=None)
    return sorted(str((first(g), len(g))) for turns, g in kept.items() if turns not in inner)


def test_snapshots(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    talk = [(t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(7)]
    rows = [(c, *x, "e") for c, n in ((1, 3), (2, 7), (3, 7), (4, 2), (9, 1)) for x in talk[:n]]
    rows += [(5, 0, "user", "other", "e"), (5, 0, "user", "other", "e"), (6, None, None, None, "e"), (7, None, None, "", "e"), (None, 0, "user", "x", "e"), (8, 0, "user", "text 0", "e"), (8, 1, "user", "fork", "e")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, last string")
    got = sorted(str(tuple(r)) for r in chat.maximal(turns).select("conv_id", "copies").collect())
    assert got == _maximal([r[:4] for r in rows])
    assert chat.render(turns).where("conv_id = 2").count() == 7 and chat.render(turns.limit(0)).count() == 0


def test_turns_that_collide_in_one_hash_stay_apart(spark):
    """Two turns made to have the same xxhash64(turn, role, text)."""
    bits, p1, p2, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5
    turn = lambda role: (xxhash.xxh64_intdigest(role, xxhash.xxh64_intdigest(bytes(8), 42)) + p5 + 8) & bits
    mixed = lambda x: (x := x * p2 & bits, (x << 31 | x >> 33) * p1 & bits)[1]
    want = turn("user") ^ mixed(int.from_bytes(b"eight by", "little"))
    for k in range(100_000):
        x = (turn(f"r{k}") ^ want) * pow(p1, -1, 1 << 64) & bits
        text = ((x >> 31 | x << 33) * pow(p2, -1, 1 << 64) & bits).to_bytes(8, "little")
        if text.isascii():
            break
    rows = [(1, 0, "user", "eight by"), (2, 0, f"r{k}", text.decode())]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    assert turns.selectExpr("xxhash64(bigint(turn), role, text)").distinct().count() == 1
    assert sorted((r.conv_id, r.copies) for r in chat.maximal(turns).collect()) == [(1, 1), (2, 1)]


def test_checked_queries_equal_sql(spark):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.CHECKS.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want), name


def test_every_operator_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES}
    assert "pipeline" in entry_points.queries()


@pytest.fixture(scope="module")
def stages(spark, docs):
    kept, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (kept, stage(spark, kept, SF))
        kept = out[name][1]
    return out


def test_stages_keep_the_columns_of_documents(stages, docs):
    names = list(stages)
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name in names[:-1]:
        assert stages[name][1].schema == docs.schema
    sizes = [stages[n][1].count() for n in names[:-1]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 50


def test_run_packs_what_the_stages_keep(spark, stages):
    ids = lambda df: sorted({r.doc_id for r in df.select("doc_id").collect()})
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages["benchmark_decontamination"][1])


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_take_odd_rows(spark, which, request):
    df = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, df, SF).count()

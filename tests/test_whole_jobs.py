"""Queries that must answer for all of their tables: what the rounds' findings found left out."""

import itertools
import math
import random
import time
from collections import Counter
from datetime import datetime

import duckdb
import pytest

from statelens.operators import repair as J
from statelens.operators import stats as L
from statelens.plans import bindings as B
from statelens.plans import registry
from statelens.sources import files as A
from statelens.sources import shared


def test_balanced_subset_takes_every_stratum(spark, sf):
    """50 cases in rounds over three strata that have enough: 17, 17 and 16."""
    got = registry.QUERIES["f3_balanced_subset"](spark, sf).collect()
    assert Counter(r.complexity for r in got) == {"simple": 17, "medium": 17, "complex": 16}
    assert len({r.case_id for r in got}) == 50


def test_paired_stages_of_every_run(spark, sf):
    """A pair for each case with a first and a final run and metadata, whatever its run's id says."""
    got = registry.QUERIES["j1_paired_stages"](spark, sf).collect()
    of = lambda k: {r.case_id for r in B.graph_rows(spark, sf).where(f"run_index = {k} and case_id % 10 <> 0").select("case_id").collect()}
    assert sorted(r.case_id for r in got) == sorted(of(0) & of(1))
    assert {r.run_id.rsplit("__", 1)[1] for r in got} == {"few_shot", "rag", "rag_repair"}


def test_paired_stages_by_kind(spark):
    """Repair runs unless another kind is asked for; an empty kind takes all runs."""
    rows = [(f"{run}/{stage}", run, 1, 1, stage) for run in ("a__rag", "a__rag_repair", "a__few_shot") for stage in ("initial", "final")]
    d = spark.createDataFrame(rows, "diagram_id string, run_id string, case_id int, run_index int, stage string")
    runs = lambda *x: sorted(r.run_id for r in J.paired_stages(d, None, *x).collect())
    assert (runs(), runs("rag"), runs("")) == (["a__rag_repair"], ["a__rag", "a__rag_repair"], ["a__few_shot", "a__rag", "a__rag_repair"])


def test_legacy_selection_counts_every_issue(spark, tmp_path):
    """Of three candidates without duplicate transitions, the one without issues goes first and the one with most is left out, though it has most transitions."""
    weeks = {8: ["click_3", "error_3"], 15: ["view_0", "click_3", "error_3"], 22: ["view_0", "click_0", "click_3", "error_3"]}  # names in _0 are choices, here without guards
    rows = [(100 * day + i, datetime(2024, 1, day, i), 7, n[:-2], 1.0, f'{{"k": {25 * int(n[-1])}}}') for day, names in weeks.items() for i, n in enumerate(names)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = [(7, "7/1", 1), (7, "7/2", 2)]
    assert sorted(map(tuple, registry.QUERIES["i15_legacy_selection"](spark, str(tmp_path)).select("case_id", "diagram_id", "rank").collect())) == want
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(registry.ORACLES["i15_legacy_selection"]).fetchall()) == want


def _exact(a, b, c, d):
    """The two-sided p by whole numbers."""
    ways = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
    total = sum(ways.values())
    return sum(w for w in ways.values() if w / total <= ways[a] / total + 1e-12) / total


def test_fisher_pairs_by_whole_numbers(spark):
    """Tables of all shapes against whole numbers: empty margins, the likeliest table itself, and ones that are all but impossible."""
    rng = random.Random(4)
    tables = [(0, 0, 0, 0), (0, 5, 0, 7), (5, 0, 7, 0), (3, 1, 1, 3), (10, 10, 10, 10), (40, 2, 1, 60), (300, 0, 0, 300), (0, 400, 500, 0)]
    tables += [tuple(rng.randrange(n) for _ in range(4)) for n in (3, 10, 60, 400) for _ in range(20)]
    counts = spark.createDataFrame([(i, g, t[2 * k], t[2 * k + 1]) for i, t in enumerate(tables) for k, g in enumerate("xy")], "i int, g string, valid long, invalid long")
    got = {r.i: r.p for r in L.fisher_pairs(counts, ["i"], "g").collect()}
    for i, t in enumerate(tables):
        assert math.isclose(got[i], _exact(*t), rel_tol=1e-9, abs_tol=1e-300), (t, got[i], _exact(*t))


def test_fisher_pairs_of_millions(spark):
    """Counts of a large table: the work grows with their root (by their square this never ends)."""
    counts = spark.createDataFrame([(g, 3_000_000 + 500 * i, 2_000_000) for i, g in enumerate("abcdef")], "g string, valid long, invalid long")
    began = time.time()
    got = {(r.group_a, r.group_b): r.p for r in L.fisher_pairs(counts, [], "g").collect()}
    assert time.time() - began < 30 and len(got) == 15
    n = {g: 3_000_000 + 500 * i for i, g in enumerate("abcdef")}
    for (a, b), p in got.items():  # so large that the normal tail is near
        z = (n[a] / (n[a] + 2e6) - n[b] / (n[b] + 2e6)) / math.sqrt((q := (n[a] + n[b]) / (n[a] + n[b] + 4e6)) * (1 - q) * (1 / (n[a] + 2e6) + 1 / (n[b] + 2e6)))
        assert math.isclose(p, math.erfc(abs(z) / math.sqrt(2)), abs_tol=0.002)


def test_kruskal_wallis_in_any_order(spark):
    """H of 36 million ranks is the same to its last digit in whatever order the groups come."""
    # value 1 ranks 1 to 10,000,000, value 2 the rest
    low, high = {"a": 2_508_116, "n": 4_997_637, "r": 2_494_247}, {"a": 6_501_327, "n": 12_997_565, "r": 6_501_108}
    rows = [(1, g, low[g] + high[g], low[g] * 5_000_000.5 + high[g] * 23_000_000.5, 36_000_000, 1e21 + 17.576e21) for g in "anr"]
    got = set()
    for order in itertools.permutations(rows):
        g = spark.createDataFrame(order, "c int, g string, n long, rank_sum double, total long, tie_sum double").coalesce(1)
        got.add(L._kruskal(g, ["c"], "g", False).first().h)
    assert len(got) == 1 and 0 < got.pop()


def test_packed_texts_keep_keys_and_texts(spark, tmp_path):
    """Keys and texts of any characters come back as they were, and metadata as from a file each."""
    rows = [("a/b=c", "x y+z%2F", "one\ntwo\n"), ("é", "", ""), ("", "run_id=q", " "), ("a", "b", None), ("p", "q", '{"status": "ok"}'), ("p", "r", '{"status": "o')]
    d = spark.createDataFrame(rows, "run_id string, case_id string, text string")
    t = shared.read_packed(spark, shared.pack_texts(d, f"{tmp_path}/t", ["run_id", "case_id"]), ["run_id", "case_id"])
    assert sorted(map(tuple, t.collect())) == sorted((a, b, x or "") for a, b, x in rows)
    m = shared.metadata_of(t.where("run_id = 'p'"), A.METADATA, ["run_id", "case_id"])
    assert sorted((r.case_id, r.status, r.malformed) for r in m.collect()) == [("q", "ok", False), ("r", None, True)]


@pytest.mark.parametrize("name", ["a2_diagrams", "a4_runs_with_tokens", "a8_status_gate", "a16_attempt_artifacts", "j4_recorded_iterations"])
def test_stored_texts_make_few_files(spark, sf, tmp_path, monkeypatch, name):
    """Runs and metadata of many cases are not a file each."""
    folders = iter(f"{tmp_path}/{i}" for i in range(9))
    monkeypatch.setattr(shared, "folder", lambda spark: next(folders))
    registry.QUERIES[name](spark, sf).collect()
    stored = [x for x in tmp_path.rglob("*") if x.is_file() and not x.name.startswith((".", "_"))]
    cases = B.graph_rows(spark, sf).select("case_id").distinct().count()
    assert 0 < len(stored) <= 8 < cases

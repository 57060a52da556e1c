"""S4 over runs of events as prefix rewrites: many small runs equal a replay, and what is written follows the runs."""

import random

from corpus_context.operators import moves as M
from test_moves import EVENTS, replay, some_events


def test_many_small_runs_equal_a_replay(spark):
    items, sel, events, expected = [], [], [], set()
    for k in range(12):
        r, root = random.Random(100 + k), f"/r{k}"
        own = sorted({root + "".join("/" + r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(12)})
        chosen = set(r.sample(own, len(own) // 2))
        ev = some_events(r, 80, root)
        items += [(root, p) for p in own]
        sel += [(root, p) for p in chosen]
        events += ev
        expected |= {(root, p, s) for p, s in replay(own, chosen, ev).items()}
    got = M.apply_events_keep_selection(spark.createDataFrame(items, "root string, path string"), spark.createDataFrame(sel, "root string, path string"),
                                        spark.createDataFrame(events, EVENTS), refs=25).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_moves_up_and_onto_the_top(spark):
    items = ["/p/a/a/x", "/p/a/b/x", "/p/a/x", "/p/b/x", "/q/y"]
    ev = [("/", 1, "moved", "/p/a", "/p"), ("/", 2, "created", "/p/b/x", None), ("/", 3, "moved", "/q", ""), ("/", 4, "moved", "/p/b", "/y"), ("/", 5, "deleted", "/y/x", None)]
    for refs in (1, 1000):
        got = M.apply_events_keep_selection(spark.createDataFrame([("/", p) for p in items], "root string, path string"),
                                            spark.createDataFrame([("/", items[0]), ("/", items[1])], "root string, path string"),
                                            spark.createDataFrame(ev, EVENTS), refs=refs).collect()
        want = replay(items, set(items[:2]), ev)
        assert {(r.path, r.selected) for r in got} == set(want.items()), refs


def test_runs_are_as_large_as_what_they_name(spark):
    n = 3000
    ev = [("/p", k, "moved", f"/p/{'ab'[k % 2]}", f"/p/{'ab'[1 - k % 2]}") for k in range(n)]
    runs = M.rewrites(spark.createDataFrame(ev, EVENTS).selectExpr("*", "seq as event")).collect()
    assert 0 < len(runs) <= 8 * 3  # by event: n touches of every file below


def test_a_run_ends_before_a_move_can_make_too_much():
    block = M._Block("/p", 0)
    for k in range(2000):
        block.apply([("/p", k, "moved", f"/p/s{k}", "/p/all")])
    assert block.full(10**9) and not M._Block("/p", 0).full(10)

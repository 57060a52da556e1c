"""Files and their selection after events, against a replay in seq order."""

import random

from corpus_context.operators import events as EV
from corpus_context.operators import moves as M

EVENTS = "root string, seq long, action string, src_path string, dst_path string"


def replay(items, selected, events):
    state = {p: p in selected for p in items}
    for _, _, action, src, dst in sorted(events, key=lambda e: e[1]):
        below = [p for p in state if src is not None and (p == src or p.startswith(src + "/"))]
        if action == "created":
            state.setdefault(src, False)
        elif action == "deleted":
            for p in below:
                del state[p]
        elif action == "moved" and dst is not None and dst != src and not dst.startswith(src + "/"):
            taken = {dst + p[len(src):]: state.pop(p) for p in below}
            state.update(taken)
    return state


def some_events(r, n, root):
    def path(depth):
        return root + "".join("/" + r.choice("abc") for _ in range(r.randint(1, depth)))

    out = []
    for k in range(n):
        action = r.choice(["created", "moved", "moved", "moved", "deleted", "modified"])
        out.append((root, k + 1, action, path(3), path(3) if action == "moved" else None))
    return out


def test_random_events_equal_a_replay(spark):
    items, sel, events, expected = [], [], [], set()
    for k in range(60):
        r, root = random.Random(k), f"/r{k}"
        own = sorted({root + "".join("/" + r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(12)})
        chosen = set(r.sample(own, len(own) // 2))
        ev = some_events(r, 30, root)
        items += [(root, p) for p in own]
        sel += [(root, p) for p in chosen]
        events += ev
        expected |= {(root, p, s) for p, s in replay(own, chosen, ev).items()}
    got = EV.apply_events_keep_selection(spark.createDataFrame(items, "root string, path string"),
                                         spark.createDataFrame(sel + sel[:3], "root string, path string"),
                                         spark.createDataFrame(events, EVENTS).repartition(5)).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_long_chain_of_folder_moves(spark):
    n = 60
    ev = [("/p", k, "moved", f"/p/d{(k - 1) % 7}", f"/p/d{k % 7}") for k in range(1, n)] + [("/p", n, "created", f"/p/d{(n - 1) % 7}/x.py", None)]
    items = [("/p", "/p/d0/x.py"), ("/p", "/p/d0/sub/y.py"), ("/p", "/p/keep.py")]
    got = EV.apply_events_keep_selection(spark.createDataFrame(items, "root string, path string"),
                                         spark.createDataFrame(items[:1], "root string, path string"), spark.createDataFrame(ev, EVENTS)).collect()
    last = f"/p/d{(n - 1) % 7}"
    assert {(r.path, r.selected) for r in got} == {(last + "/x.py", True), (last + "/sub/y.py", False), ("/p/keep.py", False)}


def test_odd_events_and_nothing(spark):
    items = spark.createDataFrame([("/p", "/p/a"), ("/p", "/p/a"), ("/q", "/q/a")], "root string, path string")
    ev = spark.createDataFrame([("/p", 1, "moved", "/p/a", "/p/a"), ("/p", 2, "moved", "/p/a", None), ("/p", 3, "moved", "/p/a", "/p/a/b"),
                                ("/p", 4, "created", None, None), ("/q", 5, "moved", "/q", "/elsewhere"), ("/p", 6, "deleted", "/p/aa", None)], EVENTS)
    none = items.limit(0)
    assert {tuple(r) for r in EV.apply_events_keep_selection(items, items, ev).collect()} == {("/p", "/p/a", True), ("/q", "/elsewhere/a", True)}
    assert EV.apply_events_keep_selection(none, none, ev.limit(0)).count() == 0
    assert {r.path for r in EV.apply_events_keep_selection(items, none, ev.limit(0)).collect()} == {"/p/a", "/q/a"}


def test_settle_takes_the_source_then_the_target(spark):
    rows = [(1, None, None, 7, None), (2, None, 1, None, None), (3, None, 2, 9, None), (4, 5, None, None, 3), (5, None, None, None, None), (6, None, 5, 8, None)]
    asking = spark.createDataFrame(rows, "eid long, src long, src_asks long, dst long, dst_asks long")
    assert {tuple(r) for r in M.settle(asking, M.writer(spark)).collect()} == {(1, 7), (2, 7), (3, 7), (4, 5), (5, None), (6, 8)}

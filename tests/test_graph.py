from __future__ import annotations

import random

from runledger.operators import audit, graph, views
from tests.conftest import as_dicts

ACTIVE = {"submitting", "unknown_submit", "queued", "running"}


def brute(jobs):
    live = {j["id"]: j for j in jobs if j.get("deleted_at") is None}
    kids = {}
    for j in live.values():
        if j.get("retry_of") is not None:
            kids.setdefault(j["retry_of"], []).append(j["id"])
    found = {}
    for root in live:
        seen, todo = set(), [(root, [root], 0)]
        while todo:
            node, path, depth = todo.pop()
            for c in kids.get(node, []):
                if depth == 0:
                    seen.add(c)
                    todo.append((c, [root, c], 1))
                elif c not in path:
                    seen.add(c)
                    todo.append((c, [*path, c], depth + 1))
        found[root] = seen
    return live, found


def brute_heights(live, jobs):
    kids = {}
    for j in live.values():
        if j.get("retry_of") in live:
            kids.setdefault(j["retry_of"], []).append(j["id"])
    out = {}
    for root in live:
        best, won, todo = 0, False, [(root, (root,))]
        while todo:
            node, path = todo.pop()
            best = max(best, len(path) - 1)
            for c in kids.get(node, []):
                won = won or live[c]["status"] == "succeeded"
                if c not in path:
                    todo.append((c, (*path, c)))
        out[root] = (best, won)
    return out


def brute_depth(jobs):
    by = {j["id"]: j.get("retry_of") for j in jobs}
    out = {}
    for j in by:
        d, cur = 0, j
        while by.get(cur) is not None and d <= len(by):
            cur, d = by[cur], d + 1
            if cur not in by:
                d = len(by) + 1
                break
        out[j] = d if d <= len(by) else 0
    return out


def random_jobs(seed, n=80):
    rnd = random.Random(seed)
    jobs = []
    for i in range(n):
        parent = None
        r = rnd.random()
        if r < 0.6 and i:
            parent = f"j{rnd.randrange(max(0, i - 4), i)}"
        elif r < 0.68:
            parent = f"j{rnd.randrange(n)}"
        elif r < 0.7:
            parent = "nowhere"
        jobs.append({"id": f"j{i}", "status": rnd.choice(["failed", "failed", "failed", "succeeded", "queued", "killed"]), "retry_of": parent,
                     "deleted_at": __import__("datetime").datetime(2025, 1, 1) if rnd.random() < 0.05 else None})
    chain = [{"id": f"c{i:03d}", "status": "succeeded" if i == 196 else "failed", "retry_of": f"c{i - 1:03d}" if i else None} for i in range(200)]
    chain += [{"id": f"r{i:03d}", "status": "queued" if i == 9 else "failed", "retry_of": f"r{(i + 1) % 70:03d}"} for i in range(70)] + [{"id": f"q{i}", "status": "failed", "retry_of": f"q{i - 1}" if i else "r033"} for i in range(9)]
    ring = [{"id": f"k{i}", "status": "failed", "retry_of": f"k{(i + 1) % 5}"} for i in range(5)] + [{"id": f"t{i}", "status": "failed", "retry_of": f"t{i - 1}" if i else "k2"} for i in range(4)]
    star = [{"id": "hub", "status": "failed"}] + [{"id": f"s{i}", "status": "running" if i == 7 else "failed", "retry_of": "hub"} for i in range(60)]
    return jobs + chain + ring + star + [{"id": "self", "status": "succeeded", "retry_of": "self"}]


def test_recovery_depth_cycles_and_loops_match_brute_force(make_ledger):
    for seed in (1,):
        jobs = random_jobs(seed)
        l = make_ledger(jobs=jobs)
        live, found = brute(jobs)
        rec = as_dicts(views.jobs_with_recovery(l), "job_id")
        assert set(rec) == set(live)
        for root, seen in found.items():
            wins = sorted(x for x in seen if live[x]["status"] == "succeeded")
            busy = sorted(x for x in seen if live[x]["status"] in ACTIVE)
            got = rec[root]
            assert (got["success_descendant_id"], got["active_descendant_id"]) == (wins[0] if wins else None, busy[0] if busy else None), root
            assert got["has_success_descendant"] == int(bool(wins))
        depth = brute_depth(jobs)
        owned = as_dicts(views.job_ownership(l), "job_id")
        assert {j: owned[j]["retry_depth"] for j in owned} == {j: depth[j] for j in owned}
        rings = {}
        for r in graph.cycles(l).collect():
            rings.setdefault(r["cycle_id"], set()).add(r["id"])
        expect = set()
        for j in live:
            path, cur = [], j
            while cur in live and cur not in path:
                path.append(cur)
                cur = live[cur].get("retry_of")
            if cur in path:
                expect.add(frozenset(path[path.index(cur):]))
        assert {frozenset(m) for m in rings.values()} == expect
        assert all(min(m) == low for low, m in rings.items())
        loops = {r["entity_id"]: r["details"] for r in audit.RULES["job_retry.loop"].issues(l, audit.Thresholds()).collect()}
        heights = brute_heights(live, jobs)
        want = {j for j, (d, won) in heights.items() if live[j]["status"] == "failed" and d > 3 and not won}
        assert set(loops) == want
        assert all(f'"max_retry_depth":{heights[j][0]},' in loops[j] for j in want)


def test_heights_without_deep_chains_or_rings(make_ledger):
    jobs = [{"id": f"a{i}", "status": "failed", "retry_of": f"a{i - 1}" if i else None} for i in range(6)]
    l = make_ledger(jobs=jobs)
    assert graph.cycles(l).count() == 0
    got = {r["id"]: r["depth"] for r in graph.retry_heights(l).collect()}
    assert got == {f"a{i}": 5 - i for i in range(5)}


def test_retry_lineage_states(make_ledger):
    for status, state in [("submitting", "recovery_in_progress"), ("unknown_submit", "recovery_in_progress"), ("queued", "recovery_in_progress"), ("succeeded", "recovered_failed"),
                          ("killed", "blocking_failed")]:
        l = make_ledger(experiments=[{"id": "e1"}], jobs=[{"id": "j1", "experiment_id": "e1", "status": "failed"}, {"id": "j2", "experiment_id": "e1", "status": status, "retry_of": "j1"}])
        assert as_dicts(views.jobs_with_recovery(l), "job_id")["j1"]["retry_state"] == state
    blockers = as_dicts(views.experiment_blockers(make_ledger(jobs=[{"id": "j1", "status": "failed"}, {"id": "j2", "status": "submitting", "retry_of": "j1"}])))
    assert [b["blocker_type"] for b in blockers] == ["submission_in_progress"]

"""Retry lineage: every job names at most one job it retries, so the graph is a
forest unless corrupted by cycles.

All algorithms are pointer doubling on the jobs that *have* a parent (a slim
subset), O(rows x log depth) at any depth, with the state cut to shared storage per
round.  Values travel upwards as combined minima and maxima: no list of ancestors is
kept and no group of siblings or ring of jobs is gathered, so a parent with a third
of all jobs as retries only shows up as a combined partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.ledger import Ledger
from runledger.lineage import cut
from runledger.schemas import ACTIVE_JOB_STATUSES


def retry_edges(jobs: DataFrame) -> DataFrame:
    """(id, parent, status) of active jobs whose retry target is an active job."""
    live = jobs.filter(F.col("deleted_at").isNull())
    child = live.filter(F.col("retry_of").isNotNull()).select("id", F.col("retry_of").alias("parent"), "status")
    parents = live.select(F.col("id").alias("parent"))
    return child.join(parents, "parent").select("id", "parent", "status")


def edges(ledger: Ledger) -> DataFrame:
    return ledger.once("retry_edges", lambda: cut(retry_edges(ledger.table("jobs")), "retry-edges"))


def lift(nodes: DataFrame, own: dict[str, Column], below: dict[str, str], label: str) -> DataFrame:
    """Combine values of all proper descendants in a forest.

    ``nodes`` has (id, ptr) and what ``own`` needs; ptr is the parent or NULL.  ``own`` names a node's
    value, ``below`` how values combine (min or max).  Each round passes on what was combined below a node to the ancestor as many
    steps above as are already covered, and then doubles the steps.  Returns id, the columns of ``own`` for the node
    itself, the same with suffix ``_below``, and ``height``, the steps down to the deepest descendant.
    """
    both = {"min": F.least, "max": F.greatest}
    state = cut(nodes.select("id", "ptr", *[c.alias(n) for n, c in own.items()], *[F.when(F.lit(False), c).alias(f"{n}_below") for n, c in own.items()],
                             F.lit(0).alias("height")), label)
    span = 1
    while not (moving := state.filter(F.col("ptr").isNotNull())).isEmpty():
        passed = moving.groupBy(F.col("ptr").alias("id")).agg(
            *[getattr(F, below[n])(both[below[n]](n, f"{n}_below")).alias(f"{n}_in") for n in own], (F.max("height") + span).alias("height_in"))
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
        state = cut(state.join(passed, "id", "left").join(ahead, "ptr", "left").select(
            "id", F.col("ptr2").alias("ptr"), *own, *[both[below[n]](f"{n}_below", f"{n}_in").alias(f"{n}_below") for n in own],
            F.greatest("height", F.coalesce("height_in", F.lit(0))).alias("height")), label)
        span *= 2
    return state.drop("ptr")


def _forest(ledger: Ledger) -> DataFrame:
    """Lifted values of the retry forest: rings are cut open everywhere, so their jobs are roots here."""
    def build() -> DataFrame:
        edge_df = edges(ledger)
        ring = cycles(ledger).select("id", F.lit(True).alias("on_ring"))
        child = edge_df.join(ring, "id", "left").select("id", F.when(F.col("on_ring").isNull(), F.col("parent")).alias("ptr"), "status")
        roots = edge_df.select(F.col("parent").alias("id")).distinct().join(edge_df.select("id"), "id", "left_anti")
        nodes = child.unionByName(roots.select("id", F.lit(None).cast("string").alias("ptr"), F.lit(None).cast("string").alias("status")))
        return lift(nodes, {"won": F.when(F.col("status") == "succeeded", F.col("id")), "busy": F.when(F.col("status").isin(*ACTIVE_JOB_STATUSES), F.col("id"))},
                    {"won": "min", "busy": "min"}, "retry-forest")
    return ledger.once("retry_forest", build)


def _ring_lows(ledger: Ledger) -> DataFrame:
    """Per ring job, the least succeeded and active ids among the other jobs of its ring and all that hang off it."""
    ring = cycles(ledger).join(_forest(ledger), "id").join(edges(ledger).select("id", (F.col("id") == F.col("parent")).alias("self_retry")), "id")
    state = ring
    for n in ("won", "busy"):
        low = ring.groupBy("cycle_id").agg(F.min(n).alias(f"{n}_first"), F.min(f"{n}_below").alias(f"{n}_trees"))
        state = state.join(low, "cycle_id")
        second = state.filter(F.col(n) != F.col(f"{n}_first")).groupBy("cycle_id").agg(F.min(n).alias(f"{n}_second"))
        state = state.join(second, "cycle_id", "left")
    # on a ring the walk comes back to the job itself; only a direct self retry counts
    others = {n: F.when((F.col(n) == F.col(f"{n}_first")) & ~F.col("self_retry"), F.col(f"{n}_second")).otherwise(F.col(f"{n}_first")) for n in ("won", "busy")}
    return state.select("id", *[F.least(others[n], f"{n}_trees").alias(f"{n}_below") for n in others])


def retry_recovery(ledger: Ledger) -> DataFrame:
    """Per ancestor: has a succeeded / active retry descendant at any depth, and the smallest such id."""
    def build() -> DataFrame:
        trees = _forest(ledger).join(cycles(ledger).select("id"), "id", "left_anti").select("id", "won_below", "busy_below")
        every = trees.unionByName(_ring_lows(ledger))
        return every.filter(F.coalesce("won_below", "busy_below").isNotNull()).select(
            F.col("id").alias("root_id"), F.col("won_below").isNotNull().cast("int").alias("has_success_descendant"),
            F.col("busy_below").isNotNull().cast("int").alias("has_active_descendant"), F.col("won_below").alias("success_descendant_id"),
            F.col("busy_below").alias("active_descendant_id"))
    return ledger.once("retry_recovery", build)


def retry_depth(jobs: DataFrame) -> DataFrame:
    """(job_id, retry_depth) for jobs that retry something, archived jobs included.

    Depth counts the steps to a job without retry target; chains that dangle or
    end in a cycle get no row.
    """
    child = jobs.filter(F.col("retry_of").isNotNull()).select("id", F.col("retry_of").alias("ptr"))
    state = cut(child.join(jobs.select(F.col("id").alias("ptr")), "ptr").select(
        "id", "ptr", F.lit(1).alias("depth"), F.lit(False).alias("done")), "retry-depth")
    # A pointer that is itself a child must resolve further; dangling children drop out as unresolved.
    inner = cut(child.select("id"), "retry-children")
    state = state.join(inner.select(F.col("id").alias("ptr"), F.lit(True).alias("is_child")), "ptr", "left").select(
        "id", "ptr", "depth", F.col("is_child").isNull().alias("done"))
    waiting = -1
    while True:
        state = cut(state, "retry-depth")
        pending = state.filter(~F.col("done"))
        # each round resolves some chain that has an end; what is left when none did runs in circles
        if (left := pending.count()) in (0, waiting):
            break
        waiting = left
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("depth").alias("depth2"),
                             F.col("done").alias("done2"))
        moved = pending.select("id", "ptr", "depth").join(ahead, "ptr").select(
            "id", F.col("ptr2").alias("ptr"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done"))
        state = state.filter("done").unionByName(moved)
    return state.filter("done").select(
        F.col("id").alias("job_id"), F.col("depth").alias("retry_depth"))


def _hop(ptrs: DataFrame) -> DataFrame:
    ahead = ptrs.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
    return ptrs.join(ahead, "ptr").select("id", F.col("ptr2").alias("ptr"))


def cycle_members(edge_df: DataFrame) -> DataFrame:
    """(id, cycle_id): jobs lying on a retry cycle; cycle_id is the smallest member id."""
    none = edge_df.sparkSession.createDataFrame([], "id string, cycle_id string")
    single = edge_df.select("id", F.col("parent").alias("ptr"))
    ptrs = single
    before = ptrs.count()
    while before:
        # two squarings per write; only rows in or below cycles survive in the end
        ptrs = cut(_hop(_hop(ptrs)), "cycle-hop")
        after = ptrs.count()
        if after == before:
            break
        before = after
    if not before:
        return none
    # images of far jumps settle on the cycles themselves
    images = -1
    while (count := ptrs.select("ptr").distinct().count()) != images:
        images = count
        ptrs = cut(_hop(ptrs), "cycle-image")
    members = cut(ptrs.select(F.col("ptr").alias("id")).distinct(), "cycle-members")
    state = single.join(members, "id", "left_semi").select("id", "ptr", F.least("id", "ptr").alias("low"))
    previous = None
    while True:
        state = cut(state, "cycle-low")
        signature = state.agg(F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()[0]
        if signature == previous:
            return state.select("id", F.col("low").alias("cycle_id"))
        previous = signature
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        state = state.join(ahead, "ptr").select("id", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"))


def cycles(ledger: Ledger) -> DataFrame:
    return ledger.once("retry_cycles", lambda: cycle_members(edges(ledger)))


def retry_roots(ledger: Ledger) -> DataFrame:
    """(id, parent, root) of every job that retries an active job: the tree index, one row for each edge.

    ``root`` is the top of the job's tree; jobs on or below a ring share the ring's least id.  A stored ledger keeps this table with each
    version and brings it along in its memo, so it is built once for a ledger and not for each manifest.
    """
    def build() -> DataFrame:
        ring = cycles(ledger)
        edge_df = edges(ledger).select("id", "parent")
        state = cut(edge_df.join(ring.select("id"), "id", "left_anti").select("id", F.col("parent").alias("ptr")), "retry-roots")
        while True:
            ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
            moved = cut(state.join(ahead, "ptr", "left").select("id", F.coalesce("ptr2", "ptr").alias("ptr"), F.col("ptr2").isNotNull().alias("moved")), "retry-roots")
            if moved.filter("moved").isEmpty():
                break
            state = moved.drop("moved")
        tops = state.select("id", F.col("ptr").alias("top")).unionByName(ring.select("id", F.col("id").alias("top")))
        onto = ring.select(F.col("id").alias("top"), "cycle_id")
        roots = tops.join(onto, "top", "left").select("id", F.coalesce("cycle_id", "top").alias("root"))
        return cut(edge_df.join(roots, "id").select("id", "parent", "root"), "retry-root-index")
    return ledger.once("retry_roots", build)


def retry_heights(ledger: Ledger) -> DataFrame:
    """(id, depth, success): longest retry descent below each job and whether any
    descendant succeeded.  Cycle members see the whole cycle once."""
    trees = _forest(ledger).select("id", F.col("height").alias("depth"), F.col("won_below").isNotNull().alias("success"))
    on_ring = cycles(ledger)
    plain = trees.join(on_ring.select("id"), "id", "left_anti").filter("depth > 0")
    if on_ring.isEmpty():
        return plain
    # Each ring is cut open at its smallest member; ``pos`` counts the steps up to that member.
    ring = edges(ledger).join(on_ring, "id").join(trees, "id").select(
        "id", "cycle_id", "depth", (F.col("success") | (F.col("status") == "succeeded")).alias("success"),
        F.when(F.col("id") != F.col("cycle_id"), F.col("parent")).alias("ptr"))
    state = cut(ring.select("id", "ptr", F.col("ptr").isNotNull().cast("int").alias("pos")), "ring-rank")
    while not state.filter(F.col("ptr").isNotNull()).isEmpty():
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("pos").alias("pos2"))
        state = cut(state.join(ahead, "ptr", "left").select("id", F.col("ptr2").alias("ptr"), (F.col("pos") + F.coalesce("pos2", F.lit(0))).alias("pos")), "ring-rank")
    ranked = cut(ring.join(state.select("id", "pos"), "id").withColumn("reach", F.col("pos") + F.col("depth")), "ring-ranked")
    # the furthest reach of the members behind the cut comes from below, that of those before it from above
    ahead_max = lift(ranked, {"reach": F.col("reach")}, {"reach": "max"}, "ring-reach").select("id", F.greatest("reach", "reach_below").alias("ahead_max"))
    before = cut(ranked.join(ranked.select(F.col("id").alias("ptr"), F.col("reach").alias("upper")), "ptr", "left").select("id", "ptr", F.col("upper").alias("behind_max")), "ring-before")
    while not before.filter(F.col("ptr").isNotNull()).isEmpty():
        up = before.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("behind_max").alias("more"))
        before = cut(before.join(up, "ptr", "left").select("id", F.col("ptr2").alias("ptr"), F.greatest("behind_max", "more").alias("behind_max")), "ring-before")
    whole = ranked.groupBy("cycle_id").agg(F.count("*").alias("length"), F.max("success").alias("success"))
    depth = F.greatest(F.col("ahead_max") - F.col("pos"), F.coalesce(F.col("behind_max") - F.col("pos") + F.col("length"), F.lit(0))).cast("int")
    members = ranked.drop("success").join(ahead_max, "id").join(before.select("id", "behind_max"), "id").join(whole, "cycle_id").select("id", depth.alias("depth"), "success")
    return plain.unionByName(members)

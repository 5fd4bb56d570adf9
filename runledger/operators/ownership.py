"""Which experiments an entity belongs to, and which entities exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.ledger import Ledger
from runledger.lineage import cut
from runledger.schemas import ENTITY_TABLE

VARIANTS = ("owner", "lease", "audit")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Shares that rows without a join key are dealt into.
SHARES = 1009


def left_by_key(df: DataFrame, side: DataFrame, on: list[str], deal: list[str]) -> DataFrame:
    """``df.join(side, on, "left")`` where rows with a null key, which match nothing, are dealt by the columns ``deal`` instead of all meeting in one task."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    # the right side's share is always 0, but no constant: a constant would be taken out of the join key
    left = df.withColumn("_share", F.when(lacks, 1 + F.pmod(F.xxhash64(*deal), F.lit(SHARES))).otherwise(F.lit(0).cast("bigint")))
    right = side.withColumn("_share", F.pmod(F.xxhash64(*on), F.lit(1).cast("bigint")))
    return left.join(right, [*on, "_share"], "left").drop("_share")


def entity_index(ledger: Ledger, types: list[str] | None = None) -> DataFrame:
    """(entity_type, entity_id, deleted_at) over the entity tables."""
    return union_all([
        ledger.table(ENTITY_TABLE[t]).select(F.lit(t).alias("entity_type"), F.col("id").alias("entity_id"), "deleted_at")
        for t in (types or list(ENTITY_TABLE))])


def run_experiments(ledger: Ledger, variant: str = "owner") -> DataFrame:
    """(run_id, experiment_id) pairs."""
    bridge = ledger.table("experiment_runs").select("run_id", "experiment_id")
    if variant != "audit":
        return bridge
    own = ledger.table("runs").filter(F.col("experiment_id").isNotNull()).select(F.col("id").alias("run_id"), "experiment_id")
    return bridge.unionByName(own).distinct()


def job_experiments(ledger: Ledger, variant: str = "owner", only: DataFrame | None = None) -> DataFrame:
    """(job_id, experiment_id) pairs, distinct; ``only`` (job ids as ``id``) narrows the jobs first."""
    jobs = ledger.table("jobs")
    if only is not None:
        jobs = jobs.join(only, "id", "left_semi")
    runs = run_experiments(ledger, variant)
    via_run = jobs.select(F.col("id").alias("job_id"), "run_id")
    if variant != "owner":
        edge = ledger.active("job_runs").select("job_id", "run_id").join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
        via_run = via_run.unionByName(edge).distinct()
    direct = jobs.filter(F.col("experiment_id").isNotNull()).select(F.col("id").alias("job_id"), "experiment_id")
    return direct.unionByName(via_run.join(runs, "run_id").select("job_id", "experiment_id")).distinct()


def _expand_owners(ledger: Ledger, df: DataFrame, keys: list[str], narrow: bool) -> DataFrame:
    """Experiments of rows with own experiment_id, run_id and job_id columns (owner variant).

    One look-up fetches the job's experiment and run; then at most two direct ids and
    two runs per row fan out.  Direct pairs are distinct by construction, linked pairs
    leave out what is direct already, so only those need deduplication.
    """
    jobs = ledger.table("jobs").select(F.col("id").alias("job_id"), F.col("experiment_id").alias("_je"), F.col("run_id").alias("_jr"))
    if narrow:
        jobs = jobs.join(df.select("job_id").filter("job_id IS NOT NULL"), "job_id", "left_semi")

    def pair(a: str, b: str) -> Column:
        return F.array_distinct(F.filter(F.array(a, b), lambda x: x.isNotNull()))

    rows = left_by_key(df, jobs, ["job_id"], keys).select(*[F.col(k) for k in keys], pair("experiment_id", "_je").alias("_direct"), pair("run_id", "_jr").alias("_runs"))
    links = ledger.table("experiment_runs").select(F.col("run_id").alias("_run"), F.col("experiment_id").alias("resolved_id"))
    direct = rows.select(*keys, F.explode("_direct").alias("resolved_id"))
    linked = rows.select(*keys, "_direct", F.explode("_runs").alias("_run")).join(links, "_run").filter(
        ~F.array_contains("_direct", F.col("resolved_id"))).select(*keys, "resolved_id").distinct()
    return direct.unionByName(linked)


def artifact_experiments(ledger: Ledger, variant: str = "owner", only: DataFrame | None = None) -> DataFrame:
    """(artifact_id, experiment_id) pairs over the direct, run and job paths, distinct.

    ``only`` (ids as ``artifact_id``) resolves just those artifacts.
    """
    arts = ledger.table("artifacts").select(F.col("id").alias("artifact_id"), "experiment_id", "run_id", "job_id")
    if only is not None:
        arts = arts.join(only.select("artifact_id"), "artifact_id", "left_semi")
        if variant != "owner":  # read four times below
            arts = cut(arts, "asked-artifacts")
    if variant == "owner":
        return _expand_owners(ledger, arts, ["artifact_id"], only is not None).withColumnRenamed("resolved_id", "experiment_id")
    runs = run_experiments(ledger, variant)
    jobs = job_experiments(ledger, variant, arts.select(F.col("job_id").alias("id")) if only is not None else None)
    return union_all([
        arts.filter(F.col("experiment_id").isNotNull()).select("artifact_id", "experiment_id"),
        arts.select("artifact_id", "run_id").join(runs, "run_id").select("artifact_id", "experiment_id"),
        arts.select("artifact_id", "job_id").join(jobs, "job_id").select("artifact_id", "experiment_id"),
    ]).distinct()


def owner_experiments(ledger: Ledger, triples: DataFrame, narrow: bool = False) -> DataFrame:
    """Resolve distinct (experiment_id, run_id, job_id) owner triples to experiments.

    ``narrow``: the triples are few against the jobs, so look up only their jobs.
    """
    keys = [F.col(c).alias(f"owner_{c}") for c in ("experiment_id", "run_id", "job_id")]
    df = triples.select(*keys, "experiment_id", "run_id", "job_id")
    return _expand_owners(ledger, df, ["owner_experiment_id", "owner_run_id", "owner_job_id"], narrow)


def artifact_counts(ledger: Ledger) -> DataFrame:
    """Active artifacts per experiment over all owner paths, each counted once.

    Artifacts are first combined per owner triple, so a run or job holding a large
    share of them is followed as one row.
    """
    triples = ledger.active("artifacts").groupBy("experiment_id", "run_id", "job_id").agg(F.count("*").alias("n"))
    keyed = triples.select(F.col("n"), *[F.col(c).alias(f"owner_{c}") for c in ("experiment_id", "run_id", "job_id")], "experiment_id", "run_id", "job_id")
    spread = _expand_owners(ledger, keyed, ["n", "owner_experiment_id", "owner_run_id", "owner_job_id"], False)
    return spread.groupBy(F.col("resolved_id").alias("experiment_id")).agg(F.sum("n").alias("artifact_count"))


def entity_experiments(ledger: Ledger, variant: str = "owner") -> DataFrame:
    """(entity_type, entity_id, experiment_id), distinct.

    owner: run by bridge, job own + its run, artifact by all owners, metric by its run.
    lease: as owner for experiment, run, job, plus active job/run edges for jobs.
    audit: adds runs.experiment_id and job/run edges; no metrics.
    """
    def label(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), "experiment_id")

    parts = [
        ledger.table("experiments").select(F.lit("experiment").alias("entity_type"), F.col("id").alias("entity_id"),
                                           F.col("id").alias("experiment_id")),
        label(run_experiments(ledger, variant), "run", "run_id"),
        label(job_experiments(ledger, variant), "job", "job_id"),
    ]
    if variant != "lease":
        parts.append(label(artifact_experiments(ledger, variant), "artifact", "artifact_id"))
    if variant == "owner":
        metric = ledger.table("metrics").select(F.col("id").alias("metric_id"), "run_id").join(run_experiments(ledger), "run_id")
        parts.append(label(metric, "metric", "metric_id"))
    return union_all(parts)


def attach_experiments(ledger: Ledger, df: DataFrame, type_col: str, id_col: str, variant: str) -> DataFrame:
    """Add ``owner_id`` (one row per owning experiment).  An experiment owns itself, listed or not;
    other entity types go through their own bridge so no polymorphic key is ever hot."""
    def branch(kind: str, bridge: DataFrame, key: str) -> DataFrame:
        b = bridge.select(F.col(key).alias("_key"), F.col("experiment_id").alias("owner_id"))
        part = df.filter(F.col(type_col) == kind)
        return part.join(b, part[id_col] == b["_key"]).drop("_key")

    parts = [
        df.filter(F.col(type_col) == "experiment").withColumn("owner_id", F.col(id_col)),
        branch("run", run_experiments(ledger, variant), "run_id"),
        branch("job", job_experiments(ledger, variant), "job_id"),
    ]
    if variant != "lease":
        parts.append(branch("artifact", artifact_experiments(ledger, variant), "artifact_id"))
    if variant == "owner":
        metric = ledger.table("metrics").select(F.col("id").alias("metric_id"), "run_id").join(run_experiments(ledger), "run_id")
        parts.append(branch("metric", metric, "metric_id"))
    return union_all(parts)


def flag(condition: Column) -> Column:
    """0/1 as INT, NULL conditions count as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0).cast("bigint")).alias(column)

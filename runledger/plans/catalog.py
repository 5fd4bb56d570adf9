"""All named queries: name -> (function of a ledger, checking SQL body or None)."""

from __future__ import annotations

from runledger.plans.audit_checks import AUDITS
from runledger.plans.checking import checking_sql
from runledger.plans.flow_checks import FLOWS
from runledger.plans.reconcile_checks import RECONCILE
from runledger.plans.report_checks import REPORTS
from runledger.plans.store_checks import STORED
from runledger.plans.view_checks import VIEWS
from runledger.projection import project

QUERIES: dict = {**VIEWS, **AUDITS, **REPORTS, **FLOWS, **RECONCILE, **STORED}


def spark_queries() -> dict:
    def bind(fn):
        return lambda spark, sf_dir: fn(project(spark, sf_dir))
    return {name: bind(fn) for name, (fn, _sql) in QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    return {name: checking_sql(sql) for name, (_fn, sql) in QUERIES.items() if sql}

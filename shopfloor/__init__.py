"""shopfloor — manufacturing-ERP report operators as Spark DataFrame plans.

Every public operator takes DataFrames (plus plain Python parameters) and
returns a DataFrame.  Nothing is collected to the driver except one-row
settings lookups; all heavy work is joins, aggregations and explodes that
Catalyst plans and AQE re-plans at run time.

Layout
------
functions/  Column-level helpers (CASE labels, cost method, date formats,
            route-string rendering, edge-work token arithmetic).
operators/  Reusable DataFrame operators (optional filters, anti/semi joins,
            look-back aggregation, list splitting, EAV attributes, edge flags).
plans/      The report-level operators (usage, demand, backlog, labels,
            plan-date workflow, post-edge lineal).
sources/    Input contracts (schemas), table loading, and the mapping from the
            driver's TPC-H-shaped test tables to the ERP input contracts.
"""

_EXPORTS = {
    "backlog_snapshot": "shopfloor.plans.backlog",
    "post_edge_lineal": "shopfloor.plans.edgework",
    "plan_date_workflow": "shopfloor.plans.workflow",
    "so_quantity_detail": "shopfloor.plans.demand",
    "usage_by_period": "shopfloor.plans.usage",
    "work_cell_labels": "shopfloor.plans.labels",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        import importlib

        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)

"""All queries of the library itself."""

from __future__ import annotations

from quillstone.plans import answering, answers, clinical, concepts, evidence, extras, graphs, hygiene, intake, paths, projections, reporting, reports, retrieval, tabular, texts  # noqa: F401
from quillstone.plans.catalog import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

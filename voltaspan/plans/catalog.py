"""All queries of the engine's own operators, by id."""

from __future__ import annotations

from voltaspan.plans import characterisation, models, recordings, relations, reports, rules, series
from voltaspan.plans.base import Query

CATALOG: dict[str, Query] = {**series.QUERIES, **relations.QUERIES, **reports.QUERIES, **models.QUERIES, **rules.QUERIES, **recordings.QUERIES, **characterisation.QUERIES}

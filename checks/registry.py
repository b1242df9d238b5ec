"""All registered queries and their DuckDB texts."""

from __future__ import annotations

from checks import (
    oracle_dataset,
    oracle_defects,
    oracle_features,
    registry_dataset,
    registry_defects,
    registry_features,
)

QUERIES = {**registry_features.QUERIES, **registry_defects.QUERIES, **registry_dataset.QUERIES}
ORACLES = {**oracle_features.ORACLES, **oracle_defects.ORACLES, **oracle_dataset.ORACLES}

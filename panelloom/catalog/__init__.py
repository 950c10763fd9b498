"""All registered queries with their check SQL."""

from panelloom.catalog import (  # noqa: F401
    aggregates,
    gates,
    modelling,
    monitoring,
    scans,
    screening,
    statistics,
)
from panelloom.catalog.base import QUERIES, SQL  # noqa: F401

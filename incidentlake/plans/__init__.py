"""All registered queries. Importing the family modules fills the registry."""

from incidentlake.plans import ingest, models, regionhour, requests, stats, vulns  # noqa: F401
from incidentlake.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

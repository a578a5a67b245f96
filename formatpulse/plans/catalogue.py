"""All registered queries: name -> (function of session and directory, SQL or None)."""

from __future__ import annotations

from formatpulse.plans import (
    catalogue_content, catalogue_ingest, catalogue_jobs, catalogue_relational, catalogue_scores,
)

CATALOGUE = {
    **catalogue_scores.QUERIES,
    **catalogue_relational.QUERIES,
    **catalogue_content.QUERIES,
    **catalogue_jobs.QUERIES,
    **catalogue_ingest.QUERIES,
}

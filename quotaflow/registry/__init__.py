"""All registered queries by name."""

from __future__ import annotations

from quotaflow.registry import documents, jobs, live, metrics, monitoring, questions, streams, tables

ENTRIES = {
    **tables.ENTRIES, **metrics.ENTRIES, **monitoring.ENTRIES, **questions.ENTRIES, **documents.ENTRIES, **jobs.ENTRIES,
    **streams.ENTRIES, **live.ENTRIES,
}

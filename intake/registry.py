"""Every registered query and, where SQL can express it, the SQL that must give the same rows."""

from __future__ import annotations

from intake.plans import history, lookups, streams, trees
from intake.plans import intake as pages

QUERIES: dict = {**lookups.QUERIES, **history.QUERIES, **pages.QUERIES, **streams.QUERIES, **trees.QUERIES}
ORACLES: dict[str, str] = {**lookups.ORACLES, **history.ORACLES, **pages.ORACLES, **streams.ORACLES, **trees.ORACLES}
FLAGSHIP = "resolve_progress"

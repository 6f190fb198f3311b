"""The library's own queries and their SQL."""

from __future__ import annotations

from recollect.plans import answers, changes, dense, memory, rebuilt, reports, splits, sweeps, tables, texts, tokens

QUERIES: dict = dense.QUERIES | answers.QUERIES | texts.QUERIES | changes.QUERIES | reports.QUERIES | splits.QUERIES | tables.QUERIES | memory.QUERIES | tokens.QUERIES | sweeps.QUERIES | rebuilt.QUERIES
ORACLES: dict[str, str] = dense.ORACLES | answers.ORACLES | texts.ORACLES | changes.ORACLES | reports.ORACLES | splits.ORACLES | tables.ORACLES | memory.ORACLES | tokens.ORACLES | sweeps.ORACLES | rebuilt.ORACLES

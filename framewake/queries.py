"""Every query of the library, and the SQL that says the same."""

from __future__ import annotations

from .plans import audio, files, packs, records, reports, requirements, rules, scalars, shapes, streams, timed, trees, verify, video

QUERIES, ORACLE_SQL = {}, {}
for module in (timed, reports, scalars, rules, streams, packs, records, files, trees, video, requirements, shapes, verify, audio):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL

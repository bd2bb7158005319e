"""All queries over the reference's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from scenewatch.jobs import block_queries, grid_queries, more_queries, scene_queries

FLAGSHIP = "pathology_tiles"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (scene_queries, grid_queries, more_queries, block_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES

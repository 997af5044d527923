"""Canonical tables and the closed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies of the exchange format.
NODE_KINDS = [
    "repository", "workspace", "package", "build_target", "directory",
    "file", "symbol", "external_package", "agent_session",
]
EDGE_KINDS = [
    "contains", "owns", "depends_on", "imports", "defines",
    "references", "calls", "inherits", "generated_from",
]
FRESHNESS = ["current", "stale", "pending", "invalid"]
CONFIDENCE = ["exact", "high", "heuristic", "unresolved"]
LEVELS = ["package", "build_target", "file", "symbol"]
FILE_CHANGES = ["created", "modified", "deleted", "renamed"]
PROCESSING = ["pending", "structural", "semantic", "settled"]
ADAPTER_STATES = ["idle", "running", "degraded", "failed"]
IMPACT_CAUSES = ["implementation", "dependency_added", "dependency_removed"]
EVENT_TYPES = [
    "session.started", "file.changed", "graph.updated",
    "impact.updated", "adapter.status", "reconcile.checkpoint",
]

# Edge kinds that express a dependency, and node kinds each level admits.
DEPENDENCY_KINDS = ["depends_on", "imports", "references", "calls", "inherits", "generated_from"]
LEVEL_KINDS = {
    "package": ["package"],
    "build_target": ["build_target"],
    "file": ["file"],
    "symbol": ["symbol", "file"],
}
# Edge kinds a level is scored with when no impact result names its own.
LEVEL_EDGE_KINDS = {
    "package": ["depends_on"],
    "build_target": ["depends_on"],
    "file": ["imports", "calls", "references", "inherits"],
    "symbol": ["imports", "calls", "references", "inherits"],
}
MAX_DEPTH = 8
MAX_ANCESTORS = 64
HUB_THRESHOLD = 0.35
LOG_LIMIT = 512
DEAD_LETTER_LIMIT = 200

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


EVIDENCE = _struct(artifact=_S, line=_I, snippet=_S)

NODE = _struct(id=_S, kind=_S, name=_S, path=_S, parent=_S, language=_S, freshness=_S,
               attrs=T.MapType(_S, _S))
EDGE = _struct(id=_S, kind=_S, src=_S, dst=_S, provider=_S, provider_version=_S,
               confidence=_S, freshness=_S, valid_from=_L, valid_to=_L, evidence=EVIDENCE)

NODES = T.StructType([T.StructField("repo_id", _S)] + NODE.fields)
EDGES = T.StructType([T.StructField("repo_id", _S)] + EDGE.fields)

# The document spells the edge ends ``from`` and ``to``; tables say ``src`` and ``dst``.
EDGE_JSON = T.StructType([
    T.StructField({"src": "from", "dst": "to"}.get(f.name, f.name), f.dataType) for f in EDGE.fields
])

SESSION = _struct(id=_S, name=_S, baseline_generation=_L, started_at_ms=_D)
REPO = _struct(root=_S, name=_S, head=_S, branch=_S, detached=_B)

SNAPSHOT_JSON = _struct(
    schema=_S, generation=_L, repo=REPO, session=SESSION,
    nodes=T.ArrayType(NODE), edges=T.ArrayType(EDGE_JSON),
)

FILTERS = _struct(max_depth=_I, edge_kinds=T.ArrayType(_S), include_heuristic=_B)
IMPACTED_JSON = _struct(
    node_id=_S, min_distance=_I, direct=_B, changed=_B, freshness=_S, cause=_S,
    paths=T.ArrayType(_struct(edges=T.ArrayType(_S))), paths_truncated=_B,
)

EVENT_JSON = _struct(
    t_ms=_D, type=_S, generation=_L,
    session=SESSION,
    path=_S, node_id=_S, change=_S, from_path=_S, processing=_S,
    added_nodes=T.ArrayType(NODE), updated_nodes=T.ArrayType(NODE),
    removed_nodes=T.ArrayType(_S),
    added_edges=T.ArrayType(EDGE_JSON), updated_edges=T.ArrayType(EDGE_JSON),
    removed_edges=T.ArrayType(_S), note=_S,
    level=_S, baseline_generation=_L, seed_nodes=T.ArrayType(_S), filters=FILTERS,
    impacted_nodes=T.ArrayType(IMPACTED_JSON),
    adapter=_S, state=_S, queue_depth=_I, last_success_generation=_L, message=_S,
    corrections=_I,
    snapshot=SNAPSHOT_JSON,
)

FILES = _struct(repo_id=_S, rel=_S, content=_S)
LISTING = _struct(repo_id=_S, rel=_S, is_dir=_B, mtime=_D)

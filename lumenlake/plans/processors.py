"""Processing chains: named DataFrame transforms, applied in the order that a workflow's edges give.

Spark plans the work; what is checked here is only that a configuration can be applied.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame, dict], DataFrame]


@dataclass(frozen=True)
class Node:
    id: str
    processor: str
    enabled: bool = True
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Workflow:
    nodes: tuple[Node, ...]
    edges: tuple[tuple[str, str], ...]


def load_workflow(text: str) -> Workflow:
    """A workflow from JSON: ``{"nodes": [{"id", "processor", "enabled", "config"}], "edges": [["from", "to"]]}``; unknown fields are ignored."""
    raw, known = json.loads(text), {f.name for f in fields(Node)}
    nodes = tuple(Node(**{k: v for k, v in n.items() if k in known}) for n in raw.get("nodes", []))
    return Workflow(nodes, tuple((a, b) for a, b in raw.get("edges", [])))


def problems(workflow: Workflow, known: Iterable[str], required: Iterable[str], sink: str) -> list[str]:
    """Codes of what is wrong with a workflow; none if it can be applied."""
    out, ids = [], [n.id for n in workflow.nodes]
    if len(set(ids)) < len(ids):
        out.append("duplicate_node")
    if any(n.processor not in set(known) for n in workflow.nodes):
        out.append("unknown_processor")
    if any(a not in ids or b not in ids for a, b in workflow.edges):
        out.append("missing_edge_node")
    active = {n.processor for n in workflow.nodes if n.enabled}
    if any(r not in active for r in required):
        out.append("missing_required_processor")
    if sink not in active:
        out.append("missing_index_sink")
    if len(set(ids) - {b for _, b in workflow.edges}) != 1 and ids:
        out.append("invalid_start")
    try:
        order(workflow)
    except CycleError:
        out.append("cycle")
    return out


def order(workflow: Workflow) -> list[Node]:
    before: dict[str, set[str]] = {n.id: set() for n in workflow.nodes}
    for a, b in workflow.edges:
        before.setdefault(b, set()).add(a)
    by_id = {n.id: n for n in workflow.nodes}
    return [by_id[i] for i in TopologicalSorter(before).static_order() if i in by_id]


def apply(df: DataFrame, workflow: Workflow, registry: dict[str, Transform], without: Iterable[str] = ()) -> DataFrame:
    """The frame passed through the enabled processors; ``without`` leaves out the sink in searches."""
    for node in order(workflow):
        if node.enabled and node.processor not in set(without):
            df = df.transform(registry[node.processor], node.config)
    return df

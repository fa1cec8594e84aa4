"""Small results as Markdown; each takes what a query has already narrowed down."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a section; that there are more is said.
SHOWN = 200


def section(title: str, rows: DataFrame, columns: list[str]) -> str:
    lines = [f"## {title}", ""]
    found = rows.select(*columns).limit(SHOWN + 1).collect()
    for r in found[:SHOWN]:
        lines.append("- " + " — ".join(str(x) for x in r if x is not None))
    if len(found) > SHOWN:
        lines.append(f"- … and more than {SHOWN}")
    return "\n".join([*lines, ""])


def chat_context(nodes: DataFrame, edges: DataFrame, layers: DataFrame) -> str:
    """What a question's neighbourhood holds: nodes, edges, layers."""
    return "\n".join([section("Nodes", nodes.orderBy("ord"), ["id", "type", "name"]), section("Relations", edges.orderBy("ord"), ["source", "type", "target"]), section("Layers", layers.orderBy("layer_id"), ["layer_id"])])


def change_report(changed: DataFrame, affected: DataFrame, layers: DataFrame, risk: DataFrame) -> str:
    r = risk.first()
    level = "high" if r.has_complex and r.crosses_layers else "medium" if r.has_complex or r.crosses_layers or r.wide else "low"
    return "\n".join([f"# Impact: {level}", "", section("Changed", changed.orderBy("id"), ["id"]), section("Affected", affected.orderBy("id"), ["id"]), section("Layers", layers.orderBy("layer_id"), ["layer_id"])])


def onboarding(project: str, layers: DataFrame, hotspots: DataFrame, tour: DataFrame) -> str:
    return "\n".join([f"# {project}", "", section("Layers", layers.orderBy("layer_id"), ["layer_id", "members", "complexity"]), section("Hotspots", hotspots, ["id", "degree"]), section("Tour", tour.orderBy("step", "pos"), ["step", "title", "id"])])

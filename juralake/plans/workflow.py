"""Workflow graphs compiled to one DataFrame plan.

A graph is a dict of nodes and edges, as JSON holds it. Nodes run level by level, a node after all its predecessors; every
row is a request and carries the nodes' outputs as columns.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juralake.functions.extract import json_or_text
from juralake.functions.text import fill_template
from juralake.plans.providers import messages

#: What a node that wants JSON tells its model.
JSON_ONLY = " Output ONLY valid JSON."

#: A small graph with a router and two branches that meet.
EXAMPLE = {
    "nodes": [
        {"id": "start", "type": "start"},
        {"id": "route", "type": "router", "data": {"condition": "n_chars > 500"}},
        {"id": "long", "type": "action", "data": {"template": "long {{lang}} text of {{n_chars}}"}},
        {"id": "count", "type": "code", "data": {"expression": "n_chars div 4"}},
        {"id": "both", "type": "action", "data": {"template": "{{long}}: {{count}} tokens"}},
    ],
    "edges": [{"from": "start", "to": "route"}, {"source": "start", "target": "count"}, {"from": "route", "to": "long"}, {"from": "long", "to": "both"}, {"from": "count", "to": "both"}],
}


#: A graph whose router stops short texts.
GUARDED = {
    "nodes": [
        {"id": "begin", "type": "start"},
        {"id": "enough", "type": "router", "data": {"condition": "n_chars > 900"}},
        {"id": "told", "type": "action", "data": {"template": "{{lang}} text of {{n_chars}}"}},
    ],
    "edges": [{"from": "begin", "to": "enough"}, {"from": "enough", "to": "told"}],
}


@dataclass
class Handlers:
    """What runs the nodes that need the outside: each takes the frame, the node's data and the name of its output column.

    ``complete`` gets a prompt, or a conversation as JSON where the node has a system prompt, a history (the column chat_history) or
    wants JSON; ``retrieve`` serves retrieval nodes and the grounding of actions; ``others`` serve types of their own, such as research.
    """

    complete: Callable[[DataFrame, str, str], DataFrame] | None = None
    retrieve: Callable[[DataFrame, dict, str], DataFrame] | None = None
    others: dict[str, Callable[[DataFrame, dict, str], DataFrame]] = field(default_factory=dict)


def edges_of(graph: dict) -> list[tuple[str, str]]:
    """Edges as pairs, by either spelling of their ends."""
    return [(e.get("from", e.get("source")), e.get("to", e.get("target"))) for e in graph.get("edges", [])]


def levels(spark: SparkSession, graph: dict) -> DataFrame:
    """(node, level): the longest way from a start to each node that can be reached, by a recursive query."""
    edges = spark.createDataFrame(edges_of(graph), "a string, b string")
    starts = spark.createDataFrame([(n["id"],) for n in graph["nodes"] if n["type"] == "start"], "node string")
    n = len(graph["nodes"])
    return spark.sql(
        f"""WITH RECURSIVE walk(node, level) AS (
            SELECT node, 0 FROM {{starts}} UNION ALL SELECT e.b, w.level + 1 FROM walk w JOIN {{edges}} e ON e.a = w.node WHERE w.level < {n})
        SELECT node, max(level) AS level FROM walk GROUP BY node""",
        starts=starts, edges=edges,
    )


def ordered(graph: dict) -> list[str]:
    """Nodes that a start reaches, each after all its predecessors; raises on a cycle."""
    follow, before = defaultdict(list), defaultdict(set)
    for a, b in edges_of(graph):
        follow[a].append(b)
        before[b].add(a)
    known = {n["id"] for n in graph["nodes"]}
    reached, todo = set(), [n["id"] for n in graph["nodes"] if n["type"] == "start"]
    while todo:
        a = todo.pop()
        if a not in reached and a in known:
            reached.add(a)
            todo += follow[a]
    out: list[str] = []
    while len(out) < len(reached):
        ready = [n["id"] for n in graph["nodes"] if n["id"] in reached and n["id"] not in out and before[n["id"]] & reached <= {*out}]
        if not ready:
            raise ValueError("the graph has a cycle")
        out += ready
    return out


def run(graph: dict, requests: DataFrame, handlers: Handlers) -> DataFrame:
    """``requests`` with a column per node's output, ``status`` and ``output``.

    A node runs on a row if one of its predecessors ran there; a router passes rows on whose SQL condition holds, NULL holding
    not. Outputs of nodes that didn't run are NULL. status is completed if a node without successors ran, else halted; output is
    the last such node's. Unknown types are refused when the plan is made.
    """
    nodes = {n["id"]: n for n in graph["nodes"]}
    before, after = defaultdict(list), defaultdict(list)
    for a, b in edges_of(graph):
        before[b].append(a)
        after[a].append(b)
    df, order = requests, ordered(graph)
    columns = requests.columns
    for name in order:
        node, data = nodes[name], nodes[name].get("data", {})
        here = F.lit(node["type"] == "start")
        for p in before[name]:
            if p in order:
                here = here | F.col(f"__on_{p}")
        kind = node["type"]
        active = here
        if kind == "start":
            value = F.lit("manual")
        elif kind == "router":
            active = here & F.coalesce(F.expr(data["condition"]).cast("boolean"), F.lit(False))
            value = F.expr(data["condition"]).cast("string")
        elif kind == "code":
            value = F.expr(data["expression"]).cast("string")
        elif kind == "action":
            value = fill_template(F.lit(data["template"]), {c: F.col(f"`{c}`") for c in df.columns if not c.startswith("__on_")})
            if data.get("grounding") and handlers.retrieve:
                df = handlers.retrieve(df, data, "__ground")
                value = F.concat(value, F.coalesce(F.concat(F.lit("\n\nContext:\n"), F.nullif("__ground", F.lit(""))), F.lit("")))
            if handlers.complete:
                system = data.get("system_prompt", "") + (JSON_ONLY if data.get("json_mode") else "")
                past = F.col("chat_history") if data.get("use_chat_history") and "chat_history" in df.columns else None
                asked = messages(F.lit(system), past, value) if system or past is not None else value
                df = handlers.complete(df.withColumn("__prompt", F.when(here, asked)), "__prompt", "__reply").drop("__prompt")
                value = F.col("__reply")
            if data.get("json_mode"):
                held = json_or_text(value)
                value = F.coalesce(F.to_json(held["json"]), held["text"])
        elif kind == "retrieval" and handlers.retrieve:
            df = handlers.retrieve(df, data, "__reply")
            value = F.col("__reply")
        elif kind in handlers.others:
            df = handlers.others[kind](df, data, "__reply")
            value = F.col("__reply")
        else:
            raise ValueError(f"unknown node type {kind!r}")
        df = df.withColumn(f"__on_{name}", active).withColumn(name, F.when(here, value)).drop("__reply", "__ground")
    ends = [n for n in order if not after[n]]
    ran = F.lit(False)
    for n in ends:
        ran = ran | F.col(f"__on_{n}")
    output = F.coalesce(*(F.when(F.col(f"__on_{n}"), F.col(n)) for n in reversed(order) if nodes[n]["type"] not in ("start", "router")), F.lit(None).cast("string"))
    out = df.withColumn("status", F.when(ran, "completed").otherwise("halted")).withColumn("output", output)
    return out.select(*columns, *(n for n in order if n not in columns), "status", "output")

"""The two documents that hand a project on: its context and the brief for compiling notes, each as JSON and as markdown.

All parts are bounded top-n of distributed tables (see ``brief``), so what comes to the driver doesn't grow with the project.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import brief
from .context import Context

PROJECT_CHARS, MARK_CHARS = 1200, 240


@dataclass(frozen=True)
class Project:
    """What a document says about the project besides its events."""

    workspace: str
    made: str
    last_sync: str | None = None
    summary: str | None = None
    agents: list[dict] = field(default_factory=list)  # name, events, connected


def connected(agents: DataFrame) -> list[dict]:
    """The connected ones of a table of agents (name, status, events, connected)."""
    rows = agents.where("status = 'connected'").select("name", F.coalesce("events", F.lit(0)).alias("events"), F.col("connected").cast("string").alias("connected"))
    return [r.asDict() for r in rows.orderBy("name").collect()]


def _iso(column: str = "ts"):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def event_rows(rows: DataFrame, limit: int = brief.CONTENT) -> DataFrame:
    """The recent events of each sort as a context shows them: edits by file and summary, messages by their text."""
    edit = F.col("kind").isin("code_edit", "artifact")
    summary = X.truncated(F.coalesce(F.nullif("summary", F.lit("")), F.nullif("content", F.lit("")), F.lit("File edited")), limit)
    shown = brief.recent(rows)
    return shown.select(
        _iso().alias("ts"), "source", "kind", "role", F.when(edit, F.col("file")).alias("file"), F.when(edit, F.col("path")).alias("path"), F.when(edit, summary).alias("summary"),
        F.when(edit, F.coalesce(F.length("diff") > 0, F.lit(False))).alias("has_diff"), F.when(~edit, X.truncated(F.coalesce("content", F.lit("")), limit)).alias("content"),
    )


def context_document(project: Project, rows: DataFrame, tasks: DataFrame, decisions: DataFrame, graph: Context | None = None) -> dict:
    """The context as a structure: figures, open work (lines of notes), last checkpoint, recent events, the compiled graph."""
    mark = brief.last_checkpoint(rows).select(
        _iso().alias("ts"), "source", "kind", F.coalesce(F.nullif("file", F.lit("")), "path").alias("file"), F.coalesce(F.nullif("summary", F.lit("")), "content").alias("summary")
    ).first()
    names = ", ".join(a["name"] for a in project.agents) or "none"
    plain = lambda: "\n".join([f"Workspace: {project.workspace}", f"Connected agents: {names}", f"Timeline events: {rows.count()}", f"Last sync: {project.last_sync or 'never'}"])
    out = {
        "version": 1, "made": project.made, "workspace": project.workspace, "last_sync": project.last_sync, "summary": (project.summary or "").strip()[:PROJECT_CHARS] or plain(),
        "tasks": [r["line"] for r in brief.task_lines(tasks).collect()], "decisions": [r["line"] for r in brief.open_decision_lines(decisions).collect()],
        "agents": project.agents, "checkpoint": mark.asDict() if mark else None, "events": [r.asDict() for r in event_rows(rows).collect()],
    }
    if graph is not None:
        out["graph"] = {"text": graph.text, "included": graph.included, "used": graph.used, "budget": graph.budget}
    return out


def _heading(e: dict) -> str:
    if e["kind"] == "code_edit":
        return f"[edit] {e['source']} edited {e['file'] or 'file'}"
    return f"[artifact] {e['source']} {e['file'] or ''}" if e["kind"] == "artifact" else f"[{e['source']}] {e['role']}"


def context_markdown(doc: dict) -> str:
    mark, events = doc["checkpoint"], doc["events"]
    parts = ["# PROJECT CONTEXT", f"> {doc['made']} | workspace `{doc['workspace']}` | last sync {doc['last_sync'] or 'never'}", "## PROJECT SUMMARY", doc["summary"]]
    parts += ["## CURRENT TASKS", "\n".join(doc["tasks"]) or "_No tasks yet._", "## OPEN DECISIONS", "\n".join(doc["decisions"]) or "_No open decisions._"]
    agents = "\n".join(f"- **{a['name']}** | {a['events']} events | connected {a['connected'] or '?'}" for a in doc["agents"])
    parts += ["## CONNECTED AGENTS", agents or "_No agents connected._", "## LAST CHECKPOINT"]
    if mark:
        parts += [f"- **{mark['kind']}** via {mark['source']} at {mark['ts']}", f"- File: `{mark['file']}`" if mark["file"] else "", f"- {_cut(mark['summary'], MARK_CHARS)}" if mark["summary"] else ""]
    else:
        parts.append("No checkpoint or code edit recorded yet.")
    parts.append("## RELEVANT EVENTS")
    parts += [f"### {_heading(e)} | {e['ts'] or '?'}\n{e['content'] or e['summary'] or ''}" for e in events] or ["_No events yet._"]
    if g := doc.get("graph"):
        parts += ["## MEMORY GRAPH", g["text"] or "_empty_", f"_{len(g['included'])} nodes | ~{g['used']}/{g['budget']} tokens_"]
    return "\n".join(p for p in parts if p)


def _cut(text: str, limit: int) -> str:
    text = text.strip()
    return text if len(text) <= limit else text[: limit - 1] + "…"


def brief_document(project: Project, rows: DataFrame, notes: dict[str, str]) -> dict:
    """What a compile of the notes starts from: the last events as texts, and the notes (name to text) as they are."""
    sample = [r["text"] for r in brief.sample(rows).collect()]
    return {"version": 1, "made": project.made, "workspace": project.workspace, "last_sync": project.last_sync, "events": rows.count(), "shown": len(sample), "agents": project.agents, "notes": notes, "sample": sample}


def brief_markdown(doc: dict) -> str:
    lines = ["# COMPILE BRIEF", "", f"> {doc['made']} | workspace `{doc['workspace']}` | {doc['shown']} of {doc['events']} timeline events", "", "## Connected agents", ""]
    lines.append("\n".join(f"- {a['name']} ({a['events']} events)" for a in doc["agents"]) or "_None._")
    lines += ["", "## Notes", ""]
    for name, text in doc["notes"].items():
        lines += [f"### {name}", "", "```markdown", text.strip() or "(empty)", "```", ""]
    lines += ["## Timeline sample", "", *(x for block in doc["sample"] for x in ("```text", block, "```", ""))]
    return "\n".join(lines if doc["sample"] else [*lines, "_Empty._"])


def write(spark: SparkSession, doc: dict, markdown: str, root: str) -> None:
    """One row of JSON and one of markdown under ``root``, each overwritten whole."""
    for name, text in (("json", json.dumps(doc, ensure_ascii=False)), ("markdown", markdown)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")

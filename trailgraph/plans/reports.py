"""Markdown reports over ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, headers: dict[str, str], limit: int | None = None) -> str:
    """Markdown table of all rows, or of the first ``limit`` and a note of how many are left out; headers map columns to titles."""
    rows = (df if limit is None else df.limit(limit)).select(*headers).collect()
    more = 0 if limit is None else df.count() - len(rows)
    lines = ["| " + " | ".join(headers.values()) + " |", "|" + "---|" * len(headers)]
    lines += ["| " + " | ".join("—" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    if more > 0:
        lines += ["", f"_{more} more rows_"]
    return "\n".join(lines if rows or more > 0 else lines + ["|" + " — |" * len(headers)])


def history_report(hotspots: DataFrame, ownership: DataFrame, coupling: DataFrame, velocity: DataFrame, window_days: int) -> str:
    parts = [
        f"# Change history\n\nWindow: last {window_days} days",
        "## Hotspots\n\n" + table(hotspots, {"file": "File", "change_freq": "Change Freq", "score": "Score"}),
        "## Module Ownership\n\n" + table(ownership.orderBy("module"), {"module": "Module", "primary_owner": "Primary Owner", "bus_factor": "Bus Factor", "is_orphaned": "Orphaned"}),
        "## Change Coupling\n\n" + table(coupling, {"file_a": "File A", "file_b": "File B", "co_changes": "Co-changes", "strength": "Strength", "cross_module": "Cross-module"}),
        "## Velocity\n\n" + table(velocity.orderBy(velocity.touches_per_week.desc(), "module"), {"module": "Module", "touches_per_week": "Touches/Week", "trend": "Trend"}),
    ]
    return "\n\n".join(parts) + "\n"


def freshness_report(scores: DataFrame, decision: DataFrame) -> str:
    d = decision.first()
    head = f"# Freshness\n\nDecision: **{d['decision']}** (lowest score {d['min_score']})"
    return head + "\n\n" + table(scores.orderBy("score", "path"), {"path": "Document", "score": "Score", "status": "Status", "action": "Action"}) + "\n"


def claims_report(verified: DataFrame, counts: DataFrame) -> str:
    c = counts.first()
    head = f"Claims: {c['verified']} verified, {c['refuted']} refuted, {c['unverified']} unverified, {c['stale']} stale, {c['missing']} missing — of {c['total']}."
    return head + "\n\n" + table(verified.filter("status <> 'verified'").orderBy("id"), {"id": "Claim", "status": "Status", "stale": "Stale", "missing": "Missing"}) + "\n"


def experiments_report(experiments: DataFrame, summary: DataFrame) -> str:
    s = summary.first()
    body = table(experiments, {"id": "ID", "target_file": "Target", "verdict": "Verdict", "hypothesis": "Hypothesis"})
    return f"# Experiment history\n\n{body}\n\n**Summary:** Total: {s['total']} | Keep: {s['kept']} ({s['kept_percent']}%) | Revert: {s['reverted']}\n"


def brief_report(title: str, parts: dict[str, DataFrame], limit: int | None = None) -> str:
    out = [f"# Repo Brief — {title}"]
    for name, df in parts.items():
        out.append(f"## {name.replace('_', ' ').capitalize()}\n\n" + table(df, {c: c.replace("_", " ") for c in df.columns}, limit))
    return "\n\n".join(out) + "\n"

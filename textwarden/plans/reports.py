"""Reports of small roll-ups as JSON or HTML. What they collect is bounded by the number of categories and ``incidents``."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

from ..sources.evidence import query, stats
from . import compliance as c

VERSION = "1.0"
#: Columns shown as a badge or, times a factor to percent, as a bar.
BADGES, BARS = ("grade", "compliant", "risk_level", "maturity_label", "severity", "passed"), {"risk_score": 100, "compliance_score": 1, "score": 1}
GOOD, BAD = ("A", "B", "low", "Defined", "Optimizing"), ("D", "F", "high", "critical", "Initial")
STYLE = "<style>td,th{text-align:left;padding:2px 8px}.badge{border-radius:4px;padding:0 6px;color:#fff}.good{background:#187a3c}.fair{background:#8a6100}.bad{background:#b3261e}.bar{background:#ddd;height:6px;width:120px}.bar i{background:#33579b;display:block;height:6px}</style>"


def json_report(evidence: DataFrame, rows: DataFrame, incidents: int = 10) -> dict:
    """Version, summary, the three findings and the latest failures of stored evidence and its verdicts."""
    plain = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    owasp, eu, nist = c.owasp_findings(rows), c.eu_findings(rows), c.nist_findings(rows)
    summary = plain(stats(evidence))[0] | {"owasp": plain(c.owasp_posture(owasp))[0], "eu_ai_act": plain(c.eu_posture(eu))[0]}
    return {"version": VERSION, "summary": summary, "owasp_findings": plain(owasp), "eu_ai_act_findings": plain(eu), "nist_findings": plain(nist), "incidents": plain(query(evidence, failed_only=True, limit=incidents).drop("checks"))}


def html_report(report: dict) -> str:
    def table(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        names = list(dict.fromkeys(k for r in rows for k in r))
        plain = lambda x: html.escape(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))

        def cell(name: str, x: object) -> str:
            if name in BADGES and isinstance(x, (str, bool)):
                return f'<span class="badge {"good" if x in GOOD or x is True else "bad" if x in BAD or x is False else "fair"}">{plain(x)}</span>'
            if name in BARS and isinstance(x, (int, float)):
                return f'{plain(x)}<div class="bar"><i style="width:{max(0, min(100, round(x * BARS[name])))}%"></i></div>'
            return plain(x)

        head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{cell(n, r.get(n, ''))}</td>" for n in names) + "</tr>" for r in rows)
        return f"<table><tr>{head}</tr>{body}</table>"

    parts = [("Summary", [report["summary"]]), ("OWASP LLM Top 10", report["owasp_findings"]), ("EU AI Act", report["eu_ai_act_findings"]), ("NIST AI RMF", report["nist_findings"]), ("Incidents", report["incidents"])]
    return "<!DOCTYPE html><meta charset=utf-8><title>Compliance</title>" + STYLE + "".join(f"<h2>{t}</h2>{table(r)}" for t, r in parts)


def save_report(report: dict | str, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(report if isinstance(report, str) else json.dumps(report, indent=2, ensure_ascii=False), encoding="utf-8")
    return path

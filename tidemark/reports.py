"""Small tables as text: Markdown for people and plain data for files."""

from __future__ import annotations

import datetime
import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that a report shows.
MOST_ROWS = 1000
REPORT_VERSION = "1.0"
#: Metrics of which more is better.
HIGHER = ("topn_path_overlap", "nn_distance_p05")


def plain(value: Any) -> Any:
    """A value as JSON has it: times as ISO text, numbers that are not finite as null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def rows(df: DataFrame, most: int = MOST_ROWS) -> list[dict[str, Any]]:
    """The first rows, in order of their columns."""
    kept = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    return [plain(r.asDict()) for r in df.orderBy(*kept).limit(most).collect()]


def cell(value: Any) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.4g}" if abs(value) < 1e6 else f"{value:.0f}"
    return ", ".join(map(cell, value)) if isinstance(value, list) else str(value).replace("|", "\\|").replace("\n", " ")


def table(data: list[dict[str, Any]]) -> list[str]:
    if not data:
        return ["(nothing)"]
    names = list(data[0])
    return ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in data)]


def collected(tables: Mapping[str, DataFrame], most: int = MOST_ROWS) -> dict[str, list[dict[str, Any]]]:
    return {name: rows(df, most) for name, df in tables.items()}


def markdown(title: str, data: Mapping[str, list[dict[str, Any]]], notes: list[str] | None = None) -> str:
    lines = [f"# {title}"]
    for name, part in data.items():
        lines += ["", f"## {name}", "", *table(part)]
    return "\n".join([*lines, *([""] + [f"- {n}" for n in notes] if notes else [])]) + "\n"


def sides(real: DataFrame, synthetic: DataFrame) -> list[dict[str, Any]]:
    """Events, sessions and learners of two logs."""
    size = lambda df: df.agg(F.count("*").alias("n_events"), F.count_distinct("session_id").alias("n_sessions"), F.count_distinct("learner_id").alias("n_learners")).first().asDict()
    return [{"log": "real", **size(real)}, {"log": "synthetic", **size(synthetic)}]


def validation(found: DataFrame, real: DataFrame, synthetic: DataFrame, protocol: Mapping[str, Any]) -> dict[str, Any]:
    """A report of (metric, value, bound, status): it fails where a metric does."""
    metrics = rows(found)
    return {
        "report_version": REPORT_VERSION, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), "status": "fail" if any(m["status"] == "fail" for m in metrics) else "pass",
        "logs": sides(real, synthetic), "protocol": dict(protocol), "metrics": [m | {"direction": "higher" if m["metric"] in HIGHER else "lower"} for m in metrics],
        "notes": ["Distances to real data say nothing certain about privacy."],
    }


def metric(report: Mapping[str, Any], name: str) -> dict[str, Any]:
    return next(m for m in report["metrics"] if m["metric"] == name)


def validation_markdown(report: Mapping[str, Any]) -> str:
    return markdown(f"Validation: {report['status']}", {"Logs": report["logs"], "Metrics": report["metrics"]}, report["notes"])


def best(found: list[dict[str, Any]], metric_name: str) -> str | None:
    """The generator whose mean is best, by name on ties; the reference does not compete."""
    own = [r for r in found if r["metric"] == metric_name and r["generator"] != "reference" and r["mean"] is not None]
    sign = -1 if metric_name in HIGHER else 1
    return min(own, key=lambda r: (sign * r["mean"], r["generator"]))["generator"] if own else None


def bars(data: list[dict[str, Any]], label: str, value: str, width: int = 40) -> list[str]:
    """Values as bars of text, for dashboards where nothing draws."""
    most = max((abs(r[value] or 0) for r in data), default=0) or 1
    return [f"{cell(r[label]):>24} {'#' * round(width * abs(r[value] or 0) / most)} {cell(r[value])}" for r in data]


def dashboard(report: Mapping[str, Any]) -> str:
    """A validation report, or the rows of a benchmark, as bars."""
    if "metrics" in report:
        return "\n".join(["validation: " + report["status"], *bars(report["metrics"], "metric", "value")]) + "\n"
    by: dict[str, list[dict[str, Any]]] = {}
    for r in report["rows"]:
        by.setdefault(r["metric"], []).append(r)
    return "\n".join(line for name, part in sorted(by.items()) for line in [name, *bars(sorted(part, key=lambda r: r["generator"]), "generator", "mean"), ""])


#: Plots are functions of (real, synthetic or None) that give a table to draw.
PLOTS: dict[str, Any] = {}


def register_plot(name: str, make: Any, *, replace: bool = False) -> None:
    if not callable(make) or (name in PLOTS and not replace):
        raise ValueError(f"plot {name!r} exists or is no function")
    PLOTS[name] = make


def save_figure(data: list[dict[str, Any]], path: str, label: str, value: str, dpi: int = 150) -> None:
    """Bars as PNG, SVG or PDF, where matplotlib is installed."""
    if path.rsplit(".", 1)[-1] not in ("png", "svg", "pdf"):
        raise ValueError("figures are png, svg or pdf")
    try:
        import matplotlib
    except ImportError:
        raise RuntimeError("figures need matplotlib, which is not installed") from None
    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots()
    axes.barh([cell(r[label]) for r in data], [r[value] or 0 for r in data])
    figure.savefig(path, dpi=dpi, bbox_inches="tight")
    pyplot.close(figure)

"""Results as text, JSON and CSV. Each takes the rows of a result's DataFrame, in order."""

from __future__ import annotations

import csv
import io
import itertools
import json
from collections.abc import Callable, Iterable

from pyspark.sql import Row


def write_output(text: str, path: str | None = None) -> None:
    """To a file, else to standard output."""
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def _csv(header: Iterable[str], rows: Iterable[Iterable]) -> str:
    rows = list(rows)
    if not rows:
        return ""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def _grouped(rows: list[Row]) -> list[tuple[tuple, list[Row]]]:
    key = lambda r: (r["file_path"] if "file_path" in r else "", r["query_index"])
    return [(k, list(g)) for k, g in itertools.groupby(rows, key)]


def text_table(title: str, header: list[str], rows: list[list[str]]) -> str:
    """A plain table with a title and a count."""
    widths = [max(len(str(r[i])) for r in [header, *rows]) for i in range(len(header))]
    line = lambda r: "  ".join(str(x).ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([title, line(header), line(["-" * w for w in widths]), *map(line, rows), f"Total: {len(rows)} row(s)"])


# lineage


def lineage_text(rows: list[Row]) -> str:
    if not rows:
        return "No lineage results found."
    out = []
    for _, items in _grouped(rows):
        what = "Column" if items[0]["level"] == "column" else "Table"
        sources: dict[str, list[str]] = {}
        for r in items:
            sources.setdefault(r["output_name"], []).extend([r["source_name"]] if r["source_name"] else [])
        body = [[name if i == 0 else "", s] for name in sorted(sources) for i, s in enumerate(sorted(sources[name]) or ["(no sources)"])]
        out.append(text_table(f"Query {items[0]['query_index']}: {items[0]['query_preview']}", [f"Output {what}", f"Source {what}"], body))
    return "\n\n".join(out)


def lineage_json(rows: list[Row]) -> str:
    queries = [{"query_index": g[0]["query_index"], "query_preview": g[0]["query_preview"], "level": g[0]["level"], "lineage": [{"output_name": r["output_name"], "source_name": r["source_name"]} for r in g]} for _, g in _grouped(rows)]
    return json.dumps({"queries": queries}, indent=2)


def lineage_csv(rows: list[Row]) -> str:
    what = rows[0]["level"] if rows else "column"
    return _csv(("query_index", f"output_{what}", f"source_{what}"), ((r["query_index"], r["output_name"], r["source_name"]) for r in rows))


# tables


def tables_text(rows: list[Row]) -> str:
    if not rows:
        return "No tables found."
    return "\n\n".join(text_table(f"Query {g[0]['query_index']}: {g[0]['query_preview']}", ["Table Name", "Usage", "Type"], [[r["table_name"], r["usage"], r["object_type"]] for r in g]) for _, g in _grouped(rows))


def tables_json(rows: list[Row]) -> str:
    queries = [{"query_index": g[0]["query_index"], "query_preview": g[0]["query_preview"], "tables": [{"name": r["table_name"], "usage": r["usage"], "object_type": r["object_type"]} for r in g]} for _, g in _grouped(rows)]
    return json.dumps({"queries": queries}, indent=2)


def tables_csv(rows: list[Row]) -> str:
    return _csv(("query_index", "table_name", "usage", "object_type"), ((r["query_index"], r["table_name"], r["usage"], r["object_type"]) for r in rows))


# dissection

_COMPONENT = ("component_type", "component_index", "name", "sql", "parent_index", "depth", "is_executable", "dependencies", "location")


def dissection_text(rows: list[Row]) -> str:
    if not rows:
        return "No components found."
    return "\n\n".join(
        text_table(f"Query {g[0]['query_index']} ({g[0]['statement_type']}): {g[0]['query_preview']}", ["Index", "Type", "Name", "Depth", "Executable", "Location", "Dependencies"], [[r["component_index"], r["component_type"], r["name"] or "-", r["depth"], "Yes" if r["is_executable"] else "No", r["location"], ", ".join(r["dependencies"]) or "-"] for r in g])
        for _, g in _grouped(rows)
    )


def dissection_json(rows: list[Row], originals: dict[int, str] | None = None) -> str:
    queries = [
        {"query_index": g[0]["query_index"], "query_preview": g[0]["query_preview"], "statement_type": g[0]["statement_type"], "total_components": len(g), "components": [{k: list(r[k]) if k == "dependencies" else r[k] for k in _COMPONENT} for r in g], "original_sql": (originals or {}).get(g[0]["query_index"], "")}
        for _, g in _grouped(rows)
    ]
    return json.dumps({"queries": queries}, indent=2)


def dissection_csv(rows: list[Row]) -> str:
    header = ("query_index", "component_index", "component_type", "name", "depth", "is_executable", "location", "dependencies", "sql")
    return _csv(header, ((r["query_index"], r["component_index"], r["component_type"], r["name"] or "", r["depth"], str(r["is_executable"]).lower(), r["location"], ";".join(r["dependencies"]), r["sql"]) for r in rows))


# graph queries


def arrows(path: Iterable[str]) -> str:
    return " -> ".join(path)


def related_text(result, rows: list[Row]) -> str:
    verb = "sources of" if result.direction == "upstream" else "affected by"
    if not rows:
        return f"No {result.direction} columns found for '{result.query}'."
    mark = lambda r: ", ".join(x for x, y in (("root", r["is_root"]), ("leaf", r["is_leaf"])) if y)
    body = [[r["identifier"], r["table"] or "", r["column"] or "", r["hops"], mark(r), "; ".join(arrows(p) for p in r["paths"] or [])] for r in rows]
    return text_table(f"Columns {verb} '{result.query}'", ["Column", "Table", "Name", "Hops", "Ends", "Paths"], body)


def related_json(result, rows: list[Row]) -> str:
    keep = ("identifier", "file_path", "query_index", "schema_name", "table", "column", "hops", "output_column", "is_root", "is_leaf")
    columns = [{**{k: r[k] for k in keep}, "paths": [list(p) for p in r["paths"] or []]} for r in rows]
    return json.dumps({"query_column": result.query, "direction": result.direction, "count": len(rows), "columns": columns}, indent=2)


def related_csv(result, rows: list[Row]) -> str:
    keep = ("identifier", "table", "column", "hops", "output_column", "is_root", "is_leaf")
    flag = lambda x: str(x).lower() if isinstance(x, bool) else x if x is not None else ""
    return _csv((*keep, "paths"), ((*(flag(r[k]) for k in keep), ";".join(arrows(p) for p in r["paths"] or [])) for r in rows))


FORMATS: dict[str, dict[str, Callable]] = {
    "lineage": {"text": lineage_text, "json": lineage_json, "csv": lineage_csv},
    "tables": {"text": tables_text, "json": tables_json, "csv": tables_csv},
    "dissection": {"text": dissection_text, "json": dissection_json, "csv": dissection_csv},
    "related": {"text": related_text, "json": related_json, "csv": related_csv},
}

"""Cut a SQL text into statements."""

from __future__ import annotations

import re

#: Comments, quoted texts and identifiers, and the end of a statement.
_PART = re.compile(r"--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|;", re.S)


def split_statements(sql: str) -> list[str]:
    """The statements of a text without their semicolons; those of comments and white space only are left out."""
    out, start, solid = [], 0, ""
    last = 0
    for m in _PART.finditer(sql):
        solid += sql[last : m.start()].strip()
        last = m.end()
        if m[0] == ";":
            if solid:
                out.append(sql[start : m.start()].strip())
            start, solid = m.end(), ""
        elif m[0][:2] not in ("--", "/*"):
            solid += m[0]
    if solid + sql[last:].strip():
        out.append(sql[start:].strip())
    return out


def preview(sql: str, length: int = 100) -> str:
    """White space collapsed, cut to `length` characters."""
    flat = " ".join(sql.split())
    return flat if len(flat) <= length else flat[:length] + "..."


def blanked(sql: str) -> str:
    """sql with comments and quoted parts blanked, of equal length."""
    return _PART.sub(lambda m: m[0] if m[0] == ";" else " " * len(m[0]), sql)

"""The golden fixture of FIXTURES.md §2: six hand-made tables and the expected 13 rows.

The tables are read from the Markdown itself so the test and the document cannot drift.
Cell syntax: ``NULL`` is NULL, ``''`` is the empty string, backticks keep outer spaces.
"""

from __future__ import annotations

import datetime as dt
import pathlib
import re

from dimweave.sources.schemas import SCHEMAS

FIXTURES = pathlib.Path(__file__).resolve().parent.parent / "FIXTURES.md"


def _cell(raw: str):
    raw = raw.strip()
    if raw == "NULL":
        return None
    if raw == "''":
        return ""
    if raw.startswith("`") and raw.endswith("`"):
        return raw[1:-1]
    return raw


def _tables() -> dict[str, list[list]]:
    text = FIXTURES.read_text(encoding="utf-8")
    part = text.split("## 2. Golden fixture", 1)[1]
    out, name, rows = {}, None, None
    for line in part.splitlines():
        m = re.match(r"^### (.+)$", line)
        if m:
            name, rows = m.group(1).strip(), None
            continue
        if name and line.startswith("|"):
            cells = [_cell(c) for c in line.strip().strip("|").split("|")]
            if rows is None:
                rows = out.setdefault(name, [])
                out[name + ".header"] = cells
                continue
            if all(set(c or "") <= {"-", " "} for c in cells):
                continue
            rows.append(cells)
    return out


def _convert(value, dtype: str):
    if value is None:
        return None
    if dtype in ("bigint", "int"):
        return int(value)
    if dtype == "double":
        return float(value)
    if dtype == "timestamp_ntz":
        return dt.datetime.fromisoformat(value)
    if dtype == "date":
        return dt.date.fromisoformat(value)
    return value


def fixture_rows() -> dict[str, list[tuple]]:
    """Rows of the six tables, typed per ``dimweave.sources.schemas``."""
    raw = _tables()
    rows = {}
    for name, schema in SCHEMAS.items():
        header = raw[name + ".header"]
        typed = []
        for cells in raw[name]:
            rec = dict(zip(header, cells))
            typed.append(
                tuple(_convert(rec.get(f.name), f.dataType.simpleString()) for f in schema.fields)
            )
        rows[name] = typed
    return rows


# Column types of the expected result (report names -> simple type).
_EXPECTED_TYPES = {
    "Nº Demanda": "bigint",
    "Data de Cadastro": "date",
    "Ano do Processo": "int",
    "Ano Previsto": "int",
    "Data de Início Prevista": "date",
    "Data de Término Prevista": "date",
    "Data de Execução": "date",
}


def expected_rows() -> tuple[list[str], list[tuple]]:
    """Header and rows of the expected result table."""
    text = FIXTURES.read_text(encoding="utf-8")
    part = text.split("### Expected result", 1)[1]
    lines = [ln for ln in part.splitlines() if ln.startswith("|")]
    header = [c.strip() for c in lines[0].strip().strip("|").split("|")]
    rows = []
    for ln in lines[2:]:
        cells = [_cell(c) for c in ln.strip().strip("|").split("|")]
        rows.append(tuple(_convert(v, _EXPECTED_TYPES.get(h, "string")) for h, v in zip(header, cells)))
    return header, rows

"""Documents in Google's JSON form: paragraphs, nested tables, named styles."""

from __future__ import annotations

import json

from foliolith.sources.docx import heaviest

Block = tuple[str, dict, bool]
# Alignments, and the length of a point in EMU.
_ALIGN = {"START": "left", "CENTER": "center", "END": "right", "JUSTIFIED": "justified"}
_EMU = 12700.0
_SPACES = {"space_above_pt": "spaceAbove", "space_below_pt": "spaceBelow", "indent_first_line_pt": "indentFirstLine", "indent_start_pt": "indentStart", "indent_end_pt": "indentEnd"}


def _points(x) -> float | None:
    if not isinstance(x, dict) or x.get("magnitude") is None:
        return None
    return round(float(x["magnitude"]) / (_EMU if x.get("unit") == "EMU" else 1.0), 3)


def _given(weighted) -> bool | None:
    """As docx.mostly, but what isn't set doesn't count."""
    yes, no = (sum(n for v, n in weighted if v is x) for x in (True, False))
    return yes >= no if yes or no else None


def _paragraphs(content: list):
    for el in content:
        if "paragraph" in el:
            yield el["paragraph"]
        else:
            for row in (el.get("table") or {}).get("tableRows", ()):
                for cell in row.get("tableCells", ()):
                    yield from _paragraphs(cell.get("content", ()))


def _format(p: dict, named: dict) -> dict:
    """Runs take what they don't set from the paragraph's named style; the paragraph's own
    properties aren't inherited."""
    style = p.get("paragraphStyle") or {}
    base = named.get(style.get("namedStyleType") or "NORMAL_TEXT", {})
    runs = []
    for e in p.get("elements", ()):
        run = e.get("textRun") or {}
        text = (run.get("content") or "").replace("\n", " ").replace("\x0b", " ").strip()
        if text:
            runs.append((len(text), base | {k: v for k, v in (run.get("textStyle") or {}).items() if v is not None}))
    sizes = [((s.get("fontSize") or {}).get("magnitude"), n) for n, s in runs]
    size = heaviest([(m, n) for m, n in sizes if isinstance(m, (int, float))])
    out = {
        "font_family": heaviest([(s.get("fontFamily"), n) for n, s in runs]), "font_size_pt": None if size is None else round(float(size), 2),
        "bold": _given([(s.get("bold"), n) for n, s in runs]), "italic": _given([(s.get("italic"), n) for n, s in runs]),
        "alignment": _ALIGN.get(style.get("alignment")), "line_spacing": round(style["lineSpacing"] / 100, 3) if style.get("lineSpacing") else None,
        **{k: _points(style.get(x)) for k, x in _SPACES.items()},
    }
    return {k: v for k, v in out.items() if v is not None}


def parse_google_doc(data: bytes) -> list[Block]:
    doc = json.loads(data)
    styles = [s.get("namedStyle") or {} for s in (doc.get("namedStyles") or {}).get("styles", ())]
    named = {s["namedStyleType"]: s.get("textStyle") or {} for s in styles if s.get("namedStyleType")}
    out: list[Block] = []
    for p in _paragraphs((doc.get("body") or {}).get("content", ())):
        text = " ".join("".join((e.get("textRun") or {}).get("content") or "" for e in p.get("elements", ())).split())
        if text:
            kind = (p.get("paragraphStyle") or {}).get("namedStyleType") or "NORMAL_TEXT"
            out.append((text, _format(p, named), kind.startswith("HEADING")))
    return out


def gdoc_info(data: bytes) -> dict:
    """Page, margins, columns and title."""
    doc = json.loads(data)
    style = doc.get("documentStyle") or {}
    size = style.get("pageSize") or {}
    width, height = (_points(size.get(x)) or 0.0 for x in ("width", "height"))
    columns = int((style.get("columnProperties") or {}).get("count") or 1) if isinstance(style.get("columnProperties"), dict) else 1
    for el in (doc.get("body") or {}).get("content", ()):
        section = (el.get("sectionBreak") or {}).get("sectionStyle") or {}
        if isinstance(section.get("columnProperties"), list) and section["columnProperties"]:
            columns = max(columns, len(section["columnProperties"]))
        elif isinstance(section.get("columns"), int):
            columns = max(columns, section["columns"])
    margins = {x: _points(style.get(f"margin{x.title()}")) or 0.0 for x in ("top", "bottom", "left", "right")}
    return {"width": width, "height": height, **margins, "orientation": "landscape" if width > height else "portrait", "columns": columns, "title": doc.get("title") or ""}

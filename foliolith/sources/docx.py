"""Word documents: paragraphs and tables in order, formats through style inheritance."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
# Alignments, containers of runs, what stands for text in a run, and the page
# of a document that doesn't say.
_ALIGN = {
    "start": "left", "left": "left", "center": "center", "end": "right", "right": "right",
    "both": "justified", "distribute": "justified", "justify": "justified",
}
_HOLDERS = ("hyperlink", "ins", "del", "moveFrom", "moveTo")
_CHARACTERS = {"tab": " ", "br": " ", "noBreakHyphen": "‑", "instrText": " "}
_PAGE = {"width": 612.0, "height": 792.0, "top": 72.0, "bottom": 72.0, "left": 72.0, "right": 72.0, "orientation": "portrait", "columns": 1}
Block = tuple[str, dict, bool]


def _find(el, *tags):
    for tag in tags:
        el = None if el is None else el.find(_W + tag)
    return el


def _val(el, tag: str, attr: str = "val"):
    x = _find(el, tag)
    return None if x is None else x.get(_W + attr)


def _number(x: str | None, by: float = 1.0, places: int = 2) -> float | None:
    try:
        return None if x is None else round(float(x) / by, places)
    except ValueError:
        return None


def _present(d: dict) -> dict:
    return {k: v for k, v in d.items() if v is not None}


def _run_format(props) -> dict:
    font = _find(props, "rFonts")
    flag = lambda tag: None if _find(props, tag) is None else _val(props, tag) not in ("0", "false", "off")
    return _present({
        "font_family": None if font is None else font.get(_W + "ascii") or font.get(_W + "hAnsi"),
        "font_size_pt": _number(_val(props, "sz"), 2.0, 6), "bold": flag("b"), "italic": flag("i"),
    })


def _paragraph_format(props) -> dict:
    s, i, at = _find(props, "spacing"), _find(props, "ind"), _val(props, "jc")
    out = {"alignment": _ALIGN.get(at, at)}
    if s is not None:
        if s.get(_W + "lineRule") in (None, "auto") and s.get(_W + "line"):
            out["line_spacing"] = _number(s.get(_W + "line"), 240.0, 3)
        out["space_above_pt"], out["space_below_pt"] = (_number(s.get(_W + x), 20.0) for x in ("before", "after"))
    if i is not None:
        first = _number(i.get(_W + "firstLine"), 20.0)
        if first is not None:
            out["indent_first_line_pt"] = max(first - (_number(i.get(_W + "hanging"), 20.0) or 0.0), 0.0)
        out["indent_start_pt"], out["indent_end_pt"] = (_number(i.get(_W + x), 20.0) for x in ("left", "right"))
    return _present(out)


class Styles:
    """Paragraph styles by id: (name, own format, parent), over the document's defaults."""

    def __init__(self, root):
        self.base, self.by = {}, {}
        if root is not None:
            defaults = _find(root, "docDefaults")
            self.base = {**_run_format(_find(defaults, "rPrDefault", "rPr")), **_paragraph_format(_find(defaults, "pPrDefault", "pPr"))}
            for s in root.findall(_W + "style"):
                if s.get(_W + "type") == "paragraph":
                    own = {**_run_format(_find(s, "rPr")), **_paragraph_format(_find(s, "pPr"))}
                    self.by[s.get(_W + "styleId") or ""] = (_val(s, "name") or "", own, _val(s, "basedOn"))

    def name(self, sid: str | None) -> str:
        return self.by[sid][0] if sid in self.by else ""

    def format(self, sid: str | None) -> dict:
        """A style's format over its ancestors'; no style is Normal; a cycle ends where it closes."""
        chain, at = [], sid or "Normal"
        while at and at not in chain:
            chain.append(at)
            at = self.by[at][2] if at in self.by else None
        merged = dict(self.base)
        for at in reversed(chain):
            merged |= self.by[at][1] if at in self.by else {}
        return merged


def _runs(el):
    for x in el:
        if x.tag == _W + "r":
            yield x
        elif x.tag in [_W + h for h in _HOLDERS]:
            yield from _runs(x)
        elif x.tag == _W + "sdt" and (inner := _find(x, "sdtContent")) is not None:
            yield from _runs(inner)


def _run_text(run) -> str:
    out = []
    for x in run:
        tag = x.tag.removeprefix(_W)
        out.append((x.text or "") if tag == "t" else _run_text(x) if tag == "r" else _CHARACTERS.get(tag, ""))
    return "".join(out)


def _paragraphs(el):
    for x in el:
        if x.tag == _W + "p":
            yield x
        elif x.tag == _W + "tbl":
            for cell in x.findall(f"{_W}tr/{_W}tc"):
                yield from _paragraphs(cell)


def heaviest(weighted: list[tuple]) -> object | None:
    """The value with the most weight, the first among equals; None doesn't count."""
    total: dict = {}
    for value, n in weighted:
        if value is not None:
            total[value] = total.get(value, 0) + n
    return max(total, key=total.get) if total else None


def mostly(weighted: list[tuple]) -> bool | None:
    """Whether true weighs no less than false; None without any weight."""
    yes, no = (sum(n for v, n in weighted if bool(v) is x) for x in (True, False))
    return yes >= no if yes or no else None


def _block(p, styles: Styles) -> Block | None:
    props = _find(p, "pPr")
    sid = _val(props, "pStyle")
    base = styles.format(sid) | _paragraph_format(props)
    runs = [(text, base | _run_format(_find(r, "rPr"))) for r in _runs(p) if (text := _run_text(r))]
    whole = " ".join(" ".join(t for t, _ in runs).split())
    if not whole:
        return None
    each = lambda key: [(f.get(key), len(t)) for t, f in runs]
    size = heaviest(each("font_size_pt"))
    fmt = {**base, "font_family": heaviest(each("font_family")), "font_size_pt": None if size is None else round(size, 2), "bold": mostly(each("bold")), "italic": mostly(each("italic"))}
    return whole, _present(fmt), styles.name(sid).lower().startswith("heading") or (sid or "").lower().startswith("heading")


def _part(z: zipfile.ZipFile, name: str):
    try:
        return ET.fromstring(z.read(name))
    except (KeyError, ET.ParseError, OSError):
        return None


def parse_docx(data: bytes) -> list[Block]:
    """(text, format, heading style) of every paragraph with text, tables in place."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _find(ET.fromstring(z.read("word/document.xml")), "body")
        styles = Styles(_part(z, "word/styles.xml"))
    return [b for p in _paragraphs(body) if (b := _block(p, styles))]


def docx_info(data: bytes) -> dict:
    """The page of the last section, the core title, and what the parts tell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        root, core = ET.fromstring(z.read("word/document.xml")), _part(z, "docProps/core.xml")
        title = core.find(_DC + "title") if core is not None else None
        defaults = Styles(_part(z, "word/styles.xml")).base
    sections = list(root.iter(_W + "sectPr"))
    out = dict(_PAGE, title="" if title is None else (title.text or "").strip())
    size, margins, cols = (_find(sections[-1] if sections else None, x) for x in ("pgSz", "pgMar", "cols"))
    if size is not None:
        out["width"], out["height"] = float(size.get(_W + "w", 12240)) / 20, float(size.get(_W + "h", 15840)) / 20
        if size.get(_W + "orient") == "landscape":
            out |= {"orientation": "landscape", "width": max(out["width"], out["height"]), "height": min(out["width"], out["height"])}
    if margins is not None:
        out |= {x: _number(margins.get(_W + x), 20.0) or 72.0 for x in ("top", "bottom", "left", "right")}
    if cols is not None:
        out["columns"] = max(1, int(cols.get(_W + "num", 1)))
    out["images"] = sum(n.startswith("word/media/") for n in names)
    out["comments"] = "word/comments.xml" in names
    out["track_changes"] = any(next(root.iter(_W + x), None) is not None for x in ("ins", "del"))
    out["default_font"], out["default_size"] = defaults.get("font_family"), defaults.get("font_size_pt")
    return out

"""Small value functions: percentages, units, file formats, link ids, cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What extensions mean, what Drive calls folders and documents, units, pages.
FORMATS = {"pdf": "pdf", "tex": "latex", "latex": "latex", "ltx": "latex", "docx": "docx"}
FOLDER, SHORTCUT, GOOGLE_DOC = (f"application/vnd.google-apps.{x}" for x in ("folder", "shortcut", "document"))
POINTS = {
    "pt": 1.0, "in": 72.0, "mm": 72.0 / 25.4, "cm": 72.0 / 2.54, "bp": 7200.0 / 7227.0, "pc": 12.0,
    "dd": 1238.0 / 1157.0, "cc": 12.0 * 1238.0 / 1157.0,
}
PAGES = (
    ("A5", 419.53, 595.28), ("A4", 595.28, 841.89), ("Letter", 612.0, 792.0), ("Legal", 612.0, 1008.0),
    ("Tabloid", 792.0, 1224.0), ("Executive", 522.0, 756.0),
)
PAGE_TOLERANCE = 2.0
ROLES = {"author": 1, "reviewer": 2, "owner": 3}


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def percent(part: Column, whole: Column, empty: int) -> Column:
    """100 * part / whole, halves to even; ``empty`` for an empty whole."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 0).cast("int")).otherwise(F.lit(empty))


def extension(name: Column) -> Column:
    """Lower-case extension of a file name, null without one."""
    ext = F.regexp_extract(F.lower(name), r"[^/.]\.([^./]+)$", 1)
    return F.when(ext != "", ext)


def format_of(name: Column) -> Column:
    return F.try_element_at(literal_map(FORMATS), F.coalesce(extension(name), F.lit("")))


def sniff_format(content: Column, name: Column) -> Column:
    """The format by the first bytes, then by the extension, then by LaTeX commands."""
    head = F.substring(content, 1, 5)
    ext = F.coalesce(extension(name), F.lit(""))
    latex = content.cast("string").rlike(r"\\documentclass|\\begin\{document\}")
    return (
        F.when(head == F.to_binary(F.lit("%PDF-"), F.lit("utf-8")), "pdf")
        .when(F.substring(content, 1, 2) == F.to_binary(F.lit("PK"), F.lit("utf-8")), "docx")
        .when(ext.isin("tex", "latex", "ltx"), "latex").when(F.coalesce(latex, F.lit(False)), "latex")
        .when(ext == "pdf", "pdf").when(ext == "docx", "docx").otherwise("unknown")
    )


def folder_id(url: Column) -> Column:
    """The id in a folder link, or a bare id."""
    return F.coalesce(
        F.nullif(F.regexp_extract(url, r"/folders/([A-Za-z0-9_-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1), F.lit("")),
        F.when(F.trim(url).rlike(r"^[A-Za-z0-9_-]{10,}$"), F.trim(url)),
    )


def doc_id(url: Column) -> Column:
    """The id in a document link (its query names in any case), or a bare id."""
    return F.coalesce(
        F.nullif(F.regexp_extract(url, r"/document/d/([A-Za-z0-9_-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"[?&](?i:id)=([A-Za-z0-9_-]+)", 1), F.lit("")),
        F.when(F.trim(url).rlike(r"^[A-Za-z0-9_-]{10,}$"), F.trim(url)),
    )


def to_points(length: Column) -> Column:
    """A LaTeX length such as 2.5cm in points, to three places; an unknown unit is a point."""
    form = r"^\s*([+-]?[0-9]*\.?[0-9]+)\s*([a-zA-Z]*)\s*$"
    n, unit = F.regexp_extract(length, form, 1), F.lower(F.regexp_extract(length, form, 2))
    return F.when(n != "", F.round(n.cast("double") * F.coalesce(F.try_element_at(literal_map(POINTS), unit), F.lit(1.0)), 3))


def emu_to_points(x: Column) -> Column:
    return F.round(x / 12700.0, 3)


def twips_to_points(x: Column) -> Column:
    return F.round(x / 20.0, 3)


def page_label(width: Column, height: Column) -> Column:
    """The first standard page within tolerance, in either orientation; null without one."""
    near = lambda a, b: F.abs(a - F.lit(b)) <= PAGE_TOLERANCE
    out = F.lit(None).cast("string")
    for name, w, h in reversed(PAGES):
        out = F.when((near(width, w) & near(height, h)) | (near(width, h) & near(height, w)), F.lit(name)).otherwise(out)
    return out


def role_at_least(role: Column, least: str) -> Column:
    return F.coalesce(F.try_element_at(literal_map(ROLES), role), F.lit(0)) >= ROLES[least]


def encode_cursor(**parts: Column) -> Column:
    return F.base64(F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])))


def decode_cursor(cursor: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(cursor).cast("string"), schema)


def number(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("double").cast("decimal(18,3)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")

"""Parsers and file sources on generated files; the event stream."""

import io
import json
import zipfile

import pytest
from foliolith.sources import files
from foliolith.sources.docx import docx_info, parse_docx
from foliolith.sources.gdoc import gdoc_info, parse_google_doc
from foliolith.sources.latex import latex_info, parse_latex, source_facts
from foliolith.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
TEX = r"""\documentclass[11pt,a4paper]{article}
\usepackage{times,graphicx} % comment
\title{A \emph{fine} title} \author{Ann \and Bob}
\begin{document}\maketitle
\begin{abstract}Short abstract.\end{abstract}
\section{Introduction} First \textbf{bold} text 50\% done.

\begin{center}{\small centred}\end{center}
\begin{thebibliography}{9}\bibitem{a} Smith, J.: One (2001)\end{thebibliography}
\end{document}"""


def docx(body, styles=None, extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        for k, v in (extra or {}).items():
            z.writestr(k, v)
    return out.getvalue()


STYLES = """<w:style w:type="paragraph" w:styleId="A"><w:name w:val="heading 1"/><w:basedOn w:val="B"/><w:rPr><w:b/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="B"><w:name w:val="base"/><w:basedOn w:val="A"/><w:rPr><w:sz w:val="28"/><w:rFonts w:ascii="Arial"/></w:rPr><w:pPr><w:jc w:val="center"/></w:pPr></w:style>"""
BODY = """<w:p><w:pPr><w:pStyle w:val="A"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:pPr><w:spacing w:line="360" w:before="120"/></w:pPr><w:ins><w:r><w:rPr><w:i/></w:rPr><w:t>long italic</w:t></w:r></w:ins><w:r><w:t>x</w:t></w:r></w:p><w:p/>"""


def test_docx():
    got = parse_docx(docx(BODY, STYLES))
    assert [g[0] for g in got] == ["Head", "cell", "long italic x"]
    assert got[0][2] and got[0][1] == {"font_size_pt": 14.0, "font_family": "Arial", "alignment": "center", "bold": True, "italic": False}
    assert got[2][1] == {"line_spacing": 1.5, "space_above_pt": 6.0, "italic": True, "bold": False}
    normal = '<w:style w:type="paragraph" w:styleId="Normal"><w:rPr><w:sz w:val="21"/></w:rPr><w:pPr><w:ind w:firstLine="100" w:hanging="300"/></w:pPr></w:style>'
    got = parse_docx(docx("<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>", normal))
    assert got == [("a b", {"font_size_pt": 10.5, "indent_first_line_pt": 0.0, "bold": False, "italic": False}, False)]
    info = docx_info(docx('<w:sectPr><w:pgSz w:w="11906" w:h="16838" w:orient="landscape"/><w:pgMar w:top="720"/><w:cols w:num="2"/></w:sectPr>'))
    assert (info["width"], info["height"], info["top"], info["left"], info["columns"], info["orientation"]) == (841.9, 595.3, 36.0, 72.0, 2, "landscape")


def test_latex():
    got = parse_latex(TEX.encode())
    # Words of one stretch of markup join the next without a blank; unknown commands leave their arguments.
    assert [g[0] for g in got] == ["Afinetitle", "Ann, Bob", "Abstract", "Short abstract.", "Introduction", "Firstboldtext 50%done.", "centred9aSmith, J.: One (2001)"]
    by = {g[0]: g for g in got}
    assert by["Afinetitle"][1]["font_size_pt"] == 17.28 and by["Afinetitle"][1]["alignment"] == "center" and by["Introduction"][2] and by["Introduction"][1]["font_size_pt"] == 11.0
    assert by["Firstboldtext 50%done."][1]["font_family"] == "Times New Roman" and by["Firstboldtext 50%done."][1]["bold"] is False
    facts = source_facts(TEX)
    assert facts["packages"] == ["graphicx", "times"] and facts["font_packages"] == ["times"] and facts["options"] == ["11pt", "a4paper"] and facts["maketitle"]
    lists = parse_latex(rb"\begin{document}{\Large big {\bfseries b} still} \begin{enumerate}\item one \item[x] two\end{enumerate}\begin{keywords}a, b\end{keywords}\begin{center}mid\par\end{center} $x$ \frac{1}{2}\% \textcolor{red}{r}\end{document} after")
    assert [g[0] for g in lists] == ["bigbstill", "1. one", "2.", "Keywords—a, b", "mid", "$x$1 / 2%r"] and lists[0][1]["font_size_pt"] == 14.4 and lists[4][1]["alignment"] == "center"
    page = latex_info(rb"\documentclass[twocolumn,12pt]{a}\usepackage[margin=1in,left=2cm]{geometry}\linespread{1.5}\setlength{\parindent}{2pc}\title{T $x$}\begin{document}x\end{document}")
    assert (page["columns"], page["base_size"], page["left"], page["top"], page["title"], page["width"]) == (2, 12.0, 56.693, 72.0, "T x", 595.28)
    with pytest.raises(ValueError):
        parse_latex(b" ")


def test_google_doc():
    doc = {"title": "T", "documentStyle": {"pageSize": {"width": {"magnitude": 7559675, "unit": "EMU"}, "height": {"magnitude": 841.89, "unit": "PT"}}, "marginTop": {"magnitude": 72}},
           "namedStyles": {"styles": [{"namedStyle": {"namedStyleType": "HEADING_1", "textStyle": {"bold": True, "fontSize": {"magnitude": 20}}}}]}, "body": {"content": [
        {"paragraph": {"paragraphStyle": {"namedStyleType": "HEADING_1", "spaceAbove": {"magnitude": 12700, "unit": "EMU"}}, "elements": [{"textRun": {"content": "Head\n"}}]}},
        {"sectionBreak": {"sectionStyle": {"columnProperties": [{}, {}]}}},
        {"table": {"tableRows": [{"tableCells": [{"content": [{"paragraph": {"elements": [{"textRun": {"content": "cell", "textStyle": {"italic": True, "fontFamily": "Arial"}}}]}}]}]}]}}]}}
    data = json.dumps(doc).encode()
    assert parse_google_doc(data) == [("Head", {"bold": True, "font_size_pt": 20.0, "space_above_pt": 1.0}, True), ("cell", {"italic": True, "font_family": "Arial"}, False)]
    info = gdoc_info(data)
    assert (info["width"], info["height"], info["top"], info["columns"], info["title"], info["orientation"]) == (595.25, 841.89, 72.0, 2, "T", "portrait")


def test_containers():
    assert files.container_error(docx(BODY), "docx") is None
    assert files.container_error(docx(BODY, extra={"word/vbaProject.bin": "x"}), "docx") == "macros"
    assert files.container_error(docx(BODY, extra={"../x": "x"}), "docx") == "unsafe path"
    assert files.container_error(docx(BODY, extra={"a.xml": "<!DOCTYPE a>"}), "docx") == "document type declaration"
    assert files.container_error(docx(BODY, extra={"big": "0"}), "docx") is None and files.container_error(b"PK", "docx") == "damaged archive"
    assert files.container_error(docx(BODY, extra={"bomb.bin": "0" * 400_000}), "docx") == "encrypted or expands too much"
    assert files.container_error(b"%PDF " + b"/Type /Page " * 501, "pdf") == "too many pages"
    assert files.container_error(b"%PDF /Encrypt", "pdf") == "encrypted" and files.container_error(b"%PDF /JavaScript", "pdf") == "active content"


def test_folder_to_blocks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.tex": TEX.encode(), "sub/b.docx": docx(BODY, STYLES), "c.pdf": b"%PDF-1.4", "d.txt": b"hello", "e.docx": b"PK bad"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.read_folder(spark, str(tmp_path))
    rows = files.parse(found).collect()
    errors = {r["filename"]: r["error"] for r in rows}
    assert errors == {"a.tex": None, "b.docx": None, "c.pdf": "no parser for this format here", "d.txt": "unsupported file type", "e.docx": "damaged archive"}
    assert sum(r["filename"] == "a.tex" for r in rows) == 7
    assert files.read_folder(spark, str(tmp_path), 2).count() == 2
    deep = tmp_path / "1" / "2" / "3"
    (deep / "4").mkdir(parents=True)
    (deep / "in.tex").write_bytes(b"x")
    (deep / "4" / "out.tex").write_bytes(b"x")
    names = {r["filename"] for r in files.read_folder(spark, str(tmp_path)).select("filename").collect()}
    assert "in.tex" in names and "out.tex" not in names


def test_tables_are_copied_and_read_in_chunks(spark, tmp_path):
    from foliolith.operators import portal, relational

    df = spark.range(250).withColumnRenamed("id", "n")
    assert relational.copy_table(df, str(tmp_path / "copy")) == (250, 250)
    assert [len(c) for c in portal.in_chunks(files.read_stores(spark, {"t": str(tmp_path / "copy")})["t"], 100)] == [100, 100, 50]
    files.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 250


def test_event_stream_counts_each_event_once(spark, tmp_path):
    data = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 01:10:00", "a")], "event_id int, ts string, event_type string").selectExpr("event_id", "to_timestamp(ts) ts", "event_type")
    data.write.parquet(f"{tmp_path}/in")
    stream = events.distinct_events(events.read_events(spark, f"{tmp_path}/in", "event_id int, ts timestamp, event_type string"))
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select * from seen").count() == 2

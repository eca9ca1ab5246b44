"""DOCX results: tokens filled into a template, or a document composed from lines. A row that fails carries its error."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from quillon.sources.docx import W, docx_bytes


def fill_template(template: bytes, values: dict[str, str]) -> bytes:
    """Every ``{{TOKEN}}`` replaced, also where its characters are spread over runs; a value's lines become paragraphs. A token that isn't there is an error."""
    ElementTree.register_namespace("w", W[1:-1])
    source = zipfile.ZipFile(io.BytesIO(template))
    root = ElementTree.fromstring(source.read("word/document.xml"))
    found = set()
    for parent in root.iter():
        for place, p in [(i, c) for i, c in enumerate(parent) if c.tag == W + "p"][::-1]:
            texts = list(p.iter(W + "t"))
            whole = "".join(t.text or "" for t in texts)
            tokens = {t for t in re.findall(r"\{\{(\w+)\}\}", whole) if t in values}
            if not tokens:
                continue
            found |= tokens
            lines = re.sub(r"\{\{(\w+)\}\}", lambda m: values.get(m[1], m[0]), whole).split("\n")
            texts[0].text = lines[0]
            for t in texts[1:]:
                t.text = ""
            for more in reversed(lines[1:]):
                extra = ElementTree.Element(W + "p")
                ElementTree.SubElement(ElementTree.SubElement(extra, W + "r"), W + "t").text = more
                parent.insert(place + 1, extra)
    if missing := set(values) - found:
        raise ValueError("tokens not in the template: " + ", ".join(sorted(missing)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in source.infolist():
            z.writestr(item, ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True) if item.filename == "word/document.xml" else source.read(item.filename))
    return out.getvalue()


def write_results(results: DataFrame, template: bytes | None = None) -> DataFrame:
    """Results (case_id, final, appendix) to (case_id, content, error): the template with BODY and APPENDIX filled, else composed."""

    def run(batches):
        for pdf in batches:
            rows = []
            for case_id, final, appendix in zip(pdf["case_id"], pdf["final"], pdf["appendix"], strict=True):
                try:
                    if template is None:
                        made = docx_bytes([x for x in ((final or "") + "\n" + (appendix or "")).split("\n") if x.strip()])
                    else:
                        made = fill_template(template, {"BODY": final or "", "APPENDIX": appendix or ""})
                    rows.append((case_id, made, None))
                except Exception as e:  # noqa: BLE001 - a bad row must not fail the others
                    rows.append((case_id, None, str(e)))
            yield type(pdf)(rows, columns=["case_id", "content", "error"])

    return results.select("case_id", "final", "appendix").mapInPandas(run, "case_id string, content binary, error string")

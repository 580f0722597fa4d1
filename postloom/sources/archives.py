"""Text of attachments: office documents, archives, calendars, cards, pages and plain text, within budgets."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.html import to_text

#: Entries and unpacked bytes of an archive, characters of text and bytes of a file that are read, unless the caller says
#: otherwise; text_state tells of every file that was cut (truncated) or not read (too_large, error).
MOST_ENTRIES, MOST_BYTES, MOST_TEXT, LARGEST = 5000, 50_000_000, 200_000, 20_000_000

# File kinds by end of name, and by content type.
BY_NAME = {
    "docx": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "pptx": "pptx", "odt": "odf", "ods": "odf", "odp": "odf", "pdf": "pdf", "ics": "ics", "vcs": "ics", "vcf": "vcf", "html": "html", "htm": "html",
    "eml": "eml", "txt": "text", "csv": "text", "md": "text", "log": "text", "json": "text", "xml": "text", "tsv": "text",
}
BY_TYPE = (("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("presentationml", "pptx"), ("opendocument", "odf"), ("pdf", "pdf"), ("calendar", "ics"), ("vcard", "vcf"), ("html", "html"), ("message/rfc822", "eml"), ("text/", "text"))
PARTS = {"docx": r"word/(?:document|footnotes|header\d*|footer\d*)\.xml", "pptx": r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml", "odf": r"content\.xml"}


def kind_of(filename: Column, content_type: Column) -> Column:
    """The kind of a file by its name, else by its content type, else null."""
    end = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.create_map(*(F.lit(x) for kv in BY_NAME.items() for x in kv))[end]
    by_type = F.lit(None).cast("string")
    for piece, kind in reversed(BY_TYPE):
        by_type = F.when(F.lower(content_type).contains(piece), kind).otherwise(by_type)
    return F.coalesce(by_name, by_type)


def decode(data: bytes) -> str:
    """UTF-8 where it is, else Windows-1252."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def members(data: bytes, wanted: str) -> list[tuple[str, bytes]]:
    """Members of an archive whose name matches, in natural order, within the budgets of entries and bytes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > MOST_ENTRIES:
            raise ValueError("too many entries")
        natural = lambda i: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", i.filename)]
        out, left = [], MOST_BYTES
        for info in sorted((i for i in infos if re.fullmatch(wanted, i.filename)), key=natural):
            with z.open(info) as f:
                part = f.read(left + 1)
            left -= len(part)
            if left < 0:
                raise ValueError("too large")
            out.append((info.filename, part))
        return out


def _xml_text(xml: str) -> str:
    import html

    xml = re.sub(r"<(?:w:tab|text:tab)\b[^>]*/?>", "\t", xml)
    xml = re.sub(r"</(?:w:p|a:p|text:p|text:h|table:table-row)>|<(?:w:br|a:br|text:line-break)\b[^>]*/?>", "\n", xml)
    xml = re.sub(r"</table:table-cell>", "\t", xml)
    text = html.unescape(re.sub(r"<[^>]*>", "", xml))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def office_text(kind: str, data: bytes) -> str:
    """Text of a word processor, presentation or spreadsheet file."""
    if kind != "xlsx":
        return "\n\n".join(filter(None, (_xml_text(decode(x)) for _, x in members(data, PARTS[kind]))))
    import html

    shared = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<rPh\b.*?</rPh>", "", s, flags=re.S))) for _, x in members(data, r"xl/sharedStrings\.xml") for s in re.findall(r"<si\b[^>]*>(.*?)</si>", decode(x), re.S)]
    sheets = []
    for _, x in members(data, r"xl/worksheets/sheet\d+\.xml"):
        lines = []
        for row in re.findall(r"<row\b[^>]*>(.*?)</row>", decode(x), re.S):
            cells = []
            for attrs, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S):
                value = re.search(r"<v\b[^>]*>(.*?)</v>", body or "", re.S)
                if 't="s"' in attrs and value and value[1].isdigit() and int(value[1]) < len(shared):
                    cells.append(shared[int(value[1])])
                elif 't="inlineStr"' in attrs:
                    cells.append(html.unescape(re.sub(r"<[^>]*>", "", body)))
                else:
                    cells.append(html.unescape(value[1]) if value else "")
            if any(cells):
                lines.append("\t".join(cells).rstrip())
        sheets.append("\n".join(lines))
    return "\n\n".join(filter(None, sheets))


def card_text(text: str) -> str:
    """The readable lines of an address card."""
    out = []
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        name, _, value = line.partition(":")
        if name.split(";")[0].split(".")[-1].upper() in ("FN", "ORG", "TITLE", "TEL", "EMAIL", "ADR", "URL", "NOTE", "BDAY") and value.strip(" ;"):
            out.append(re.sub(r"\s*;[;\s]*", ", ", re.sub(r"\\([,;\\])", r"\1", value)).strip(", "))
    return "\n".join(out)


_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]|<<[^<>]*>>|<[0-9A-Fa-f\s]*>)*)>>\s*stream\r?\n(?P<data>.*?)endstream", re.S)
_SHOW = re.compile(rb"\((?P<s>(?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[(?P<a>(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]])*)\]\s*TJ|<(?P<h>[0-9A-Fa-f\s]+)>\s*Tj|(?P<nl>T\*|ET|(?:-?[\d.]+\s+){2}T[dD])", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(.)|\r?\n)", re.S)


def pdf_text(data: bytes, budget: int = 64_000_000) -> str:
    """Text of the content streams of a PDF with simple encodings (no character maps, no encryption)."""
    if b"/Encrypt" in data:
        raise ValueError("encrypted")

    def literal(s: bytes) -> str:
        def one(m: re.Match) -> bytes:
            if m[1]:
                return bytes([int(m[1], 8) & 255])
            return {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[2], m[2] or b"")

        raw = _ESCAPE.sub(one, s)
        return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")

    out = []
    for m in _STREAM.finditer(data):
        head, body = m["dict"], m["data"]
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body, min(budget, 16_000_000))
            except zlib.error:
                continue
            budget -= len(body)
            if budget <= 0:
                break
        elif b"/Filter" in head:
            continue
        if b"BT" not in body or b"/Image" in head:
            continue
        for t in _SHOW.finditer(body):
            if t["s"] is not None:
                out.append(literal(t["s"]))
            elif t["a"] is not None:
                for piece in re.finditer(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>|(-?\d+(?:\.\d+)?)", t["a"]):
                    if piece[1] is not None:
                        out.append(literal(piece[1]))
                    elif piece[2] is not None:
                        out.append(literal(bytes.fromhex(re.sub(rb"\s", b"", piece[2]).decode()[: len(piece[2]) // 2 * 2])))
                    elif float(piece[3]) < -200:
                        out.append(" ")
            elif t["h"] is not None:
                digits = re.sub(rb"\s", b"", t["h"]).decode()
                out.append(literal(bytes.fromhex(digits + "0" * (len(digits) % 2))))
            else:
                out.append("\n")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def extract(kind: str | None, data: bytes | None, most_text: int = MOST_TEXT, largest: int = LARGEST) -> tuple[str | None, str]:
    """(text, state): extracted, truncated, empty, unsupported, too_large or error; never raises."""
    if kind is None or data is None:
        return None, "unsupported"
    if len(data) > largest:
        return None, "too_large"
    try:
        if kind in ("docx", "xlsx", "pptx", "odf"):
            text = office_text(kind, data)
        elif kind == "pdf":
            text = pdf_text(data)
        elif kind == "html":
            text = to_text(decode(data))[0]
        elif kind == "vcf":
            text = card_text(decode(data))
        elif kind == "eml":
            from postloom.sources.mime import parse_message

            m = parse_message(data)
            text = "\n".join(filter(None, (m["subject"], m["from_name"] or m["from_addr"], m["body"])))
        elif kind == "ics":
            from postloom.sources.ics import parse

            text = "\n".join(" ".join(filter(None, (e["summary"], e["location"], e["organizer"]))) for e in parse(decode(data)))
        else:
            text = decode(data)
    except Exception:  # a broken file becomes a row that says so, never a failed task
        return None, "error"
    if not text.strip():
        return "", "empty"
    return (text[:most_text], "truncated") if len(text) > most_text else (text, "extracted")


def attachment_texts(files: DataFrame, most_text: int = MOST_TEXT, largest: int = LARGEST) -> DataFrame:
    """files (id, filename, content_type, data binary) with kind, text and text_state, in Arrow batches."""
    @F.pandas_udf("text string, state string")
    def read(kind: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(k, None if d is None else bytes(d), most_text, largest) for k, d in zip(kind, data)], columns=["text", "state"])

    out = files.withColumn("kind", kind_of(F.col("filename"), F.col("content_type"))).withColumn("r", read("kind", "data"))
    return out.select("id", "kind", F.col("r.text").alias("text"), F.col("r.state").alias("text_state"))

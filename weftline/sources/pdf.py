"""Reports as PDF documents, written without any library: text, colour fields and PNG pictures."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WIDTH, HEIGHT, MARGIN = 595.0, 842.0, 56.0


def _said(text: str) -> bytes:
    """A PDF string in Latin-1."""
    raw = text.replace("…", "...").encode("latin-1", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def wrapped(text: str, size: float, width: float) -> list[str]:
    """Lines that fit, at half the type size a character."""
    most, lines = max(1, int(width / (size * 0.5))), [""]
    for word in text.split():
        while len(word) > most:
            lines.append(word[:most])
            word = word[most:]
        if len(lines[-1]) + len(word) + bool(lines[-1]) <= most:
            lines[-1] += (" " if lines[-1] else "") + word
        else:
            lines.append(word)
    return [x for x in lines if x] or [""]


def pill_rows(items: list[str], width: float, size: float = 8.0) -> list[list[str]]:
    """Labels in rows, each filled as far as it goes."""
    rows, used = [[]], 0.0
    for item in items:
        w = min(width, max(28.0, len(item) * size * 0.5 + 16.0))
        if rows[-1] and used + w > width:
            rows.append([])
            used = 0.0
        rows[-1].append(item)
        used += w
    return [r for r in rows if r]


def fitted(aspect: float, width: float, height: float) -> tuple[float, float]:
    """Size within a box at the picture's height over width."""
    return (width, width * aspect) if width * aspect <= height else (height / aspect if aspect else width, height)


def png_rows(data: bytes) -> tuple[int, int, bytes] | None:
    """Width, height and packed rows (with their filter bytes) of an 8-bit RGB PNG without interlace; null for others."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) < 33 or data[24:26] != b"\x08\x02" or data[28] != 0:
        return None
    at, body = 8, b""
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), body


class Document:
    """Pages of operators, with a cursor that moves down."""

    def __init__(self):
        self.pages: list[list[bytes]] = []
        self.pictures: list[tuple[int, int, bytes]] = []
        self.turn()

    def turn(self) -> None:
        self.pages.append([])
        self.y = HEIGHT - MARGIN

    def room(self, height: float) -> None:
        if self.y - height < MARGIN:
            self.turn()

    def text(self, said: str, size: float = 10.0, bold: bool = False) -> None:
        for line in wrapped(said, size, WIDTH - 2 * MARGIN):
            self.room(size * 1.4)
            self.y -= size * 1.4
            self.pages[-1].append(b"BT /F%d %.1f Tf %.1f %.1f Td %s Tj ET" % (2 if bold else 1, size, MARGIN, self.y, _said(line)))

    def section(self, title: str) -> None:
        """A heading with a line under it, which keeps some room for what follows."""
        self.room(90)
        self.y -= 10
        self.text(title, 16, True)
        self.y -= 6
        self.pages[-1].append(b"0.6 w %.1f %.1f m %.1f %.1f l S" % (MARGIN, self.y, WIDTH - MARGIN, self.y))
        self.y -= 6

    def pairs(self, rows: list[tuple[str, str]], label: float = 130.0, size: float = 10.0) -> None:
        """Names on the left, what they stand for on the right."""
        for name, said in rows:
            lines = wrapped(said, size, WIDTH - 2 * MARGIN - label)
            for k, line in enumerate(lines):
                self.room(size * 1.4)
                self.y -= size * 1.4
                if not k:
                    self.pages[-1].append(b"BT /F2 %.1f Tf %.1f %.1f Td %s Tj ET" % (size, MARGIN, self.y, _said(name)))
                self.pages[-1].append(b"BT /F1 %.1f Tf %.1f %.1f Td %s Tj ET" % (size, MARGIN + label, self.y, _said(line)))
            self.y -= 3

    def pills(self, items: list[str]) -> None:
        for row in pill_rows(items, WIDTH - 2 * MARGIN):
            self.text(" · ".join(row), 8)

    def fields(self, colours: list[str]) -> None:
        """A row of colours with their names; a grey one if there are none."""
        colours = colours or ["#CCCCCC"]
        self.room(60)
        w = (WIDTH - 2 * MARGIN) / len(colours)
        self.y -= 44
        for k, c in enumerate(colours):
            r, g, b = (int(c[i : i + 2], 16) / 255 for i in (1, 3, 5))
            self.pages[-1].append(b"%.3f %.3f %.3f rg %.1f %.1f %.1f 40 re f 0 0 0 rg" % (r, g, b, MARGIN + k * w, self.y, w))
            self.pages[-1].append(b"BT /F1 7.5 Tf %.1f %.1f Td %s Tj ET" % (MARGIN + k * w + 2, self.y - 10, _said(c)))
        self.y -= 16

    def strip(self, pictures: list[bytes], height: float = 120.0) -> None:
        """Pictures side by side, each within its box; those that can't be read are left out."""
        good = [p for p in map(png_rows, pictures) if p]
        if not good:
            return
        self.room(height + 8)
        w = (WIDTH - 2 * MARGIN - 8 * (len(good) - 1)) / len(good)
        self.y -= height
        for k, p in enumerate(good):
            x, y = fitted(p[1] / max(1, p[0]), w, height)
            self.pictures.append(p)
            self.pages[-1].append(b"q %.1f 0 0 %.1f %.1f %.1f cm /I%d Do Q" % (x, y, MARGIN + k * (w + 8), self.y, len(self.pictures)))
        self.y -= 8

    def bytes(self) -> bytes:
        fonts = [b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold/Encoding/WinAnsiEncoding>>"]
        objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"", *fonts]
        pictures = {}
        for k, (w, h, data) in enumerate(self.pictures, 1):
            objects.append(b"<</Type/XObject/Subtype/Image/Width %d/Height %d/ColorSpace/DeviceRGB/BitsPerComponent 8/Filter/FlateDecode/DecodeParms<</Predictor 15/Colors 3/Columns %d>>/Length %d>>stream\n%s\nendstream" % (w, h, w, len(data), data))
            pictures[k] = len(objects)
        kids = []
        shown = b"".join(b"/I%d %d 0 R" % kv for kv in pictures.items())
        for page in self.pages:
            body = zlib.compress(b"\n".join(page))
            objects.append(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(body), body))
            objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Contents %d 0 R/Resources<</Font<</F1 3 0 R/F2 4 0 R>>/XObject<<%s>>>>>>" % (len(objects), shown))
            kids.append(len(objects))
        objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
        out, at = b"%PDF-1.4\n", []
        for n, o in enumerate(objects, 1):
            at.append(len(out))
            out += b"%d 0 obj%s endobj\n" % (n, o)
        table = b"".join(b"%010d 00000 n \n" % a for a in at)
        return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(at) + 1, table, len(at) + 1, len(out))


#: Parts of a profile: ``(title, its text, its named values, its lists of labels)``, by fields of the profile.
SECTIONS = (
    ("Summary", ("summary",), (("Industry", "industry"), ("Position", "positioning")), ("keywords",)),
    ("Visual identity", ("visual_identity",), (("Photography", "photography"), ("Composition", "composition"), ("Materials", "materials"), ("Colours", "colours")), ("visual_keywords",)),
    ("Voice", ("voice",), (("Tone", "tone"), ("Vocabulary", "vocabulary"), ("Messages", "messages")), ("voice_traits",)),
    ("Audience", ("audience",), (("Age", "age"), ("Lifestyle", "lifestyle"), ("Motives", "motives")), ("audience_signals",)),
)
NOTES = ("Strategic notes", ("notes",), (("Strengths", "strengths"), ("Risks", "risks"), ("Openings", "openings")), ())


def _there(profile: dict, section: tuple) -> tuple[list[str], list[tuple[str, str]], list[str]]:
    """What a profile says for a section; blank fields are left out."""
    said = lambda k: str(profile.get(k) or "").strip() if not isinstance(profile.get(k), list) else ", ".join(map(str, profile[k]))
    _, texts, named, labels = section
    return [said(k) for k in texts if said(k)], [(n, said(k)) for n, k in named if said(k)], [str(x) for k in labels for x in profile.get(k) or () if str(x).strip()]


def _written(d: Document, profile: dict, section: tuple, more: list[str] = ()) -> None:
    texts, named, labels = _there(profile, section)
    if texts or named or labels or more:
        d.section(section[0])
        for t in texts:
            d.text(t)
        d.pairs(named)
        d.pills(labels)
        for t in more:
            d.text(t)


def rendered(name: str, palette: list[str], clusters: list[dict], texts: list[str], pictures: dict[str, bytes], profile: dict | None = None) -> bytes:
    """Cover, summary, visual identity, palette, voice, audience, themes with pictures, and notes; sections without content are left out."""
    d, profile = Document(), profile or {}
    d.y = HEIGHT / 2
    d.text(name, 32, True)
    d.turn()
    summary, visual, voice, audience = SECTIONS
    _written(d, profile, summary)
    _written(d, profile, visual)
    d.section("Palette")
    d.fields(palette)
    _written(d, profile, voice, texts)
    _written(d, profile, audience)
    if clusters:
        d.section("Themes")
    for c in clusters:
        d.text(c["label"] or "", 12, True)
        if c.get("description"):
            d.text(c["description"])
        d.pills(list(c.get("key_elements") or ()))
        d.strip([pictures[u] for u in c.get("image_urls") or () if u in pictures])
    _written(d, profile, NOTES)
    return d.bytes()


def documents(reports: DataFrame, blobs: DataFrame) -> DataFrame:
    """``(brand_id, pdf)``; ``blobs`` are ``(url, content)``, of which each report meets its own few.

    A column ``profile`` (a struct, or JSON text) fills the sections of summary, identity, voice, audience and notes.
    """
    profile = F.lit(None).cast("string") if "profile" not in reports.columns else F.col("profile") if reports.schema["profile"].dataType.simpleString() == "string" else F.to_json("profile")
    wanted = reports.select("brand_id", F.explode("clusters").alias("c")).select("brand_id", F.explode("c.image_urls").alias("url")).distinct()
    shown = wanted.join(blobs, "url").groupBy("brand_id").agg(F.collect_list(F.struct("url", "content")).alias("pictures"))
    rows = reports.select("brand_id", "name", F.transform("palette", lambda p: p["hex"]).alias("palette"), "clusters", "texts", profile.alias("profile")).join(shown, "brand_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [rendered(r["name"] or "", r["palette"] or [], r["clusters"] or [], r["texts"] or [], {p["url"]: p["content"] for p in r["pictures"] or ()}, json.loads(r["profile"] or "{}")) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("brand_id"), pa.array(out, pa.binary())], names=["brand_id", "pdf"])

    return rows.mapInArrow(run, "brand_id bigint, pdf binary")

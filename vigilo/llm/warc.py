"""WARC derivatives (operator 1): linked metadata and plain-text conversion records.

``responses`` turns fetched pages into response records; ``derive`` gives for
every response one ``metadata`` record (source headers, digests, title, links)
and one ``conversion`` record (plain text).  Both refer to the response by
``WARC-Refers-To`` and repeat its target, date and digests; the metadata record
also names its conversion.  Record ids are name-based, so a rerun gives the
same ids.  ``write_records`` writes records as WARC files.

Defined results: a null page is an empty page; a null url an empty target;
repeated pages (same id, url and html) give records with equal ids; an empty
table gives no records; further columns are ignored.  Line breaks and other control
characters of a url or outlink are percent-encoded, so that no page can write a
header line of its own; a page of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilo.llm.words import sub_batches

CRLF = "\r\n"
FETCHED = "2024-01-01T00:00:00Z"   # pages carry no fetch time; a parameter of `responses`

# Named character references that are decoded (numeric ones follow a rule).
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "iexcl": "¡", "cent": "¢",
    "pound": "£", "yen": "¥", "sect": "§", "copy": "©", "laquo": "«", "raquo": "»", "reg": "®", "deg": "°",
    "plusmn": "±", "para": "¶", "middot": "·", "iquest": "¿", "times": "×", "divide": "÷", "szlig": "ß",
    "Agrave": "À", "Aacute": "Á", "Acirc": "Â", "Atilde": "Ã", "Auml": "Ä", "Aring": "Å", "AElig": "Æ",
    "Ccedil": "Ç", "Egrave": "È", "Eacute": "É", "Ecirc": "Ê", "Euml": "Ë", "Igrave": "Ì", "Iacute": "Í",
    "Icirc": "Î", "Iuml": "Ï", "Ntilde": "Ñ", "Ograve": "Ò", "Oacute": "Ó", "Ocirc": "Ô", "Otilde": "Õ",
    "Ouml": "Ö", "Oslash": "Ø", "Ugrave": "Ù", "Uacute": "Ú", "Ucirc": "Û", "Uuml": "Ü", "Yacute": "Ý",
    "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å", "aelig": "æ",
    "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "igrave": "ì", "iacute": "í",
    "icirc": "î", "iuml": "ï", "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocirc": "ô", "otilde": "õ",
    "ouml": "ö", "oslash": "ø", "ugrave": "ù", "uacute": "ú", "ucirc": "û", "uuml": "ü", "yacute": "ý",
    "yuml": "ÿ", "OElig": "Œ", "oelig": "œ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„", "bull": "•", "hellip": "…", "lsaquo": "‹",
    "rsaquo": "›", "euro": "€", "trade": "™",
}

# Fixed patterns of the page clean-up, applied in this order (same text in both engines).
HIDDEN = r"(?is)<!--.*?-->|<(?:script|style|noscript)\b.*?</(?:script|style|noscript)[ \t\r\n]*>"
BLOCK_TAG = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|"
             r"hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>")
ANY_TAG = r"<[a-zA-Z/!?][^<>]*>"
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
BLANKS = r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+"
TITLE = r"(?is)<title\b[^<>]*>(.*?)</title"
CONTROLS = (*range(32), 127)   # never written into a header or field as they are
LINK = r"""(?i)<a\b[^<>]*?\bhref[ \t]*=[ \t]*["']([^"'<>]*)["']"""


_HIDDEN, _BLOCK_TAG, _ANY_TAG, _REFERENCE, _BLANKS, _TITLE, _LINK = (
    re.compile(x, re.ASCII) for x in (HIDDEN, BLOCK_TAG, ANY_TAG, REFERENCE, BLANKS, TITLE, LINK))


_CONTROL = {c: f"%{c:02X}" for c in CONTROLS}


def encoded(url: Column) -> Column:
    """``url`` with its control characters percent-encoded."""
    out = url
    for c, code in _CONTROL.items():
        out = F.replace(out, F.lit(chr(c)), F.lit(code))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), out).otherwise(url)


def _character(m: re.Match) -> str:
    ref = m[1]
    if ref[0] != "#":
        return ENTITIES.get(ref, m[0])
    code = int(ref[2:], 16) if ref[1] in "xX" else int(ref[1:])
    return "\ufffd" if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code)


def tidy(text: str) -> str:
    """References decoded once, blanks squeezed, lines trimmed, empty lines gone."""
    text = _REFERENCE.sub(_character, text) if "&" in text else text
    lines = (x.strip(" ") for x in _BLANKS.sub(" ", text).split("\n"))
    return "\n".join(x for x in lines if x)


def page_parts(html: str) -> tuple[str, str, str]:
    """Plain text, title (one line) and ``outlink`` fields of a page."""
    shown = _HIDDEN.sub("", html)
    text = tidy(_ANY_TAG.sub("", _BLOCK_TAG.sub("\n", shown)))
    title = _TITLE.search(shown)
    links = "".join(f"outlink: {x.translate(_CONTROL)}{CRLF}" for x in _LINK.findall(shown))
    return text, tidy(_ANY_TAG.sub("", title[1])).replace("\n", " ") if title else "", links


def _with_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "payload"):
        kept = [x for x in batch.schema.names if x != "payload"]
        parts = [page_parts(x) for x in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(x) for x in kept] + [pa.array(x, pa.string()) for x in zip(*parts)],
            kept + ["text", "title", "links"])


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def record_id(kind: str, name: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + "|"), name))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              fetched: str = FETCHED) -> DataFrame:
    """Response records of fetched pages: ``source_id, record_id, target_uri,
    date, http_header, payload, payload_digest, block_digest``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = encoded(F.coalesce(F.col(url_col), F.lit("")))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                      F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    p = pages.select(F.col(id_col).alias("source_id"), url.alias("target_uri"), F.lit(fetched).alias("date"),
                     header.alias("http_header"), html.alias("payload"), digest(html).alias("payload_digest"))
    name = F.concat_ws("|", F.col("source_id").cast("string"), "target_uri", "date", "payload_digest")
    return p.select("source_id", record_id("response", name).alias("record_id"), "target_uri", "date", "http_header",
                    "payload", "payload_digest", digest(F.concat("http_header", "payload")).alias("block_digest"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(CRLF))


def derive(records: DataFrame) -> DataFrame:
    """Two records per response: ``source_id, record_type, record_id,
    refers_to, target_uri, date, source_digest, content_type, content_length,
    block_digest, warc_header, block``."""
    names = ("source_id", "record_id", "target_uri", "date", "http_header", "payload_digest", "block_digest")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (records.schema[x] for x in names))
    r = (records.select(*names, "payload").mapInArrow(_with_parts, schema + ", text string, title string, links string")
         .withColumn("conversion_id", record_id("conversion", F.col("record_id"))))
    meta = F.concat(
        F.regexp_replace(F.col("http_header"), r"(?:\r\n)+$", CRLF),
        _field("source-payload-digest", F.col("payload_digest")), _field("source-block-digest", F.col("block_digest")),
        _field("conversion", F.col("conversion_id")), _field("conversion-digest", digest(F.col("text"))),
        _field("title", F.col("title")), F.col("links"))
    both = r.select("*", F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), record_id("metadata", F.col("record_id")).alias("id"),
                 F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("id"),
                 F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")))).alias("d"))
    out = both.select(
        "source_id", F.col("d.record_type").alias("record_type"), F.col("d.id").alias("record_id"),
        F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_digest"),
        F.col("d.content_type").alias("content_type"),
        F.octet_length("d.block").cast("long").alias("content_length"),
        digest(F.col("d.block")).alias("block_digest"), F.col("d.block").alias("block"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Refers-To-Target-URI", F.col("target_uri")), _field("WARC-Refers-To-Date", F.col("date")),
        _field("WARC-Target-URI", F.col("target_uri")), _field("WARC-Date", F.col("date")),
        _field("WARC-Block-Digest", F.col("block_digest")), _field("Content-Type", F.col("content_type")),
        _field("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF))
    return out.select("source_id", "record_type", "record_id", "refers_to", "target_uri", "date", "source_digest",
                      "content_type", "content_length", "block_digest", header.alias("warc_header"), "block")


def write_records(records: DataFrame, path: str) -> None:
    """WARC files in ``path``: header, block and the closing blank lines of every record."""
    (records.select(F.concat("warc_header", "block").alias("value"))
     .write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path))

"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm.common import table, text_batches
from fringeflow.tables import materialise

#: Elements whose content isn't text, and elements that end a line.
HIDDEN = "script style noscript template"
BLOCK = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table td th title tr ul"

_OPENS = re.compile(r"<!--|<(" + "|".join(HIDDEN.split()) + r")\b", re.I)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN.split()}
_BLOCK = re.compile(r"</?(?:" + "|".join(BLOCK.split()) + r")\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_BLANK = re.compile(r"[ \t\r\f\v\u00A0]+")


def _shown(markup: str) -> str:
    """The markup without comments and hidden elements; one that isn't closed reaches to the end. One pass: no place is searched twice."""
    out, at = [], 0
    while m := _OPENS.search(markup, at):
        if m[1] is None:
            end = markup.find("-->", m.end())
            end = len(markup) if end < 0 else end + 3
        else:
            opened = markup.find(">", m.end())
            if opened < 0:  # no tag ends any more, so only a comment can follow
                end = markup.find("<!--", m.end())
                out.append(markup[at:] if end < 0 else markup[at:end])
                return "".join(out)
            close = _CLOSES[m[1].lower()].search(markup, opened + 1)
            end = close.end() if close else len(markup)
        out.append(markup[at : m.start()])
        at = end
    return "".join([*out, markup[at:]])


def _without(tags: re.Pattern, by: str, markup: str) -> str:
    """Each tag replaced. Behind the last > no tag ends, so none is looked for: unclosed ones would make every search reach to the end."""
    last = markup.rfind(">") + 1
    return tags.sub(by, markup[:last]) + markup[last:]


def plain_text(markup: str) -> str:
    """The visible text: hidden elements and comments go, block elements end a line, entities are resolved after the tags
    are gone, blanks are joined and empty lines dropped. A tag that isn't closed stays as text. Linear in the markup."""
    text = html.unescape(_without(_TAG, "", _without(_BLOCK, "\n", _shown(markup.replace("\n", " ")))))
    return "\n".join(x for x in (_BLANK.sub(" ", line).strip() for line in text.split("\n")) if x)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str | None) -> str:
    """A name-based urn:uuid, the same in each run."""
    h = hashlib.sha256("\x00".join("\x01" if p is None else p for p in parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def one_line(value: str) -> str:
    """A header's value: line ends would start another header."""
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, own_id: str, refers_to: str, uri: str | None, date: str, content_type: str, block: bytes, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Date": date, "WARC-Refers-To": refers_to}
    head |= {"WARC-Target-URI": one_line(uri)} if uri is not None else {}
    head |= {k: one_line(v) for k, v in more.items()} | {"WARC-Block-Digest": digest(block), "Content-Type": content_type, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


FIELDS = "metadata_id string, conversion_id string, refers_to string, payload_digest string, text string, text_digest string, metadata binary, conversion binary"


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 128):
            piece = batch.slice(part, 128)
            out = []
            for source, uri, date, head, payload in zip(*(piece.column(c).to_pylist() for c in ("source_id", "uri", "date", "head", "payload")), strict=True):
                raw = payload or b""
                text = plain_text(raw.decode("utf-8", "replace"))
                body = text.encode("utf-8", "surrogatepass")
                meta_id, text_id = record_id(source, "metadata"), record_id(source, "conversion")
                of_payload = digest(raw)
                fields = [("source-headers", x) for x in (head or "").split("\r\n") if x] + [("payload-digest", of_payload), ("payload-length", str(len(raw))), ("conversion-record", text_id), ("conversion-digest", digest(body))]
                block = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
                links = {"WARC-Payload-Digest": of_payload}
                out.append(
                    (
                        meta_id, text_id, source, of_payload, text, digest(body),
                        record("metadata", meta_id, source, uri, date, "application/warc-fields", block, links | {"WARC-Concurrent-To": text_id}),
                        record("conversion", text_id, source, uri, date, "text/plain; charset=utf-8", body, links | {"WARC-Source-Content-Type": "text/html"}),
                    )
                )
            kinds = [pa.string()] * 6 + [pa.binary()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("source_id"), *columns], ["key", "source_id", *(f.split()[0] for f in FIELDS.split(", "))])


def derivatives(responses: DataFrame) -> DataFrame:
    """key, source_id and FIELDS for each row of responses (key, source_id, uri, date, head, payload).

    source_id, a WARC record id, goes on as WARC-Refers-To of both derived records; the response's header lines and
    payload digest go into the metadata record; the records name each other. A null payload is empty: its conversion
    is an empty block. A null uri leaves the header out. Derived ids follow from source_id, so repeated rows derive
    the same records and a second run writes the same bytes. Each row is converted by itself, without a shuffle."""
    key = responses.schema["key"].dataType.simpleString()
    return responses.select("key", "source_id", "uri", "date", "head", "payload").mapInArrow(_derived, f"key {key}, source_id string, {FIELDS}")


def responses_of(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response rows of a table of raw pages: ids by key, url and content, the head that a server sends with such a page."""
    payload = F.col(body).cast("string").cast("binary")
    hexed = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("\x01")), F.coalesce(F.col(url), F.lit("\x01")), F.sha2(F.coalesce(payload, F.lit(b"")), 256)), 256)
    cut = lambda a, n: F.substring(hexed, a, n)
    name = F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length(payload), F.lit(0)).cast("string"))
    return pages.select(F.col(key).alias("key"), name.alias("source_id"), F.col(url).cast("string").alias("uri"), F.lit(date).alias("date"), head.alias("head"), payload.alias("payload"))


def write_warc(derived: DataFrame, path: str) -> None:
    """One WARC record per row of a Parquet table (source_id, kind, record): the bytes of a WARC file when put end to end, in any order."""
    pair = F.explode(F.array(F.struct(F.lit("metadata").alias("kind"), F.col("metadata").alias("record")), F.struct(F.lit("conversion").alias("kind"), F.col("conversion").alias("record"))))
    derived.select("source_id", pair.alias("r")).select("source_id", "r.kind", "r.record").write.parquet(path)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named headers and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return named, rest[: int(named["Content-Length"])]


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of both derived records of every page; see derivatives for nulls and repeated rows. Pages have neither
    a date nor a head, so responses_of makes both up."""
    with text_batches(spark):
        derived = materialise(derivatives(responses_of(table(spark, sf_dir, "pages"))), "warc")
    size = lambda c: F.octet_length(c).cast("long")
    return derived.select(
        F.col("key").alias("page_id"), "refers_to", "metadata_id", "conversion_id", "payload_digest", "text_digest",
        F.char_length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"), size("metadata").alias("metadata_bytes"), size("conversion").alias("conversion_bytes"),
    )

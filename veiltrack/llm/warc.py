"""WARC derivatives: metadata and plain-text conversion records from responses.

A response (its page's URL, HTTP headers and HTML) gives two records that
refer to it: ``metadata``, a JSON of the source headers, title and links, and
``conversion``, the visible text.  Record ids are UUIDs made from URL, payload
digest and kind, so a rerun gives the same ones; digests are SHA-1 in base 32.
A record's own payload digest is that of its block; the response's stands in
the metadata and in source_digest.  Each record is made from one response
alone, in a map over all of them.

Files are read record by record, so memory holds one record and one batch of
rows; of a store that isn't mounted on the workers, one file (of at most 2 GB,
which is what Spark can hand over) besides.  Bodies are freed of chunking and
of gzip or deflate coding, and decoded by the charset of the HTTP header, else
by that which the markup names in its first 1024 bytes, else as UTF-8; other
codings stay as they are.  HTTP fields that stand several times become lists.

Defined results: null URL or null HTML counts as empty, and an empty target is
left out of the headers; pages of any length are worked on whole; repeated
pages give records of equal ids; broken markup gives what text it has; an empty
table gives no records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_entities
import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "page_id long, kind string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, source_digest string, content_length long, block string"

_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|title)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title")}
_BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?]?[a-zA-Z][^>]*>|<[!/?][^>]*>")
_LINKING = re.compile(r"<(a|area|img|link|iframe|script)\b", re.I)
_TARGET = re.compile(r"\b(href|src)\s*=\s*", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
_SPACE = re.compile(r"[ \t\r\f\v\u00a0]+")
_LINES = re.compile(r" *\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=4)}>"


class Page(NamedTuple):
    """Markup without comments, scripts and styles: with its first title, without it, and the markup of that title."""

    markup: str
    body: str
    title: str


def read_page(markup: str, titled: bool = True) -> Page:
    """One pass over a page: what an opening mark hides is skipped at once, so no part is read twice.  What isn't closed goes on to the end.  Later titles are text, and so is the first if not ``titled``."""
    whole, body, title, at, look = [], [], None, 0, 0
    while found := _HIDDEN.search(markup, look):
        name = (found[1] or "").lower()
        if name:
            opened = markup.find(">", found.end()) + 1
            if not opened:  # no tag ends any more, so only a comment can follow
                comment = markup.find("<!--", found.end())
                if comment < 0:
                    break
                look = comment
                continue
            if name == "title" and (title is not None or not titled):
                look = opened
                continue
            close = _ENDS[name].search(markup, opened)
            inner, end = markup[opened : close.start() if close else len(markup)], close.end() if close else len(markup)
        else:
            close = markup.find("-->", found.end())
            end = close + 3 if close >= 0 else len(markup)
        before = markup[at : found.start()]
        if name == "title":
            title = inner
            whole += [before, markup[found.start() : opened], read_page(inner, False).body, markup[close.start() if close else end : end]]
            body += [before, "\n"]
        else:
            whole += [before, " "]
            body += [before, " "]
        at = look = end
    return Page("".join([*whole, markup[at:]]), "".join([*body, markup[at:]]), title or "")


def _cut(pattern: re.Pattern, by: str, markup: str) -> str:
    """Without tags of a pattern, none of which can begin after the last end of one."""
    k = markup.rfind(">") + 1
    return pattern.sub(by, markup[:k]) + markup[k:]


def _plain(markup: str) -> str:
    return _SPACE.sub(" ", html_entities.unescape(_cut(_TAG, "", markup)))


def visible_text(markup: str) -> str:
    """The text of a page: a line a block, no scripts, styles or comments, and not its title, wherever that stands."""
    return _LINES.sub("\n", _plain(_cut(_BREAKS, "\n", read_page(markup).body))).strip()


def page_title(markup: str) -> str:
    """The first title that is not in a comment, script or style."""
    return _plain(read_page(markup).title).strip()


def page_links(markup: str) -> list[dict]:
    """The first target of each linking tag that has one.  Tags, ends of tags and targets are met in order, each once."""
    markup = read_page(markup).markup
    targets, out, done, end = _TARGET.finditer(markup), [], 0, -1
    target = next(targets, None)
    for tag in _LINKING.finditer(markup):
        if tag.start() < done:
            continue
        if end < tag.end():
            end = markup.find(">", tag.end())
            end = len(markup) if end < 0 else end
        while target and target.start() < end:
            value = _VALUE.match(markup, target.end()) if target.start() >= tag.end() else None
            if value:
                out.append({"path": f"{tag[1].upper()}@/{target[1].lower()}", "url": html_entities.unescape(value[1] or value[2] or value[3] or "")})
                done = value.end()
            target = next(targets, None)
            if value:
                while target and target.start() < done:
                    target = next(targets, None)
                break
    return out


def header_fields(lines: str) -> dict[str, str | list[str]]:
    """HTTP fields by name, as it was first spelt; those that stand several times as lists."""
    spelt: dict[str, str] = {}
    out: dict[str, str | list[str]] = {}
    for line in lines.split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name = spelt.setdefault(name.strip().lower(), name.strip())
        held, value = out.get(name), value.strip()
        out[name] = value if held is None else [*(held if isinstance(held, list) else [held]), value]
    return out


def derive(url: str, markup: str, date: str = DATE, http: str = HTTP, source_id: str | None = None, source_digest: str | None = None, source_length: int | None = None) -> list[tuple]:
    """The metadata and the conversion record of a response, as RECORD has them but for page_id."""
    body = markup.encode("utf-8", "surrogatepass")
    payload = source_digest or digest(body)
    source = source_id or record_id("response", url, payload)
    status, _, fields = http.rstrip("\r\n").partition("\r\n")
    about = {
        "Envelope": {
            "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": source, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": payload, "Content-Length": str(len(http.encode()) + len(body) if source_length is None else source_length)},
            "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": header_fields(fields), "HTML-Metadata": {"Head": {"Title": page_title(markup)}, "Links": page_links(markup)}}},
        }
    }
    out = []
    for kind, content_type, block in (("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", visible_text(markup))):
        raw = block.encode("utf-8", "replace")
        own = digest(raw)
        out.append((kind, record_id(kind, url, payload), source, url, date, content_type, own, own, payload, len(raw), raw.decode()))
    return out


def derivatives(pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """RECORD rows, two a page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                made = [(None if pd.isna(p) else int(p), *r) for p, u, h in zip(part["page_id"], part["url"], part["html"]) for r in derive(u, h, date)]
                out = pd.DataFrame(made, columns=columns)
                yield out.assign(page_id=out["page_id"].astype("Int64"))

    return rows.mapInPandas(build, RECORD)


def record_bytes(kind: str, own_id: str, refers_to: str | None, target: str, date: str, content_type: str, block_digest: str, payload_digest: str | None, block: bytes) -> bytes:
    """One record as it stands in a file, not compressed."""
    head = [f"WARC-Type: {kind}", f"WARC-Target-URI: {target}" if target else None, f"WARC-Date: {date}", f"WARC-Record-ID: {own_id}", f"WARC-Refers-To: {refers_to}" if refers_to else None, f"WARC-Block-Digest: {block_digest}", f"WARC-Payload-Digest: {payload_digest}" if payload_digest else None, f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.0", *filter(None, head), "", ""]).encode() + block + b"\r\n\r\n"


def response_bytes(url: str, markup: str, date: str = DATE, http: str = HTTP) -> bytes:
    """A page as the response record that its derivatives refer to."""
    body = markup.encode("utf-8", "surrogatepass")
    block, payload = http.encode() + body, digest(body)
    return record_bytes("response", record_id("response", url, payload), None, url, date, "application/http; msgtype=response", digest(block), payload, block)


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, compressed or not, one after the other."""
    stream = io.BufferedReader(stream, 1 << 20) if not hasattr(stream, "peek") else stream
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.read(int(headers.get("Content-Length", 0)))


def _last(fields: dict[str, str | list[str]], name: str) -> str:
    found = next((v for k, v in fields.items() if k.lower() == name), "")
    return (found[-1] if isinstance(found, list) else found).lower()


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return body if not out else b"".join(out)
        if size == 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def decode_body(fields: dict[str, str | list[str]], body: bytes) -> str:
    """The markup of a response's body."""
    if "chunked" in _last(fields, "transfer-encoding"):
        body = _unchunked(body)
    coding = _last(fields, "content-encoding")
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # gzip or zlib, then a bare deflate stream
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", _last(fields, "content-type")) or re.search(r"<meta\b[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", body[:1024].decode("latin-1"), re.I)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def write_records(records: DataFrame, folder: str) -> DataFrame:
    """RECORD rows as files of gzip members in a folder that all workers mount, one a partition; gives path and n of each when run."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        path, n = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.warc.gz"), 0
        with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            for batch in batches:
                for r in batch.itertuples():
                    f.write(gzip.compress(record_bytes(r.kind, r.record_id, r.refers_to, r.target_uri, r.date, r.content_type, r.block_digest, r.payload_digest, r.block.encode()), mtime=0))
                    n += 1
        os.replace(tmp, path)
        yield pd.DataFrame({"path": [path], "n": [n]})

    return records.mapInPandas(write, "path string, n long")


_RESPONSE = "source_id string, url string, date string, http string, html string, digest string, length long"


def _responses(stream: BinaryIO) -> Iterator[tuple]:
    for headers, block in parse_records(stream):
        if headers.get("WARC-Type") == "response":
            http, gap, body = block.partition(b"\r\n\r\n")
            http = (http + gap).decode("utf-8", "replace")
            fields = header_fields(http.rstrip("\r\n").partition("\r\n")[2])
            yield headers.get("WARC-Record-ID", ""), headers.get("WARC-Target-URI", ""), headers.get("WARC-Date", ""), http, decode_body(fields, body), headers.get("WARC-Payload-Digest") or digest(body), len(block)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """_RESPONSE rows of the response records in files; a file is one task's, record by record."""
    columns, files = [c.split()[0] for c in _RESPONSE.split(", ")], spark.read.format("binaryFile").load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch.iloc[:, 0]:
                # a path that workers open as Spark does, or what Spark has read
                with open(unquote(urlsplit(source).path), "rb") if isinstance(source, str) else io.BytesIO(source) as stream:
                    rows, size = [], 0
                    for row in _responses(stream):
                        rows.append(row)
                        size += row[-1]
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=columns)

    mounted = F.col("path").startswith("file:")
    near = files.filter(mounted).select("path").mapInPandas(read, _RESPONSE)
    return near.unionByName(files.filter(~mounted).select("content").mapInPandas(read, _RESPONSE))


def convert_responses(responses: DataFrame) -> DataFrame:
    """RECORD rows (page_id null) of read_responses: ids, dates, HTTP headers and digests of the source are kept."""
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                made = [(None, *r) for r0 in batch.iloc[lo : lo + 500].itertuples() for r in derive(r0.url, r0.html, r0.date, r0.http, r0.source_id or None, r0.digest, int(r0.length))]
                out = pd.DataFrame(made, columns=columns)
                yield out.assign(page_id=out["page_id"].astype("Int64"))

    return responses.mapInPandas(build, RECORD)

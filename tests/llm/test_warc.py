"""Derivatives read back from files; ids, headers and digests."""

import base64
import gzip
import hashlib
import io
import json
import re
import time
import zlib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from veiltrack.llm.queries import op6_warc
from veiltrack.llm.warc import convert_responses, derivatives, derive, page_links, page_title, parse_records, read_responses, record_bytes, response_bytes, visible_text, write_records

PAGE = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><h1>Head</h1><p>one <b>two</b>&nbsp;three<br>four</p><a href="/x?a=1&amp;b=2">link</a><img src=\'i.png\'></body></html>'


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_text_and_links():
    assert visible_text(PAGE) == "Head\none two three\nfour\nlink"
    assert [x["url"] for x in page_links(PAGE)] == ["/x?a=1&b=2", "i.png"]
    assert visible_text("") == "" and visible_text("<p>open <b") == "open <b" and visible_text("1 < 2 and <i>so</i>") == "1 < 2 and so"


@pytest.mark.parametrize("head", ["", "<meta content='" + "x" * 5000 + "'>", "<style>" + "p{} " * 2000 + "</style>", "<script>" + "var a = '<title>'; " * 400 + "</script>", "<!-- <title> " + "y" * 5000 + " -->"])
def test_title_is_taken_out_wherever_it_stands(head):
    page = f"<html><head>{head}<TITLE>A page</TITLE></head><body><p>one</p><svg><title>two<!-- no --></title></svg></body></html>"
    assert visible_text(page) == "one\ntwo"
    assert derive("http://e.x/", page)[1][10] == "one\ntwo"


@pytest.mark.parametrize("head", ["<!-- <title>Old</title> -->", "<script>var t = '<title>Old</title>';</script>", "<style><title>Old</title></style>"])
def test_titles_that_are_hidden_are_none(head):
    page = head + "<title>Re<!-- x -->al</title><p>one"
    assert page_title(page) == "Real" and visible_text(page) == "one"
    assert page_title(head) == "" and page_title("<title>un <b>closed") == "un closed" and visible_text("a<title>un <b>closed") == "a"


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<!", "<script>", "<script ", "<!--", "<a href=", "<a href='", "<div", "</title ", "<title><!--", "<a <img ", "href ", "< "])
@pytest.mark.parametrize("end", ["", ">"])
def test_long_broken_markup_is_read_once(piece, end):
    page = piece * (2_000_000 // len(piece)) + end
    began = time.monotonic()
    for of in (page_links, page_title, visible_text):
        of(page)
    assert time.monotonic() - began < 12


def test_links_of_odd_tags():
    urls = lambda page: [(x["path"], x["url"]) for x in page_links(page)]
    assert urls("<a title='x>y' href=a><a href='p>q'><img alt=\"<a b\" src=c>") == [("A@/href", "p>q"), ("IMG@/src", "c")]
    assert urls("<a href= ><a href=\"\" src=z><area x href = t") == [("A@/href", ""), ("AREA@/href", "t")]
    assert urls("<!-- <a href=no> --><title><a href=yes></title><a href=a src=b>") == [("A@/href", "yes"), ("A@/href", "a")]


def test_records_refer_to_their_source():
    (kind, own, source, url, date, _, block_digest, payload, source_digest, length, block), text = derive("http://e.x/", PAGE)
    about = json.loads(block)["Envelope"]
    assert kind == "metadata" and about["WARC-Header-Metadata"]["WARC-Record-ID"] == source == text[2] and own != text[1]
    assert about["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Head"]["Title"] == "A & B"
    assert about["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["Content-Type"].startswith("text/html")
    assert payload == block_digest and text[7] == text[6] and text[8] == sha1(PAGE.encode()) and block_digest == sha1(block.encode()) and length == len(block.encode())
    assert text[0] == "conversion" and text[6] == sha1(text[10].encode()) and source_digest == text[8] == about["WARC-Header-Metadata"]["WARC-Payload-Digest"]


def test_round_trip_through_files(spark, tmp_path):
    rows = [(i, f"http://e.x/{i}", PAGE.replace("one", f"é{i}")) for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(response_bytes(u, h)) for _, u, h in rows[:4]))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(response_bytes(u, h) for _, u, h in rows[4:]))
    direct = derivatives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = convert_responses(read_responses(spark, str(tmp_path / "in")))
    key = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert key(found) == key(direct)
    out = write_records(direct.coalesce(2), str(tmp_path / "out")).collect()
    assert sum(r.n for r in out) == 12
    back = [(h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Block-Digest"], b.decode()) for r in out for h, b in parse_records(open(r.path, "rb"))]
    assert sorted(back) == sorted((r.record_id, r.refers_to, r.block_digest, r.block) for r in direct.collect())


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "http://e.x/", ""), (2, "http://e.x/", ""), (None, "u", "<p>x"), (3, "v", "<p>word </p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("kind"))
    got = derivatives(df).collect()
    assert len(got) == 10 and len({r.record_id for r in got if r.page_id == 2}) == 2
    assert [r.block for r in got if r.page_id == 1 and r.kind == "conversion"] == [""]
    assert derivatives(df.limit(0)).count() == 0


class Visible(HTMLParser):
    """Text by the parser of the standard library: a new line at each block, nothing hidden, and not the first title."""

    BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.titles = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.titles += tag == "title"
        self.hidden += tag in ("script", "style", "noscript", "template") or (tag == "title" and self.titles == 1)
        self.out += ["\n"] if tag in self.BLOCKS else []

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style", "noscript", "template") or (tag == "title" and self.titles == 1)))
        self.out += ["\n"] if tag in self.BLOCKS else []

    def handle_data(self, data):
        self.out += [] if self.hidden else [data]

    def text(self, page):
        self.feed(page)
        self.close()
        lines = (re.sub(r"[ \t\r\f\v\u00a0]+", " ", x).strip(" ") for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_text_of_the_pages(spark, sf_dir):
    """Word for word what a parser of whole documents sees."""
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.block for r in op6_warc(spark, sf_dir).collect() if r.kind == "conversion"}
    assert len(got) == len(pages) > 10
    assert all(got[p].split() == Visible().text(h).split() for p, h in pages.items())
    assert sum(got[p].split("\n") == Visible().text(h).split("\n") for p, h in pages.items()) >= 0.95 * len(pages)


def test_bodies_and_fields(spark, tmp_path):
    """Charsets, chunks, codings, repeated fields; digests and lengths of the source."""
    page = "<title>t</title><p>caf\u00e9 na\u00efve</p>"
    latin, utf = page.encode("latin-1"), page.encode()
    chunked = b"5\r\n" + utf[:5] + b"\r\n%x;x=y\r\n" % len(utf[5:]) + utf[5:] + b"\r\n0\r\n\r\n"
    raw_deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    cases = [("Content-Type: text/html; charset=ISO-8859-1", latin), ("X: y", b"<meta charset='latin1'>" + latin), ("Transfer-Encoding: chunked", chunked), ("Content-Encoding: gzip", gzip.compress(utf)), ("Content-Encoding: deflate", zlib.compress(utf)), ("Content-Encoding: deflate", raw_deflate.compress(utf) + raw_deflate.flush()), ("Content-Type: text/html; charset=unheard-of", utf)]
    records = b""
    for i, (field, body) in enumerate(cases):
        block = f"HTTP/1.1 200 OK\r\n{field}\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\n\r\n".encode() + body
        records += gzip.compress(record_bytes("response", f"<urn:{i}>", None, f"http://e.x/{i}", "2020-01-01T00:00:00Z", "application/http", sha1(block), sha1(body), block))
    (tmp_path / "a b.warc.gz").write_bytes(records)
    got = {(r.target_uri, r.kind): r for r in convert_responses(read_responses(spark, str(tmp_path))).collect()}
    assert len(got) == 2 * len(cases)
    for i, (_, body) in enumerate(cases):
        text, about = got[f"http://e.x/{i}", "conversion"], got[f"http://e.x/{i}", "metadata"]
        assert text.block == "caf\u00e9 na\u00efve" and text.refers_to == f"<urn:{i}>" and text.source_digest == sha1(body)
        fields = json.loads(about.block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]
        assert fields["Set-Cookie"] == ["a=1", "b=2"]


def test_on_the_pages(spark, sf_dir):
    got = op6_warc(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == 2 * len(pages)
    for r in got:
        assert r.target_uri == (pages[r.page_id].url or "") and r.source_digest == sha1((pages[r.page_id].html or "").encode())
        assert r.kind == "metadata" or ("<script" not in r.block and "</p>" not in r.block)


@pytest.mark.parametrize("text", ["WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"])
def test_plain_record(text):
    assert list(parse_records(io.BytesIO(text.encode()))) == [({"Content-Length": "3"}, b"abc")]

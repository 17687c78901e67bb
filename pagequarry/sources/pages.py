"""Page corpus in, element tree out.

``parse_pages`` is the only Python table function of the library.  It is a
narrow ``mapInArrow``: each page row gains its elements as one array column, so
everything after it (selectors, scores, gates) is a per-row expression and the
corpus is never shuffled for extraction.
"""

import codecs
import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import NODE_TYPE

# The parser travels inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARSED_COLUMNS = f"text string, nodes array<{NODE_TYPE}>, parse_error string"

# ---- Fixed values: HTML void elements, and elements whose text stays out of
# the text of their ancestors.
VOID_TAGS = {"area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image",
             "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param",
             "source", "spacer", "track", "wbr"}
APART_TAGS = {"script", "style", "template", "rt", "rp"}
KEEP_SPACE_TAGS = {"pre", "textarea"}


#: Single-byte charsets by the names that responses use; and those that Spark decodes itself.
SINGLE_BYTE = {"windows-1252": ("windows-1252", "cp1252", "iso-8859-1", "latin1", "latin-1"), "iso-8859-15": ("iso-8859-15", "latin-9"),
               "windows-1251": ("windows-1251", "cp1251"), "koi8-r": ("koi8-r",), "iso-8859-2": ("iso-8859-2", "latin2")}
OWN = {"UTF-16": ("utf-16",), "UTF-16LE": ("utf-16le",), "UTF-16BE": ("utf-16be",), "UTF-32": ("utf-32",)}


def page_scan(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def decoded_body(body: Column, content_type: Column) -> Column:
    """Text of a fetched body in the charset that the response names; UTF-8 without a name or for an unknown one.

    A single-byte charset is Latin-1 with other letters, so it is read as that and
    its upper half replaced.  ``iso-8859-1`` means windows-1252, as in browsers.
    """
    named = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=[\"']?([A-Za-z0-9_-]+)", 1))
    text = F.decode(body, "UTF-8")
    for charset, names in OWN.items():
        text = F.when(named.isin(*names), F.decode(body, charset)).otherwise(text)
    upper = [bytes([b]) for b in range(128, 256)]
    for charset, names in SINGLE_BYTE.items():
        letters = "".join(b.decode(charset, "replace") for b in upper)
        text = F.when(named.isin(*names), F.translate(F.decode(body, "ISO-8859-1"), "".join(b.decode("latin-1") for b in upper), letters)).otherwise(text)
    return text


#: Names that pages use for a charset and the decoder that reads it; others go by the standard library's names.
DECODERS = {"gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "us-ascii": "cp1252",
            "ascii": "cp1252", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932",
            "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "iso-8859-9": "cp1254", "tis-620": "cp874"}
#: Byte order marks, longest first.
MARKS = ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Charsets that are tried where nothing names one, with the letters that tell them apart and their weight: kana are about half of a
#: Japanese text.
UNNAMED = (("euc_jp", "[\u3041-\u30ff]", 2), ("cp932", "[\u3041-\u30ff]", 2), ("cp949", "[\uac00-\ud7a3]", 1),
           ("gb18030", "[\u4e00-\u9fff]", 1), ("big5", "[\u4e00-\u9fff]", 1))
_NAMED = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.IGNORECASE)
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.IGNORECASE)
_COMMENT = re.compile(rb"<!--.*?(?:-->|\Z)", re.DOTALL)


def _decoder(label: str) -> str | None:
    try:
        return codecs.lookup(DECODERS.get(label.lower(), label)).name
    except LookupError:
        return None


def _unnamed(body: bytes) -> str:
    """UTF-8 if the bytes are valid in it, else the charset in which they are valid and hold the largest share of its own
    letters among those beyond ASCII, else windows-1252.

    Of the two Chinese ones, pairs of bytes in the range of the most used characters decide.
    """
    try:
        body.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    best, share = "cp1252", 0.5
    for charset, letters, weight in UNNAMED:
        try:
            far = [c for c in body.decode(charset) if c > "\x7f"]
        except UnicodeDecodeError:
            continue
        own = weight * len(re.findall(letters, "".join(far))) / max(1, len(far))
        if charset == "gb18030":  # most used: first bytes B0 to D7, second ones A1 and above
            own *= len(re.findall(rb"[\xb0-\xd7][\xa1-\xfe]", body)) / max(1, len(far))
        if charset == "big5":  # most used: first bytes A4 to C6
            own *= len(re.findall(rb"[\xa4-\xc6][\x40-\x7e\xa1-\xfe]", body)) / max(1, len(far))
        if own > share:
            best, share = charset, own
    return best


def charset_of(body: bytes, content_type: str | None) -> str:
    """Decoder of a fetched page: its byte order mark, else the response's name, else that of a ``meta`` element in its first
    1,024 bytes (where UTF-16 can only mean UTF-8), else by its bytes."""
    for mark, charset in MARKS:
        if body.startswith(mark):
            return charset
    named = _NAMED.search(content_type or "")
    if named and (charset := _decoder(named[1])):
        return charset
    meta = _META.search(_COMMENT.sub(b"", body[:1024]))
    if meta and (charset := _decoder(meta[1].decode("ascii"))):
        return "utf-8" if charset.startswith("utf-16") else charset
    return _unnamed(body)


def decoded_pages(fetched: DataFrame) -> DataFrame:
    """``page_id, url, html`` of ``page_id, url, content_type, body``: a narrow pass; bytes that the charset lacks become
    replacement characters, and a NULL body stays NULL."""
    def run(batches):
        for batch in batches:
            types = batch.column("content_type").to_pylist()
            texts = [None if b is None else b.decode(charset_of(b, t), "replace").removeprefix("\ufeff")
                     for b, t in zip(batch.column("body").to_pylist(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "html"])
    return fetched.select(F.col("page_id").cast("long").alias("page_id"), "url", "content_type", "body") \
        .mapInArrow(run, "page_id long, url string, html string")


class _Tree(HTMLParser):
    """Elements of one page in document order, with text kept once per page.

    There are no implied end tags: an end tag closes up to the nearest open
    element of its name and is ignored if there is none.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.counts = [], [], {}
        self.parts, self.length, self.pending = [], 0, []

    def _flush(self):
        data = "".join(self.pending)
        self.pending.clear()
        if not data:
            return
        if not data.strip(" \n\t\r\x0c") and not any(self.counts.get(t) for t in KEEP_SPACE_TAGS):
            data = "\n" if "\n" in data else " "
        if any(self.counts.get(t) for t in APART_TAGS):
            # Text at any depth of such an element belongs to it alone.
            row = next(r for r in map(self.rows.__getitem__, reversed(self.open)) if r["tag"] in APART_TAGS)
            row["raw"] = (row["raw"] or "") + data
        else:
            self.parts.append(data)
            self.length += len(data)

    def _close(self):
        row = self.rows[self.open.pop()]
        row["end_id"], row["text_len"] = len(self.rows), self.length - row["text_start"]
        self.counts[row["tag"]] -= 1

    def handle_starttag(self, tag, attrs):
        self._flush()
        attrs = {k: v or "" for k, v in attrs}
        self.rows.append({
            "node_id": len(self.rows) + 1, "parent_id": self.open[-1] + 1 if self.open else 0,
            "depth": len(self.open), "tag": tag, "id": attrs.get("id"),
            "classes": attrs.get("class", "").split(), "attrs": list(attrs.items()),
            "text_start": self.length, "raw": None})
        self.open.append(len(self.rows) - 1)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in VOID_TAGS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close()

    def handle_endtag(self, tag):
        self._flush()
        if self.counts.get(tag):
            while self.rows[self.open[-1]]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def tree(self, html):
        self.feed(html)
        self.close()
        self._flush()
        while self.open:
            self._close()
        return "".join(self.parts), self.rows


def _parsed(html):
    if html is None:
        return None, [], "Request error: no page body"
    try:
        text, rows = _Tree().tree(html)
        return text, rows, None
    except Exception as e:  # a malformed page must not fail the job
        return None, [], f"Error: {e}"


def parse_pages(pages: DataFrame, max_nodes_per_batch: int = 50_000) -> DataFrame:
    """Replace ``html`` by ``text``, ``nodes`` and ``parse_error``; other columns pass through."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [PARSED_COLUMNS])
    arrow_node = pa.struct([
        ("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()),
        ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())), ("text_start", pa.int32()), ("text_len", pa.int32()),
        ("raw", pa.string())])

    def emit(batch, start, done):
        columns = [batch.column(n).slice(start, len(done)) for n in names]
        texts, nodes, errors = zip(*done)
        return pa.RecordBatch.from_arrays(
            columns + [pa.array(texts, pa.string()), pa.array(nodes, pa.list_(arrow_node)),
                       pa.array(errors, pa.string())],
            names=names + ["text", "nodes", "parse_error"])

    def parse(batches):
        for batch in batches:
            start, done, size = 0, [], 0
            for html in batch.column("html"):
                done.append(_parsed(html.as_py()))
                size += len(done[-1][1])
                if size >= max_nodes_per_batch:
                    yield emit(batch, start, done)
                    start, done, size = start + len(done), [], 0
            if done:
                yield emit(batch, start, done)

    return pages.select(*names, "html").mapInArrow(parse, schema)

"""Web archives: records written and read by Spark, and captures assembled from their records.

Each capture is a request, a response (or a revisit of an equal payload) and a metadata record; the
others name the response in WARC-Concurrent-To. Reading joins them again through
that field and gives one nested row per capture. Records are never gathered
by payload: the first capture of each payload comes from a grouped minimum.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.registry import query, table
from plantscope.session import scratch_path

END = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Records in one archive file; readers take a file at a time.
PER_FILE = 3_000


def _record(kind: str, name: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), *fields, ("Content-Length", str(len(body)))]
    return "\r\n".join([VERSION, *[f"{k}: {v}" for k, v in head]]).encode() + END.encode() + body


def _uuid(*parts) -> str:
    return str(uuid.UUID(bytes=hashlib.md5("/".join(map(str, parts)).encode()).digest()))


def _one_line(text) -> str:
    return " ".join(str(text or "").split())


def _archive(date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, nr, url, html, digest, first in pdf[["page", "nr", "url", "html", "digest", "first"]].itertuples(index=False):
                body = (html or "").encode()
                name = _uuid('' if pd.isna(page) else int(page), digest, nr)
                target = [("WARC-Target-URI", u)] if (u := _one_line(url)) else []
                about = [("WARC-Date", date), *target, ("WARC-Payload-Digest", f"sha1:{digest}")]
                own = [] if pd.isna(page) else [("X-Page-ID", str(int(page)))]
                if pd.isna(first):
                    main = _record("response", name, [*about, *own, ("Content-Type", "text/html")], body)
                else:
                    main = _record("revisit", name, [*about, *own, ("WARC-Refers-To", f"<urn:uuid:{_uuid(int(first), digest, '')}>"), ("X-Refers-To-Page", str(int(first))),
                                                     ("X-Payload-Bytes", str(len(body))), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")
                beside = [("WARC-Date", date), *target, ("WARC-Concurrent-To", f"<urn:uuid:{name}>")]
                ask = f"GET {_one_line(url) or '/'} HTTP/1.1{END}".encode()
                # three records in one row, so that one file holds a capture; the writer ends the row with what ends the last record
                out.append(END.encode().join([
                    _record("request", _uuid(name, "request"), [*beside, ("Content-Type", "application/http; msgtype=request")], ask), main,
                    _record("metadata", _uuid(name, "metadata"), [*beside, ("Content-Type", "application/warc-fields")], f"payload-bytes: {len(body)}\r\n".encode()),
                ]).decode())
            yield pd.DataFrame({"value": out})

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``pages`` as gzipped WARC files of Spark's text writer (each a sequence of whole records).

    Of pages whose payloads are equal and at least ``least`` bytes long the smallest id is a response and the others are
    revisits of it. NULL html is an empty payload. A page without id is a response. Rows that share an id and a payload
    share their record ids, and are one capture when they are read; white space in urls is made single. Other columns are not looked at.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = rows.where((F.octet_length("html") >= least) & F.col("page").isNotNull()).groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    # only digests and ids are shuffled here; the list of repeats meets the pages by id
    repeats = rows.select("page", "sha", F.octet_length("html").alias("bytes")).join(first.select("sha", "first"), "sha").where(f"page > first and bytes >= {least}")
    repeats = repeats.select(F.col("page").alias("p"), F.col("sha").alias("s"), "first").distinct()
    marked = rows.join(repeats, (F.col("page") == F.col("p")) & (F.col("sha") == F.col("s")), "left")
    nr = F.when(F.col("page").isNull(), F.uuid()).otherwise(F.lit(""))
    base32 = F.pandas_udf(lambda s: s.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode()), "string")
    marked.select("page", nr.alias("nr"), "url", "html", base32("sha").alias("digest"), "first").mapInPandas(_archive(date), "value string").write.option(
        "lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(folder)


def _records(with_payload: bool):
    import gzip

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bytes(raw)
                rows, at = [], 0
                while at < len(data):
                    if data[at : at + len(VERSION)] != VERSION.encode():
                        raise ValueError(f"no WARC record at byte {at} of {path}")
                    top = data.index(END.encode(), at)
                    head = dict(line.split(": ", 1) for line in data[at:top].decode().split("\r\n")[1:])
                    begin = top + len(END)
                    end = begin + int(head["Content-Length"])
                    body = data[begin:end]
                    if data[end : end + len(END)] != END.encode():
                        raise ValueError(f"a record of {path} doesn't end where it says")
                    at = end + len(END)
                    rows.append((head["WARC-Record-ID"], head["WARC-Type"], head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head, len(body),
                                 base64.b32encode(hashlib.sha1(body).digest()).decode(), body if with_payload else None))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=FIELDS)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=FIELDS)

    return run


FIELDS = ["record_id", "type", "concurrent_to", "refers_to", "headers", "bytes", "digest", "payload"]
SHAPE = "record_id string, type string, concurrent_to string, refers_to string, headers map<string,string>, bytes long, digest string, payload binary"


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives in ``folder``, plain or gzipped; length and digest are those of the body as read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").mapInPandas(_records(with_payload), SHAPE)


def captures(records: DataFrame) -> DataFrame:
    """(capture_id, main, request, metadata): records joined through WARC-Concurrent-To; the last two are NULL where they are missing.

    A capture without response or revisit has a NULL ``main``. Of several requests or metadata records the one with the smallest id is taken.
    """
    row = F.struct("record_id", "type", "refers_to", "headers", "bytes", "digest", "payload")
    of = lambda *kinds: F.min_by(F.when(F.col("type").isin(*kinds), row), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        of("response", "revisit", "resource").alias("main"), of("request").alias("request"), of("metadata").alias("metadata"))


@query("op5_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), folder)
    found = captures(read_records(spark, folder, with_payload=False))
    # what a revisit repeats is measured on the response that it refers to
    sources = found.where("main.type = 'response'").select(F.col("capture_id").alias("source"), F.col("main.bytes").alias("full"), F.col("main.digest").alias("sha"))
    joined = found.join(sources, found.main.refers_to == sources.source, "left")
    return joined.select(
        F.col("main.headers")["X-Page-ID"].cast("long").alias("page_id"),
        F.coalesce("full", "main.bytes").alias("payload_bytes"), F.coalesce("sha", "main.digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"), F.col("main.headers")["X-Refers-To-Page"].cast("long").alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))

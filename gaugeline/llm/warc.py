"""WARC archives: written by Spark's text sink, read by a Python data source (operator 3).

A record is a line of text whose separator is the blank line that ends a record, so archives are
written by Spark's own file writer, with its commit protocol, to any file system Spark knows.

The reader plans a partition per archive, takes filters on record_type, record_id, target_uri,
refers_to and payload_digest, parses a record's headers first, and passes over the block of a record
that a filter rejects or whose payload isn't wanted (option ``payload``: ``true``, the default, or
``false``).  Archives may be compressed (``.gz``, a member a record or not); header names are met in any
case; a block that is no HTTP response is its own payload; an archive that is cut off raises.
The query reads payloads of responses only and takes revisits from their headers.

Equal payloads of at least ``least`` bytes are stored once: the record with the largest page_id is the
response, the others are revisits that refer to it.  Null html is empty; a null url has no header;
a url with control characters or blanks is percent-encoded as a whole.  Rows repeated with the largest page_id
are all responses; a null page_id is smaller than any other and gives a record without a number.
An empty table makes an empty archive and an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import contextlib
import gzip
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import filesystem, lookup, materialize, shared_dir, table

LEAST = 1000
URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, file string, position long, payload binary"
#: Record types whose block is a payload.
STORED = ("response", "resource")
#: The column that each header gives.
HEADERS = {"WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to", "WARC-Payload-Digest": "payload_digest", "X-Payload-Length": "payload_length"}


def write(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Writes page_id, url and html as archives into ``folder``."""
    html = F.coalesce("html", F.lit(""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    # payloads met more than once; partial counts make a hot payload one row a task
    shared = full.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).filter("n > 1").drop("n")
    marked = lookup(full, materialize(shared), ["digest", "bytes"])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.col("url")
    url = F.when(url.rlike(r"[\x00-\x20\x7f]"), F.regexp_replace(F.url_encode(url), r"\+", "%20")).otherwise(url)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        F.lit(f"WARC-Record-ID: <{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\n"),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Target-URI", url),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{URN}"), F.col("first"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"), block,
    )
    marked.select(record.alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").text(folder)


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.payload, self.wanted = options["path"], options.get("payload", "true") != "false", []

    def pushFilters(self, filters):
        taken = set(HEADERS.values()) - {"payload_length"}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in taken:
                self.wanted.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self):
        import pyarrow.fs as pafs

        fs, place = filesystem(self.folder)
        found = fs.get_file_info(pafs.FileSelector(place, recursive=True))
        return [Archive(f.path) for f in found if f.type == pafs.FileType.File and f.size and f.base_name[0] not in "._"] or [Archive("")]

    def read(self, partition):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64() if c.endswith("long") else pa.binary() if c.endswith("binary") else pa.string() for c in SCHEMA.split(", ")]
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)
        for row in records(self.folder, partition.path, self.payload, self.wanted) if partition.path else ():
            rows.append(row)
            held += len(row.get("payload") or b"")
            if len(rows) >= 2000 or held >= 16 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


def headers(file, what: str) -> dict[str, str]:
    """Header lines up to the blank one: names in lower case, and lines that go on joined."""
    found: dict[str, str] = {}
    name = None
    while (line := file.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError(f"{what} is cut off")
        text = line.decode(errors="replace")
        if text[0] in " \t" and name:
            found[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def payload_of(block: bytes, content_type: str) -> bytes:
    """What an HTTP response holds; any other block is its own payload."""
    if not content_type.lower().startswith("application/http") or not block.startswith(b"HTTP/"):
        return block
    ends = [at + len(e) for e in (b"\r\n\r\n", b"\n\n") if (at := block.find(e)) >= 0]
    return block[min(ends) :] if ends else b""


def records(folder: str, path: str, payload: bool = True, wanted=()):
    """The records of an archive that pass ``wanted``, pairs of a column and the values let through.

    Archives whose name ends in .gz are read member after member; positions are those in the inflated bytes.
    """
    fs, _ = filesystem(folder)
    with contextlib.ExitStack() as stack:
        raw = stack.enter_context(fs.open_input_file(path))
        if path.endswith(".gz"):
            raw = stack.enter_context(gzip.GzipFile(fileobj=raw))
        file = stack.enter_context(io.BufferedReader(raw, 1 << 20))
        while True:
            position = file.tell()
            version = file.readline()
            if not version:
                return
            what = f"{path}: the record at {position}"
            if not version.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at {position}")
            said = headers(file, what)
            row: dict = {"file": path, "position": position}
            for name, column in HEADERS.items():
                if (value := said.get(name.lower())) is not None:
                    row[column] = value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value
            if "payload_length" in row:
                row["payload_length"] = int(row["payload_length"])
            if "payload_digest" in row:
                row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
            length = int(said.get("content-length", 0))
            passes = all(row.get(c) in v for c, v in wanted)
            if passes and payload and row.get("record_type") in STORED:
                block = file.read(length)
                row["payload"] = payload_of(block, said.get("content-type", ""))
            else:
                file.seek(length, io.SEEK_CUR)
            if file.read(4) != b"\r\n\r\n":  # in its place if the block is whole
                raise ValueError(f"{what} is cut off")
            if passes:
                yield row


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", folder).option("payload", str(payload).lower()).load()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/archives"
    write(table(spark, sf_dir, "pages"), folder)
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(URN) + 1}) AS BIGINT)")
    named = lambda df, size, digest: df.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    # what a response holds is read and measured; of revisits, the headers say it
    responses = read(spark, folder).filter("record_type = 'response'")
    revisits = read(spark, folder, payload=False).filter("record_type = 'revisit'")
    responses = named(responses, F.octet_length("payload").cast("long"), F.sha1("payload"))
    return responses.unionByName(named(revisits, F.col("payload_length"), F.col("payload_digest")))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""

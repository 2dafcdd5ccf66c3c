"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page id, address and digest, and dealt to shards by ranges of that order. A shard
begins at every record whose hash says so, on average after ``SHARD_BYTES`` of payload, so
that the ranges depend on the records alone and not on tasks or samples. Within a shard files are
rolled once they have ``ROLL_BYTES`` compressed. All headers and digests are made anew, record
ids are derived from the records and the date is a parameter: the same records give the same files,
byte for byte.

A task writes under temporary names. Its list of files is a table that Spark commits, so lists
of failed and repeated attempts are never seen. Only files on that list are then given
their names, which can be repeated at any point, and the manifest is written last. Readers
read what the manifest lists.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the largest page
id is the response and the others revisit it; rows repeated under that id are all responses. If none has an id,
all are responses. A null payload counts as an empty one. A null or empty address becomes
``urn:page:`` and the id. Columns other than id, address and payload are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapfolio.sources.scratch import new_folder, written

LEAST_REVISIT = 1000
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "name STRING, shard BIGINT, part INT, records BIGINT, bytes BIGINT, sha1 STRING, temporary STRING"
RECORDS = (
    "page_id BIGINT, url STRING, payload BINARY, payload_bytes BIGINT, payload_digest STRING, "
    "record_type STRING, refers_to BIGINT, record_id STRING, intact BOOLEAN"
)


def record_id(page_id: int | None, url: str, digest: str, nth: int = 0) -> str:
    name = json.dumps([page_id, url, digest, nth])
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own. The member carries no time."""
    lines = [*headers, ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def page_record(page_id, url, payload, digest, n_bytes, refers_to, refers_url, nth, date) -> bytes:
    """A response, or a revisit if ``refers_to`` is given."""
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, url, digest, nth)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", _base32(digest)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, refers_url, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    return _record(headers, http.encode() + (payload if refers_to is None else b""))


def info_record(name: str, date: str) -> bytes:
    block = b"software: snapfolio\r\nformat: WARC File Format 1.1\r\n"
    return _record(
        [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", record_id(None, name, "")),
            ("WARC-Date", date),
            ("WARC-Filename", name),
            ("Content-Type", "application/warc-fields"),
        ],
        block,
    )


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _address(page_id: int | None, url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{'' if page_id is None else page_id}"


def _digested(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})


def _decided(rows: DataFrame) -> DataFrame:
    """Adds ``refers_to`` and ``refers_url``; payloads of revisits are dropped before they are dealt."""
    same = (
        rows.filter(F.col("bytes") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(
            F.count("*").alias("n"),
            # Of several addresses under the newest id, always the same one.
            F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("last"),
        )
        .select("digest", "n", F.col("last.page_id").alias("newest"), F.col("last.url").alias("newest_url"))
        .filter("n > 1 and newest is not null")
        .drop("n")
    )
    # Written, its size is known: if it is small, Spark need not shuffle the payloads to join it.
    same = written(same, "same")
    joined = rows.join(same, "digest", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select(
        "page_id", "url", "digest", "bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, F.col("newest")).alias("refers_to"),
        F.when(revisit, F.col("newest_url")).alias("refers_url"),
    )


def _key(page_id: Column, tie: Column) -> Column:
    """Text that sorts as (page id, tie); no id comes first."""
    def sortable(x: Column) -> Column:
        return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")

    return F.concat(
        F.when(page_id.isNull(), F.lit("0")).otherwise(F.lit("1")),
        sortable(F.coalesce(page_id, F.lit(0).cast("long"))), sortable(tie),
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = DATE,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Writes the archives and gives the manifest. ``folder`` must be one that all executors reach
    and that is not in use."""
    spark = pages.sparkSession
    rows = _decided(_digested(pages, id_col, url_col, payload_col))
    keyed = rows.withColumn("tie", F.xxhash64("url", "digest"))
    keyed = keyed.withColumn("key", _key(F.col("page_id"), F.col("tie")))
    source = _digested(pages, id_col, url_col, payload_col)
    total = source.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    apart = max(1, round(shard_bytes * total["n"] / max(total["b"] or 0, 1)))
    narrow = source.select("page_id", F.xxhash64("url", "digest").alias("tie"))
    begins = narrow.filter(F.pmod(F.xxhash64("page_id", "tie"), F.lit(apart)) == 0)
    # One text of 33 characters per shard.
    cuts = [r["key"] for r in begins.select(_key(F.col("page_id"), F.col("tie")).alias("key")).distinct().collect()]
    shared = spark.sparkContext.broadcast(np.array(sorted(cuts), dtype="U33"))

    @F.pandas_udf("bigint")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy(dtype="U33"), side="right"))

    placed = keyed.withColumn("shard", shard_of("key"))
    # Every shard is a partition of its own, which a hash of few numbers would not give.
    sorted_ = placed.repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions(
        "shard", "key", "url", "digest"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        out, state = None, {}

        def close() -> pa.RecordBatch | None:
            if out is None:
                return None
            out.close()
            row = {k: [v] for k, v in state.items() if k != "hash"} | {"sha1": [state["hash"].hexdigest()]}
            return pa.RecordBatch.from_pydict(row, schema=MANIFEST_ARROW)

        def put(data: bytes) -> None:
            out.write(data)
            state["hash"].update(data)
            state["bytes"] += len(data)

        last, nth = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or r["shard"] != state["shard"] or state["bytes"] >= roll_bytes:
                    part = state["part"] + 1 if out is not None and r["shard"] == state["shard"] else 0
                    if (row := close()) is not None:
                        yield row
                    name = f"pages-{r['shard']:08d}-{part:05d}.warc.gz"
                    temporary = f"_temporary/{uuid.uuid4().hex}-{name}"
                    system.create_dir(f"{root}/_temporary", recursive=True)
                    out = system.open_output_stream(f"{root}/{temporary}", compression=None)
                    state = {"name": name, "shard": r["shard"], "part": part, "records": 0, "bytes": 0,
                             "temporary": temporary, "hash": hashlib.sha1()}
                    put(info_record(name, date))
                url = _address(r["page_id"], r["url"])
                refers_url = None if r["refers_to"] is None else _address(r["refers_to"], r["refers_url"])
                # Rows that are repeated whole have numbers.
                this = (r["page_id"], url, r["digest"])
                nth = nth + 1 if this == last else 0
                last = this
                put(page_record(r["page_id"], url, r["payload"], r["digest"], r["bytes"], r["refers_to"], refers_url, nth, date))
                state["records"] += 1
        if (row := close()) is not None:
            yield row

    columns = ["page_id", "url", "digest", "bytes", "payload", "refers_to", "refers_url", "shard"]
    listed = written(sorted_.select(columns).mapInArrow(write, MANIFEST), "manifest")

    def name_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = _file_system(folder)
        for batch in batches:
            for r in batch.to_pylist():
                source, target = f"{root}/{r['temporary']}", f"{root}/{r['name']}"
                # A repeated task finds the file where it should be.
                if system.get_file_info(source).type == fs.FileType.File:
                    system.move(source, target)
                if system.get_file_info(target).size != r["bytes"]:
                    raise OSError(f"{r['name']} is not as it was written")
            yield batch

    named = listed.mapInArrow(name_files, MANIFEST)
    named.drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


MANIFEST_ARROW = pa.schema(
    [("name", pa.string()), ("shard", pa.int64()), ("part", pa.int32()), ("records", pa.int64()),
     ("bytes", pa.int64()), ("sha1", pa.string()), ("temporary", pa.string())]
)


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked."""
    while content:
        one = zlib.decompressobj(31)
        yield one.decompress(content)
        if not one.eof:
            raise ValueError("a record is cut off")
        content = one.unused_data


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(record: bytes) -> dict | None:
    """A row of ``RECORDS``, or None for a record that is no page."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(head + b"\r\n")}
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = {k.lower(): v for k, v in _FIELD.findall(http + b"\r\n")}[b"content-length"]
    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    own = hashlib.sha1(payload).hexdigest()
    number = lambda name: int(fields[name]) if name in fields else None
    response = kind == "response"
    return {
        "page_id": number("x-page-id"),
        "url": fields["warc-target-uri"],
        "payload": payload if response else None,
        "payload_bytes": len(payload) if response else int(length),
        "payload_digest": own if response else stated,
        "record_type": kind,
        "refers_to": number("x-refers-to-page-id"),
        "record_id": fields["warc-record-id"],
        "intact": _base32(hashlib.sha1(block).hexdigest()) == fields["warc-block-digest"]
        and (not response or own == stated),
    }


RECORDS_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("record_id", pa.string()), ("intact", pa.bool_())]
)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of the files that the manifest lists, as ``RECORDS``."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    listed = named.join(manifest.select("name"), "name", "left_semi").select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in members(content.as_py()):
                    if (row := parse(record)) is not None:
                        rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS_ARROW)

    return listed.mapInArrow(unpack, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to a new folder of the shared scratch area and reads them back."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)

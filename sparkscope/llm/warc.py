"""Deterministic sharded WARC writer and its reader.

Shards are ranges of the record id of about equal bytes, whose bounds follow from the data alone. Each task sorts its shards, rolls files by
compressed size, writes them under temporary names and renames them; names and bytes depend on the input only, so a
repeated task renames the same file again. A manifest, written last, names the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.llm import common

#: Shards have a share of 1 / MOST_SHARDS of all bytes at least. Bits of ids by which they are weighed first, and further
#: bits of what is heavy: 4096 sums reach the driver at first, and 16 for each heavy bin, which are fewer than shards.
MOST_SHARDS, FIRST_BITS, MORE_BITS = 4096, 12, 4
MANIFEST = "name string, shard long, records long, bytes long, sha256 string"
#: Records carry one fixed date, so that the same input gives the same bytes.
DATE = "1970-01-01T00:00:00Z"
#: What a record takes besides its payload, about.
HEAD_BYTES = 500


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page}\n{url}\n{digest}'.encode()).digest()[:16], version=5)}>"


def info(name: str) -> bytes:
    """The warcinfo record at the head of a file."""
    body = b"software: sparkscope\r\nformat: WARC File Format 1.1\r\n"
    heads = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name, digest_of(body))}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"WARC-Block-Digest: sha1:{digest_of(body)}", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(heads).encode() + body + b"\r\n\r\n"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC 1.1 record. A revisit carries no payload; its digest and length are those of the full payload."""
    digest = digest_of(payload)
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    heads = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page, url, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url or '')}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(body)}",
        f"X-Page-Id: {'' if page is None else page}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        heads += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"WARC-Refers-To-Target-URI: {_header(refers_url or '')}", f"X-Refers-To-Page-Id: {refers_to}"]
    heads += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(heads).encode() + body + b"\r\n\r\n"


def _header(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def _member(data: bytes, level: int) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def shard_bounds(sizes: DataFrame, shard_bytes: int, least: int) -> list[int]:
    """The lowest page_id of every shard but the first, so that shards are ranges of ids with about equal bytes.

    ``sizes``: (page_id, bytes). Ids are weighed by their leading bits; what is heavier than a shard is weighed again by
    more bits, down to single ids. The bounds follow from the data alone, wherever the ids lie in the range of a long.
    """
    spark = sizes.sparkSession
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if low is None:
        return []
    goal = max(1, min(shard_bytes, -(-total // least)), -(-total // MOST_SHARDS))
    shift = max(0, ((low + 2**63) ^ (high + 2**63)).bit_length() - FIRST_BITS)
    known = sizes.filter("page_id IS NOT NULL")

    def weigh(rows: DataFrame) -> dict[int, int]:
        return {r["bin"] << shift: r["bytes"] for r in rows.groupBy(F.shiftright("page_id", shift).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()}

    weight = weigh(known)
    # No more bins than shards are over a shard's bytes, and each comes apart into 2 ** MORE_BITS.
    while shift and (heavy := [k for k, w in weight.items() if w > goal]):
        of = spark.createDataFrame([(k >> shift,) for k in heavy], "_bin long")
        rows = known.join(F.broadcast(of), F.shiftright("page_id", shift) == F.col("_bin"), "left_semi")
        weight = {k: w for k, w in weight.items() if w <= goal}
        shift = max(0, shift - MORE_BITS)
        weight |= weigh(rows)
    out, filled = [], 0
    for k in sorted(weight):
        if filled and filled + weight[k] / 2 > goal:
            out.append(k)
            filled = 0
        filled += weight[k]
    return out


def revisits(keyed: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, _key, refers_to, refers_url) of the pages that revisit another: of equal payloads of ``least`` bytes or
    more, all but that with the largest page_id.

    ``keyed``: (page_id, url, _key, bytes). Groups are found by SHA-1, pre-aggregated before they are shuffled; payloads do
    not move.
    """
    wanted = keyed.filter(F.col("bytes") >= least)
    groups = wanted.groupBy("_key").agg(F.max(F.struct("page_id", "url")).alias("r"), F.count("*").alias("_n")).filter("_n > 1")
    groups = common.materialise(groups.select("_key", F.col("r.page_id").alias("refers_to"), F.col("r.url").alias("refers_url")), "payloads")
    found = wanted.select("page_id", "_key").join(groups, "_key").filter("page_id <> refers_to")
    return common.materialise(found.select("page_id", "_key", "refers_to", "refers_url").distinct(), "revisits")


def payload_key():
    return F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))


def write(pages: DataFrame, target: str, file_bytes: int = 256_000_000, shard_bytes: int = 256_000_000, min_shards: int = 48, min_revisit_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write (page_id, url, html) as gzipped WARC files under ``target``; returns the manifest.

    Null html is an empty payload, a null url an empty one; a null page_id goes to the first shard. Rows that share
    page_id and payload are each a record; those with the largest page_id of their payload are all responses. An
    empty table gives an empty manifest. A file is closed once its compressed size reaches ``file_bytes``; a record
    is never split.
    """
    spark = pages.sparkSession
    common.ship(spark)
    keyed = pages.select("page_id", "url", payload_key().alias("_key"), (common.utf8_length(F.col("html")) + HEAD_BYTES).alias("bytes"))
    keyed = common.materialise(keyed, "payload-keys")
    bounds = np.array(shard_bounds(keyed, shard_bytes, min_shards), dtype=np.int64)
    n = len(bounds) + 1

    @F.pandas_udf("long")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    shard = number(F.coalesce(F.col("page_id"), F.lit(-(2**63)).cast("long"))).alias("shard")
    # Both sides are dealt out by shard, so the join moves each payload once only.
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), shard, payload_key().alias("_key")).repartition(n, "shard")
    known = revisits(keyed, min_revisit_bytes + HEAD_BYTES).select("page_id", "_key", "refers_to", "refers_url", shard).repartition(n, "shard")
    rows = rows.join(known, ["shard", "page_id", "_key"], "left").select("page_id", "url", "html", "refers_to", "refers_url", "shard")
    rows = rows.sortWithinPartitions("shard", "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(target)
        system.create_dir(f"{root}/_temporary", recursive=True)
        state: dict = {}

        def close() -> list:
            state["out"].close()
            system.move(state["temporary"], f"{root}/{state['name']}")
            return [state["name"], state["shard"], state["records"], state["bytes"], state["sha"].hexdigest()]

        def start(shard: int, part: int) -> None:
            name = f"shard-{shard:06d}-{part:05d}.warc.gz"
            temporary = f"{root}/_temporary/{uuid.uuid4().hex}-{name}"
            state.update(name=name, shard=shard, part=part, records=0, bytes=0, sha=hashlib.sha256(), temporary=temporary, out=system.open_output_stream(temporary, compression=None))
            put(_member(info(name), level))

        def put(data: bytes) -> None:
            state["out"].write(data)
            state["sha"].update(data)
            state["bytes"] += len(data)

        done = []
        for batch in batches:
            for page, url, html, refers, refers_url, shard in zip(*[c.to_pylist() for c in batch.columns]):
                if not state or state["shard"] != shard:
                    if state:
                        done.append(close())
                    start(shard, 0)
                elif state["bytes"] >= file_bytes:
                    done.append(close())
                    start(shard, state["part"] + 1)
                put(_member(record(page, url, html.encode(), refers, refers_url), level))
                state["records"] += 1
        if state:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["name", "shard", "records", "bytes", "sha256"]))

    manifest = rows.mapInArrow(common.lean(run), MANIFEST)
    with common.eager_cleanup(spark):
        manifest.write.parquet(f"{target}/_manifest")
    clean(spark, f"{target}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{target}/_manifest")


def clean(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a gzipped WARC file, read member by member."""
    with pa.PythonFile(stream, mode="r") if not hasattr(stream, "read") else stream as raw:
        pending, z, data = b"", zlib.decompressobj(31), bytearray()
        while True:
            chunk = pending or raw.read(1 << 20)
            if not chunk:
                break
            data += z.decompress(chunk)
            pending = z.unused_data
            if z.eof:
                head, _, body = bytes(data).partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                yield fields, body[: int(fields["Content-Length"])]
                z, data = zlib.decompressobj(31), bytearray()
        if data:
            raise ValueError("a WARC file ends within a record")


def read(spark: SparkSession, target: str) -> DataFrame:
    """The records of the files that the manifest names: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    A file whose size differs from the manifest, or a record whose block differs from its digest, is an error.
    """
    common.ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{target}/_manifest").select("name", "bytes")
    # One small row stands for a whole file, so the files are dealt out one by one.
    files = manifest.repartition(max(1, min(2000, manifest.count())), "name")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(target)

        def pack(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/{name}"
                if system.get_file_info(path).size != size:
                    raise ValueError(f"{os.path.basename(path)} has not the size that its manifest says")
                rows: list[list] = []
                held = 0
                for head, body in _records(system.open_input_stream(path, compression=None)):
                    if head["WARC-Block-Digest"] != f"sha1:{digest_of(body)}":
                        raise ValueError(f"a record of {name} differs from its digest")
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    page, refers = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
                    rows.append([int(page) if page else None, head["WARC-Target-URI"], head["WARC-Type"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(refers) if refers else None, body])
                    held += len(body)
                    if len(rows) >= 2000 or held > 16_000_000:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    return files.mapInArrow(common.lean(run), schema)

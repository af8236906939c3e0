"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Archives are rows of (name, content): what the binaryFile source gives for .warc.zst files, and what `write` makes, a
table in the shared folder, since executors share no local folder. `read` takes any such rows.

Of records with equal payloads of at least `least` bytes, the one with the smallest id is a response; the others are
revisits that refer to it and carry no payload. Null payloads are empty. Records are validated on reading: version
line, mandatory headers, Content-Length against the frame, block and payload digests; a record that fails has its
reason in `error`. An empty table gives no archives and no records. Each row is a record, repeated ids included; of equal
payloads all with the smallest id are responses. Pages without id are responses, referred to by none. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.bitmap import MAYBE, maybe_in
from veilstream.llm.store import Store

SKIPPABLE = 0x184D2A5D  # fixed by the format: magic number of the dictionary's frame
ZSTD = 0xFD2FB528
SEGMENT = 8 << 20
#: The dictionary is trained on at most so many payloads, each cut to so many bytes.
SAMPLE, SAMPLE_BYTES = 400, 16_384
URN = "urn:page:"


def train(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads, raw content if there is too little to train on."""
    order = F.xxhash64("page_id")
    first = pages.select(order.alias("o")).orderBy("o").limit(SAMPLE).agg(F.max("o")).first()[0]  # hashes only, so little per task
    if first is None:
        return b""
    rows = pages.where(order <= first).select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("h")).limit(SAMPLE).collect()
    texts = [r.h.encode()[:SAMPLE_BYTES] for r in rows if r.h]
    try:
        return zstandard.train_dictionary(32_768, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[:32_768]


def header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, digest, refers_to. Only pages whose payload may occur again are shuffled."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = p.where(F.octet_length("html") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"),
        F.count("*").alias("c"),
    ).where("c > 1").drop("c")
    marked = maybe_in(p, first, "digest")
    columns = ["page_id", "url", "html", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to")]
    again = marked.where(MAYBE).join(first, "digest", "left").select(*columns)
    return again.union(marked.where(~F.col(MAYBE)).withColumn("first", F.lit(None).cast(first.schema["first"].dataType)).select(*columns))


def write(pages: DataFrame, store: Store, least: int = 100) -> DataFrame:
    """The archives of pages (page_id, url, html): rows of name and content, each of about SEGMENT bytes or less."""
    dictionary = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        # without a trained dictionary's header the bytes serve as raw content
        packer = zstandard.ZstdCompressor(
            level=3,
            dict_data=zstandard.ZstdCompressionDict(dictionary),
            write_checksum=True,
            write_content_size=True,
        ) if dictionary else zstandard.ZstdCompressor(level=3, write_checksum=True)
        frames, size = [], 0

        def archive() -> pa.RecordBatch:
            content = (lead if dictionary else b"") + b"".join(frames)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{hashlib.sha256(content).hexdigest()[:16]}.warc.zst"]), pa.array([content], pa.binary())],
                ["name", "content"],
            )

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                kind = "response" if refers is None else "revisit"
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                block = head + payload if refers is None else head
                fields = [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", f"<{URN}{page_id}>"),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("WARC-Block-Digest", _b32(block)),
                    ("WARC-Payload-Digest", f"sha256:{digest}"),
                ]
                fields += [("WARC-Target-URI", "".join(url.split()))] if url else []
                fields += [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<{URN}{refers}>"),
                ] if refers is not None else []
                frames.append(packer.compress(header(fields, block)))
                size += len(frames[-1])
                if size >= SEGMENT:
                    yield archive()
                    frames, size = [], 0
        if frames:
            yield archive()

    return store.keep(plan(pages, least).mapInArrow(run, "name string, content binary"), "archives")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, error) of each frame of an archive."""
    at, unpack = 0, zstandard.ZstdDecompressor()
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", content, 4)[0]
        d = content[8 : 8 + n]
        if d[:4] == struct.pack("<I", ZSTD):  # the dictionary may itself be compressed
            d = zstandard.ZstdDecompressor().decompress(d)
        unpack, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)), 8 + n
    while at < len(content):
        magic = struct.unpack_from("<I", content, at)[0] if at + 4 <= len(content) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50 and at + 8 <= len(content):
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        one = unpack.decompressobj()
        try:
            raw = one.decompress(content[at : at + (1 << 16)])
            end = at + (1 << 16)
            while not one.eof:
                if end >= len(content):
                    raise zstandard.ZstdError("truncated frame")
                raw += one.decompress(content[end : end + (1 << 20)])
                end += 1 << 20
        except zstandard.ZstdError as e:
            yield {}, b"", f"frame: {e}"
            return
        at = min(end, len(content)) - len(one.unused_data)
        yield parse(raw)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, str | None]:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return fields, b"", "no WARC version line or no end of headers"
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        return fields, b"", f"missing {', '.join(missing)}"
    n = int(fields["content-length"]) if fields["content-length"].isascii() and fields["content-length"].isdigit() else -1
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        return fields, b"", "Content-Length does not fit the record"
    block = rest[:n]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"] != _b32(block):
        return fields, block, "block digest"
    return fields, block, None


def read(archives: DataFrame) -> DataFrame:
    """record_id, record_type, url, payload (null for revisits), payload_digest, refers_to, error of each record."""
    schema = "record_id string, record_type string, url string, payload binary, payload_digest string, refers_to string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block, error in records(content.as_py() or b""):
                    kind, said = f.get("warc-type"), f.get("warc-payload-digest", "")
                    payload = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").startswith("application/http") else block
                    digest = said.removeprefix("sha256:") if said.startswith("sha256:") else None
                    if kind == "revisit":
                        payload = None
                    elif digest and not error and hashlib.sha256(payload).hexdigest() != digest:
                        error = "payload digest"
                    rows.append(
                        (
                            f.get("warc-record-id", "").strip("<>") or None,
                            kind,
                            f.get("warc-target-uri"),
                            payload,
                            digest,
                            f.get("warc-refers-to", "").strip("<>") or None,
                            error,
                        )
                    )
                    size += len(payload or b"")
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return archives.select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, error."""
    store = Store(pages.sparkSession, "warc")
    r = store.keep(
        read(write(pages, store, least)).select(
            "record_id",
            "record_type",
            "payload_digest",
            "refers_to",
            "error",
            F.octet_length("payload").cast("long").alias("n"),
        ),
        "records",
    )
    # of a repeated id with several payloads, the one referred to has the revisit's digest
    of = r.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", F.col("n").alias("of_n")).join(
        r.select("refers_to", "payload_digest").distinct(),
        ["refers_to", "payload_digest"],
        "left_semi",
    ).dropDuplicates(["refers_to", "payload_digest"])
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    joined = r.join(of, ["refers_to", "payload_digest"], "left")
    return joined.select(
        number("record_id").alias("page_id"),
        F.coalesce("n", "of_n").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"),
        "error",
    )

"""WARC records of pages: sorted, deduplicated by payload, rolled by compressed size, committed by a manifest, and read back."""

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelog.llm.common import by_runs
from ridgelog.session import checkpointed, folder_system

#: compressed bytes after which a file ends
ROLL_BYTES = 128 << 20
#: a payload of more than this share of all rows is taken out before the shuffle; there are at most as many of them
HOT_SHARE = 1000
#: revisit records that one row of the plan stands for
_CHUNK = 1000
MANIFEST, PENDING, _STAGING = "_MANIFEST.json", "_MANIFEST.pending", "_staging"
_LABEL = "urn:uuid:"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record-of-a-page")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
# Fixed values of the format.
_VERSION, _END = b"WARC/1.1\r\n", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_TYPE = "application/http; msgtype=response"
_PARTS = "file string, place long, member binary"
_RECORD = "page_id long, url string, record_type string, record_id string, refers_to_record string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_label(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """The same page, payload and copy always get the same id."""
    return f"<{_LABEL}{uuid.uuid5(_SPACE, json.dumps([page_id, url, digest, copy]))}>"


def _record(kind: str, block: bytes, fields: list[tuple[str, str | int | None]]) -> bytes:
    """One record; fields without a value are left out."""
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha1_label(block)}"), ("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    return b"".join([_VERSION, head.encode(), b"\r\n", block, _END])


def _member(record: bytes, level: int) -> bytes:
    """A record as gzip members of which the last ends in a zero byte, which is left out.

    A member ends with the length of its content, whose last byte is zero below 16 MiB; behind a longer record stands an empty member.
    """
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    data = packer.compress(record) + packer.flush()
    if data[-1]:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        data += packer.compress(b"") + packer.flush()
    return data[:-1]


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _target(url: str | None, page_id: int | None) -> str:
    """The url with characters percent-encoded that would break a header; a page without one is named by its id."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'' if page_id is None else page_id}"


def _response(page_id, url, payload: bytes, copy: int, date: str) -> bytes:
    digest = sha1_label(payload)
    fields = [("WARC-Record-ID", record_id(page_id, url, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", _target(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", page_id), ("Content-Type", _HTTP_TYPE)]
    return _record("response", _http(len(payload)) + payload, fields)


def _revisit(page_id, url, digest: str, n: int, copy: int, first_page, first_url, date: str) -> bytes:
    fields = [
        ("WARC-Record-ID", record_id(page_id, url, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", _target(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first_page, first_url, digest, 0)), ("WARC-Refers-To-Target-URI", _target(first_url, first_page)),
        ("WARC-Refers-To-Date", date), ("Page-ID", page_id), ("Refers-To-Page-ID", first_page), ("Content-Type", _HTTP_TYPE),
    ]
    return _record("revisit", _http(n), fields)


def _plan(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """What is to be written, without payloads; the payloads of very many rows; and the number of all rows.

    Rows of the plan have ``kind`` 0 (``copies`` response records of the payload that follows) or 2 (``copies`` revisits).
    """
    same = ["page_id", "url", "digest", "n"]
    pages = checkpointed(rows.select(*same).groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), "warc-plan")
    total = pages.agg(F.sum("copies")).first()[0] or 0
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    firsts = pages.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min(order).alias("first"), F.sum("copies").alias("rows"))
    firsts = firsts.select("digest", "n", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"), "rows", F.lit(True).alias("shared"))
    joined = pages.join(firsts, ["digest", "n"], "left")
    own = F.col("shared").isNull() | (F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url")))
    responses = joined.where(own).withColumns({"slot": F.lit(0).cast("long"), "kind": F.lit(0), "copies": F.when(F.col("shared").isNull(), F.col("copies")).otherwise(F.lit(1).cast("long"))})
    left = F.col("copies") - own.cast("long")
    again = joined.where(F.col("shared").isNotNull() & (left > 0)).withColumn("left", left)
    again = again.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"), F.lit(_CHUNK).cast("long")))).withColumns({"kind": F.lit(2), "copies": F.least(F.lit(_CHUNK), F.col("left") - F.col("slot") + 1)})
    columns = [*same, "slot", "kind", "copies", "first_page", "first_url"]
    hot = firsts.where(F.col("rows") * HOT_SHARE > total).select("digest", "n", "first_page", "first_url")
    return responses.select(columns).union(again.select(columns)), hot, total


def _sorted_rows(pages: DataFrame, least: int, page_id: str, url: str, markup: str) -> tuple[DataFrame, int]:
    """Plan and payloads in one order, a payload right behind its plan row; and the number of pages.

    Rows are sorted by ranges of (page_id, url, payload digest), so both meet without a join of the payloads. Of a
    payload that very many rows share only one goes through the shuffle.
    """
    payload = F.coalesce(F.col(markup).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    plan, hot, total = _plan(rows, least)
    columns = ["page_id", "url", "digest", "n", "payload"]
    few = hot.collect()  # at most HOT_SHARE rows
    bodies = rows
    if few:
        hot = F.broadcast(pages.sparkSession.createDataFrame(few, hot.schema))
        cold = rows.join(hot, ["digest", "n"], "left_anti").select(columns)
        first = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
        one = rows.join(hot, ["digest", "n"]).where(first).groupBy("page_id", "url", "digest", "n").agg(F.first("payload").alias("payload"))
        bodies = cold.union(one.select(columns))
    bodies = bodies.select("page_id", "url", "digest", "n", F.lit(0).cast("long").alias("slot"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("long").alias("first_page"), F.lit(None).cast("string").alias("first_url"), "payload")
    both = plan.withColumn("payload", F.lit(None).cast("binary")).unionByName(bodies)
    order = [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), "digest", "slot"]
    return both.repartitionByRange(*order).sortWithinPartitions(*order, "kind"), total


def _members(rows: DataFrame, prefix: str, roll_bytes: int, level: int, date: str) -> DataFrame:
    """``(file, place, member)``: the compressed records, a file for each ``roll_bytes`` of them in a task."""

    def pack(batches):
        task, roll, place, size, due = TaskContext.get().partitionId(), 0, 0, 0, None
        out, held = [], 0

        def add(record: bytes):
            nonlocal roll, place, size, held
            if place and size >= roll_bytes:
                roll, place, size = roll + 1, 0, 0
            file = f"{task:05d}-{roll:05d}"
            if not place:
                name = f"{prefix}-{file}.warc.gz"
                about = _record("warcinfo", b"format: WARC file version 1.1\r\n", [("WARC-Record-ID", record_id(None, name, "", 0)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")])
                put(file, _member(about, level))
            put(file, _member(record, level))

        def put(file: str, member: bytes):
            nonlocal place, size, held
            out.append((file, place, member))
            place, size, held = place + 1, size + len(member) + 1, held + len(member)

        def batch_of_out():
            nonlocal out, held
            columns = list(zip(*out))
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["file", "place", "member"])

        for batch in batches:
            names = ("page_id", "url", "digest", "n", "slot", "kind", "copies", "first_page", "first_url")
            columns = [batch.column(x).to_pylist() for x in names]
            for page_id, url, digest, n, slot, kind, copies, first_page, first_url, payload in zip(*columns, by_runs(batch.column("payload"))):
                if kind == 0:
                    due = (page_id, url, digest, copies)
                elif kind == 1:
                    if due and due[:3] == (page_id, url, digest):
                        for copy in range(due[3]):
                            add(_response(page_id, url, payload, copy, date))
                        due = None
                else:
                    label = base64.b32encode(bytes.fromhex(digest)).decode()
                    for copy in range(slot, slot + copies):
                        add(_revisit(page_id, url, label, n, copy, first_page, first_url, date))
                        if held > 1 << 22:
                            yield batch_of_out()
                if held > 1 << 22:
                    yield batch_of_out()
        if out:
            yield batch_of_out()

    return rows.mapInArrow(pack, _PARTS)


def _text_of(system, path) -> str | None:
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _finish(spark: SparkSession, path: str) -> dict | None:
    """Carry out the moves of a pending manifest; files that an earlier try moved already are left alone."""
    system, root = folder_system(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    text = _text_of(system, at(root, PENDING))
    if text is None:
        return None
    manifest = json.loads(text)

    def move(entry):
        source, target = at(root, entry["staged"]), at(root, entry["name"])
        if not system.exists(target) and not system.rename(source, target):
            raise OSError(f"{entry['staged']} can't be moved")
        if system.getFileStatus(target).getLen() != entry["bytes"]:
            raise OSError(f"{entry['name']} is incomplete")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, manifest["files"]))
    if not system.rename(at(root, PENDING), at(root, MANIFEST)):
        raise OSError("the manifest can't be moved")
    system.delete(at(root, _STAGING), True)
    return manifest


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a commit that the driver did not live to end; whether there was one."""
    return _finish(spark, path) is not None


def write_archive(pages: DataFrame, path: str, least: int = 0, roll_bytes: int = ROLL_BYTES, level: int = 6, date: str = "2024-01-01T00:00:00Z", prefix: str = "pages", page_id: str = "page_id", url: str = "url", markup: str = "html") -> dict:
    """Write one WARC record for every row of ``pages`` below ``path`` and return the manifest.

    Records are sorted by (page_id, url, payload), nulls last. Of rows with equal payloads of at least ``least`` bytes the one with the
    smallest (page_id, url) becomes a response, the others revisits that refer to it; smaller payloads are all responses. A null
    payload is empty. Repeated rows get a record each; headers, record ids and digests are made anew from the rows, so equal
    input gives equal files.

    Files end at the record with which they reach ``roll_bytes`` compressed. Spark's text writer puts the records into a staging folder
    (every record ends with a zero byte, which serves as line separator), through whatever file system ``path`` names, and only its
    committer lets the output of one attempt a task through. Then a pending manifest is written, the files are renamed as it says,
    and it takes its final name; readers see only files of a final manifest. ``recover`` ends an interrupted commit.
    An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    system, root = folder_system(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    if system.exists(at(root, MANIFEST)) or system.exists(at(root, PENDING)):
        raise FileExistsError(f"{path} holds an archive already")
    rows, total = _sorted_rows(pages, least, page_id, url, markup)
    parts = _members(rows, prefix, roll_bytes, level, date).sortWithinPartitions("file", "place")
    staging = f"{path.rstrip('/')}/{_STAGING}"
    parts.select("file", F.col("member").cast("string").alias("value")).write.mode("overwrite").partitionBy("file").option("lineSep", "\0").text(staging)
    files = []
    for status in system.globStatus(at(at(root, _STAGING), "file=*/part-*")) or []:
        file = status.getPath()
        folder = file.getParent().getName()
        files.append({"staged": f"{_STAGING}/{folder}/{file.getName()}", "name": f"{prefix}-{folder.partition('=')[2]}.warc.gz", "bytes": status.getLen()})
    manifest = {"records": int(total), "files": sorted(files, key=lambda f: f["name"])}
    fresh = at(root, f"{PENDING}.new")
    stream = system.create(fresh, True)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()
    if not system.rename(fresh, at(root, PENDING)):
        raise OSError("the manifest can't be written")
    return _finish(spark, path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of the records of a file of gzip members, one record at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack = zlib.decompressobj(31)
        parts = []
        while not unpack.eof:
            piece = unpack.decompress(view[at : at + (1 << 20)])
            step = min(1 << 20, len(view) - at)
            at += step - len(unpack.unused_data)
            parts.append(piece)
            if not step and not unpack.eof:
                raise ValueError("a record is cut off")
        record = b"".join(parts)
        if not record:
            continue
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if lines[0] != "WARC/1.1" or len(rest) != n + len(_END):
            raise ValueError(f"a record of {len(rest)} bytes names {n}")
        yield fields, rest[:n]


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        n = len(payload)
        if sha1_label(payload) != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    else:
        n, payload = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", head)[1]), None
    number = lambda name: int(fields[name]) if name in fields else None
    return number("page-id"), fields["warc-target-uri"], kind, fields["warc-record-id"], fields.get("warc-refers-to"), number("refers-to-page-id"), n, digest, payload


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of an archive: ids, url, type, reference, size and digest of the payload, and the payload.

    Only files that the manifest names are read, each by one task; digests of responses are checked. ``refers_to`` is the page_id of the
    response that a revisit stands for. Without ``payloads`` that column is null.
    """
    system, root = folder_system(spark, path)
    text = _text_of(system, spark._jvm.org.apache.hadoop.fs.Path(root, MANIFEST))
    if text is None:
        raise FileNotFoundError(f"{path} holds no finished archive")
    manifest = json.loads(text)
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in _RECORD.split(", ")]

    def parse(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                out, held = [], 0
                for fields, block in records(batch.column(0)[k].as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    row = _parsed(fields, block)
                    out.append(row if payloads else (*row[:-1], None))
                    held += len(block) if payloads else 500
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    if not manifest["files"]:
        return spark.createDataFrame([], _RECORD)
    names_of = {f["name"]: f["bytes"] for f in manifest["files"]}
    listed = {s.getPath().getName(): s.getLen() for s in system.listStatus(root)}
    if missing := [n for n, size in names_of.items() if listed.get(n) != size]:
        raise FileNotFoundError(f"{missing[0]} is missing or incomplete")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    known = F.broadcast(spark.createDataFrame([(n,) for n in names_of], "name string"))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    extra = set(listed) - set(names_of) - {MANIFEST}
    if any(n.endswith(".warc.gz") for n in extra):
        files = files.join(known, "name", "left_semi")
    return files.select("content").mapInArrow(parse, _RECORD)

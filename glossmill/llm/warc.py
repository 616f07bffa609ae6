"""WARC archives: records with revisits, and a normaliser for archives that were gzipped as one stream.

Archives are written as whole-file gzip streams, as careless tools leave them.
The normaliser inflates each stream once and writes every record as a gzip
member of its own, with a sidecar index of offsets, so single records can be
read.  Memory holds a record at a time; a file takes its name when whole.
"""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefilter, store

#: Level of compression: archives are read more often than written.
LEVEL = 5
MANIFEST = "path string, records long, bytes long, error string"
#: Tasks that archives are dealt to, at most.
TASKS = 4096


def decide(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Adds digest (SHA-1, hex), record_type and refers_to.

    Of rows with equal payloads of least_bytes or more the one with the
    largest id is the response and the others revisit it; rows that share
    that id are all responses.  Null payloads are empty, null ids never the
    largest unless all are null, and then all are responses.  The added
    columns' names follow store.free.
    """
    digest, kind, refers, same, kept = store.free(pages, "digest", "record_type", "refers_to", "same", "kept")
    payload, own_id = F.coalesce(store.column(payload_column), F.lit("")), store.column(id_column)
    large = F.octet_length(payload) >= least_bytes
    rows = pages.withColumn(digest, F.sha1(F.encode(payload, "UTF-8")))
    copies = rows.where(large).groupBy(F.col(digest).alias(same)).agg(F.max(own_id).alias(kept), F.count(F.lit(1)).alias("n")).where("n > 1").select(same, kept)
    copies = store.stage(copies, "copies")
    likely, others = prefilter.split(rows.where(large), [F.col(digest)], copies.select(same))
    revisit = F.col(kept).isNotNull() & ~own_id.eqNullSafe(F.col(kept))
    joined = likely.join(copies, F.col(digest) == F.col(same), "left")
    decided = joined.withColumn(kind, F.when(revisit, "revisit").otherwise("response")).withColumn(refers, F.when(revisit, F.col(kept))).drop(same, kept)
    alone = [rest.withColumn(kind, F.lit("response")).withColumn(refers, F.lit(None).cast(dict(pages.dtypes)[id_column])) for rest in (rows.where(~large), others)]
    return decided.union(alone[0]).union(alone[1])


def record(page, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers, and so the payload's length, but no payload."""
    import base64

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def records(chunks):
    """The whole records, bytes as they stand, of an archive given in chunks of any size."""
    buffer, more = bytearray(), iter(chunks)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            chunk = next(more, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while True:
        while fill(1) and buffer[:1] in (b"\r", b"\n"):
            del buffer[:1]
        if not buffer:
            return
        at, looked = -1, 0
        while (at := buffer.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                raise ValueError("archive ends in a record's head")
        if not buffer.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        length = parse_fields(bytes(buffer[:at])).get("content-length", "")
        if not length.isdecimal():
            raise ValueError("record without Content-Length")
        end = at + 4 + int(length)
        if not fill(end):
            raise ValueError("archive ends in a record's block")
        yield bytes(buffer[:end]) + b"\r\n\r\n"
        del buffer[:end]


def inflated(source, size: int = 1 << 18):
    """The chunks of a gzip stream of one or many members, read once, with zeros after them or not; ValueError if it is broken or ends before its end."""
    import zlib

    engine, begun, whole = zlib.decompressobj(31), False, False
    while data := source.read(size):
        while data:
            if whole and not begun and not (data := data.lstrip(b"\0")):
                break  # zeros after the last member are padding
            try:
                part, begun = engine.decompress(data), True
            except zlib.error as why:
                raise ValueError(f"broken gzip stream: {why}") from None
            if part:
                yield part
            data = engine.unused_data
            if engine.eof:
                engine, begun, whole = zlib.decompressobj(31), False, True
    if begun:
        raise ValueError("gzip stream cut short")


def write_monolithic(decided: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", added: tuple = ("digest", "record_type", "refers_to"), file_bytes: int = 64 << 20) -> DataFrame:
    """Write each partition's records into archives gzipped as one stream, of about file_bytes unpacked; a stored manifest of them.

    added: what decide() has called its columns.  Null urls and payloads are
    empty, null ids give records without one.  Repeated rows are records of
    their own; an empty table makes no archive.
    """

    def write(batches):
        import zlib

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)

        name, more, k = store.task_name(), rows(), 0
        row = next(more, None)
        while row is not None:
            path, n, raw, packer = f"{folder}/{name}-{k:04d}.warc.gz", 0, 0, zlib.compressobj(LEVEL, wbits=31)
            with store.whole_file(path) as out:
                while row is not None and raw < file_bytes:
                    page, url, payload, digest, kind, refers_to = row
                    data = record(page, url, (payload or "").encode(), digest, kind, refers_to)
                    out.write(packer.compress(data))
                    n, raw, row = n + 1, raw + len(data), next(more, None)
                out.write(packer.flush())
            k += 1
            yield _manifest([path], [n], [raw], [None])

    rows = decided.select(*[store.column(c).alias(f"c{k}") for k, c in enumerate((id_column, url_column, payload_column, *added))])
    return store.stage(rows.mapInArrow(write, MANIFEST), "manifest")


def _manifest(*columns):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "records", "bytes", "error"])


def spread(manifest: DataFrame) -> DataFrame:
    """The paths of a manifest's whole archives, dealt round to at most TASKS tasks."""
    whole = manifest.where("error is null").select("path")
    return whole.repartition(max(1, min(TASKS, whole.count())))


def normalise(manifest: DataFrame, folder: str, remove: bool = False) -> DataFrame:
    """Rewrite each archive of the manifest with a member for each record, beside it `.idx` lines of offset, length, id and type.

    An archive that is broken or cut short gives no file, but a row of the
    manifest with the reason in `error`; it stays where it is.  remove deletes
    the others' sources, when all copies are whole; a task that runs again
    finds its copy and leaves it.
    """

    def rewrite(batches):
        import zlib

        for batch in batches:
            for source in batch.column(0).to_pylist():
                path = f"{folder}/{source.rpartition('/')[2]}"
                fs, there = store.file_system(path)
                origin = store.file_system(source)[1]
                try:
                    if fs.get_file_info(f"{there}.idx").type.name == "NotFound":
                        lines, at = [], 0
                        with fs.open_input_stream(origin, compression=None) as stream, store.whole_file(path) as out:
                            for data in records(inflated(stream)):
                                packer = zlib.compressobj(LEVEL, wbits=31)
                                member = packer.compress(data) + packer.flush()
                                fields = parse_fields(data[: data.index(b"\r\n\r\n")])
                                lines.append(json.dumps({"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}))
                                out.write(member)
                                at += len(member)
                        with store.whole_file(f"{path}.idx") as out:
                            out.write("".join(x + "\n" for x in lines).encode())
                    with fs.open_input_stream(f"{there}.idx", compression=None) as index:
                        n = index.read().count(b"\n")
                    yield _manifest([path], [n], [fs.get_file_info(there).size], [None])
                except ValueError as why:
                    yield _manifest([source], [None], [None], [str(why)])

    def delete(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                fs, there = store.file_system(source)
                if fs.get_file_info(there).type.name != "NotFound":
                    fs.delete_file(there)
            yield _manifest([], [], [], [])

    done = store.stage(spread(manifest).mapInArrow(rewrite, MANIFEST), "manifest")
    if remove:
        failed = done.where("error is not null").select("path")
        spread(manifest.join(failed, "path", "left_anti")).mapInArrow(delete, MANIFEST).count()
    return done


def read(manifest: DataFrame) -> DataFrame:
    """The records of normalised archives, each read alone by its index line: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Rows of the manifest with an error are passed over.  page_id is null for
    records whose name has no page.  A record of another type is its own
    payload; what a revisit doesn't say is null.
    """

    def parse(batches):
        import base64
        import hashlib
        import zlib

        import pyarrow as pa

        def number(name: str | None) -> int | None:
            bare = (name or "").removeprefix("<urn:page:").removesuffix(">")
            return int(bare) if bare.removeprefix("-").isdecimal() else None

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, there = store.file_system(path)
                with fs.open_input_stream(f"{there}.idx", compression=None) as index:
                    lines = [json.loads(x) for x in index.read().splitlines()]
                rows = []
                with fs.open_input_file(there) as archive:
                    for line in lines:
                        archive.seek(line["offset"])
                        data = zlib.decompress(archive.read(line["length"]), 31)
                        head, _, block = data.partition(b"\r\n\r\n")
                        fields = parse_fields(head)
                        block, kind = block[: int(fields["content-length"])], fields.get("warc-type")
                        http, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
                        if kind == "revisit":
                            size, told = parse_fields(http).get("content-length"), fields.get("warc-payload-digest", "")
                            size, digest = size and int(size), base64.b32decode(told[5:]).hex() if told.startswith("sha1:") else None
                        else:
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        rows.append((number(fields.get("warc-record-id")), size, digest, kind, number(fields.get("warc-refers-to"))))
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return spread(manifest).mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

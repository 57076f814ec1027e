"""One portable file: header, Parquet members, manifest.

``TMRK`` version offset length | members ... | manifest (JSON: catalog, and each member's
offset, length and SHA-256).  Members are plain byte ranges, so that a reader of ranges
needs the header, the manifest and what its tables hold.
"""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import SparkSession

from tidemark.database import Database
from tidemark.errors import CorruptionError, IoError, SignatureMismatchError, UnsupportedVersionError
from tidemark.sources.files import Files, scratch

MAGIC, VERSION, HEADER = b"TMRK", 1, struct.Struct("<4sIQQ")


def _plan(db: Database) -> tuple[dict, list[tuple[str, str, int]]]:
    """The catalog, and (member, path, length) of every file of all versions and deletions: history is kept."""
    if db.is_writable():
        for t in db.tables.values():
            db._flush_table(t)
    members, tables = [], []
    for n, t in enumerate(db.tables.values()):
        names: dict[str, list[str]] = {"segments": [], "deletions": []}
        for what, paths in (("segments", t.segments), ("deletions", t.deletions)):
            for i, path in enumerate(paths):
                folder = f"{n}/{what}/{i}"
                names[what].append(folder)
                members += [(f"{folder}/part-{j:05}.parquet", part, db.files.size(part)) for j, part in enumerate(db.files.parts(path))]
        tables.append(t.manifest() | names | {"indexed": {}})
    return {"version": 1, "clock": db.clock, "commits": 0, "tables": tables}, members


def _manifest(catalog: dict, members: list[tuple[str, str, int]], digests: list[str]) -> bytes:
    at, found = HEADER.size, {}
    for (name, _, length), digest in zip(members, digests, strict=True):
        found[name] = {"offset": at, "length": length, "sha256": digest}
        at += length
    return json.dumps({"catalog": catalog, "members": found}).encode()


def _head(catalog: dict, members: list[tuple[str, str, int]]) -> bytes:
    """Digests have one length, so that the manifest's place and length are known before any file is read."""
    length = len(_manifest(catalog, members, ["0" * 64] * len(members)))
    return HEADER.pack(MAGIC, VERSION, HEADER.size + sum(n for _, _, n in members), length)


def bake(db: Database, path: str) -> None:
    """Writes the artifact file by file, from stream to stream: its size is no matter of the driver's memory."""
    catalog, members = _plan(db)
    db.files.concatenate(path, _head(catalog, members), [(p, n) for _, p, n in members], lambda digests: _manifest(catalog, members, digests), db.durability == "sync")


def bake_to_bytes(db: Database) -> bytes:
    """The artifact as bytes of this process, for small ones."""
    catalog, members = _plan(db)
    body = [db.files.read(p) for _, p, _ in members]
    return b"".join([_head(catalog, members), *body, _manifest(catalog, members, [hashlib.sha256(x).hexdigest() for x in body])])


def header(data: bytes, size: int) -> tuple[int, int]:
    """Offset and length of the manifest."""
    if len(data) < HEADER.size or data[:4] != MAGIC:
        raise SignatureMismatchError("this is not an artifact")
    _, version, offset, length = HEADER.unpack(data[: HEADER.size])
    if not 1 <= version <= VERSION:
        raise UnsupportedVersionError(f"artifact version {version}")
    if offset < HEADER.size or offset + length != size:
        raise CorruptionError("the manifest lies outside the artifact")
    return offset, length


def catalog(manifest: bytes, end: int) -> tuple[dict, dict]:
    try:
        found = json.loads(manifest)
        members = found["members"]
        for name, m in members.items():
            if m["offset"] < HEADER.size or m["length"] < 0 or m["offset"] + m["length"] > end or ".." in name or name.startswith("/"):
                raise CorruptionError(f"member {name} lies outside the artifact")
        return found["catalog"], members
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise CorruptionError(f"the manifest can't be read: {e}") from e


def _extracted(db: Database, data: bytes, end: int, put) -> None:
    """Loads the catalog of a manifest after ``put(member, offset, length)`` has written each member and told its digest."""
    found, members = catalog(data, end)
    done = f"{db.root}/_complete"
    if not db.files.exists(done):  # a folder of this content that is complete is used again
        for name, m in members.items():
            if put(f"{db.root}/{name}", m["offset"], m["length"]) != m["sha256"]:
                raise CorruptionError(f"member {name} fails its checksum")
        db.files.write(done, b"1")
    db.load(json.dumps(found).encode())


def open_artifact(spark: SparkSession, path: str) -> Database:
    """Reads header and manifest, and has the members copied from stream to stream."""
    files = Files(spark)
    if not files.exists(path):
        raise IoError(f"no such file: {path}")
    size = files.size(path)
    offset, length = header(files.read(path, 0, min(size, HEADER.size)), size)
    manifest = files.read(path, offset, length)
    # The manifest holds the digests of all members: its own names the content.
    db = Database(spark, scratch(spark, "artifact", hashlib.sha256(manifest).hexdigest()[:32]), writable=False)
    _extracted(db, manifest, offset, lambda to, at, n: files.extract(path, at, n, to))
    return db


def import_bytes(spark: SparkSession, data: bytes) -> Database:
    """A writable in-memory database with the artifact's history."""
    offset, length = header(data, len(data))
    db = Database(spark, scratch(spark, "import"))

    def put(to: str, at: int, n: int) -> str:
        part = data[at : at + n]
        digest = hashlib.sha256(part).hexdigest()
        db.files.write(to, part)
        return digest

    _extracted(db, data[offset : offset + length], offset, put)
    return db

"""Facts about files of any size, by one pass over their blocks.

A file's hash, first and last bytes and the strings that its patterns find are kept
while its blocks go by; the last bytes of a block are searched again with the next
one, so that a match on a border is found.  Only of a small file the content stays.
What an archive holds is read from its directory, by place.  So a task needs a few
blocks of memory, whatever the sizes of its files are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import TriageOptions
from ..functions.archive import list_members
from ..functions.columns import MAGIC, TEXT_WINDOW
from ..operators import findings
from ..schemas import FACTS
from .files import BLOCK, Mounted, Store, files_of
from .tree import dealt

MEMBER = pa.struct([("name", pa.string()), ("stored_name", pa.string())])
ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("error", pa.string()), ("sha256", pa.string()), ("head", pa.binary()), ("tail", pa.binary()), ("hits", pa.list_(pa.string())), ("body", pa.binary()), ("members", pa.list_(MEMBER))])
#: Facts of so many files, or bytes of their small contents, make a batch.
FILES_A_BATCH, BYTES_A_BATCH = 256, 8 << 20


def kinds(name: str, head: bytes) -> tuple[set[str], bool]:
    """The kinds of a file that have patterns of their own, and whether its archive directory is asked for."""
    magic = next((label for label, prefix in MAGIC if head.startswith(bytes.fromhex(prefix))), "")
    named = re.fullmatch(r".+(\.[^.]+)", name, re.S)
    suffix = named[1].lower() if named else ""
    found = {"any"}
    if magic == "pdf" or suffix == ".pdf":
        found.add("pdf")
    if suffix in findings.IMAGES:
        found.add("image")
    return found, magic == "zip" or suffix in (".zip", *findings.OFFICE_OPEN, *findings.OFFICE_MACRO)


def facts_row(files: Mounted | Store, path: str, limit: int, patterns: dict[str, str], block: int = BLOCK) -> tuple:
    """One file's facts; over the limit it is not opened, and what fails is told in ``error``."""
    nothing = (None,) * 6
    try:
        length = files.stat(path).length
        if length > limit:
            return path, length, None, *nothing
        digest, head, carry, hits, body, search = hashlib.sha256(), None, b"", set(), [], None
        archived, last = False, b""
        for data in files.blocks(path, block):
            digest.update(data)
            if head is None or len(head) < TEXT_WINDOW:
                head = (head or b"") + data[: TEXT_WINDOW - len(head or b"")]
            if search is None:
                own, archived = kinds(path.rpartition("/")[2], head)
                chosen = [patterns[k] for k in ("pdf", "image", "any") if k in own and k in patterns]
                search = re.compile("|".join(chosen).encode("latin-1")) if chosen else False
            if search:
                carry += data
                hits.update(m[0].decode("latin-1") for m in search.finditer(carry))
                carry = carry[-findings.LONGEST_HIT + 1 :]
            last = (last + data)[-findings.IMAGE_TAIL :] if len(data) < findings.IMAGE_TAIL else data[-findings.IMAGE_TAIL :]
            if length <= findings.URL_LIMIT:
                body.append(data)
        members = []
        if search is None:
            _, archived = kinds(path.rpartition("/")[2], b"")
        if archived and last:
            with files.seekable(path) as f:
                members = [{"name": a, "stored_name": b} for a, b in list_members(f)]
        return path, length, None, digest.hexdigest(), head or b"", last, sorted(hits), b"".join(body) if length <= findings.URL_LIMIT else None, members
    except OSError as e:
        return path, 0, str(e), *nothing


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(dict(zip(ARROW.names, row, strict=True)))
        size += len(row[ARROW.names.index("body")] or b"")
        if len(held) >= FILES_A_BATCH or size >= BYTES_A_BATCH:
            yield pa.RecordBatch.from_pylist(held, ARROW)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, ARROW)


def read_facts(listing: DataFrame, path: str, options: TriageOptions = TriageOptions()) -> DataFrame:
    """Facts of the files of a listing (path, length) of ``path``."""
    files, _ = files_of(listing.sparkSession, path)
    limit, patterns = options.max_file_size, findings.search_patterns(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(facts_row(files, name, limit, patterns) for batch in batches for name in batch.column(0).to_pylist())

    return dealt(listing, limit).mapInArrow(run, FACTS)

"""ZIP member names: the one thing that needs Python on executors.

Only the central directory is read and nothing is unpacked.  The gate belongs
into the argument (``when(gate, content)``): a Python function runs on all rows,
whatever stands around it, but returns at once for null.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MEMBERS

MEMBER = pa.struct([("name", pa.string()), ("stored_name", pa.string())])


def list_members(content: bytes | io.IOBase | None) -> list[tuple[str, str]]:
    """(name, name as stored) in the directory's order; what is no ZIP file has none.  Of an open file only the directory is read."""
    if not content:
        return []
    try:
        with zipfile.ZipFile(content if isinstance(content, io.IOBase) else io.BytesIO(content)) as archive:
            found = [(i.filename, i.orig_filename) for i in archive.infolist()]
        del archive  # its entries take more memory than their names
    except Exception:  # hostile input: any failure means that there is no usable directory
        return []
    safe = lambda s: s if s.isascii() else s.encode("utf-8", "replace").decode()
    return [(safe(a), safe(b)) for a, b in found]


def _members(contents: pa.Array) -> pa.Array:
    """A list for each content; names go to Arrow content by content, so that the directory of one at a time is held as objects."""
    ends, parts = [0], []
    for c in contents:
        found = list_members(c.as_py())
        parts.append(pa.StructArray.from_arrays([pa.array([m[k] for m in found], pa.string()) for k in (0, 1)], fields=list(MEMBER)))
        ends.append(ends[-1] + len(found))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], MEMBER))


_members.__annotations__ = {"contents": pa.Array, "return": pa.Array}
_zip_members = F.arrow_udf(_members, MEMBERS)


def zip_members(content: Column) -> Column:
    """The members of a ZIP file, an empty list for other content and for null."""
    return _zip_members(content)

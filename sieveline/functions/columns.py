"""Column builders for names, contents and texts.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes, in the order in which they are tried.
MAGIC = (("pdf", "25504446"), ("zip", "504B0304"), ("zip", "504B0506"), ("zip", "504B0708"), ("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("pe", "4D5A"))
#: White space that ends a link (the 29 Unicode code points), for Java and RE2 alike.
SPACE_CLASS = r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
URL_PATTERN = f"https?://[^{SPACE_CLASS}]+"
ADDRESS_PATTERN = r"\A\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+\z"
TEXT_WINDOW = 4096


def binary(hexadecimal: str) -> Column:
    return F.unhex(F.lit(hexadecimal))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def head(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def tail(content: Column, n: int) -> Column:
    """The last n bytes, or all if there are fewer."""
    return F.substring(content, -n, n)


def magic_type(content: Column) -> Column:
    first = head(content, 16)
    out = F.lit("unknown")
    for label, prefix in reversed(MAGIC):
        out = F.when(F.startswith(first, binary(prefix)), label).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last suffix in lower case; a leading or trailing dot makes none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def last_two_suffixes(name: Column) -> tuple[Column, Column]:
    """The last but one and the last suffix in lower case, null if there are not two."""
    parts = F.split(F.regexp_replace(F.lower(name), r"^\.+", ""), r"\.")
    both = (F.size(parts) >= 3) & ~F.endswith(name, F.lit("."))
    part = lambda k: F.when(both, F.concat(F.lit("."), F.try_element_at(parts, F.lit(k))))
    return part(-2), part(-1)


def latin1(content: Column) -> Column:
    """Bytes as characters one to one, for patterns over bytes."""
    return F.decode(content, "ISO-8859-1")


def is_text(content: Column) -> Column:
    """The first 4096 bytes are not empty, have no NUL and are UTF-8 (a character that is cut there makes them not)."""
    first = head(content, TEXT_WINDOW)
    return (F.length(first) > 0) & ~F.contains(first, binary("00")) & F.is_valid_utf8(first.cast("string"))


def text_of(content: Column) -> Column:
    """The content as UTF-8 without its invalid bytes.

    Invalid bytes become U+FFFD and are dropped; a U+FFFD that the content itself
    has is written with two noncharacters meanwhile, as are those.
    """
    valid = lambda c: F.replace(F.make_valid_utf8(c.cast("string")), F.lit("\ufffd"), F.lit(""))
    bytes_of = lambda text: text.encode().decode("latin-1")
    kept = F.replace(latin1(content), F.lit(bytes_of("\ufdd0")), F.lit(bytes_of("\ufdd0\ufdd1")))
    kept = valid(F.encode(F.replace(kept, F.lit(bytes_of("\ufffd")), F.lit(bytes_of("\ufdd0\ufdd2"))), "ISO-8859-1"))
    kept = F.replace(F.replace(kept, F.lit("\ufdd0\ufdd2"), F.lit("\ufffd")), F.lit("\ufdd0\ufdd1"), F.lit("\ufdd0"))
    return F.when(F.contains(content, binary("EFBFBD")), kept).otherwise(valid(content))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "//([^/]*)", 1)


def suspicious_host(name: Column) -> Column:
    return F.startswith(name, F.lit("xn--")) | name.rlike(ADDRESS_PATTERN)


def path_order(path: Column) -> Column:
    """A sort key that orders paths by their components."""
    return F.split(path, "/")


def path_list(raw: Column) -> Column:
    """A list of paths from text in which semicolons part them."""
    return F.filter(F.transform(F.split(raw, ";"), lambda p: F.trim(p)), lambda p: p != "")

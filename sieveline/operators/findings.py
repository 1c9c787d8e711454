"""Detectors as pure column builders: each turns the columns of a file into an array of findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TriageOptions
from ..functions import columns as C
from ..schemas import ISSUES

# Suffixes and tokens.
EXECUTABLE = (".exe", ".bat", ".cmd", ".scr", ".pif", ".js", ".jse", ".vbs", ".vbe", ".ps1", ".dll")
MEMBER_EXECUTABLE = (".exe", ".dll", ".js", ".vbs", ".bat", ".cmd", ".scr", ".ps1", ".jar")
DISGUISING = (".pdf", ".doc", ".docx", ".txt", ".png", ".jpg")
MEMBER_DISGUISING = ("jpg", "png", "pdf", "doc", "docx", "pptx", "xlsx")
MEMBER_ARCHIVES = ("zip", "rar", "7z", "gz")
PDF_TOKENS = ("/JAVASCRIPT", "/JS", "/OPENACTION", "/LAUNCH", "/EMBEDDEDFILE", "/AA")
OFFICE_OPEN = (".docx", ".pptx", ".xlsx")
OFFICE_MACRO = (".docm", ".xlsm", ".pptm")
IMAGES = (".png", ".jpg", ".jpeg")
MACRO_STORE = "vbaProject.bin"
MARKERS = ("This program cannot be run in DOS mode", "powershell")
# Limits.
LONG_NAME, IMAGE_TAIL, URL_LIMIT, LARGE_EXIF = 180, 8192, 512_000, 5_000_000
# Descriptions, which are part of a finding's identity.
DOUBLE_EXTENSION = "Filename uses double extension pattern"
TRAILING_EXECUTABLE = "Suspicious trailing executable extension"
PE_HEADER = "File starts with MZ header indicative of a Windows executable"
ZIP_LONG_NAME = "Archive member has unusually long name"
ZIP_NUL_BYTE = "Archive member name contains NUL byte"
EXE_IN_ZIP = "Found executable file inside archive"
ZIP_DOUBLE_EXTENSION = "Archive member has double extension"
ZIP_VBA_PROJECT = "Archive contains potential Office macro store"
PDF_TOKEN = "PDF contains token "
PNG_TRAILING = "PNG file contains data after IEND chunk"
JPEG_TRAILING = "JPEG file contains data after end marker"
MACRO_EXTENSION = "Office document type supports embedded macros"
MACRO_CONTAINER = "Office document contains vbaProject.bin"
URL_SUSPICIOUS = "Suspicious URL host"
URL_FOUND = "URL found in document"
PDF_ACTIONS = "Document defines automatic actions (OpenAction/AA)."
PDF_JAVASCRIPT = "Embedded JavaScript detected."
PDF_FILES = "Contains embedded files/attachments."
PDF_LINKS = "External URLs present (strict mode)."
OFFICE_MACROS = "vbaProject.bin present (macros)."
OFFICE_SETTINGS = "Settings file may define auto behaviors."
MEMBER_SUSPICIOUS = "Archive contains suspicious file: "
MEMBER_DOUBLE = "Double extension pattern: "
MEMBER_NESTED = "Nested archive found (strict): "
PNG_APPENDED = "Data present after PNG IEND (appended payload)."
JPEG_APPENDED = "JPEG missing terminal marker; potential appended data."
LARGE_IMAGE = "Large image with EXIF present (strict mode)."
SKIPPED_LARGE = "File skipped due to size"
MARKER_STRINGS = "Content holds a marker string"


@dataclass(frozen=True)
class File:
    """The columns of a file that detectors read: facts about its content, of which ``body`` is there for small files only."""

    name: Column
    suffix: Column
    magic: Column
    length: Column
    head: Column
    tail: Column
    hits: Column
    body: Column
    members: Column

    # Gates.
    def lists_zip(self) -> Column:
        return (self.magic == "zip") | self.suffix.isin(".zip", *OFFICE_OPEN)

    def is_pdf(self) -> Column:
        return (self.magic == "pdf") | (self.suffix == ".pdf")

    def is_image(self) -> Column:
        return self.suffix.isin(*IMAGES)

    def is_office(self) -> Column:
        return self.suffix.isin(*OFFICE_OPEN, *OFFICE_MACRO)

    def is_zip(self) -> Column:
        return (self.magic == "zip") | (self.suffix == ".zip")

    def needs_members(self) -> Column:
        return self.lists_zip() | self.is_office()


def none() -> Column:
    return F.array().cast(ISSUES)


def issue(code: str | Column, description: str | Column, evidence: Column | None = None, severity: str | None = None) -> Column:
    text = lambda x: (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")
    return F.struct(text(code).alias("code"), text(description).alias("description"), text(evidence).alias("evidence"), text(severity).alias("severity"))


def one_if(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(none())


def gated(gate: Column, found: Column) -> Column:
    return F.when(gate, found).otherwise(none())


def joined(*arrays: Column) -> Column:
    return F.concat(*arrays)


# What contents are searched for, once each: one pattern for each kind of file, in the syntax that Java and Python share.
# No match can hide another one: slashes stand in front only, and a link's second slash is looked at but not taken.
PDF_HITS = (*PDF_TOKENS, "/FILESPEC")
LINK_HITS = "https?:/(?=/)"
IMAGE_HITS = ("IEND", "Exif")
#: Bytes that a match may span, what is looked at behind it included.
LONGEST_HIT = max(map(len, (*PDF_HITS, *MARKERS, "https://")))


def search_patterns(o: TriageOptions) -> dict[str, str]:
    """The pattern for each kind of file; ``any`` is for all files."""
    out = {"pdf": f"(?i:{'|'.join(PDF_HITS)}{f'|{LINK_HITS}' if o.pdf_rules == 'strict' else ''})", "image": "|".join(IMAGE_HITS)}
    return out | ({"any": "|".join(MARKERS)} if o.use_markers else {})


def searched(content: Column, is_pdf: Column, is_image: Column, o: TriageOptions) -> Column:
    """Each different string that a file's patterns find in it, in one search."""
    patterns = search_patterns(o)

    def find(*kinds: str) -> Column:
        own = [patterns[k] for k in (*kinds, "any") if k in patterns]
        return F.array_distinct(F.regexp_extract_all(C.latin1(content), F.lit(f"({'|'.join(own)})"), F.lit(1))) if own else F.array().cast("array<string>")

    return F.when(is_pdf & is_image, find("pdf", "image")).when(is_pdf, find("pdf")).when(is_image, find("image")).otherwise(find())


def hit(f: File, *words: str) -> Column:
    return F.coalesce(F.arrays_overlap(f.hits, F.array(*map(F.lit, words))), F.lit(False))


def double_extension_kind(name: Column) -> Column:
    """The description of a double extension in a name, or null."""
    before, last = C.last_two_suffixes(name)
    return F.when(before.isin(*DISGUISING) & last.isin(*EXECUTABLE), DOUBLE_EXTENSION).when(last.isin(".exe", ".bat") & ~before.isin(*EXECUTABLE), TRAILING_EXECUTABLE)


def double_extension(f: File, _: TriageOptions) -> Column:
    kind = double_extension_kind(f.name)
    return one_if(kind.isNotNull(), issue("double_extension", kind, f.name))


def pe_header(f: File, _: TriageOptions) -> Column:
    return one_if(F.startswith(f.head, C.binary("4D5A")), issue("pe_header", PE_HEADER))


def member_base(name: Column) -> Column:
    return C.file_name(F.regexp_replace(name, r"(/\.?)+\z", ""))


def ends_with_any(name: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | F.endswith(name, F.lit(e))
    return out


def legacy_member_issues(m: Column) -> Column:
    name = m["name"]
    return joined(
        one_if(F.length(name) > LONG_NAME, issue("zip_long_name", ZIP_LONG_NAME, name)),
        one_if(F.contains(m["stored_name"], F.lit("\0")), issue("zip_nul_byte", ZIP_NUL_BYTE, name)),
        one_if(ends_with_any(F.lower(name), EXECUTABLE), issue("exe_in_zip", EXE_IN_ZIP, name)),
        one_if(double_extension_kind(member_base(name)).isNotNull(), issue("zip_double_extension", ZIP_DOUBLE_EXTENSION, name)),
        one_if(F.endswith(name, F.lit(MACRO_STORE)), issue("zip_vba_project", ZIP_VBA_PROJECT, name)),
    )


def zip_contents(f: File, _: TriageOptions) -> Column:
    return gated(f.lists_zip(), F.flatten(F.transform(f.members, legacy_member_issues)))


def pdf_tokens(f: File, _: TriageOptions) -> Column:
    held = F.array_intersect(F.array(*map(F.lit, PDF_TOKENS)), F.coalesce(F.transform(f.hits, F.upper), F.array().cast("array<string>")))
    return gated(f.is_pdf(), F.transform(held, lambda t: issue("pdf_token", F.concat(F.lit(PDF_TOKEN), t), t)))


def image_trailing(f: File, _: TriageOptions) -> Column:
    last = C.latin1(f.tail)
    after = lambda marker: F.contains(last, F.lit(marker)) & F.substring_index(last, marker, -1).rlike("[^\\x00]")
    png = one_if((f.suffix == ".png") & after("IEND"), issue("image_trailing_data", PNG_TRAILING))
    jpeg = one_if(f.suffix.isin(".jpg", ".jpeg") & after("\xff\xd9"), issue("image_trailing_data", JPEG_TRAILING))
    return joined(png, jpeg)


def has_macro_store(members: Column) -> Column:
    return F.exists(members, lambda m: F.endswith(m["name"], F.lit(MACRO_STORE)))


def office_macro(f: File, _: TriageOptions) -> Column:
    return joined(
        one_if(f.suffix.isin(*OFFICE_MACRO), issue("office_macro_extension", MACRO_EXTENSION)),
        one_if(f.suffix.isin(*OFFICE_OPEN) & has_macro_store(f.members), issue("office_macro_container", MACRO_CONTAINER)),
    )


def links(f: File, _: TriageOptions) -> Column:
    def found(url: Column) -> Column:
        bad = C.suspicious_host(C.host(url))
        return issue(F.when(bad, "url_suspicious").otherwise("url"), F.when(bad, URL_SUSPICIOUS).otherwise(URL_FOUND), url)

    return gated((f.length <= URL_LIMIT) & C.is_text(f.head), F.transform(C.urls(C.text_of(f.body)), found))


def pdf_rules(f: File, o: TriageOptions) -> Column:
    found = [
        one_if(hit(f, "/OpenAction", "/AA"), issue("pdf_auto_actions", PDF_ACTIONS, severity="high")),
        one_if(hit(f, "/JavaScript", "/JS"), issue("pdf_javascript", PDF_JAVASCRIPT, severity="high")),
        one_if(hit(f, "/EmbeddedFile", "/Filespec"), issue("pdf_embedded_files", PDF_FILES, severity="medium")),
    ]
    if o.pdf_rules == "strict":
        found.append(one_if(hit(f, "http:/", "https:/"), issue("pdf_external_links", PDF_LINKS, severity="low")))
    return gated(f.is_pdf(), joined(*found))


def office_rules(f: File, _: TriageOptions) -> Column:
    return gated(f.is_office(), joined(
        one_if(has_macro_store(f.members), issue("office_vba_project", OFFICE_MACROS, severity="high")),
        one_if(F.exists(f.members, lambda m: F.contains(m["name"], F.lit("settings.xml"))), issue("office_auto_actions_hint", OFFICE_SETTINGS, severity="medium")),
    ))


def rule_member_issues(m: Column, strict: bool) -> Column:
    name = F.lower(m["name"])
    base = C.file_name(name)
    extension = F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"(?s)(\.[^.]*)\z", 1)
    parts = F.split(base, r"\.")
    part = lambda k: F.try_element_at(parts, F.lit(k))
    double = (F.size(parts) >= 3) & ~part(-1).isin(*MEMBER_ARCHIVES) & part(-2).isin(*MEMBER_DISGUISING)
    found = [
        one_if(extension.isin(*MEMBER_EXECUTABLE), issue("zip_susp_executable", F.concat(F.lit(MEMBER_SUSPICIOUS), name), severity="high")),
        one_if(double, issue("zip_double_extension", F.concat(F.lit(MEMBER_DOUBLE), name), severity="high")),
    ]
    if strict:
        found.append(one_if(F.endswith(name, F.lit(".zip")), issue("zip_nested_archive", F.concat(F.lit(MEMBER_NESTED), name), severity="medium")))
    return joined(*found)


def zip_rules(f: File, o: TriageOptions) -> Column:
    return gated(f.is_zip(), F.flatten(F.transform(f.members, lambda m: rule_member_issues(m, o.zip_rules == "strict"))))


def image_rules(f: File, o: TriageOptions) -> Column:
    last = C.latin1(f.tail)  # where the last chunk marker is not in the last bytes, there is more than 8 behind it
    behind = ~F.contains(last, F.lit("IEND")) | (F.length(F.substring_index(last, "IEND", -1)) > 8)
    png = F.startswith(f.head, C.binary("89504E470D0A1A0A")) & hit(f, "IEND") & behind
    jpeg = F.startswith(f.head, C.binary("FFD8FF")) & ~F.endswith(f.tail, C.binary("FFD9"))
    found = [one_if(png, issue("png_appended_data", PNG_APPENDED, severity="medium")), one_if(jpeg, issue("jpeg_appended_data", JPEG_APPENDED, severity="medium"))]
    if o.image_rules == "strict":
        found.append(one_if(hit(f, "Exif") & (f.length > LARGE_EXIF), issue("image_large_exif", LARGE_IMAGE, severity="low")))
    return gated(f.is_image(), joined(*found))


def marker_strings(f: File, _: TriageOptions) -> Column:
    found = F.array_intersect(F.array(*map(F.lit, MARKERS)), F.coalesce(f.hits, F.array().cast("array<string>")))
    return one_if(F.size(found) > 0, issue("marker_strings", MARKER_STRINGS, F.array_join(found, ",")))


Detector = Callable[[File, TriageOptions], Column]

#: In the order in which findings are listed; a rule set is left out of the plan when it is off.
REGISTRY: tuple[tuple[str, Detector, Callable[[TriageOptions], bool]], ...] = (
    ("double_extension", double_extension, lambda o: True),
    ("pe_header", pe_header, lambda o: True),
    ("zip_contents", zip_contents, lambda o: True),
    ("pdf_tokens", pdf_tokens, lambda o: True),
    ("image_trailing", image_trailing, lambda o: True),
    ("office_macro", office_macro, lambda o: True),
    ("links", links, lambda o: True),
    ("pdf_rules", pdf_rules, lambda o: o.pdf_rules != "off"),
    ("office_rules", office_rules, lambda o: o.office_rules != "off"),
    ("zip_rules", zip_rules, lambda o: o.zip_rules != "off"),
    ("image_rules", image_rules, lambda o: o.image_rules != "off"),
    ("marker_strings", marker_strings, lambda o: o.use_markers),
)


def all_findings(f: File, options: TriageOptions) -> Column:
    """Findings of all detectors that are on, each finding once, the first one staying in place."""
    return F.array_distinct(joined(*(detect(f, options) for _, detect, on in REGISTRY if on(options))))

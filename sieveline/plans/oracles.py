"""The queries of ``plans.queries`` as DuckDB SQL over the same tables.

The values here are stated on their own and not taken from the engine, so that a
wrong suffix, token, description, weight or limit there shows.
"""

from __future__ import annotations


class D:
    """Suffixes, tokens, limits and descriptions of findings."""

    EXECUTABLE = (".exe", ".bat", ".cmd", ".scr", ".pif", ".js", ".jse", ".vbs", ".vbe", ".ps1", ".dll")
    MEMBER_EXECUTABLE = (".exe", ".dll", ".js", ".vbs", ".bat", ".cmd", ".scr", ".ps1", ".jar")
    DISGUISING = (".pdf", ".doc", ".docx", ".txt", ".png", ".jpg")
    MEMBER_DISGUISING = ("jpg", "png", "pdf", "doc", "docx", "pptx", "xlsx")
    MEMBER_ARCHIVES = ("zip", "rar", "7z", "gz")
    PDF_TOKENS = ("/JAVASCRIPT", "/JS", "/OPENACTION", "/LAUNCH", "/EMBEDDEDFILE", "/AA")
    OFFICE_MACRO = (".docm", ".xlsm", ".pptm")
    MACRO_STORE = "vbaProject.bin"
    MARKERS = ("This program cannot be run in DOS mode", "powershell")
    LONG_NAME, URL_LIMIT = 180, 512_000
    DOUBLE_EXTENSION = "Filename uses double extension pattern"
    TRAILING_EXECUTABLE = "Suspicious trailing executable extension"
    PE_HEADER = "File starts with MZ header indicative of a Windows executable"
    ZIP_LONG_NAME = "Archive member has unusually long name"
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


class S:
    """Weights, the weight of any other code, the cap, and the lowest score of each band."""

    WEIGHTS = {
        "exe_in_zip": 40, "zip_vba_project": 35, "zip_double_extension": 25, "zip_long_name": 10, "zip_nul_byte": 25, "pdf_token": 20, "double_extension": 15, "pe_header": 50, "office_macro_extension": 30,
        "office_macro_container": 45, "image_trailing_data": 15, "url_suspicious": 10, "url": 5, "pdf_auto_actions": 40, "pdf_javascript": 35, "pdf_embedded_files": 20, "pdf_external_links": 10,
        "office_vba_project": 45, "office_auto_actions_hint": 15, "zip_susp_executable": 40, "zip_nested_archive": 20, "png_appended_data": 15, "jpeg_appended_data": 15, "image_large_exif": 10,
    }
    DEFAULT_WEIGHT, CAP = 5, 100
    BANDS = ((80, "High"), (50, "Suspicious"), (20, "Caution"), (0, "Safe"))


#: The white space that ends a link.
URL = r"https?://[^\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ADDRESS = r"\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+"


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


FILES = r"""
vf AS (
  SELECT path, regexp_extract(path, '[^/]*$') AS name, body, strlen(body)::BIGINT AS size, sha256(body) AS sha256,
    CASE WHEN starts_with(body, '%PDF') THEN 'pdf' WHEN starts_with(body, 'MZ') THEN 'pe' ELSE 'unknown' END AS magic_type,
    regexp_extract(lower(regexp_extract(path, '[^/]*$')), '(?s)^.+(\.[^.]+)$', 1) AS suffix,
    strlen(body) > 0 AND NOT (hex(encode(body)[4097:4097]) BETWEEN '80' AND 'BF') AS is_text
  FROM (
    SELECT source || '/doc_' || doc_id || CASE WHEN k <= 2 THEN '.txt' WHEN k <= 4 THEN '.pdf' WHEN k = 5 THEN '.pdf.exe' WHEN k = 6 THEN '.v2.exe' ELSE '.docm' END AS path,
      CASE k WHEN 1 THEN text || ' powershell'
        WHEN 2 THEN regexp_replace(text, '([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})', 'http://\1/x', 'g')
        WHEN 3 THEN '%PDF-1.4 /OpenAction /JavaScript ' || text WHEN 4 THEN '%PDF-1.4 /js /EmbeddedFile http://a.example/ ' || text WHEN 5 THEN 'MZ' || text ELSE text END AS body
    FROM (SELECT *, doc_id % 8 AS k FROM documents)))
"""
CONVERSATIONS = """
vc AS (SELECT 'conv/' || conv_id || '/' || turn || '.txt' AS path, text AS body, sha256(text) AS sha256, strlen(text)::BIGINT AS size,
  strlen(text) > 0 AND NOT (hex(encode(text)[4097:4097]) BETWEEN '80' AND 'BF') AS is_text FROM conversations)
"""
PARTS = "string_split(ltrim(lower({0}), '.'), '.')"


def _double(name: str) -> str:
    p = PARTS.format(name)
    last, before = f"'.' || {p}[-1]", f"'.' || {p}[-2]"
    return (
        f"CASE WHEN len({p}) < 3 OR ends_with({name}, '.') THEN NULL WHEN {before} IN {_list(D.DISGUISING)} AND {last} IN {_list(D.EXECUTABLE)} THEN '{D.DOUBLE_EXTENSION}' "
        f"WHEN {last} IN ('.exe', '.bat') AND {before} NOT IN {_list(D.EXECUTABLE)} THEN '{D.TRAILING_EXECUTABLE}' END"
    )


def _links(source: str) -> str:
    host = "regexp_extract(u, '//([^/]*)', 1)"
    bad = f"(starts_with({host}, 'xn--') OR regexp_full_match({host}, '{ADDRESS}'))"
    return f"""SELECT path, CASE WHEN {bad} THEN 'url_suspicious' ELSE 'url' END AS code, CASE WHEN {bad} THEN '{D.URL_SUSPICIOUS}' ELSE '{D.URL_FOUND}' END AS description, u AS evidence, '' AS severity, 7000000 + k AS place
      FROM (SELECT path, unnest(us) AS u, generate_subscripts(us, 1) AS k FROM (SELECT path, regexp_extract_all(body, '{URL}') AS us FROM {source} WHERE is_text AND size <= {D.URL_LIMIT}))"""


def _any_case(token: str) -> str:
    return "".join(f"[{c}{c.lower()}]" if c.isalpha() else c for c in token)


def _pdf_rules(strict: bool) -> str:
    rules = [("pdf_auto_actions", D.PDF_ACTIONS, "high", ("/OpenAction", "/AA")), ("pdf_javascript", D.PDF_JAVASCRIPT, "high", ("/JavaScript", "/JS")), ("pdf_embedded_files", D.PDF_FILES, "medium", ("/EmbeddedFile", "/Filespec"))]
    rules += [("pdf_external_links", D.PDF_LINKS, "low", ("http://", "https://"))] * strict
    return " UNION ALL ".join(
        f"SELECT path, '{code}' AS code, '{text}' AS description, '' AS evidence, '{severity}' AS severity, {8000000 + k} AS place FROM vf WHERE (magic_type = 'pdf' OR suffix = '.pdf') AND ({' OR '.join(f"contains(body, '{w}')" for w in words)})"
        for k, (code, text, severity, words) in enumerate(rules)
    )


DOUBLE = f"SELECT path, 'double_extension' AS code, d AS description, name AS evidence, '' AS severity, 1000000 AS place FROM (SELECT *, {_double('name')} AS d FROM vf) WHERE d IS NOT NULL"
PE = f"SELECT path, 'pe_header' AS code, '{D.PE_HEADER}' AS description, '' AS evidence, '' AS severity, 2000000 AS place FROM vf WHERE starts_with(body, 'MZ')"
TOKENS = " UNION ALL ".join(
    f"SELECT path, 'pdf_token' AS code, '{D.PDF_TOKEN}{t}' AS description, '{t}' AS evidence, '' AS severity, {4000000 + k} AS place FROM vf WHERE (magic_type = 'pdf' OR suffix = '.pdf') AND regexp_matches(body, '{_any_case(t)}')" for k, t in enumerate(D.PDF_TOKENS)
)
MACRO = f"SELECT path, 'office_macro_extension' AS code, '{D.MACRO_EXTENSION}' AS description, '' AS evidence, '' AS severity, 6000000 AS place FROM vf WHERE suffix IN {_list(D.OFFICE_MACRO)}"
WEIGHTS = "weights(code, weight) AS (VALUES " + ", ".join(f"('{c}', {w})" for c, w in S.WEIGHTS.items()) + ")"
ISSUES = f"""{FILES}, {WEIGHTS}, found AS ({DOUBLE} UNION ALL {PE} UNION ALL {TOKENS} UNION ALL {MACRO} UNION ALL {_links('vf')} UNION ALL {_pdf_rules(False)}),
issues AS (SELECT path, code, description, evidence, severity, min(place) AS place FROM found GROUP BY ALL),
scored AS (SELECT vf.path, vf.sha256, vf.size, vf.magic_type, count(code)::BIGINT AS n_issues, least(coalesce(sum(CASE WHEN issues.code IS NULL THEN 0 ELSE coalesce(weight, {S.DEFAULT_WEIGHT}) END), 0), {S.CAP})::BIGINT AS score,
    string_agg(issues.code, ', ' ORDER BY place) AS codes, string_agg(issues.code || ': +' || coalesce(weight, {S.DEFAULT_WEIGHT}), ';' ORDER BY place) AS reasons
  FROM vf LEFT JOIN issues ON vf.path = issues.path LEFT JOIN weights USING (code) GROUP BY ALL),
results AS (SELECT *, CASE {' '.join(f"WHEN score >= {low} THEN '{label}'" for low, label in S.BANDS)} END AS severity FROM scored)
"""

MEMBERS = """
vm AS (SELECT 'archives/' || replace(p_brand, '#', '_') || '{ending}' AS path, base || CASE p_partkey % 9 WHEN 0 THEN '.pdf.exe' WHEN 1 THEN '.jar' WHEN 2 THEN '.VBS' WHEN 3 THEN '.pdf.txt' WHEN 4 THEN '/vbaProject.bin'
    WHEN 5 THEN '/settings.xml' WHEN 6 THEN '.ZIP' WHEN 7 THEN repeat('x', 190) || '.txt' ELSE '.txt' END AS name, p_partkey
  FROM (SELECT *, replace(p_name, ' ', '_') AS base FROM part))
"""
MEMBER_BASE = "regexp_extract(name, '[^/]*$')"


def _member_rules(strict: bool) -> str:
    base = "regexp_extract(lower(name), '[^/]*$')"
    parts = f"string_split({base}, '.')"
    double = f"len({parts}) >= 3 AND {parts}[-1] NOT IN {_list(D.MEMBER_ARCHIVES)} AND {parts}[-2] IN {_list(D.MEMBER_DISGUISING)}"
    rules = [
        f"SELECT path, 'zip_susp_executable' AS code, '{D.MEMBER_SUSPICIOUS}' || lower(name) AS description, 'high' AS severity FROM vm WHERE regexp_extract(ltrim({base}, '.'), '(\\.[^.]*)$', 1) IN {_list(D.MEMBER_EXECUTABLE)}",
        f"SELECT path, 'zip_double_extension', '{D.MEMBER_DOUBLE}' || lower(name), 'high' FROM vm WHERE {double}",
    ]
    if strict:
        rules.append(f"SELECT path, 'zip_nested_archive', '{D.MEMBER_NESTED}' || lower(name), 'medium' FROM vm WHERE ends_with(lower(name), '.zip')")
    return f"SELECT DISTINCT * FROM ({' UNION ALL '.join(rules)})"


def _members(select: str, ending: str = ".zip") -> str:
    return f"WITH {MEMBERS.format(ending=ending)} {select}"


LEGACY_MEMBERS = f"""SELECT DISTINCT * FROM (
  SELECT path, 'zip_long_name' AS code, '{D.ZIP_LONG_NAME}' AS description, name AS evidence FROM vm WHERE length(name) > {D.LONG_NAME}
  UNION ALL SELECT path, 'exe_in_zip', '{D.EXE_IN_ZIP}', name FROM vm WHERE {' OR '.join(f"ends_with(lower(name), '{e}')" for e in D.EXECUTABLE)}
  UNION ALL SELECT path, 'zip_double_extension', '{D.ZIP_DOUBLE_EXTENSION}', name FROM vm WHERE {_double(MEMBER_BASE)} IS NOT NULL
  UNION ALL SELECT path, 'zip_vba_project', '{D.ZIP_VBA_PROJECT}', name FROM vm WHERE ends_with(name, '{D.MACRO_STORE}'))"""
OFFICE_MEMBERS = f"""SELECT DISTINCT * FROM (
  SELECT path, 'office_macro_container' AS code, '{D.MACRO_CONTAINER}' AS description, '' AS severity FROM vm WHERE ends_with(name, '{D.MACRO_STORE}')
  UNION ALL SELECT path, 'office_vba_project', '{D.OFFICE_MACROS}', 'high' FROM vm WHERE ends_with(name, '{D.MACRO_STORE}')
  UNION ALL SELECT path, 'office_auto_actions_hint', '{D.OFFICE_SETTINGS}', 'medium' FROM vm WHERE contains(name, 'settings.xml'))"""
#: What follows the end marker: 4 bytes, 9 NULs, 20 bytes, nothing, 3 NULs and a byte.
IMAGES = "vi AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'img/' || doc_id || '.png' ELSE 'img/' || doc_id || '.jpg' END AS path, doc_id % 2 = 0 AS png, doc_id % 5 IN (0, 2, 4) AS data, CASE doc_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 9 WHEN 2 THEN 20 WHEN 3 THEN 0 ELSE 4 END AS extra FROM documents)"


MARKED = f"SELECT path, 'marker_strings' AS code, concat_ws(',', {', '.join(f"CASE WHEN contains(body, '{m}') THEN '{m}' END" for m in D.MARKERS)}) AS evidence FROM vf WHERE {' OR '.join(f"contains(body, '{m}')" for m in D.MARKERS)}"


def _with(select: str, ctes: str = ISSUES) -> str:
    return f"WITH {ctes} {select}"


#: Four listings of users by the events so far, and the rows of each that the one before it did not have.
LISTINGS = """WITH listings AS (SELECT k, 'user_' || user_id AS path, max(ts) AS t, count(*) AS length FROM events, (SELECT unnest(range(4)) AS k) WHERE event_id % 4 <= k GROUP BY ALL),
    changes AS (SELECT path, t, length, k + 1 AS generation FROM listings l WHERE NOT EXISTS (SELECT 1 FROM listings b WHERE b.path = l.path AND b.k = l.k - 1 AND b.t = l.t))"""


def oracle_sql() -> dict[str, str]:
    skipped = "size > 4000"
    vc_issues = _links("vc")
    return {
        "triage_full": _with("SELECT path, sha256, size, magic_type, n_issues, score, severity FROM results"),
        "fingerprint_docs": _with("SELECT path, sha256, size, magic_type, suffix FROM vf", FILES),
        "is_text_docs": _with("SELECT path, is_text FROM vf", FILES),
        "head_and_tail": _with("SELECT path, hex(encode(body)[1:16]) AS head_hex, hex(encode(body)[greatest(size - 15, 1):size]) AS tail_hex FROM vf", FILES),
        "size_gate": _with(f"SELECT path, size, CASE WHEN {skipped} THEN '' ELSE sha256 END AS sha256, {skipped} AS skipped FROM vf", FILES),
        "double_extension": _with(f"SELECT path, description, evidence FROM ({DOUBLE})", FILES),
        "pe_header": _with(f"SELECT path, code, description FROM ({PE})", FILES),
        "pdf_tokens": _with(f"SELECT path, description, evidence FROM ({TOKENS})", FILES),
        "pdf_rules_normal": _with(f"SELECT path, code, description, severity FROM ({_pdf_rules(False)})", FILES),
        "pdf_rules_strict": _with(f"SELECT path, code, description, severity FROM ({_pdf_rules(True)})", FILES),
        "url_extract": _with(f"SELECT DISTINCT path, code, evidence FROM ({_links('vf')})", FILES),
        "url_hosts_pages": _with(
            f"SELECT DISTINCT path, code, regexp_extract(evidence, '//([^/]*)', 1) AS host FROM ({_links('vp')})",
            "vp AS (SELECT *, strlen(body) AS size, strlen(body) > 0 AND NOT (hex(encode(body)[4097:4097]) BETWEEN '80' AND 'BF') AS is_text FROM (SELECT 'pages/' || page_id || '.html' AS path, url || chr(10) || html AS body FROM pages))",
        ),
        "zip_member_legacy": _members(LEGACY_MEMBERS),
        "zip_member_rules": _members(_member_rules(False)),
        "zip_member_rules_strict": _members(_member_rules(True)),
        "office_rules_members": _members(OFFICE_MEMBERS, ".docx"),
        "office_macro_docs": _with(f"SELECT path, code, description FROM ({MACRO})", FILES),
        "image_trailing": _with(f"SELECT path, 'image_trailing_data' AS code, CASE WHEN png THEN '{D.PNG_TRAILING}' ELSE '{D.JPEG_TRAILING}' END AS description FROM vi WHERE data", IMAGES),
        "image_rules": _with(f"SELECT path, CASE WHEN png THEN 'png_appended_data' ELSE 'jpeg_appended_data' END AS code, CASE WHEN png THEN '{D.PNG_APPENDED}' ELSE '{D.JPEG_APPENDED}' END AS description, 'medium' AS severity FROM vi WHERE CASE WHEN png THEN extra > 8 ELSE extra > 0 END", IMAGES),
        "marker_strings": _with(MARKED, FILES),
        "issues_dedup": _with("SELECT path, code, description, evidence, severity FROM issues"),
        "weighted_score": _with("SELECT path, score, coalesce(reasons, '') AS reasons FROM results"),
        "weighted_score_join": _with("SELECT path, score FROM results WHERE n_issues > 0"),
        "severity_bands": _with("SELECT path, score, severity FROM results"),
        "severity_summary": _with("SELECT severity, count(*)::BIGINT AS n_files, sum(score)::BIGINT AS total_score, max(score)::BIGINT AS max_score FROM results GROUP BY severity"),
        "issue_counts": _with("SELECT path, greatest(n_issues, 1)::BIGINT AS n_evidence FROM results"),
        "exit_code": _with("SELECT coalesce(max(CASE severity WHEN 'High' THEN 2 WHEN 'Suspicious' THEN 1 WHEN 'Caution' THEN 1 ELSE 0 END), 0)::BIGINT AS exit_code FROM results"),
        "path_sort_rank": _with("SELECT path, (row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY string_split(path, '/')))::BIGINT AS place FROM vf", FILES),
        "path_rank": _with("SELECT path, row_number() OVER (ORDER BY string_split(path, '/'))::BIGINT AS place FROM (SELECT path FROM vf UNION ALL SELECT 'conv/' || conv_id || '/' || turn || '.txt' FROM conversations)", FILES),
        "report_saved": _with("SELECT path, sha256, size, score, severity, n_issues, row_number() OVER (ORDER BY string_split(path, '/'))::BIGINT AS place FROM results"),
        "report_page": _with("SELECT path, severity, score FROM results"),
        "console_rows": _with("SELECT path, severity, score::VARCHAR AS score, coalesce(codes, '-') AS issues FROM results"),
        "console_widths": _with("SELECT max(length(path))::BIGINT AS path_width, max(length(severity))::BIGINT AS severity_width, max(length(score::VARCHAR))::BIGINT AS score_width, max(length(coalesce(codes, '-')))::BIGINT AS issues_width FROM results"),
        "watch_delta": """WITH now AS (SELECT 'user_' || user_id AS path, max(ts) AS t FROM events GROUP BY ALL), before AS (SELECT 'user_' || user_id AS path, max(ts) AS t FROM events WHERE event_id % 2 = 0 GROUP BY ALL)
            SELECT path, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS changed_at FROM now WHERE NOT EXISTS (SELECT 1 FROM before WHERE before.path = now.path AND before.t = now.t)""",
        "targets_union": _with(
            f"""SELECT 0::BIGINT AS target_idx, path, sha256, score FROM results UNION ALL SELECT 2::BIGINT, path, sha256, score FROM results
            UNION ALL SELECT 1::BIGINT, vc.path, vc.sha256, least(coalesce(sum(weight), 0), {S.CAP})::BIGINT FROM vc LEFT JOIN (SELECT DISTINCT path, code, evidence FROM ({vc_issues})) i ON vc.path = i.path LEFT JOIN weights USING (code) GROUP BY vc.path, vc.sha256""",
            f"{ISSUES}, {CONVERSATIONS}",
        ),
        "target_paths": "SELECT p_partkey, trim(p, ' ') AS path FROM (SELECT p_partkey, unnest(string_split(' ' || p_name || ';;' || p_brand || ' ; ', ';')) AS p FROM part) WHERE trim(p, ' ') <> ''",
        "json_issue": _with("""SELECT path, '{"code":"' || code || '","description":"' || description || '"' || CASE WHEN evidence <> '' THEN ',"evidence":"' || evidence || '"' ELSE '' END || CASE WHEN severity <> '' THEN ',"severity":"' || severity || '"' ELSE '' END || '}' AS issue
            FROM issues WHERE code IN ('double_extension', 'pe_header', 'pdf_javascript')"""),
        "scan_tree": "SELECT regexp_extract(filename, '[^/]*$') AS name, size::BIGINT AS size, sha256(content) AS sha256, 'unknown' AS magic_type FROM read_blob('/root/testdata/sf0.01/*.parquet')",
        "archive_members": _members("SELECT path, (row_number() OVER (PARTITION BY path ORDER BY p_partkey) - 1)::BIGINT AS place, name FROM vm"),
        "archives_scanned": _members(f"SELECT path, code, description, evidence, '' AS severity FROM ({LEGACY_MEMBERS}) UNION ALL SELECT path, code, description, '' AS evidence, severity FROM ({_member_rules(True)})"),
        "office_archives_scanned": _members(f"SELECT path, code, description FROM ({OFFICE_MEMBERS})", ".docx"),
        "error_rows": _with("SELECT path, CASE WHEN bad THEN '' ELSE sha256 END AS sha256, CASE WHEN bad THEN 0 ELSE size END AS size, CASE WHEN bad THEN 'unknown' ELSE magic_type END AS magic_type, 0::BIGINT AS n_issues, CASE WHEN bad THEN 'Safe' ELSE severity END AS severity, CASE WHEN bad THEN 'unreadable' ELSE '' END AS error FROM (SELECT *, regexp_matches(path, '5[.][^/]*$') AS bad FROM results)"),
        "error_exit_code": "SELECT max(CASE WHEN doc_id % 10 = 5 THEN 3 ELSE 0 END)::BIGINT AS exit_code FROM documents",
        "empty_exit_code": "SELECT 0::BIGINT AS exit_code",
        "report_files": "SELECT 'order/' || o_orderkey AS path, o_orderkey AS size, o_orderkey % 101 AS score, o_orderpriority AS code, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE 'none' END AS reasons FROM orders",
        "large_exif": f"SELECT path, code, description, severity FROM (SELECT 'sized/' || n_nationkey || '.jpg' AS path, 'jpeg_appended_data' AS code, '{D.JPEG_APPENDED}' AS description, 'medium' AS severity FROM nation UNION ALL SELECT 'sized/' || n_nationkey || '.jpg', 'image_large_exif', '{D.LARGE_IMAGE}', 'low' FROM nation WHERE n_nationkey % 3 > 0)",
        "url_size_limit": "SELECT 'sized/' || n_nationkey || '.txt' AS path, 'url' AS code, 'http://a.b/c' AS evidence FROM nation WHERE n_nationkey % 3 = 0",
        "markers_by_option": _with(f"SELECT evidence, count(*)::BIGINT AS n, (count(*) * {S.DEFAULT_WEIGHT})::BIGINT AS points FROM ({MARKED}) GROUP BY evidence", FILES),
        "rules_off": _with("SELECT code, count(*)::BIGINT AS n FROM (SELECT code FROM issues WHERE place < 8000000 UNION ALL SELECT 'image_trailing_data' FROM vi WHERE data) GROUP BY code", f"{ISSUES}, {IMAGES}"),
        "watch_state": "SELECT 'user_' || user_id AS path, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS known_at FROM events WHERE event_id % 3 < 2 GROUP BY user_id",
        "watch_log": f"{LISTINGS} SELECT path, strftime(max(t), '%Y-%m-%d %H:%M:%S.%f') AS known_at, max(generation) AS generation FROM changes GROUP BY path",
        "watch_stream": f"{LISTINGS} SELECT path, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS changed_at, length, generation FROM changes",
        "watch_ticks": _with("SELECT CASE WHEN k = 0 THEN 0 ELSE 1 END::BIGINT AS batch, path, sha256, score, severity FROM (SELECT *, regexp_extract(path, 'doc_([0-9]+)', 1)::BIGINT AS id FROM results), (SELECT unnest([0, 1]) AS k) WHERE CASE WHEN k = 0 THEN id % 2 = 0 ELSE id % 2 = 1 OR id % 10 = 0 END"),
        "quarantined": _with("SELECT path, CASE WHEN severity IN ('High', 'Suspicious') THEN regexp_extract(path, '[^/]*$') ELSE '' END AS stored, sha256 FROM results"),
        "genuine_replacement_characters": "SELECT 'pages/' || page_id || '.html' AS path, 'url' AS code, 'http://a.b/x' || chr(65533) || 'y' || chr(64976) AS evidence FROM pages",
    }

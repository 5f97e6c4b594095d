"""DuckDB SQL with the same meaning as each registered query, by brute force where joins are meant.

Patterns here are written on their own (unbounded forms of the extractor's), and
matching is a plain nested comparison of every text with every indicator.
"""

from __future__ import annotations

from .views import GLOBS, NET, TLDS

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"
V4_RUN = r"[A-Za-z_]?[0-9]{1,4}(?:\.[0-9]{1,4}){3,126}[A-Za-z_]?"
LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
HOST_LABEL = "[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?"
# whole runs, by what they consist of and must contain
DOMAIN_RUN = r"[A-Za-z0-9_-]*\.[A-Za-z0-9._-]+"
EMAIL_RUN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9._-]+"
V6_RUN = r"[0-9A-Za-z_.]*:[0-9A-Za-z_:.]*"
LONG_RUN = "[0-9A-Za-z_]{26,}"
G = "[0-9A-Fa-f]{1,4}"
V6 = (
    f"(?:{G}:){{7}}{G}|(?:{G}:){{1,7}}:|(?:{G}:){{1,6}}:{G}|(?:{G}:){{1,5}}(?::{G}){{1,2}}|(?:{G}:){{1,4}}(?::{G}){{1,3}}"
    f"|(?:{G}:){{1,3}}(?::{G}){{1,4}}|(?:{G}:){{1,2}}(?::{G}){{1,5}}|{G}:(?::{G}){{1,6}}|:(?:(?::{G}){{1,7}}|:)|::ffff:{V4}"
)
BITCOIN = "[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71}"


def values(texts) -> str:
    return ", ".join(f"('{t}')" for t in texts)


def v4_bits(a: str) -> str:
    return " || ".join(f"lpad(bin(CAST(split_part({a}, '.', {i}) AS INTEGER)), 8, '0')" for i in (1, 2, 3, 4))


def is_ip(e: str) -> str:
    return f"regexp_full_match({e}, '{V4}(?:/(?:[12]?[0-9]|3[0-2]))?')"


LINES_DOCUMENTS = """
lines_documents AS (
  SELECT * FROM (
    SELECT lang AS monitor_id, source, CAST(doc_id AS VARCHAR) AS path,
           CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_number,
           unnest(string_split(text, chr(10))) AS line,
           TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id AS BIGINT)) AS event_ts
    FROM documents) WHERE length(line) > 0)"""

LINES_PAGES = """
lines_pages AS (
  SELECT 'pages' AS monitor_id, 'Zeek:http' AS source, CAST(page_id AS VARCHAR) AS path, CAST(1 AS BIGINT) AS line_number,
         url AS line, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(page_id AS BIGINT)) AS event_ts FROM pages)"""

LOG_FILES = """
log_files AS (
  SELECT source AS path, line, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS line_number
  FROM (SELECT source, doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents))"""

V6_PART = [f"substr(md5(text), {4 * i + 1}, 4)" for i in range(8)]
V6_FULL = " || ':' || ".join(V6_PART)

ADDRESS = "'10.' || CAST(user_id % 8 AS VARCHAR) || '.' || CAST(event_id % 4 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR)"

LINES_CONN = f"""
lines_conn AS (
  SELECT 'conn' AS monitor_id, 'Zeek:conn' AS source, 'conn.log' AS path, event_id AS line_number,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || {ADDRESS} || ' ' || event_type AS line, ts AS event_ts FROM events)"""

HOSTS = "hosts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)"
ADDRESSES = f"addresses AS (SELECT {ADDRESS} AS query FROM events)"


def candidates(lines: str, name: str = "candidates", types: tuple = (), groups: tuple = ("ipv4", "ipv6", "domain", "email", "long")) -> str:
    """Items of a line table; ``pos`` counts the raw tokens of the given groups."""
    runs = {"ipv4": V4_RUN, "ipv6": V6_RUN, "domain": DOMAIN_RUN, "email": EMAIL_RUN, "long": LONG_RUN}
    tlds = ", ".join(f"'{t}'" for t in TLDS)
    labels, host_labels = rf"(?:{LABEL}\.)+", rf"(?:{HOST_LABEL}\.)+"
    kind = f"""CASE
      WHEN grp = 'ipv4' THEN CASE WHEN regexp_full_match(text, '{V4}') THEN 'IPv4' END
      WHEN grp = 'ipv6' THEN CASE WHEN regexp_full_match(text, '{V6}') THEN 'IPv6' END
      WHEN grp = 'domain' THEN CASE WHEN lower(split_part(text, '.', -1)) IN ({tlds}) AND len(string_split(text, '.')) <= 127 AND regexp_full_match(text, '{host_labels}{LABEL}') THEN 'Domain' END
      WHEN grp = 'email' THEN CASE WHEN regexp_full_match(text, '[^@]{{1,64}}@{labels}([A-Za-z]{{2,63}}|[Xx][Nn]--[A-Za-z0-9-]{{0,58}}[A-Za-z0-9])') THEN 'Email' END
      WHEN regexp_full_match(text, '[0-9A-Fa-f]{{32}}') THEN 'MD5'
      WHEN regexp_full_match(text, '[0-9A-Fa-f]{{40}}') THEN 'SHA1'
      WHEN regexp_full_match(text, '[0-9A-Fa-f]{{64}}') THEN 'SHA256'
      WHEN regexp_full_match(text, '{BITCOIN}') THEN 'Bitcoin'
      WHEN regexp_full_match(text, '0x[0-9A-Fa-f]{{40}}') THEN 'Ethereum' END"""
    parts, start = [], "0"
    for g in groups:
        found = f"regexp_extract_all(line, '{runs[g]}')"
        if g == "ipv6":  # a group with another character than a hexadecimal one ends an address
            marked = "list_transform(string_split(t, ':'), lambda g: CASE WHEN regexp_full_match(g, '[0-9A-Fa-f.]*') THEN g ELSE ' ' END)"
            pieces = f"string_split(replace(replace(array_to_string({marked}, ':'), ': ', ' '), ' :', ' '), ' ')"
            found = f"flatten(list_transform({found}, lambda t: list_filter({pieces}, lambda p: length(p) - length(replace(p, ':', '')) > 1)))"
        text = {
            "domain": f"trim(unnest({found}), '.-')",
            "email": f"ltrim(rtrim(unnest({found}), '.-'), '.')",
            "ipv6": f"regexp_replace(rtrim(unnest({found}), '.'), '([^:]):$', '\\1')",
        }.get(g, f"unnest({found})")
        parts.append(
            f"SELECT *, '{g}' AS grp, {text} AS text, {start} + unnest(range(0, len({found}))) AS pos FROM {lines}"
        )
        start += f" + len({found})"
    wanted = "" if not types else " AND match_type IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    return f"""
{name}_tokens AS ({" UNION ALL ".join(parts)}),
{name} AS (
  SELECT * EXCLUDE (grp, text, pos), CAST(pos AS INTEGER) AS pos, text AS matched_text, match_type,
         CASE WHEN match_type IN ('MD5', 'SHA1', 'SHA256') THEN lower(text) ELSE text END AS lookup_key
  FROM (SELECT *, {kind} AS match_type FROM {name}_tokens) WHERE match_type IS NOT NULL{wanted})"""


ITEMS = f"""SELECT path, line_number, pos, match_type, matched_text, lookup_key,
  CAST(CASE match_type WHEN 'IPv4' THEN 4 WHEN 'IPv6' THEN 6 ELSE -1 END AS INTEGER) AS family,
  CASE WHEN match_type = 'IPv4' THEN {v4_bits('matched_text')} END AS ip_bits FROM candidates"""

# -- feeds ---------------------------------------------------------------------

FEED_SQL = {
    "net": f"SELECT 'net' AS feed_id, 'CaseSensitive' AS mode, entry FROM (VALUES {values(NET)}) t(entry)",
    "globs": f"SELECT 'globs' AS feed_id, 'CaseInsensitive' AS mode, entry FROM (VALUES {values(GLOBS)}) t(entry)",
    "globs_cs": f"SELECT 'globs_cs' AS feed_id, 'CaseSensitive' AS mode, entry FROM (VALUES {values(GLOBS)}) t(entry)",
    "derived_ip": """
      SELECT DISTINCT 'derived_ip' AS feed_id, 'CaseSensitive' AS mode, entry FROM (
        SELECT matched_text AS entry FROM feed_ip WHERE CAST(split_part(matched_text, '.', 4) AS INTEGER) % 2 = 0
        UNION ALL
        SELECT split_part(matched_text, '.', 1) || '.' || split_part(matched_text, '.', 2) || '.0.0/16' FROM feed_ip
        WHERE CAST(split_part(matched_text, '.', 1) AS INTEGER) % 2 = 0)""",
    "derived_text": """
      SELECT DISTINCT 'derived_text' AS feed_id, 'CaseInsensitive' AS mode, entry FROM (
        SELECT upper(matched_text) AS entry FROM feed_text WHERE CAST(path AS BIGINT) % 2 = 0
        UNION ALL SELECT host FROM hosts WHERE page_id % 3 = 0)""",
    "derived_globs": """
      SELECT DISTINCT 'derived_globs' AS feed_id, 'CaseSensitive' AS mode, entry FROM (
        SELECT unnest(['*.' || split_part(host, '.', -2) || '.' || split_part(host, '.', -1), left(host, 6) || '*',
                       '?' || substring(host, 2), '*' || substring(host, 3, 5) || '*', '[a-m]*' || right(host, 9)]) AS entry
        FROM hosts WHERE page_id % 7 = 0)""",
}

# a glob as regular expression, for globs whose classes need no escaping
GLOB_RE = r"""'(?s)^' || replace(replace(replace(regexp_replace(match_key, '([.+^$(){}|\\])', '\\\1', 'g'), '*', '.*'), '?', '.'), '[!', '[^') || '\z'"""


def indicators(*feeds: str) -> str:
    parts = []
    if "derived_ip" in feeds:
        parts.append(candidates("lines_documents", "feed_ip", ("IPv4",), ("ipv4",)))
    if "derived_text" in feeds:
        parts.append(candidates("lines_documents", "feed_text", ("SHA1", "Email"), ("email", "long")))
    entries = " UNION ALL ".join(FEED_SQL[f] for f in feeds)
    address = "split_part(entry, '/', 1)"
    length = "CASE WHEN contains(entry, '/') THEN CAST(split_part(entry, '/', 2) AS INTEGER) ELSE 32 END"
    parts.append(f"""
indicators AS (
  SELECT *, CASE WHEN kind = 'glob' THEN {GLOB_RE} END AS glob_re FROM (
    SELECT feed_id, mode, entry, kind,
           CAST(row_number() OVER (PARTITION BY feed_id, kind = 'ip' ORDER BY sha256(entry)) - 1 AS BIGINT) AS pattern_id,
           CASE WHEN kind = 'ip' OR length(entry) % 3 <> 0 THEN '{{"category":"' || feed_id || '","rank":' || CAST(length(entry) AS VARCHAR) || '}}' END AS data,
           CASE WHEN kind <> 'ip' AND (mode = 'CaseInsensitive' OR regexp_full_match(entry, '[0-9A-Fa-f]{{40}}')) THEN lower(entry) ELSE entry END AS match_key,
           CAST(CASE WHEN kind = 'ip' THEN 4 END AS INTEGER) AS family,
           CAST(CASE WHEN kind = 'ip' THEN {length} END AS INTEGER) AS prefix_len,
           CASE WHEN kind = 'ip' THEN left({v4_bits(address)}, {length}) END AS net_bits
    FROM (SELECT *, CASE WHEN {is_ip('entry')} THEN 'ip' WHEN regexp_matches(entry, '[*?\\[]') THEN 'glob' ELSE 'literal' END AS kind
          FROM ({entries}))))""")
    return ",".join(parts)


def hits(source: str, place: tuple, extra: str = "", resolve: bool = False) -> str:
    """Brute force: every text of ``source`` against every indicator."""
    shown = "entry" if resolve else "'pattern_' || CAST(pattern_id AS VARCHAR)"
    identity = ", ".join(f"CAST({c} AS VARCHAR)" for c in (*place, "match_type", "matched_text", "feed_id"))
    outer = "".join(f", {c}" for c in extra.split(", ") if c)
    return f"""
texts AS (SELECT DISTINCT lookup_key, {is_ip('lookup_key')} AND NOT contains(lookup_key, '/') AS is_address FROM {source}),
known AS (
  SELECT lookup_key, feed_id, bool_or(kind = 'ip') AS by_ip, max(prefix_len) AS best, arg_max(coalesce(data, 'null'), prefix_len) AS ip_data,
         string_agg({shown}, ', ' ORDER BY pattern_id) AS names, string_agg(data, ', ' ORDER BY pattern_id) AS datas
  FROM texts JOIN indicators i ON
    (i.kind = 'ip' AND is_address AND left(CASE WHEN is_address THEN {v4_bits("CASE WHEN is_address THEN lookup_key ELSE '0.0.0.0' END")} END, i.prefix_len) = i.net_bits)
    OR (i.kind = 'literal' AND NOT is_address AND i.match_key = CASE WHEN i.mode = 'CaseInsensitive' THEN lower(lookup_key) ELSE lookup_key END)
    OR (i.kind = 'glob' AND NOT is_address AND regexp_matches(CASE WHEN i.mode = 'CaseInsensitive' THEN lower(lookup_key) ELSE lookup_key END, i.glob_re))
  GROUP BY lookup_key, feed_id),
hits AS (
  SELECT sha256(concat_ws(chr(31), {identity})) AS id, matched_text, match_type, source, feed_id AS database_id,
         CASE WHEN by_ip THEN matched_text || '/' || CAST(best AS VARCHAR) ELSE names END AS indicators,
         CASE WHEN by_ip THEN ip_data ELSE coalesce(datas, '') END AS payload{outer}
  FROM {source} JOIN known USING (lookup_key))"""


def manual(query_sql: str) -> str:
    return f"""
asked AS ({query_sql}),
manual AS (SELECT DISTINCT query AS matched_text, 'Manual' AS match_type, 'manual' AS source,
           CASE WHEN regexp_full_match(query, '[0-9A-Fa-f]{{40}}') THEN lower(query) ELSE query END AS lookup_key FROM asked WHERE query <> '')"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


PLACE = ("monitor_id", "source", "path", "line_number", "pos")
HITS = "SELECT id, matched_text, match_type, source, database_id, indicators, payload FROM hits"
TEXT_TOKENS = candidates("lines_documents", "tokens", ("SHA1", "Email"), ("email", "long"))
TEXT_QUERIES = "SELECT matched_text AS query FROM tokens UNION ALL SELECT upper(host) FROM hosts"
ALL_QUERIES = f"SELECT query FROM addresses UNION ALL {TEXT_QUERIES} UNION ALL SELECT host FROM hosts UNION ALL SELECT '' FROM pages"
TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def composed(line: str) -> str:
    return f"lines AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(1 AS BIGINT) AS line_number, {line} AS line FROM documents)"


DIGEST = "sha256(text)"
BASE58 = f"replace(left({DIGEST}, 30), '0', 'z')"
BECH32 = f"translate(left({DIGEST}, 39), '1b', 'zy')"
GROUPS = [f"substring(md5(text), {4 * i + 1}, 4)" for i in range(8)]
FULL = " || ':' || ".join(GROUPS)
V6_LINE = (
    f"'from ' || {FULL} || ' [' || {GROUPS[0]} || '::' || {GROUPS[1]} || ']:443 ::ffff:10.' || CAST(doc_id % 256 AS VARCHAR) || '.' "
    f"|| CAST(n_chars % 256 AS VARCHAR) || '.7 ' || {FULL} || ':' || {GROUPS[0]} || ' at 12:30:' || substring(md5(text), 1, 2)"
)


def v6_bits() -> str:
    """Bits of the three address forms that the composed lines hold."""

    def bits(hex_group: str) -> str:
        return f"lpad(bin(CAST('0x' || {hex_group} AS INTEGER)), 16, '0')"

    full = " || ".join(bits(f"split_part(matched_text, ':', {i})") for i in range(1, 9))
    short = f"{bits(part('1'))} || repeat('0', 96) || {bits(part('3'))}"
    dotted = f"repeat('0', 80) || repeat('1', 16) || {v4_bits(part('4'))}"
    return f"CASE WHEN contains(matched_text, '.') THEN {dotted} WHEN contains(matched_text, '::') THEN {short} ELSE {full} END"


def part(i: str) -> str:
    return f"split_part(matched_text, ':', {i})"


SIZE = """CASE WHEN bytes >= 1073741824 THEN printf('%.2f GB', bytes / 1073741824.0) WHEN bytes >= 1048576 THEN printf('%.2f MB', bytes / 1048576.0)
  WHEN bytes >= 1024 THEN printf('%.2f KB', bytes / 1024.0) ELSE CAST(bytes AS VARCHAR) || ' bytes' END"""

DOC_PATH = "'/feeds/' || source || '/' || CAST(doc_id AS VARCHAR)"
PAGE_NAME = "regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '[?#].*$', '') || CASE WHEN page_id % 3 = 0 THEN '.log.log' ELSE '' END"

ARTIFACT_FACTS = """
framed AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN encode('<!DOCTYPE html>' || text) WHEN 1 THEN encode(text)[1:3] WHEN 2 THEN encode(text)
         ELSE unhex('28B52FFD') || encode(text) END AS content FROM documents),
facts AS (SELECT *, octet_length(content) AS n, sha256(content) AS found,
          CASE WHEN doc_id % 6 = 3 THEN sha256('/landing/f-' || CAST(doc_id AS VARCHAR)) ELSE sha256(content) END AS expected,
          octet_length(content) + CASE WHEN doc_id % 6 = 4 THEN 1 ELSE 0 END AS size FROM framed),
checked AS (SELECT *, CASE
    WHEN doc_id % 11 = 0 THEN NULL
    WHEN n > 5 AND hex(content[1:5]) = '3C21444F43' THEN 'file is an HTML page'
    WHEN found <> expected THEN 'SHA-256 is ' || found || ', expected ' || expected
    WHEN n < 4 THEN 'file has only ' || CAST(n AS VARCHAR) || ' bytes'
    WHEN hex(content[1:4]) <> '28B52FFD' THEN 'first bytes are ' || hex(content[1:4])
    WHEN n <> size THEN 'size differs from the manifest' END AS error FROM facts)"""

ORACLE = {
    "lines_documents": sql(LINES_DOCUMENTS, select="SELECT monitor_id, source, path, line_number, line FROM lines_documents"),
    "tail_lines": sql(
        LINES_DOCUMENTS,
        select="""SELECT path, string_agg(line, chr(10) ORDER BY line_number) AS tail FROM (
          SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_number DESC) AS r FROM lines_documents) WHERE r <= 3 GROUP BY path""",
    ),
    "tail_log_files": sql(
        LOG_FILES,
        select="""SELECT path, string_agg(line, chr(10) ORDER BY line_number) AS tail FROM (
          SELECT *, max(line_number) OVER (PARTITION BY path) AS m FROM log_files) WHERE line_number > m - 50 GROUP BY path""",
    ),
    "tail_lines_long": sql(
        LOG_FILES,
        select="""SELECT path, md5(string_agg(line, chr(10) ORDER BY line_number)) AS tail_md5 FROM (
          SELECT *, max(line_number) OVER (PARTITION BY path) AS m FROM log_files) WHERE line_number > m - 2000 GROUP BY path""",
    ),
    "read_logs": sql(LOG_FILES, select="SELECT path, line_number, line FROM log_files WHERE line <> ''"),
    "extract_ipv6_prefixed": f"""
      SELECT CAST(doc_id AS VARCHAR) AS path, 'IPv6' AS match_type,
             unnest([{V6_FULL}, {V6_PART[0]} || '::' || {V6_PART[1]}, '::' || {V6_PART[2]}, {V6_FULL}]) AS matched_text FROM documents""",
    "extract_domain_underscore": sql(
        HOSTS, select="SELECT CAST(page_id AS VARCHAR) AS path, 'Domain' AS match_type, '_x_' || CAST(page_id AS VARCHAR) || '.' || host AS matched_text FROM hosts"
    ),
    "extract_long_runs": """
      SELECT CAST(doc_id AS VARCHAR) AS path, unnest(['Domain', 'Domain', 'Domain', 'Email']) AS match_type,
             unnest(['x.com', 'ok' || CAST(doc_id AS VARCHAR) || '.com', 'y.org', 'b' || CAST(doc_id AS VARCHAR) || '@y.org']) AS matched_text FROM documents""",
    "extract_ipv4": sql(LINES_DOCUMENTS, candidates("lines_documents", types=("IPv4",), groups=("ipv4",)), select=ITEMS),
    "extract_domain": sql(
        LINES_DOCUMENTS, LINES_PAGES, "both_lines AS (SELECT * FROM lines_documents UNION ALL SELECT * FROM lines_pages)",
        candidates("both_lines", types=("Domain",), groups=("domain",)), select=ITEMS,
    ),
    "extract_email": sql(LINES_DOCUMENTS, candidates("lines_documents", types=("Email",), groups=("email",)), select=ITEMS),
    "extract_sha1": sql(LINES_DOCUMENTS, candidates("lines_documents", types=("SHA1",), groups=("long",)), select=ITEMS),
    "extract_all": sql(LINES_DOCUMENTS, candidates("lines_documents"), select=ITEMS),
    "extract_hashes": sql(
        composed("'md5=' || md5(text) || ' sha256=' || upper(sha256(text)) || ' bad=' || md5(text) || '0'"),
        candidates("lines", types=("MD5", "SHA256"), groups=("long",)), select=ITEMS,
    ),
    "extract_wallets": sql(
        composed(f"'1' || {BASE58} || ' bc1' || {BECH32} || ' 0x' || left({DIGEST}, 40) || ' 2' || {BASE58} || ' 0x' || left({DIGEST}, 41)"),
        candidates("lines", types=("Bitcoin", "Ethereum"), groups=("long",)), select=ITEMS,
    ),
    "extract_ipv6": sql(
        composed(V6_LINE), candidates("lines", types=("IPv6",), groups=("ipv6",)),
        select=f"""SELECT path, line_number, pos, match_type, matched_text, lookup_key, CAST(6 AS INTEGER) AS family, {v6_bits()} AS ip_bits FROM candidates""",
    ),
    "ip_bits": sql(ADDRESSES, select=f"SELECT DISTINCT query AS address, CAST(4 AS INTEGER) AS family, {v4_bits('query')} AS bits FROM addresses"),
    "feed_load": sql(
        LINES_DOCUMENTS, HOSTS, indicators("derived_ip", "derived_text", "derived_globs"),
        select="SELECT feed_id, pattern_id, entry, kind, match_key, coalesce(family, -1) AS family, coalesce(prefix_len, -1) AS prefix_len, net_bits, data FROM indicators",
    ),
    "glob_regex": sql(
        HOSTS, indicators("derived_globs"),
        select="SELECT entry, glob_re, CASE WHEN regexp_full_match(entry, '[*][.][^*?\\[]+') THEN substring(entry, 3) END AS suffix_key FROM indicators",
    ),
    "feed_counts": sql(
        LINES_DOCUMENTS, HOSTS, indicators("net", "derived_ip", "derived_text", "derived_globs"),
        select="""SELECT feed_id, count(*) FILTER (kind = 'ip') AS ip, count(*) FILTER (kind = 'literal') AS literal,
          count(*) FILTER (kind = 'glob') AS glob, count(*) AS total FROM indicators GROUP BY feed_id""",
    ),
    "remove_feeds": sql(
        LINES_DOCUMENTS, HOSTS, indicators("derived_ip", "derived_text", "derived_globs"),
        select="SELECT feed_id, entry, pattern_id FROM indicators WHERE feed_id <> 'derived_ip'",
    ),
    "lookup_literal": sql(
        LINES_DOCUMENTS, HOSTS, indicators("derived_text"), TEXT_TOKENS, manual(TEXT_QUERIES), hits("manual", ("source",), resolve=True), select=HITS,
    ),
    "lookup_cidr": sql(ADDRESSES, indicators("net"), manual("SELECT query FROM addresses"), hits("manual", ("source",), resolve=True), select=HITS),
    "lookup_glob": sql(
        HOSTS, indicators("globs", "globs_cs", "derived_globs"), manual("SELECT host AS query FROM hosts"), hits("manual", ("source",), resolve=True), select=HITS,
    ),
    "lookup_multi_feed": sql(
        LINES_DOCUMENTS, HOSTS, ADDRESSES, indicators("net", "derived_ip", "derived_text", "globs", "globs_cs"), TEXT_TOKENS, manual(ALL_QUERIES),
        hits("manual", ("source",), resolve=True), select=HITS,
    ),
    "scan_documents": sql(
        LINES_DOCUMENTS, HOSTS, indicators("net", "derived_ip", "derived_text", "globs"), candidates("lines_documents"),
        hits("candidates", PLACE, "path, line_number, pos"), select="SELECT * FROM hits",
    ),
    "scan_conn": sql(
        LINES_CONN, indicators("net"), candidates("lines_conn"), hits("candidates", PLACE, "event_ts, line"),
        select=f"SELECT * EXCLUDE (event_ts, line), {TIME.format('event_ts')} AS hit_time, line AS log_line FROM hits",
    ),
    "scan_pages": sql(LINES_PAGES, HOSTS, indicators("globs", "derived_globs"), candidates("lines_pages"), hits("candidates", PLACE), select=HITS),
    "scan_brand_globs": sql(
        HOSTS,
        """brands AS (SELECT DISTINCT '*' || split_part(host, '.', -3) || '*.' || split_part(host, '.', -1) AS entry FROM hosts WHERE length(split_part(host, '.', -3)) > 2)""",
        select="""SELECT host AS matched_text, string_agg(entry, ', ' ORDER BY sha256(entry)) AS indicators
          FROM (SELECT DISTINCT host FROM hosts) JOIN brands ON regexp_full_match(host, replace(replace(entry, '.', '[.]'), '*', '.*')) GROUP BY host""",
    ),
    "scan_two_monitors": sql(
        LINES_DOCUMENTS, LINES_PAGES, HOSTS,
        "two_monitors AS (SELECT * REPLACE (unnest(['a', 'b']) AS monitor_id) FROM lines_pages)",
        indicators("globs", "derived_text"), candidates("two_monitors"), hits("candidates", PLACE, "monitor_id"), select="SELECT * FROM hits",
    ),
    "scan_html": sql(
        LINES_DOCUMENTS, HOSTS,
        """html_lines AS (SELECT * FROM (
          SELECT 'html' AS monitor_id, 'html' AS source, CAST(page_id AS VARCHAR) AS path,
                 CAST(unnest(range(1, len(string_split(html, chr(10))) + 1)) AS BIGINT) AS line_number, unnest(string_split(html, chr(10))) AS line
          FROM pages) WHERE line <> '')""",
        indicators("derived_text"), candidates("html_lines"), hits("candidates", PLACE, "path, line_number, pos"), select="SELECT * FROM hits",
    ),
    "scan_logs_stream": sql(
        LINES_DOCUMENTS, HOSTS, LOG_FILES, "full_lines AS (SELECT *, path AS source, 'm' AS monitor_id FROM log_files WHERE line <> '')",
        indicators("derived_text"), candidates("full_lines"), hits("candidates", PLACE),
        select="SELECT matched_text, match_type, 'text' AS database_id, indicators, payload FROM hits",
    ),
    "tail_stream": sql(
        LINES_DOCUMENTS, HOSTS, "m_lines AS (SELECT * REPLACE ('m' AS monitor_id) FROM lines_documents)",
        indicators("derived_text", "derived_ip"), candidates("m_lines"), hits("candidates", PLACE, "path"),
        select="""SELECT matched_text, match_type, replace(database_id, 'derived_', '') AS database_id, indicators, payload FROM hits
          WHERE CAST(path AS BIGINT) % 2 = 1 OR database_id = 'derived_text'""",
    ),
    "counters_over_midnight": sql(
        LINES_DOCUMENTS, HOSTS, indicators("derived_ip", "derived_text"), candidates("lines_documents"), hits("candidates", PLACE, "monitor_id, event_ts"),
        select="""SELECT monitor_id, lines_processed, CAST(coalesce(i, 0) AS BIGINT) AS items_extracted, CAST(coalesce(h, 0) AS BIGINT) AS hits_found,
            strftime(t + INTERVAL 86000 SECOND, '%H:%M:%S') AS last_activity
          FROM (SELECT monitor_id, count(*) AS lines_processed FROM lines_documents GROUP BY 1)
          LEFT JOIN (SELECT monitor_id, count(*) AS i FROM candidates GROUP BY 1) USING (monitor_id)
          LEFT JOIN (SELECT monitor_id, count(*) AS h, max(event_ts) AS t FROM hits GROUP BY 1) USING (monitor_id)""",
    ),
    "manifest_read": """
      SELECT source AS channel, 'f' || doc_id AS name, lang AS version, 1 AS format_version, 'https://feeds/' || doc_id AS url,
             sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents""",
    "inventory_files": """
      SELECT source AS path, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha256, left(hex(t), 10) AS head
      FROM (SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY source)""",
    "catalog_file": """
      SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 3 = 0 AS is_auto_updated, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS sha256 FROM documents""",
    "build_epochs": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id ELSE -1 END AS built FROM events",
    "publish_unload": sql(LINES_DOCUMENTS, HOSTS, indicators("derived_globs"), select="SELECT feed_id, pattern_id, entry, kind, data FROM indicators"),
    "feed_list": sql(
        LINES_DOCUMENTS, HOSTS, indicators("net", "derived_text", "derived_globs"),
        select="""SELECT feed_id, '/feeds/' || feed_id AS path, size_bytes,
            CASE WHEN size_bytes < 1024 THEN CAST(size_bytes AS VARCHAR) || ' bytes' WHEN size_bytes < 1048576 THEN printf('%.2f KB', size_bytes / 1024)
                 ELSE printf('%.2f MB', size_bytes / 1048576) END AS size_human,
            mode, 'Feed ' || feed_id AS description, strftime(make_timestamp((1700000000 + size_bytes) * 1000000), '%Y-%m-%d %H:%M UTC') AS built,
            feed_id = 'net' AS is_auto_updated, ip, literal, "glob", total
          FROM (SELECT feed_id, CAST(sum(length(entry)) AS BIGINT) AS size_bytes, min(mode) AS mode, count(*) FILTER (kind = 'ip') AS ip,
                       count(*) FILTER (kind = 'literal') AS literal, count(*) FILTER (kind = 'glob') AS "glob", count(*) AS total FROM indicators GROUP BY feed_id)""",
    ),
    "feed_file": sql(
        HOSTS, select="""SELECT 'hosts' AS feed_id, host AS entry, 'literal' AS kind, lower(host) AS match_key,
          '{"page":"' || CAST(page_id AS VARCHAR) || '"}' AS data, count(*) OVER () AS entries FROM hosts""",
    ),
    "manifest_file": """
      SELECT 'stable' AS channel, 'feed-' || CAST(doc_id AS VARCHAR) AS name, lang AS version, 'https://f/' || CAST(doc_id AS VARCHAR) AS url,
             sha256(text) AS sha256, n_chars AS size FROM documents, range(2)""",
    "alerts": sql(
        LINES_DOCUMENTS, HOSTS, indicators("derived_ip", "derived_text"), candidates("lines_documents"), hits("candidates", PLACE),
        select="SELECT 'Intelligence Hit: ' || match_type AS title, 'Matched: ' || matched_text || chr(10) || 'Source: ' || source AS body FROM hits",
    ),
    "recent_hits": sql(
        LINES_DOCUMENTS, LINES_CONN, HOSTS, indicators("net", "derived_ip", "derived_text"),
        candidates("lines_documents", "doc_items"), candidates("lines_conn", "conn_items"),
        "items AS (SELECT *, true AS from_conn FROM conn_items UNION ALL BY NAME SELECT *, false AS from_conn FROM doc_items)",
        hits("items", PLACE, "event_ts, from_conn"),
        select=f"""SELECT * EXCLUDE (event_ts, from_conn), {TIME.format('event_ts')} AS hit_time FROM hits
          WHERE from_conn = (database_id = 'net') ORDER BY event_ts DESC, id LIMIT 500""",
    ),
    "monitor_stats": sql(
        LINES_DOCUMENTS, HOSTS, indicators("derived_ip", "derived_text"), candidates("lines_documents"), hits("candidates", PLACE, "monitor_id, event_ts"),
        select="""SELECT monitor_id, lines_processed, coalesce(i, 0) AS items_extracted, coalesce(h, 0) AS hits_found, strftime(t, '%H:%M:%S') AS last_activity
          FROM (SELECT monitor_id, count(*) AS lines_processed FROM lines_documents GROUP BY 1)
          LEFT JOIN (SELECT monitor_id, count(*) AS i FROM candidates GROUP BY 1) USING (monitor_id)
          LEFT JOIN (SELECT monitor_id, count(*) AS h, max(event_ts) AS t FROM hits GROUP BY 1) USING (monitor_id)""",
    ),
    "feed_stats": sql(
        LINES_DOCUMENTS, HOSTS, ADDRESSES, indicators("net", "derived_text", "globs", "globs_cs"), TEXT_TOKENS, manual(ALL_QUERIES),
        hits("manual", ("source",), resolve=True),
        "matched AS (SELECT h.database_id AS feed_id, count(*) AS m FROM hits h JOIN asked a ON a.query = h.matched_text GROUP BY 1)",
        select="""SELECT feed_id, total AS total_queries, coalesce(m, 0) AS queries_with_match, coalesce(m, 0) / total AS match_rate,
            printf('%.0f', coalesce(m, 0) / total * 100) || '%' AS match_percent
          FROM (SELECT DISTINCT feed_id FROM indicators) CROSS JOIN (SELECT count(*) AS total FROM asked WHERE query <> '') LEFT JOIN matched USING (feed_id)""",
    ),
    "enabled_lines": sql(
        LINES_DOCUMENTS, select="SELECT monitor_id, source, count(*) AS lines FROM lines_documents WHERE monitor_id < 'e' GROUP BY ALL"
    ),
    "catalog_totals": "SELECT count(DISTINCT source) AS feeds, count(DISTINCT lang) AS monitors FROM documents",
    "catalog_parse": f"""
      SELECT unnest([{DOC_PATH}, {DOC_PATH} || '.old']) AS path, false AS is_auto_updated, CAST(NULL AS VARCHAR) AS sha256 FROM documents WHERE doc_id % 5 = 0
      UNION ALL SELECT {DOC_PATH}, doc_id % 2 = 0, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""",
    "catalog_existing": """SELECT '/feeds/' || CAST(doc_id AS VARCHAR) AS path, source,
      CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'present' ELSE 'missing' END AS state FROM documents""",
    "verify_artifacts": sql(
        ARTIFACT_FACTS,
        select="""SELECT 'feed-' || CAST(doc_id AS VARCHAR) AS name, 'v' || CAST(doc_id % 4 AS VARCHAR) AS version,
          CASE WHEN doc_id % 11 <> 0 THEN '/landing/f-' || CAST(doc_id AS VARCHAR) END AS path,
          CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN error IS NOT NULL THEN 'rejected' ELSE 'ok' END AS status, error,
          'feed-' || CAST(doc_id AS VARCHAR) || '-v' || CAST(doc_id % 4 AS VARCHAR) AS artifact FROM checked""",
    ),
    "updates_available": """
      SELECT 'threat-intel' AS name, sha256(d.text) <> i.h AS available, i.f AS installed_feed, i.h AS installed_sha256,
             CAST(d.doc_id AS VARCHAR) AS latest_version, sha256(d.text) AS latest_sha256
      FROM documents d, (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS f, sha256(text) AS h FROM documents WHERE doc_id % 5 = 4 ORDER BY 1 LIMIT 1) i
      WHERE d.doc_id % 2 = 0""",
    "replace_feed": """
      SELECT CAST(item_id AS VARCHAR) AS feed_id, true AS is_auto_updated, sha256(text) AS sha256 FROM benchmark
      UNION ALL SELECT CAST(doc_id AS VARCHAR), false, sha256(text) FROM documents
      WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT item_id FROM benchmark)""",
    "format_size": f"SELECT doc_id, bytes, {SIZE} AS size_human FROM (SELECT doc_id, unnest([n_chars, n_chars * 1024, n_chars * 1048576, n_chars * 1073741824]) AS bytes FROM documents)",
    "format_build_date": """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'Unknown date' WHEN 1 THEN NULL
      ELSE strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' END AS built FROM events""",
    "format_hit_time": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%b %d, %H:%M:%S') WHEN 1 THEN strftime(ts, '%b %d, %H:%M:%S')
      WHEN 2 THEN strftime(ts, '%H:%M:%S') WHEN 3 THEN strftime(ts - INTERVAL 2 HOUR, '%b %d, %H:%M:%S') ELSE event_type END AS shown FROM events""",
    "flatten_props": """SELECT event_id, CAST(0 AS INTEGER) AS pos, json_keys(props)[1] AS key,
      json_extract_string(props, '$.' || json_keys(props)[1]) AS value_text FROM events""",
    "flatten_deep": """
      SELECT doc_id, CAST(0 AS INTEGER) AS pos, 'deep' AS key,
             repeat('[[, ', n) || CAST(doc_id AS VARCHAR) || repeat(']', n) AS value_text
      FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 990 ELSE doc_id % 5 + 5 END AS n FROM documents)""",
    "flatten_nested": """
      SELECT doc_id, CAST(pos AS INTEGER) AS pos, key, value_text FROM (
        SELECT doc_id, 0 AS pos, 'a' AS key, lang AS value_text FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 1, 'b', 'null' FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 2, 'z', '[' || CAST(doc_id AS VARCHAR) || ', a, null, [Object], [true, []]]' FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 0, 'e', '[]' FROM documents WHERE doc_id % 4 = 1
        UNION ALL SELECT doc_id, 1, 'n', CAST(doc_id AS VARCHAR) || '.5' FROM documents WHERE doc_id % 4 = 1
        UNION ALL SELECT doc_id, 2, 'o', '[Object]' FROM documents WHERE doc_id % 4 = 1
        UNION ALL SELECT doc_id, 3, 't', 'true' FROM documents WHERE doc_id % 4 = 1
        UNION ALL SELECT doc_id, 0, NULL, '[' || CAST(doc_id AS VARCHAR) || ',2]' FROM documents WHERE doc_id % 4 = 2
        UNION ALL SELECT doc_id, 0, NULL, 'not json ' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 4 = 3)""",
    "sha256_docs": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "source_labels": f"""SELECT page_id, n AS name, n AS label, 'Zeek:' || regexp_replace(n, '([.]log)+$', '') AS capture_label, page_id % 3 = 0 AS is_log
      FROM (SELECT page_id, split_part(regexp_replace(p, '/+$', ''), '/', -1) AS n FROM (SELECT page_id, {PAGE_NAME} AS p FROM pages))""",
}

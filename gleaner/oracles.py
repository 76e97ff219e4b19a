"""SQL statements of the registered queries, for checking with another engine over the same tables."""

from __future__ import annotations

from gleaner.functions.patterns import (
    IOC_TYPES,
    PLACEHOLDER_DOMAINS,
    PRIVATE_IPV4_PREFIXES,
    URL_TRAILING_PUNCTUATION,
    oracle_patterns,
)
from gleaner.functions.paths import CONTENT_TYPES, DEFAULT_CONTENT_TYPE, DEFAULT_EXTENSIONS
from gleaner.operators.sketch import WORD_COLUMNS, layer_size
from gleaner.operators.stats import HISTOGRAM_EDGES
from gleaner.queries import ADDED_LINE, AUDIT_WINDOW_SECONDS, FIRST_LAYER, FUZZY_DISTANCE, MAX_ASKED, PERCENT_PATTERN, PORTABLE_SKETCH, TOP_K
from gleaner.schemas import SCAN_STATUSES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _ts(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%SZ') AS {alias or column.split('.')[-1]}"


_P = {name: _q(pattern) for name, pattern in oracle_patterns().items()}

_FILES = """
raw_files AS (
  SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text AS content, doc_id AS n,
         CASE lang WHEN 'en' THEN 'known' WHEN 'fr' THEN 'touched' ELSE 'new' END AS state
  FROM documents
  UNION ALL
  SELECT 'manifests/' || source || '/' || doc_id || CASE WHEN lang = 'de' THEN '.LOG' ELSE '.log' END,
         doc_id || ' md5=' || CASE WHEN lang = 'fr' THEN upper(md5(text)) ELSE md5(text) END
           || ' sha256=' || sha256(text) || ' ' || sha256(text) || chr(10)
         || 'peer ' || substr(md5(text), 1, 4) || ':' || substr(md5(text), 5, 4) || ':' || substr(md5(text), 9, 4)
           || ':' || substr(md5(text), 13, 4) || ':' || substr(md5(text), 17, 4) || ':' || substr(md5(text), 21, 4)
           || ':' || substr(md5(text), 25, 4) || ':' || substr(md5(text), 29, 4)
           || ' next ' || substr(md5(text), 1, 4) || '::' || substr(md5(text), 5, 4)
           || ' mapped ::ffff:' || substr(md5(text), 9, 4) || ':' || substr(md5(text), 13, 4) || chr(10)
         || 'from 10.0.1.' || (n_chars % 250) || ' via 203.0.113.' || (n_chars % 256)
           || ' not 192.168.001.' || (n_chars % 100) || chr(10)
         || 'null ' || repeat('f', 32) || ' ' || repeat('0', 40) || ' ' || repeat('F', 64) || chr(10)
         || 'GET (https://' || source || '.example.com/' || lang || '/' || doc_id || '?h=' || substr(md5(text), 1, 8)
           || '). host TEST.com mail Ops@' || source || '.example.org,',
         doc_id, CASE lang WHEN 'fr' THEN 'known' WHEN 'en' THEN 'touched' ELSE 'new' END
  FROM documents
  UNION ALL
  SELECT 'pages/' || page_id || '.html', url || chr(10) || html, page_id,
         CASE split_part(url, ':', 1) WHEN 'https' THEN 'known' WHEN 'http' THEN 'touched' ELSE 'new' END
  FROM pages
  UNION ALL
  SELECT 'chats/' || conv_id || '/' || turn || CASE WHEN role = 'assistant' THEN '.md' ELSE '.yaml' END, text, conv_id,
         CASE role WHEN 'assistant' THEN 'known' WHEN 'system' THEN 'touched' ELSE 'new' END
  FROM conversations
),
files AS (
  SELECT sha256(file_path) AS file_id, file_path, CAST(strlen(content) AS BIGINT) AS file_size,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n) AS last_modified, content, state
  FROM raw_files
)"""

_NOT_CONSTANT = "NOT regexp_matches(lower(v), '^(f+|0+)$')"


def _matches(name: str, value: str = "v", condition: str = "true", pattern: str | None = None) -> str:
    found = pattern or f"regexp_extract_all(content, {_P[name]})"
    return (
        f"SELECT DISTINCT file_id, '{name}' AS ioc_type, {value} AS ioc_value "
        f"FROM (SELECT file_id, unnest({found}) AS v FROM files) WHERE {condition}"
    )


_IPV6 = f"list_concat(regexp_extract_all(content, {_P['ipv6_full']}), regexp_extract_all(content, {_P['ipv6_compressed']}))"

_PER_TYPE = {
    "ipv4": _matches("ipv4", condition="NOT regexp_matches(v, '(^|\\.)0[0-9]')"),
    "ipv6": _matches("ipv6", condition=f"NOT regexp_matches(v, {_P['ipv6_mapped']})", pattern=_IPV6),
    "domain": _matches("domain", "lower(v)"),
    "url": _matches("url", f"rtrim(v, {_q(URL_TRAILING_PUNCTUATION)})"),
    "md5": _matches("md5", "lower(v)", _NOT_CONSTANT),
    "sha1": _matches("sha1", "lower(v)", _NOT_CONSTANT),
    "sha256": _matches("sha256", "lower(v)", _NOT_CONSTANT),
    "email": _matches("email", "lower(v)"),
}

_FOUND = _FILES + ", found AS (" + " UNION ALL ".join(_PER_TYPE[t] for t in IOC_TYPES) + ")"

_STORE_ONLY = """
, store AS (
  SELECT ioc_value, ioc_type, f.file_id AS source_file_id,
         CASE WHEN version = 1 THEN 'Rescan' ELSE 'Unknown' END AS malware_family,
         CAST(CASE WHEN version = 1 THEN 80 ELSE 50 END AS SMALLINT) AS confidence,
         f.last_modified + to_days(CAST(version AS INTEGER)) AS first_seen,
         f.last_modified + to_days(CAST(version AS INTEGER)) AS last_seen
  FROM found JOIN files f USING (file_id), (VALUES (0), (1)) AS versions(version)
  WHERE version = 0 OR state = 'known'
),
current_store AS (
  SELECT * FROM store
  QUALIFY row_number() OVER (PARTITION BY ioc_type, ioc_value, source_file_id ORDER BY last_seen DESC) = 1
)"""

_REGISTRY_ONLY = """
, registry AS (
  SELECT file_id, file_path, file_size,
         CASE WHEN state = 'known' THEN last_modified ELSE last_modified - INTERVAL 1 HOUR END AS last_modified,
         CASE WHEN state <> 'known' THEN 'failed' WHEN run = 1 THEN 'pending'
              WHEN file_size > 1000 THEN 'infected' ELSE 'misc' END AS scan_status,
         CASE WHEN run = 2 AND file_size > 1000 THEN file_size // 1000 ELSE 0 END AS ioc_count,
         CASE WHEN run = 2 AND file_size <= 1000 THEN file_id ELSE '' END AS object_key,
         CASE WHEN state <> 'known' THEN 'read error' ELSE '' END AS error_message,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CASE WHEN run = 2 THEN 60 ELSE 31 END) AS updated_at
  FROM files, (VALUES (1), (2)) AS runs(run)
  WHERE state <> 'new' AND (run = 1 OR state = 'known')
),
current_registry AS (
  SELECT * FROM registry QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY updated_at DESC) = 1
)"""

_RUN_ONLY = """
, changed AS (
  SELECT f.* FROM files f LEFT JOIN current_registry r ON r.file_id = f.file_id
  WHERE r.file_id IS NULL OR r.last_modified <> f.last_modified
),
counts AS (SELECT file_id, count(*) AS ioc_count FROM found GROUP BY file_id),
this_run AS (
  SELECT c.file_id, file_path, file_size, last_modified,
         CASE WHEN coalesce(ioc_count, 0) > 0 THEN 'infected' ELSE 'misc' END AS scan_status,
         coalesce(ioc_count, 0) AS ioc_count,
         CASE WHEN coalesce(ioc_count, 0) > 0 THEN '' ELSE c.file_id END AS object_key,
         '' AS error_message, TIMESTAMP '2024-06-01 00:00:00' AS updated_at
  FROM changed c LEFT JOIN counts USING (file_id)
),
merged AS (
  SELECT * FROM (SELECT * FROM registry UNION ALL SELECT * FROM this_run)
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY updated_at DESC) = 1
)"""

_CONTENT_TYPE = (
    "CASE "
    + " ".join(
        f"WHEN suffix(file_path, '{e}') AND length(file_path) > {len(e)} THEN '{t}'" for e, t in CONTENT_TYPES.items()
    )
    + f" ELSE '{DEFAULT_CONTENT_TYPE}' END"
)

_OBJECTS_ONLY = f"""
, objects AS (
  SELECT file_id AS object_key, {_CONTENT_TYPE} AS content_type, file_size AS size, md5(content) AS content_md5, state
  FROM files WHERE file_id NOT IN (SELECT file_id FROM found)
)"""

_REQUESTS_ONLY = """
, per_file AS (SELECT file_id, list_sort(list(DISTINCT ioc_value)) AS v FROM found GROUP BY file_id),
requests AS (
  SELECT file_id AS request_id,
         list_concat(coalesce(v, []), list_transform(coalesce(v, []), lambda x: upper(x)), coalesce(v[1:1], []),
                     ['absent-' || file_id]) AS iocs
  FROM files LEFT JOIN per_file USING (file_id)
),
asked AS (
  SELECT request_id, CAST(i - 1 AS INTEGER) AS position, iocs[i] AS ioc
  FROM (SELECT request_id, iocs, unnest(range(1, len(iocs) + 1)) AS i FROM requests)
)"""

_LOG = """
log AS (
  SELECT CAST(event_id AS VARCHAR) AS query_id, ts AS "timestamp", sha256(CAST(user_id AS VARCHAR)) AS api_key_hash,
         CASE event_type WHEN 'view' THEN '/context' WHEN 'signup' THEN '/stats' ELSE '/check' END AS endpoint,
         CASE WHEN event_type IN ('view', 'signup') THEN 'GET' ELSE 'POST' END AS method,
         CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status_code,
         CAST(round(value * 10) AS BIGINT) AS response_time_ms,
         round(value * 10) / 1000 AS response_seconds
  FROM events
),
keys AS (
  SELECT sha256(CAST(user_id AS VARCHAR)) AS key_hash, 'user-' || user_id AS key_name,
         CAST(CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END AS BIGINT) AS rate_limit,
         event_type <> 'error' AS is_active, ts AS last_used
  FROM events
),
current_keys AS (SELECT * FROM keys QUALIFY row_number() OVER (PARTITION BY key_hash ORDER BY last_used DESC) = 1)"""

_F = f"WITH {_FILES} "
_FD = f"WITH {_FOUND} "
_S = f"WITH {_FOUND}{_STORE_ONLY} "
_R = f"WITH {_FILES}{_REGISTRY_ONLY} "
_RUN = f"WITH {_FOUND}{_REGISTRY_ONLY}{_RUN_ONLY} "
_O = f"WITH {_FOUND}{_OBJECTS_ONLY} "
_RQ = f"WITH {_FOUND}{_REQUESTS_ONLY} "
_SRQ = f"WITH {_FOUND}{_STORE_ONLY}{_REQUESTS_ONLY} "
_L = f"WITH {_LOG} "

_REGISTRY_COLUMNS = (
    f"file_id, file_path, file_size, {_ts('last_modified')}, scan_status, ioc_count, object_key, error_message, "
    f"{_ts('updated_at')}"
)
_STORE_COLUMNS = (
    f"ioc_type, ioc_value, source_file_id, malware_family, confidence, {_ts('first_seen')}, {_ts('last_seen')}"
)
_EXTENSION = "lower(regexp_extract(file_path, '\\.[^./]*$'))"


def _check(order: str, match: str) -> str:
    return f"""{_SRQ}, winner AS (
      SELECT * FROM current_store
      QUALIFY row_number() OVER (PARTITION BY ioc_value ORDER BY {order}, ioc_type, source_file_id) = 1
    )
    SELECT request_id, position, ioc, w.ioc_value IS NOT NULL AS found, ioc_type AS type, source_file_id,
           malware_family, CAST(confidence AS VARCHAR) AS confidence, {_ts('first_seen')}
    FROM asked LEFT JOIN winner w ON w.ioc_value = {match}"""


_BLOCKS = PORTABLE_SKETCH.blocks
_PLACE = f"CAST('0x' || substr(md5(ioc_value), 1, 15) AS BIGINT) % {_BLOCKS}"
_BITS = "CAST('0x' || substr(md5(ioc_value), 16, 15) AS BIGINT)"
_SKETCH = (
    f"sketch AS (SELECT {_PLACE} AS block, "
    + ", ".join(f"bit_or(1::BIGINT << CAST(({_BITS} >> {5 * i}) & 31 AS INTEGER)) AS {w}" for i, w in enumerate(WORD_COLUMNS))
    + " FROM store GROUP BY 1)"
)
_PROBED = (
    f"probed AS (SELECT a.ioc_value, coalesce("
    + " AND ".join(
        f"({w} & (1::BIGINT << CAST((({_BITS}) >> {5 * i}) & 31 AS INTEGER))) <> 0".replace("ioc_value", "a.ioc_value")
        for i, w in enumerate(WORD_COLUMNS)
    )
    + f", false) AS maybe_present FROM (SELECT DISTINCT ioc AS ioc_value FROM asked) a "
    + f"LEFT JOIN sketch ON block = {_PLACE.replace('ioc_value', 'a.ioc_value')})"
)
_INFO = f"""info AS (
  SELECT {PORTABLE_SKETCH.capacity}::BIGINT AS capacity, {PORTABLE_SKETCH.bits // 8}::BIGINT AS size_bytes,
         (SELECT count(DISTINCT ioc_value) FROM store) AS items_inserted,
         CAST((SELECT sum({' + '.join(f'bit_count({w})' for w in WORD_COLUMNS)}) FROM sketch) AS BIGINT) AS bits_set
)"""


# Values fill the layers in the order of a hash; a layer's bound is what it and the earlier ones hold.
_LAYERS = ", ".join(f"({i}, {layer_size(FIRST_LAYER, i).blocks}, {FIRST_LAYER.capacity << i}, {(FIRST_LAYER.capacity << i + 1) - FIRST_LAYER.capacity}, "
                    f"{layer_size(FIRST_LAYER, i).bits // 8})" for i in range(30))
_GROWN = f"""layers(layer, blocks, capacity, upto, bytes) AS (VALUES {_LAYERS}),
asked_values AS (SELECT DISTINCT ioc_value FROM store),
total AS (SELECT count(*) AS n FROM asked_values),
placed AS (
  SELECT ioc_value, (SELECT min(layer) FROM layers, total
    WHERE CAST('0x' || substr(md5('layer' || ioc_value), 1, 15) AS BIGINT) % 1073741824 * n::HUGEINT < least(upto, n) * 1073741824::HUGEINT) AS layer
  FROM asked_values
),
grown AS (
  SELECT CAST(layer AS BIGINT) AS layer, CAST('0x' || substr(md5(ioc_value), 1, 15) AS BIGINT) % blocks AS block, """ + ", ".join(
    f"bit_or(1::BIGINT << CAST(({_BITS} >> {5 * i}) & 31 AS INTEGER)) AS {w}" for i, w in enumerate(WORD_COLUMNS)
) + """ FROM placed JOIN layers USING (layer) GROUP BY 1, 2
)"""


def _histogram(rows: str, value: str, edges, by: str = "") -> str:
    prefix = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    parts = [
        f"SELECT {prefix}'{float(e):g}' AS le, count(*) FILTER ({value} <= {float(e)!r}) AS bucket_count, "
        f"count({value}) AS total, sum(CAST({value} AS DOUBLE)) AS sum_value FROM {rows} {group}"
        for e in edges
    ]
    parts.append(
        f"SELECT {prefix}'+Inf' AS le, count({value}) AS bucket_count, count({value}) AS total, "
        f"sum(CAST({value} AS DOUBLE)) AS sum_value FROM {rows} {group}"
    )
    return " UNION ALL ".join(parts)


def _windows(counted: str) -> str:
    return f"""SELECT w.key_hash, strftime(to_timestamp(window_start) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS window_start,
      requests, greatest(requests - rate_limit, 0) AS exceeded, greatest(rate_limit - requests, 0) AS remaining
    FROM ({counted}) w JOIN current_keys k ON k.key_hash = w.key_hash"""


_SECOND = 'CAST(floor(epoch("timestamp")) AS BIGINT)'
_W = AUDIT_WINDOW_SECONDS

_ANCHORED = f"""WITH RECURSIVE {_LOG},
  per_second AS (SELECT api_key_hash AS key_hash, {_SECOND} AS second, count(*) AS n FROM log GROUP BY 1, 2),
  following AS (
    SELECT a.key_hash, a.second, min(b.second) AS next_second FROM per_second a
    JOIN per_second b ON a.key_hash = b.key_hash AND b.second >= a.second + {_W} GROUP BY 1, 2
  ),
  anchors AS (
    SELECT key_hash, min(second) AS second FROM per_second GROUP BY 1
    UNION ALL
    SELECT f.key_hash, f.next_second FROM anchors a JOIN following f ON f.key_hash = a.key_hash AND f.second = a.second
  ) """

ORACLES: dict[str, str] = {
    "files_by_extension": f"{_F} SELECT file_path, {_EXTENSION} AS extension, file_size FROM files "
                          f"WHERE {_EXTENSION} IN {_list(DEFAULT_EXTENSIONS)}",
    "file_identity": f"{_F} SELECT file_id, file_path, file_size, {_ts('last_modified')} FROM files",
    "registry_upsert": f"{_RUN} SELECT {_REGISTRY_COLUMNS} FROM merged",
    "ioc_load": f"{_FD} SELECT ioc_type, ioc_value, file_id AS source_file_id, 'Unknown' AS malware_family, "
                "50::SMALLINT AS confidence, '2024-06-01T00:00:00Z' AS first_seen, '2024-06-01T00:00:00Z' AS last_seen "
                "FROM found",
    "misc_objects": f"{_O} SELECT object_key, content_type, size, content_md5 FROM objects",
    "object_read": f"{_O} SELECT object_key, content_md5 FROM objects WHERE state = 'known'",
    "object_stat": f"{_O} SELECT object_key, content_type, size FROM objects WHERE state = 'known'",
    "object_exists": f"{_O} SELECT file_id AS object_key, file_id IN (SELECT object_key FROM objects) AS present FROM files",
    "object_list_prefix": f"{_O} SELECT object_key, size FROM objects WHERE starts_with(object_key, 'a')",
    "object_delete": f"{_O} SELECT object_key, size FROM objects WHERE state <> 'touched'",
    "object_read_range": f"{_O}, bytes AS (SELECT file_id AS object_key, substr(hex(encode(content)), 1001, 2400) AS digits FROM files "
                         "WHERE state = 'known' AND file_size > 500 AND file_id IN (SELECT object_key FROM objects)) "
                         "SELECT object_key, CAST(length(digits) // 2 AS BIGINT) AS n_bytes, md5(digits) AS hex_md5 FROM bytes",
    "tree_ingest": "WITH " + _FOUND.replace("last_modified, content, state", f"last_modified, content || CASE state WHEN 'touched' THEN {_q(ADDED_LINE)} ELSE '' END AS content, state", 1)
                   + f", counts AS (SELECT file_id, count(*) AS n FROM found GROUP BY 1) SELECT job, file_path, CASE WHEN coalesce(n, 0) > 0 THEN 'infected' ELSE 'misc' END "
                   f"AS scan_status, coalesce(n, 0) AS ioc_count, CAST(CASE state WHEN 'touched' THEN 2 ELSE 1 END AS BIGINT) AS runs "
                   f"FROM files LEFT JOIN counts USING (file_id), (VALUES ('batch'), ('stream')) AS jobs(job) WHERE {_EXTENSION} IN {_list(DEFAULT_EXTENSIONS)}",
    "query_log_append": f"{_L} SELECT CAST(CASE event_id % 2 WHEN 1 THEN 36 ELSE length(CAST(event_id AS VARCHAR)) END AS INTEGER) AS id_length, 1::BIGINT AS rows_of_id, "
                        f"{_ts('\"timestamp\"', '\"timestamp\"')}, api_key_hash, endpoint, strftime(\"timestamp\", '%Y-%m-%d') AS day FROM log JOIN events ON CAST(event_id AS VARCHAR) = query_id",
    "query_log_compacted": f"{_L} SELECT query_id, {_ts('\"timestamp\"', '\"timestamp\"')}, api_key_hash, endpoint, strftime(\"timestamp\", '%Y-%m-%d') AS day FROM log "
                           "WHERE \"timestamp\" > TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAYS",
    "query_log_retained": f"{_L} SELECT query_id, {_ts('\"timestamp\"', '\"timestamp\"')}, api_key_hash, endpoint FROM log "
                          "WHERE \"timestamp\" > TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAYS",
    "active_keys": f"{_L} SELECT key_hash, key_name, rate_limit, {_ts('last_used')} FROM current_keys WHERE is_active",
    **{f"ioc_{t}": f"{_F} SELECT file_id, ioc_value FROM ({_PER_TYPE[t]})" for t in IOC_TYPES},
    "ioc_ipv4_public": f"{_F} SELECT file_id, ioc_value FROM ({_PER_TYPE['ipv4']}) WHERE NOT ("
                       + " OR ".join(f"starts_with(ioc_value, '{p}')" for p in PRIVATE_IPV4_PREFIXES) + ")",
    "ioc_domain_filtered": f"{_F} SELECT file_id, ioc_value FROM ({_PER_TYPE['domain']}) "
                           f"WHERE ioc_value NOT IN {_list(PLACEHOLDER_DOMAINS)}",
    "ioc_ipv6_whole": f"""{_F}, tokens AS (SELECT file_id, unnest(string_split_regex(content, '[^0-9A-Za-z_:.]+')) AS t FROM files),
      runs AS (SELECT file_id, regexp_extract(t, '^([0-9a-fA-F:]*::[0-9a-fA-F:]*)(?:[.].*)?$', 1) AS v FROM tokens WHERE contains(t, '::'))
      SELECT file_id, v AS ioc_value FROM runs WHERE length(v) BETWEEN 2 AND 39
        AND regexp_matches(v, '^(?:[0-9a-fA-F]{{1,4}}(?::[0-9a-fA-F]{{1,4}})*)?::(?:[0-9a-fA-F]{{1,4}}(?::[0-9a-fA-F]{{1,4}})*)?$')
        AND len(regexp_extract_all(v, '[0-9a-fA-F]+')) <= 7 AND NOT regexp_matches(v, {_P['ipv6_mapped']})
      UNION SELECT file_id, ioc_value FROM ({_matches("ipv6", condition=f"NOT regexp_matches(v, {_P['ipv6_mapped']})", pattern=f"regexp_extract_all(content, {_P['ipv6_full']})")})""",
    "ioc_custom_rule": f"{_F} SELECT DISTINCT file_id, 'percent' AS ioc_type, v AS ioc_value FROM (SELECT file_id, unnest(regexp_extract_all(content, {_q(PERCENT_PATTERN)})) AS v FROM files)",
    "ioc_scan_all": f"{_FD} SELECT file_id, ioc_type, ioc_value FROM found",
    "ioc_scan_map": f"{_FD} SELECT f.file_id, coalesce(string_agg(DISTINCT ioc_type, ' ' ORDER BY ioc_type), '') AS types, "
                    "count(ioc_value) AS ioc_count FROM files f LEFT JOIN found d ON d.file_id = f.file_id GROUP BY 1",
    "ioc_scan_subset": f"{_FD} SELECT file_id, ioc_type, ioc_value FROM found WHERE ioc_type IN ('ipv4', 'sha1', 'email')",
    "ioc_count_per_file": f"{_FD} SELECT f.file_id, count(ioc_value) AS ioc_count FROM files f "
                          "LEFT JOIN found d ON d.file_id = f.file_id GROUP BY f.file_id",
    "ioc_rows_enriched": f"{_FD} SELECT ioc_type, ioc_value, file_id AS source_file_id, 'Unknown' AS malware_family, "
                         "50::SMALLINT AS confidence, '2024-06-01T00:00:00Z' AS first_seen, "
                         "'2024-06-01T00:00:00Z' AS last_seen, 0::BIGINT AS hit_count FROM found",
    "content_type": f"{_F} SELECT file_path, {_CONTENT_TYPE} AS content_type FROM files",
    "enum_violations": f"{_F} SELECT file_id, scan_status FROM (SELECT file_id, CASE state WHEN 'new' THEN 'pending' "
                       f"ELSE state END AS scan_status FROM files) WHERE scan_status NOT IN {_list(SCAN_STATUSES)}",
    "changed_files_bucketed": f"{_RUN} SELECT file_id, file_path FROM changed",
    "changed_files": f"{_RUN} SELECT file_id, file_path FROM changed",
    "failed_files_again": f"{_RUN} SELECT file_id, file_path FROM files WHERE file_id IN (SELECT file_id FROM changed) "
                          "OR file_size % 5 = 0",
    "skipped_files": f"{_RUN} SELECT file_id, file_path FROM files WHERE file_id NOT IN (SELECT file_id FROM changed)",
    "file_verdicts": f"{_RUN} SELECT file_id, scan_status, ioc_count, object_key, error_message FROM this_run",
    "check_request_valid": f"{_RQ} SELECT request_id, len(iocs) AS n_iocs, len(iocs) BETWEEN 1 AND 10 AS is_valid, "
                           "CASE WHEN len(iocs) = 0 THEN 'No IOCs provided' WHEN len(iocs) > 10 THEN 'Too many IOCs' "
                           "ELSE '' END AS error FROM requests",
    "ioc_lookup": f"{_SRQ} SELECT {_STORE_COLUMNS} FROM current_store WHERE ioc_value IN (SELECT ioc FROM asked)",
    "ioc_check": _check("last_seen", "asked.ioc"),
    "ioc_check_latest": _check("last_seen DESC", "lower(asked.ioc)"),
    "check_answers": f"SELECT request_id, position, ioc, found, type, source_file_id, '' AS error FROM ({_check('last_seen', 'asked.ioc').replace('FROM asked LEFT JOIN', f'FROM asked JOIN (SELECT request_id FROM requests WHERE len(iocs) <= {MAX_ASKED}) USING (request_id) LEFT JOIN')}) "
                     f"UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, 'Too many IOCs' FROM ({_RQ} SELECT request_id FROM requests WHERE len(iocs) > {MAX_ASKED})",
    "check_requests_json": f"{_RQ} SELECT request_id AS line_id, CASE WHEN file_size % 5 = 0 THEN 0 ELSE len(iocs) END AS n_iocs, "
                           "CASE WHEN file_size % 5 = 0 THEN 'Invalid request body' ELSE '' END AS error FROM requests JOIN files ON file_id = request_id",
    "ioc_check_bloom": _check("last_seen", "asked.ioc"),
    "file_context": f"WITH {_FOUND}{_REGISTRY_ONLY}{_RUN_ONLY}{_OBJECTS_ONLY} "
                    f"SELECT m.file_id, m.file_path, m.file_size, {_ts('m.last_modified')}, m.ioc_count, "
                    "coalesce(nullif(m.object_key, ''), m.file_id) AS object_key, content_type, "
                    "CAST(size AS VARCHAR) AS size FROM merged m "
                    "LEFT JOIN objects o ON o.object_key = coalesce(nullif(m.object_key, ''), m.file_id)",
    "ioc_provenance": f"WITH {_FOUND}{_STORE_ONLY}{_REGISTRY_ONLY} SELECT ioc_type, ioc_value, source_file_id, file_path, "
                      "scan_status, confidence FROM current_store JOIN current_registry ON file_id = source_file_id",
    "requests_by_key": f"{_L} SELECT key_hash, key_name, is_active, requests, total_ms FROM current_keys JOIN "
                       "(SELECT api_key_hash, count(*) AS requests, CAST(sum(response_time_ms) AS BIGINT) AS total_ms "
                       "FROM log GROUP BY 1) ON api_key_hash = key_hash",
    "ioc_stats_by_type": f"{_S} SELECT ioc_type, count(*) AS cnt FROM current_store GROUP BY 1",
    "file_stats_by_status": f"{_R} SELECT scan_status, count(*) AS cnt FROM current_registry GROUP BY 1",
    "ioc_daily": f"{_S} SELECT ioc_type, strftime(first_seen, '%Y-%m-%d') AS date, count(*) AS count FROM store GROUP BY 1, 2",
    "ioc_daily_live": f"{_S} SELECT ioc_type, strftime(first_seen, '%Y-%m-%d') AS date, count(*) AS count "
                      "FROM current_store GROUP BY 1, 2",
    "ingest_summary": f"{_RUN} SELECT count(*) AS files_processed, (SELECT count(*) FROM files) - count(*) AS files_skipped, "
                      "0::BIGINT AS files_failed, CAST(sum(ioc_count) AS BIGINT) AS iocs_extracted, "
                      "CAST(sum(file_size) AS BIGINT) AS bytes_processed FROM this_run",
    "run_counters": f"{_RUN} SELECT 'files_processed' AS counter, scan_status AS label, count(*) AS value FROM this_run "
                    "GROUP BY 2 UNION ALL SELECT 'iocs_extracted', ioc_type, count(*) FROM found "
                    "WHERE file_id IN (SELECT file_id FROM changed) GROUP BY 2",
    "check_summary": f"SELECT request_id, count(*) AS total, count(*) FILTER (found) AS found, "
                     f"count(*) FILTER (NOT found) AS not_found FROM ({_check('last_seen', 'asked.ioc')}) GROUP BY 1",
    "system_stats": f"WITH {_FOUND}{_STORE_ONLY}{_REGISTRY_ONLY}, {_SKETCH}, {_INFO} "
                    "SELECT 'ioc_stats' AS section, ioc_type AS key, count(*) AS value FROM current_store GROUP BY 2 "
                    "UNION ALL SELECT 'file_stats', scan_status, count(*) FROM current_registry GROUP BY 2 "
                    "UNION ALL SELECT 'bloom_filter_info', 'capacity', capacity FROM info "
                    "UNION ALL SELECT 'bloom_filter_info', 'size_bytes', size_bytes FROM info "
                    "UNION ALL SELECT 'bloom_filter_info', 'items_inserted', items_inserted FROM info",
    "request_counters": f"{_L} SELECT endpoint, method, CASE WHEN status_code >= 400 THEN 'error' ELSE 'success' END "
                        "AS status, count(*) AS requests FROM log GROUP BY 1, 2, 3",
    "latency_histogram": f"{_L} SELECT endpoint, method, le, bucket_count, total, round(sum_value, 3) AS sum_value FROM ("
                         + _histogram("log", "response_seconds", HISTOGRAM_EDGES["api_latency_seconds"], "endpoint, method")
                         + ")",
    "file_size_histogram": f"{_FD}, counts AS (SELECT f.file_id, count(ioc_value) AS ioc_count FROM files f "
                           "LEFT JOIN found d ON d.file_id = f.file_id GROUP BY 1) "
                           + _histogram("counts", "ioc_count", HISTOGRAM_EDGES["batch_insert_size"]),
    "file_time_histogram": f"{_R} SELECT scan_status, le, bucket_count, total, round(sum_value, 3) AS sum_value FROM ("
                           + _histogram("registry", "(file_size / 1000000.0::DOUBLE)", HISTOGRAM_EDGES["file_processing_seconds"], "scan_status") + ")",
    "insert_time_histogram": f"{_FD}, counts AS (SELECT f.file_id, count(ioc_value) AS ioc_count FROM files f LEFT JOIN found d ON d.file_id = f.file_id GROUP BY 1) "
                             "SELECT le, bucket_count, total, round(sum_value, 3) AS sum_value FROM ("
                             + _histogram("counts", "(ioc_count / 1000.0::DOUBLE)", HISTOGRAM_EDGES["batch_insert_seconds"]) + ")",
    "query_time_histogram": f"{_L} SELECT le, bucket_count, total, round(sum_value, 3) AS sum_value FROM ("
                            + _histogram("log", "response_seconds", HISTOGRAM_EDGES["query_seconds"]) + ")",
    "api_totals": f"{_L} SELECT count(*) AS total_requests, round(avg(response_time_ms), 6) AS average_latency_ms FROM log",
    "ioc_hit_count": f"{_SRQ}, hits AS (SELECT ioc_value, count(*) AS n FROM "
                     "(SELECT unnest(list_concat(v, v[1:1])) AS ioc_value FROM per_file) GROUP BY 1) "
                     "SELECT ioc_type, ioc_value, source_file_id, coalesce(n, 0) AS hit_count "
                     "FROM current_store LEFT JOIN hits USING (ioc_value)",
    "registry_latest": f"{_R} SELECT {_REGISTRY_COLUMNS} FROM current_registry",
    "ioc_latest": f"{_S} SELECT {_STORE_COLUMNS} FROM current_store",
    "keys_latest": f"{_L} SELECT key_hash, key_name, rate_limit, is_active, {_ts('last_used')} FROM current_keys",
    "file_metadata": f"WITH {_FOUND}{_REGISTRY_ONLY} SELECT {_REGISTRY_COLUMNS} FROM current_registry "
                     "WHERE file_id IN (SELECT file_id FROM found)",
    "rate_limit_audit": f"{_L} " + _windows(
        f"SELECT api_key_hash AS key_hash, {_SECOND} - {_SECOND} % {_W} AS window_start, count(*) AS requests FROM log GROUP BY 1, 2"
    ),
    "rate_limit_anchored": _ANCHORED + _windows(
        "SELECT a.key_hash, a.second AS window_start, CAST(sum(n) AS BIGINT) AS requests FROM anchors a JOIN per_second s "
        f"ON s.key_hash = a.key_hash AND s.second >= a.second AND s.second < a.second + {_W} GROUP BY 1, 2"
    ),
    "bloom_build": f"{_S}, {_SKETCH} SELECT * FROM sketch",
    "bloom_extend": f"{_S}, {_SKETCH} SELECT * FROM sketch",
    "bloom_probe": f"{_SRQ}, {_SKETCH}, {_PROBED} SELECT ioc_value, maybe_present FROM probed",
    "bloom_grow": f"{_S}, {_GROWN} SELECT * FROM grown",
    "bloom_grow_info": f"{_S}, {_GROWN}, opened AS (SELECT DISTINCT layer FROM placed) SELECT CAST(sum(capacity) AS BIGINT) AS capacity, "
                       "CAST(sum(bytes) AS BIGINT) AS size_bytes, (SELECT n FROM total) AS items_inserted, "
                       f"(SELECT CAST(sum({' + '.join(f'CAST(bit_count({w}) AS BIGINT)' for w in WORD_COLUMNS)}) AS BIGINT) FROM grown) AS bits_set, count(*) - 1 AS expansions "
                       "FROM opened JOIN layers USING (layer)",
    "bloom_info": f"{_S}, {_SKETCH}, {_INFO} SELECT *, round(bits_set / {PORTABLE_SKETCH.bits}, 6) AS fill_ratio FROM info",
    "gate_stats": f"{_SRQ}, {_SKETCH}, {_PROBED} SELECT count(*) AS total, count(*) FILTER (maybe_present) AS bloom_hits, "
                  "count(*) FILTER (NOT maybe_present) AS bloom_misses FROM probed",
    "vector_dim_violations": "SELECT vec_id AS id, len(embedding[1:60 + label]) AS dimensions FROM embeddings "
                             "WHERE len(embedding[1:60 + label]) <> 64",
    "vector_upsert": "SELECT vec_id AS id, CAST(label AS VARCHAR) AS payload, "
                     "CASE WHEN label IN (1, 3, 5) THEN 2 ELSE 1 END AS version, CAST(CASE WHEN label IN (1, 3, 5) "
                     "THEN embedding[len(embedding)] ELSE embedding[1] END AS DOUBLE) AS first_number FROM embeddings",
    "vector_topk": f"""WITH centres AS (
        SELECT label, list(x ORDER BY i) AS c FROM (
          SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
          FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2
        ) GROUP BY 1
      ), scored AS (
        SELECT CAST(c.label AS BIGINT) AS query_id, vec_id AS id,
               round(list_cosine_similarity(c.c, CAST(embedding AS DOUBLE[])), 6) AS score
        FROM centres c, embeddings
      )
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score
      FROM scored QUALIFY rank <= {TOP_K}""",
    "vector_topk_filtered": f"""WITH centres AS (
        SELECT label, list(x ORDER BY i) AS c FROM (
          SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
          FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2
        ) GROUP BY 1
      ), scored AS (
        SELECT CAST(c.label AS BIGINT) AS query_id, vec_id AS id,
               round(list_cosine_similarity(c.c, CAST(embedding AS DOUBLE[])), 6) AS score
        FROM centres c, embeddings e WHERE e.label < 5 AND vec_id % 2 = 0
      )
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score
      FROM scored QUALIFY rank <= {TOP_K}""",
    "vector_topk_many": f"""WITH scored AS (
        SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0
      )
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score, 1.0::DOUBLE AS recall
      FROM scored QUALIFY rank <= {TOP_K}""",
    "fuzzy_search": f"{_F}, names AS (SELECT DISTINCT ioc_value AS name FROM ({_PER_TYPE['domain']})), "
                    "hosts AS (SELECT DISTINCT lower(split_part(url, '/', 3)) AS name FROM pages WHERE split_part(url, '/', 3) <> '') "
                    "SELECT a.name AS left_name, b.name AS right_name, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance "
                    f"FROM hosts a JOIN names b ON levenshtein(a.name, b.name) <= {FUZZY_DISTANCE}",
    "fuzzy_domain": f"{_F}, names AS (SELECT DISTINCT ioc_value AS name FROM ({_PER_TYPE['domain']})) "
                    "SELECT a.name AS left_name, b.name AS right_name, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance "
                    f"FROM names a JOIN names b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= {FUZZY_DISTANCE}",
    "stream_ingest": f"{_RUN} SELECT file_id, file_path, CASE WHEN coalesce(ioc_count, 0) > 0 THEN 'infected' ELSE 'misc' "
                     "END AS scan_status, coalesce(ioc_count, 0) AS ioc_count, CASE WHEN coalesce(ioc_count, 0) > 0 "
                     "THEN '' ELSE file_id END AS object_key FROM files LEFT JOIN counts USING (file_id)",
    "stream_daily": f"{_FD} SELECT ioc_type, strftime(last_modified, '%Y-%m-%d') AS date, count(*) AS count "
                    "FROM found JOIN files USING (file_id) GROUP BY 1, 2",
    "stream_distinct": f"{_FD} SELECT file_id, ioc_type, ioc_value FROM found JOIN files USING (file_id)",
    "stream_rate_limit": _ANCHORED + "SELECT a.key_hash, strftime(to_timestamp(a.second) AT TIME ZONE 'UTC', "
                         "'%Y-%m-%dT%H:%M:%SZ') AS window_start, CAST(sum(n) AS BIGINT) AS requests "
                         "FROM anchors a JOIN per_second s ON s.key_hash = a.key_hash AND s.second >= a.second "
                         f"AND s.second < a.second + {_W} GROUP BY a.key_hash, a.second",
    "stream_check": f"""{_S}, winner AS (
        SELECT * FROM current_store QUALIFY row_number() OVER (PARTITION BY ioc_value ORDER BY last_seen, ioc_type, source_file_id) = 1
      )
      SELECT f.file_id AS request_id, f.ioc_value AS ioc, w.ioc_value IS NOT NULL AS found, w.ioc_type AS type, w.source_file_id
      FROM found f LEFT JOIN winner w ON w.ioc_value = f.ioc_value""",
}

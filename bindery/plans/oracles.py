"""SQL for DuckDB that computes the registered queries independently.

Written from the rules, with plain windows and joins over the raw tables, so
that it shares no code path with the Spark jobs it checks.
"""

from __future__ import annotations

# --- views over the raw tables -------------------------------------------------

_REGION = (
    "CASE {0} % 5 WHEN 0 THEN 'APAC' WHEN 1 THEN 'EMEA' WHEN 2 THEN 'US'"
    " WHEN 3 THEN 'UK' ELSE 'LATAM' END"
)

SUBMISSIONS = f"""
submissions AS (
  SELECT event_id AS seq, ts AS uploaded_at,
    'CSI-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS csi_id,
    {_REGION.format("user_id")} AS region,
    upper(event_type) AS regulation,
    'report_' || (event_id % 2) || '.json' AS json_name,
    '{{"report":{{"name":"R' || CAST(floor(value / 20) AS INT) || '"}}}}' AS json_text,
    'q_' || (event_id % 7) || '.sql' AS sql_name,
    'SELECT ' || length(props) AS sql_text,
    CASE WHEN event_id % 3 <> 0 THEN 't_' || (event_id % 4) || '.txt' END AS tpl_name,
    CASE WHEN event_id % 3 <> 0 THEN 'tpl ' || CAST(floor(value / 40) AS INT) END AS tpl_text
  FROM events)"""

ORDER_BUNDLES = f"""
order_bundles AS (
  SELECT o_orderkey AS seq, o_orderdate AS uploaded_at,
    'CSI-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS csi_id,
    {_REGION.format("o_custkey")} AS region,
    CASE o_orderpriority[1] WHEN '1' THEN 'CLICK' WHEN '2' THEN 'VIEW' WHEN '3' THEN 'ERROR'
      WHEN '4' THEN 'SIGNUP' ELSE 'PURCHASE' END AS regulation,
    'report_' || (o_orderkey % 2) || '.json' AS json_name,
    '{{"report":{{"name":"R' || CAST(floor(o_totalprice / 100000) AS INT) || '"}}}}' AS json_text,
    'q_' || (o_orderkey % 7) || '.sql' AS sql_name,
    'SELECT ' || o_orderstatus AS sql_text,
    CASE WHEN o_orderstatus <> 'P' THEN 't_0.html' END AS tpl_name,
    CASE WHEN o_orderstatus <> 'P' THEN 'tpl ' || CAST(floor(o_totalprice / 200000) AS INT) END
      AS tpl_text,
    o_orderstatus, o_orderpriority
  FROM orders)"""

DOCUMENTS = """
docs AS (
  SELECT doc_id AS seq, TIMESTAMP '2024-01-01 00:00:00' AS uploaded_at,
    source AS csi_id, upper(lang) AS region, 'DOCS' AS regulation, 'doc.json' AS json_name,
    '{"report":{"name":"' || source || ' ' || lang || '"},"chars":' || n_chars || '}' AS json_text,
    'body_' || doc_id || '.sql' AS sql_name, text AS sql_text,
    CASE WHEN n_chars > 1500 THEN 'long.html' END AS tpl_name,
    CASE WHEN n_chars > 1500 THEN '<p>' || CAST(floor(n_chars / 1000) AS INT) || 'k</p>' END
      AS tpl_text
  FROM documents)"""

CHATS = """
chats AS (
  SELECT conv_id * 1048576 + turn AS seq, TIMESTAMP '2024-01-01 00:00:00' AS uploaded_at,
    'CONV-' || conv_id AS csi_id, 'CHAT' AS region, 'TURNS' AS regulation,
    'chat.json' AS json_name, '{"report":{"name":"' || role || '"}}' AS json_text,
    'turn.sql' AS sql_name, text AS sql_text,
    CAST(NULL AS VARCHAR) AS tpl_name, CAST(NULL AS VARCHAR) AS tpl_text
  FROM conversations)"""

PAGES = """
page_bundles AS (
  SELECT page_id AS seq, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS csi_id,
    regexp_extract(url, '^[a-z]+://[^/?#]*/([^/]*)', 1) AS region,
    string_split(url, '/')[-1] AS regulation,
    'page.json' AS json_name, '{"report":{"name":"page ' || page_id || '"}}' AS json_text,
    'sql/page_' || page_id || '.sql' AS sql_name, 'SELECT ' || page_id AS sql_text,
    'page.html' AS tpl_name, html AS tpl_text
  FROM pages)"""

FLAWED = f"""{SUBMISSIONS},
flawed AS (
  SELECT seq, uploaded_at,
    CASE WHEN seq % 11 = 0 THEN replace(csi_id, '-', ' ') ELSE csi_id END AS csi_id,
    CASE WHEN seq % 13 = 0 THEN '  ' ELSE region END AS region,
    CASE WHEN seq % 31 <> 0 THEN regulation END AS regulation,
    CASE WHEN seq % 61 = 0 THEN 'report.yaml' ELSE json_name END AS json_name,
    CASE WHEN seq % 19 = 0 THEN '{{"report":' WHEN seq % 29 = 0 THEN '{{"report":{{"name":7}}}}'
      WHEN seq % 41 = 0 THEN NULL WHEN seq % 43 = 0 THEN '' WHEN seq % 47 = 0 THEN '[1]'
      WHEN seq % 53 = 0 THEN '{{"name":"x"}}' WHEN seq % 59 = 0 THEN '{{"report":{{"name":" "}}}}'
      ELSE json_text END AS json_text,
    CASE WHEN seq % 17 = 0 THEN 'q.txt' ELSE sql_name END AS sql_name,
    CASE WHEN seq % 23 = 0 THEN ' ' || chr(9) || chr(10) ELSE sql_text END AS sql_text,
    CASE WHEN seq % 37 = 0 AND tpl_text IS NOT NULL THEN 't.pdf' ELSE tpl_name END AS tpl_name,
    tpl_text
  FROM submissions)"""

MANIFESTS = f"""{SUBMISSIONS},
grouped AS (
  SELECT seq // 8 AS manifest,
    list({{'csi_id': csi_id, 'region': region, 'regulation': regulation, 'json_config': json_name,
      'sql_file': sql_name, 'template': tpl_name, 'gone': coalesce(tpl_text = 'tpl 0', false)}}
      ORDER BY seq) AS rows,
    arg_min(regulation, seq) AS first
  FROM submissions GROUP BY 1),
manifests AS (
  SELECT 'manifest_' || manifest AS source,
    CASE WHEN first = 'ERROR' THEN NULL WHEN first = 'SIGNUP' THEN rows[1:0] ELSE rows END
      AS bundles FROM grouped),
entries AS (
  SELECT source, unnest(range(len(bundles))) AS idx, unnest(bundles) AS b FROM manifests),
manifest_entries AS (
  SELECT source, CAST(idx AS INT) AS index, NOT b.gone AS is_mapping,
    CASE WHEN NOT b.gone THEN b.csi_id END AS csi_id,
    CASE WHEN NOT b.gone THEN b.region END AS region,
    CASE WHEN NOT b.gone THEN b.regulation END AS regulation,
    CASE WHEN NOT b.gone THEN b.json_config END AS json_config,
    CASE WHEN NOT b.gone THEN b.sql_file END AS sql_file,
    CASE WHEN NOT b.gone THEN b.template END AS template
  FROM entries)"""

# --- routing -------------------------------------------------------------------

_KEY = "csi_id, region, regulation, json_name"


def _uuid(*parts: str) -> str:
    return (
        f"regexp_replace(sha256(concat_ws('|', {', '.join(parts)})),"
        " '^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$', '\\1-\\2-8\\3-a\\4-\\5')"
    )


def _list(*pairs: tuple[str, str]) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + ")"


def route_sql(source: str, batch: str = "0", base: str | None = None, p: str = "") -> str:
    """CTEs `{p}routed` and `{p}v` for the bundles of `source`, on top of `base`."""
    based = (
        f"""
  UNION ALL
  SELECT -1, uploaded_at, csi_id, region, regulation, json_name, sql_name, tpl_name, name,
    json_sum, sql_sum, tpl_sum, json_size, sql_size, tpl_size, report_id, version
  FROM {base} WHERE (csi_id, region, regulation, json_name) IN (SELECT ({_KEY}) FROM {source})"""
        if base
        else ""
    )
    own = _uuid("csi_id", "region", "regulation", "json_name", f"'{batch}'", "seq")
    return f"""
{p}facts AS (
  SELECT seq, uploaded_at, csi_id, region, regulation, json_name, sql_name, tpl_name,
    json_text ->> '$.report.name' AS name,
    'sha256:' || sha256(json_text) AS json_sum, 'sha256:' || sha256(sql_text) AS sql_sum,
    'sha256:' || sha256(tpl_text) AS tpl_sum,
    CAST(strlen(json_text) AS BIGINT) AS json_size, CAST(strlen(sql_text) AS BIGINT) AS sql_size,
    CAST(strlen(tpl_text) AS BIGINT) AS tpl_size,
    CAST(NULL AS VARCHAR) AS base_report, CAST(NULL AS INT) AS base_version
  FROM {source}{based}),
{p}prev AS (
  SELECT *, lag(json_sum) OVER k AS prev_json, lag(sql_sum) OVER k AS prev_sql,
    last_value(tpl_sum IGNORE NULLS) OVER (PARTITION BY {_KEY} ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_tpl
  FROM {p}facts WINDOW k AS (PARTITION BY {_KEY} ORDER BY seq)),
{p}flags AS (
  SELECT *, prev_json IS NULL AS is_first,
    json_sum IS DISTINCT FROM prev_json AS cj, sql_sum IS DISTINCT FROM prev_sql AS cs,
    tpl_sum IS DISTINCT FROM prev_tpl AS dt,
    tpl_sum IS NOT NULL AND tpl_sum IS DISTINCT FROM prev_tpl AS ct
  FROM {p}prev),
{p}scanned AS (
  SELECT *, is_first OR cj OR cs OR ct AS is_new,
    CAST(sum(coalesce(base_version, CAST(is_first OR cj OR cs OR ct AS INT))) OVER k AS INT)
      AS version,
    last_value(coalesce(base_report, CASE WHEN is_first THEN {own} END) IGNORE NULLS) OVER k
      AS report_id,
    last_value(CASE WHEN cs THEN sql_name END IGNORE NULLS) OVER k AS e_sql_name,
    last_value(CASE WHEN ct THEN tpl_name END IGNORE NULLS) OVER k AS e_tpl_name,
    last_value(CASE WHEN ct THEN tpl_sum END IGNORE NULLS) OVER k AS e_tpl_sum,
    last_value(CASE WHEN ct THEN tpl_size END IGNORE NULLS) OVER k AS e_tpl_size
  FROM {p}flags WINDOW k AS (PARTITION BY {_KEY} ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}routed AS (
  SELECT *, CASE WHEN is_first THEN 'created' WHEN cj OR cs OR dt THEN 'updated'
      ELSE 'skipped' END AS status,
    CASE WHEN is_first THEN 'new record'
      WHEN cj OR cs OR dt THEN 'changed: ' ||
        {_list(("cj", "json_config"), ("cs", "sql_file"), ("dt", "template"))}
      ELSE 'checksums unchanged' END AS reason,
    {_list(("cj", "json_config"), ("cs", "sql_file"), ("ct", "template"))} AS changed
  FROM {p}scanned WHERE base_version IS NULL),
{p}v AS (
  SELECT report_id, csi_id, region, regulation, name, json_name, e_sql_name AS sql_name,
    e_tpl_name AS tpl_name, json_sum, sql_sum, e_tpl_sum AS tpl_sum, json_size, sql_size,
    e_tpl_size AS tpl_size, uploaded_at, version,
    CASE WHEN version = 1 THEN 'Initial seed from manifest' ELSE
      'Changed: ' || changed || ' (v' || (version - 1) || ' → v' || version || ')' END AS change
  FROM {p}routed WHERE is_new)"""


_SUB_ROUTED = SUBMISSIONS + "," + route_sql("submissions")
_CURRENT = """
c AS (
  SELECT *, lead(uploaded_at) OVER w AS superseded_at, lead(version) OVER w IS NULL AS active
  FROM v WINDOW w AS (PARTITION BY report_id ORDER BY version)),
act AS (SELECT * FROM c WHERE active)"""
_REG = _SUB_ROUTED + "," + _CURRENT
_CUT_ROUTED = (
    SUBMISSIONS
    + ", cut AS (SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN region END AS region)"
    + " FROM submissions),"
    + route_sql("cut")
)
_DOC = DOCUMENTS + "," + route_sql("docs") + "," + _CURRENT
_SECOND = _REG + "," + ORDER_BUNDLES + "," + route_sql("order_bundles", "1", "act", "b_")

_IDS = "report_id, csi_id, region, regulation"
_FLAT = (
    f"{_IDS}, name, json_name, sql_name, tpl_name, json_sum, sql_sum, tpl_sum, json_size,"
    " sql_size, tpl_size, uploaded_at, version"
)
_PAGE_ORDER = "csi_id, region, regulation, report_id, version"

# --- patches -------------------------------------------------------------------

_NO_ID = _uuid("o.csi_id", "o.region", "o.regulation", "o.json_name", "'none'", "o.seq")
_PATCHES = f"""{_REG},{ORDER_BUNDLES},
patches AS (
  SELECT o.seq, coalesce(a.report_id, {_NO_ID}) AS report_id, o.uploaded_at,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN o.json_name
      WHEN '2-HIGH' THEN 'moved_' || right(o.csi_id, 1) || '.json' END AS json_name,
    CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o.json_text END AS json_text,
    CASE WHEN o.o_orderstatus = 'O' THEN o.sql_name END AS sql_name,
    CASE WHEN o.o_orderstatus = 'O' THEN o.sql_text END AS sql_text,
    CASE WHEN o.o_orderstatus = 'F' THEN o.tpl_name END AS tpl_name,
    CASE WHEN o.o_orderstatus = 'F' THEN o.tpl_text END AS tpl_text
  FROM order_bundles o LEFT JOIN act a USING ({_KEY})),
key_patches AS (
  SELECT o.seq, a.report_id, csi_id, region, regulation, json_name, o.json_text, o.uploaded_at,
    CASE WHEN o.o_orderstatus = 'F' THEN o.sql_name END AS sql_name,
    CASE WHEN o.o_orderstatus = 'F' THEN o.sql_text END AS sql_text, o.tpl_name, o.tpl_text
  FROM order_bundles o LEFT JOIN act a USING ({_KEY}))"""


def _patch_sql(source: str) -> str:
    def keep(column: str, brought: str) -> str:
        return (
            f"coalesce(last_value(CASE WHEN ok AND {brought} IS NOT NULL THEN {column} END"
            f" IGNORE NULLS) OVER k, b_{column}) AS {column}"
        )

    files = ",\n    ".join(
        keep(f"{s}_{c}", f"{s}_sum") for s in ("json", "sql", "tpl") for c in ("name", "sum", "size")
    )
    return f"""
pf AS (
  SELECT seq, report_id, uploaded_at, json_name, sql_name, tpl_name,
    json_text ->> '$.report.name' AS name,
    'sha256:' || sha256(json_text) AS json_sum, 'sha256:' || sha256(sql_text) AS sql_sum,
    'sha256:' || sha256(tpl_text) AS tpl_sum,
    CAST(strlen(json_text) AS BIGINT) AS json_size, CAST(strlen(sql_text) AS BIGINT) AS sql_size,
    CAST(strlen(tpl_text) AS BIGINT) AS tpl_size
  FROM {source}),
pb AS (
  SELECT pf.*, a.csi_id, a.region, a.regulation, a.version AS b_version, a.name AS b_name,
    a.json_name AS b_json_name, a.sql_name AS b_sql_name, a.tpl_name AS b_tpl_name,
    a.json_sum AS b_json_sum, a.sql_sum AS b_sql_sum, a.tpl_sum AS b_tpl_sum,
    a.json_size AS b_json_size, a.sql_size AS b_sql_size, a.tpl_size AS b_tpl_size,
    CASE WHEN pf.json_sum IS NULL AND pf.sql_sum IS NULL AND pf.tpl_sum IS NULL
        THEN 'At least one file must be provided for modification.'
      WHEN a.report_id IS NULL
        THEN 'No active record found with report_id ''' || pf.report_id || '''' END AS error0
  FROM pf LEFT JOIN act a ON a.report_id = pf.report_id),
moves AS (
  SELECT csi_id, region, regulation, json_name, arg_min(report_id, seq) AS claimer FROM pb
  WHERE error0 IS NULL AND json_name <> b_json_name GROUP BY ALL),
owners AS (
  SELECT m.csi_id, m.region, m.regulation, m.json_name, coalesce(a.report_id, claimer) AS owner
  FROM moves m LEFT JOIN act a USING ({_KEY})),
pe AS (
  SELECT pb.*, coalesce(error0, CASE WHEN json_name <> b_json_name AND owner <> report_id THEN
      'Modify failed for report_id=''' || report_id ||
      ''': another active record holds json_config ''' || json_name || '''' END) AS error
  FROM pb LEFT JOIN owners USING ({_KEY})),
pk AS (SELECT *, error IS NULL AS ok FROM pe),
patched AS (
  SELECT seq, report_id, csi_id, region, regulation, uploaded_at, error,
    CASE WHEN ok THEN 'updated' ELSE 'failed' END AS status,
    CASE WHEN ok THEN CAST(b_version + sum(CAST(ok AS INT)) OVER k AS INT) END AS version,
    CASE WHEN ok THEN {_list(("json_sum IS NOT NULL", "json_config"),
                             ("sql_sum IS NOT NULL", "sql_file"),
                             ("tpl_sum IS NOT NULL", "template"))} END AS changed,
    coalesce(last_value(CASE WHEN ok AND json_sum IS NOT NULL THEN name END IGNORE NULLS) OVER k,
      b_name) AS name,
    {files}
  FROM pk WINDOW k AS (PARTITION BY report_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


_PATCHED = _PATCHES + "," + _patch_sql("patches")
_KEY_PATCHED = (
    _PATCHES
    + ", found_patches AS (SELECT * FROM key_patches WHERE report_id IS NOT NULL),"
    + _patch_sql("found_patches")
)

# --- a mixed batch, one row after another --------------------------------------

_K3 = "csi_id, region, regulation"
_OWN_ID = _uuid("csi_id", "region", "regulation", "json_name", "'1'", "seq")
_MIXED = f"""RECURSIVE {_REG},{ORDER_BUNDLES},
ops AS (
  SELECT o.seq, {_K3}, o.uploaded_at,
    CASE WHEN o.seq % 5 > 2 THEN 'patch_id' WHEN o.seq % 5 = 2 THEN 'patch_key' ELSE 'bundle' END
      AS kind,
    CASE WHEN o.seq % 5 > 2 THEN coalesce(a.report_id, {_NO_ID}) END AS report_id,
    CASE WHEN o.seq % 5 <= 2 THEN json_name WHEN o.seq // 5 % 4 = 1 THEN 'report_0.json'
      WHEN o.seq // 5 % 4 = 2 THEN 'report_1.json' WHEN o.seq // 5 % 4 = 3 THEN 'moved.json' END
      AS json_name,
    CASE WHEN o.seq % 5 <= 2 OR o.seq // 5 % 4 > 0 THEN 'sha256:' || sha256(o.json_text) END AS js,
    CASE WHEN o.seq % 5 < 2 OR o.o_orderstatus = 'O' THEN o.sql_name END AS sn,
    CASE WHEN o.seq % 5 < 2 OR o.o_orderstatus = 'O' THEN 'sha256:' || sha256(o.sql_text) END AS ss,
    CASE WHEN o.seq % 5 < 2 OR o.o_orderstatus = 'F' THEN o.tpl_name END AS tn,
    CASE WHEN o.seq % 5 < 2 OR o.o_orderstatus = 'F' THEN 'sha256:' || sha256(o.tpl_text) END AS ts
  FROM order_bundles o LEFT JOIN act a USING ({_KEY})),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {_K3} ORDER BY seq) AS n, {_OWN_ID} AS own FROM ops),
held AS (
  SELECT {_K3}, list({{'rid': report_id, 'jn': json_name, 'v': version, 'js': json_sum,
    'sn': sql_name, 'ss': sql_sum, 'tn': tpl_name, 'ts': tpl_sum}}) AS state FROM act GROUP BY ALL),
steps AS (
  SELECT {_K3}, 0::BIGINT AS n, coalesce(state, []) AS state, NULL::BIGINT AS seq,
    NULL::VARCHAR AS kind, NULL::VARCHAR AS report_id, NULL::VARCHAR AS status,
    NULL::VARCHAR AS error, NULL::VARCHAR AS changed, held.state[1] AS rec
  FROM (SELECT DISTINCT {_K3} FROM numbered) LEFT JOIN held USING ({_K3})
  UNION ALL
  SELECT {_K3}, n, CASE WHEN status IN ('created', 'updated')
      THEN list_append(list_filter(state, lambda x: x.rid <> rec.rid), rec) ELSE state END,
    seq, kind, CASE WHEN kind = 'patch_id' THEN report_id ELSE rec.rid END, status, error,
    CASE WHEN status <> 'failed' THEN changed END, rec
  FROM (
    SELECT *, CASE WHEN status <> 'failed' THEN {{
        'rid': coalesce(r.rid, own), 'jn': coalesce(json_name, r.jn),
        'v': CAST(CASE WHEN r.rid IS NULL THEN 1 WHEN kind <> 'bundle' OR cj OR cs OR ct
          THEN r.v + 1 ELSE r.v END AS INT),
        'js': coalesce(js, r.js),
        'sn': CASE WHEN cs THEN sn ELSE r.sn END, 'ss': CASE WHEN cs THEN ss ELSE r.ss END,
        'tn': CASE WHEN ct THEN tn ELSE r.tn END, 'ts': CASE WHEN ct THEN ts ELSE r.ts END}} END
        AS rec,
      {_list(("cj", "json_config"), ("cs", "sql_file"), ("ct", "template"))} AS changed
    FROM (
      SELECT *, js IS NOT NULL AND (kind <> 'bundle' OR js IS DISTINCT FROM r.js) AS cj,
        ss IS NOT NULL AND (kind <> 'bundle' OR ss IS DISTINCT FROM r.ss) AS cs,
        ts IS NOT NULL AND (kind <> 'bundle' OR ts IS DISTINCT FROM r.ts) AS ct,
        CASE WHEN error IS NOT NULL THEN 'failed' WHEN kind <> 'bundle' THEN 'updated'
          WHEN r.rid IS NULL THEN 'created'
          WHEN js IS NOT DISTINCT FROM r.js AND ss IS NOT DISTINCT FROM r.ss
            AND ts IS NOT DISTINCT FROM r.ts THEN 'skipped' ELSE 'updated' END AS status
      FROM (
        SELECT *, CASE
            WHEN kind <> 'bundle' AND js IS NULL AND ss IS NULL AND ts IS NULL
              THEN 'At least one file must be provided for modification.'
            WHEN kind = 'patch_id' AND r.rid IS NULL
              THEN 'No active record found with report_id ''' || report_id || ''''
            WHEN kind = 'patch_key' AND r.rid IS NULL
              THEN 'No active record found for csi_id=''' || csi_id || ''' regulation=''' ||
                regulation || ''' region=''' || region || ''' json_config=''' || json_name || ''''
            WHEN kind = 'patch_id' AND taken
              THEN 'Modify failed for report_id=''' || report_id ||
                ''': another active record holds json_config ''' || json_name || '''' END AS error
        FROM (
          SELECT o.*, s.state, CASE WHEN o.kind = 'patch_id'
              THEN list_filter(s.state, lambda x: x.rid = o.report_id)[1]
              ELSE list_filter(s.state, lambda x: x.jn = o.json_name)[1] END AS r,
            len(list_filter(s.state, lambda x: x.jn = o.json_name AND x.rid <> o.report_id)) > 0
              AS taken
          FROM steps s JOIN numbered o ON o.n = s.n + 1 AND o.csi_id = s.csi_id
            AND o.region = s.region AND o.regulation = s.regulation)))))"""

# --- validation ----------------------------------------------------------------

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TPL_SET = "{''.txt'', ''.html'', ''.jinja'', ''.j2'', ''.tmpl'', ''.xml'', ''.csv''}"


def _ext(name: str) -> str:
    return f"lower(regexp_extract(string_split({name}, '/')[-1], '.+(\\.[^.]+)$', 1))"


def _base(name: str) -> str:
    return f"string_split({name}, '/')[-1]"


_LEAD = "'Bundle #' || seq || "


def _token_checks() -> list[str]:
    return [
        f"CASE WHEN NOT regexp_full_match(trim({k}, {_SPACE}), '[A-Za-z0-9_\\-\\.]+') THEN {_LEAD}"
        f"': ''{k}'' contains invalid characters (only letters, digits, hyphens, underscores,"
        f" dots allowed): ''' || {k} || '''' END"
        for k in ("csi_id", "region", "regulation")
    ]


def _field_list() -> str:
    names = ("csi_id", "region", "regulation", "json_name", "sql_name")
    shown = ("csi_id", "region", "regulation", "json_config", "sql_file")
    each = [
        f"CASE WHEN {n} IS NULL THEN 'missing required key ''{s}'''"
        f" WHEN trim({n}, {_SPACE}) = '' THEN '''{s}'' must not be blank' END"
        for n, s in zip(names, shown)
    ]
    return "concat_ws('; ', " + ", ".join(each) + ")"


def _field_checks() -> list[str]:
    errors = _field_list()
    return [
        f"CASE WHEN {errors} <> '' THEN {_LEAD}' (csi_id=' || coalesce(csi_id, '?') ||"
        f" '): validation failed — ' || {errors} END"
    ]


def _file_checks() -> list[str]:
    def check(label: str, path: str, text: str) -> str:
        return (
            f"CASE WHEN {text} IS NULL THEN {_LEAD}': {label} not found: ' || {path}"
            f" WHEN {text} = '' THEN {_LEAD}': {label} is empty (0 bytes): ' || {path} END"
        )

    return [
        check("JSON config", "json_name", "json_text"),
        check("SQL file", "sql_name", "sql_text"),
        f"CASE WHEN tpl_name <> '' THEN {check('Template', 'tpl_name', 'tpl_text')} END",
    ]


def _ext_checks() -> list[str]:
    return [
        f"CASE WHEN {_ext('sql_name')} <> '.sql' THEN {_LEAD}': SQL file must have extension"
        f" {{''.sql''}}, got ''' || {_ext('sql_name')} || '''' END",
        f"CASE WHEN tpl_name <> '' AND {_ext('tpl_name')} NOT IN ('.txt', '.html', '.jinja',"
        f" '.j2', '.tmpl', '.xml', '.csv') THEN {_LEAD}': Template file extension ''' ||"
        f" {_ext('tpl_name')} || ''' is not in allowed set {_TPL_SET}' END",
    ]


def _request_checks() -> list[str]:
    fields = {
        "csi_id": "csi_id", "region": "region", "regulation": "regulation",
        "json_config_filename": "json_name", "json_config_content": "json_text",
        "sql_file_filename": "sql_name", "sql_file_content": "sql_text",
    }
    each = ", ".join(
        f"CASE WHEN {c} IS NULL THEN 'missing required field ''{f}''' END" for f, c in fields.items()
    )
    return [f"{_LEAD}': ' || nullif(concat_ws('; ', {each}), '')"]


def _sql_checks() -> list[str]:
    return [
        f"CASE WHEN trim(sql_text, {_SPACE}) = '' THEN {_LEAD}': SQL file contains only"
        f" whitespace: ' || {_base('sql_name')} END"
    ]


def _config_checks() -> list[str]:
    name = _base("json_name")
    # CASE keeps the order: texts that do not parse are never looked into.
    root = "json_type(json_text)"
    report = "json_type(json_text, '$.report')"
    field = "json_type(json_text, '$.report.name')"
    value = "json_text ->> '$.report.name'"
    return [
        f"CASE WHEN {_ext('json_name')} <> '.json' THEN {_LEAD}': JSON config must be a .json"
        f" file, got: ''' || {_ext('json_name')} || ''''"
        f" WHEN json_text = '' THEN {_LEAD}': JSON config is empty: ' || {name}"
        f" WHEN json_text IS NULL OR NOT json_valid(json_text) THEN {_LEAD}': Invalid JSON in ' ||"
        f" {name}"
        f" WHEN {root} <> 'OBJECT' THEN {_LEAD}': JSON config root must be a JSON object'"
        f" WHEN {report} IS DISTINCT FROM 'OBJECT' THEN {_LEAD}': JSON config ''' || {name} ||"
        f" ''' missing required ''report'' object'"
        f" WHEN {field} IS DISTINCT FROM 'VARCHAR' OR trim({value}, {_SPACE}) = '' THEN {_LEAD}"
        f"': JSON config ''' || {name} || ''' missing required field ''report.name''' END"
    ]


def _checked(source: str, *checks: list[str]) -> str:
    found = ", ".join(c for layer in checks for c in layer)
    return f"""
checked AS (
  SELECT *, seq AS index, list_filter([{found}], lambda e: e IS NOT NULL) AS errs
  FROM {source}),
findings AS (
  SELECT *, len(errs) = 0 AS valid, errs[1] AS error, array_to_string(errs, ' | ') AS errors
  FROM checked)"""


_MANIFEST_LAYERS = (
    _field_checks(), _token_checks(), _file_checks(), _ext_checks(), _sql_checks(),
    _config_checks(),
)


def _finding_query(view: str, source: str, *checks: list[str]) -> str:
    body = _checked(source, *checks)
    return f"WITH {view},{body} SELECT index, valid, error, errors FROM findings"


_LABEL = "coalesce(csi_id, 'bundle-' || index)"
_DETAILS = f"""{FLAWED},{_checked("flawed", *_MANIFEST_LAYERS)},
good AS (SELECT * FROM findings WHERE valid),{route_sql("good")},
details AS (
  SELECT index, {_LABEL} AS label, 'failed' AS status, CAST(NULL AS VARCHAR) AS report_id,
    CAST(NULL AS INT) AS version, 'Pre-validation failed' AS reason,
    'Bundle #' || index || ' ''' || {_LABEL} || ''': ' || error AS error, 0 AS position_group
  FROM findings WHERE NOT valid
  UNION ALL
  SELECT seq, csi_id, status, report_id, version, reason, NULL, 1 FROM routed)"""

def _disk_check(label: str, path: str, body: str, missing: str) -> str:
    return f"""CASE WHEN {missing} AND key % 2 = 1 THEN lead || ': {label} not found: ' || {path}
      WHEN {missing} THEN lead || ': {label} path is not a regular file: ' || {path}
      WHEN {body} = '' THEN lead || ': {label} is empty (0 bytes): ' || {path} END"""


_DISK = f"""WITH d AS (
  SELECT s_suppkey AS key, 'Bundle #' || s_suppkey AS lead,
    (s_suppkey % 10) || '/' || s_suppkey AS dir,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN ''
      ELSE '{{"report":{{"name":"R' || s_name || '"}}}}' END AS js,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN ''
      ELSE 'SELECT ' || s_suppkey END AS sq,
    CASE WHEN s_suppkey % 17 = 0 THEN NULL WHEN s_suppkey % 19 = 0 THEN ''
      ELSE repeat(s_name, s_suppkey % 1000) END AS tp
  FROM supplier),
e AS (
  SELECT *, {_disk_check("JSON config", "dir || '/config.json'", "js", "js IS NULL")} AS e1,
    {_disk_check("SQL file", "dir || '/./query.sql'", "sq", "sq IS NULL")} AS e2,
    CASE WHEN key % 3 <> 0 THEN
      {_disk_check("Template", "dir || '/x/../t.txt'", "tp", "tp IS NULL")} END AS e3
  FROM d)
SELECT CAST(key AS BIGINT) AS index, e1 IS NULL AND e2 IS NULL AND e3 IS NULL AS valid,
  concat_ws(' | ', e1, e2, e3) AS errors,
  'sha256:' || sha256(js) AS json_sum, 'sha256:' || sha256(sq) AS sql_sum,
  CASE WHEN key % 3 <> 0 THEN 'sha256:' || sha256(tp) END AS tpl_sum,
  CAST(strlen(js) AS BIGINT) AS json_size, CAST(strlen(sq) AS BIGINT) AS sql_size,
  CASE WHEN key % 3 <> 0 THEN CAST(strlen(tp) AS BIGINT) END AS tpl_size FROM e"""

# --- retention, blobs, export --------------------------------------------------


def _purge(keep: int, group: str = "csi_id, region, regulation") -> str:
    return f"""
ranked AS (
  SELECT *, count(*) FILTER (WHERE active) OVER (PARTITION BY {group}) AS n_active,
    row_number() OVER (PARTITION BY {group}, active
      ORDER BY version DESC, uploaded_at DESC, report_id) AS rank
  FROM c),
plan AS (SELECT * FROM ranked WHERE NOT active AND rank > greatest(0, {keep} - n_active)),
counts AS (
  SELECT csi_id, region, regulation,
    count(*) FILTER (WHERE NOT active AND rank > greatest(0, {keep} - n_active)) AS purged,
    count(*) FILTER (WHERE active OR rank <= greatest(0, {keep} - n_active)) AS kept
  FROM ranked GROUP BY ALL)"""


_REFS = """
refs AS (
  SELECT report_id, version, 'json_config' AS file_type, json_sum AS blob_id,
    json_name AS filename FROM v
  UNION ALL SELECT report_id, version, 'sql_file', sql_sum, sql_name FROM v
  UNION ALL SELECT report_id, version, 'template', tpl_sum, tpl_name FROM v
    WHERE tpl_sum IS NOT NULL)"""

_FATES = f"""{_DOC},{_purge(3)},{_REFS},
fates AS (
  SELECT blob_id, count(*) FILTER (WHERE p.report_id IS NOT NULL) AS purged_refs,
    count(*) FILTER (WHERE p.report_id IS NULL) AS kept_refs
  FROM refs LEFT JOIN plan p USING (report_id, version) GROUP BY blob_id)"""


def _upload_plan(routed: str, held: str | None = None) -> str:
    kinds = {"json_config": ("cj", "json"), "sql_file": ("cs", "sql"), "template": ("ct", "tpl")}
    rows = " UNION ALL ".join(
        f"SELECT seq, '{t}' AS file_type, {s}_name AS filename, {s}_sum AS blob_id,"
        f" {s}_size AS length FROM {routed} WHERE {flag}"
        for t, (flag, s) in kinds.items()
    )
    unheld = f" AND blob_id NOT IN ({held})" if held else ""
    return f"""
uploads AS ({rows}),
first_upload AS (
  SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY seq, file_type) AS rn FROM uploads),
upload_plan AS (
  SELECT blob_id, seq, file_type, filename, length,
    CASE WHEN file_type = 'json_config' THEN 'application/json' ELSE {_type("filename")} END
      AS content_type
  FROM first_upload WHERE rn = 1{unheld})"""


def _type(name: str) -> str:
    return (
        f"CASE {_ext(name)} WHEN '.sql' THEN 'application/sql' WHEN '.txt' THEN 'text/plain'"
        " WHEN '.html' THEN 'text/html' WHEN '.csv' THEN 'text/csv' WHEN '.xml' THEN 'text/xml'"
        " WHEN '.json' THEN 'application/json' ELSE 'application/octet-stream' END"
    )


_BLOBS = f"""{_DOC},{_REFS},{_upload_plan("routed")},
texts AS (
  SELECT seq, 'json_config' AS file_type, json_text AS content FROM docs
  UNION ALL SELECT seq, 'sql_file', sql_text FROM docs
  UNION ALL SELECT seq, 'template', tpl_text FROM docs),
blobs AS (
  SELECT blob_id, filename, content_type, length,
    CASE WHEN blob_id[8] = '0' THEN content || '!' ELSE content END AS content
  FROM upload_plan JOIN texts USING (seq, file_type) WHERE blob_id[8] <> 'f'
  UNION ALL
  SELECT 'sha256:' || sha256(text), 'item_' || item_id || '.txt', 'text/plain',
    CAST(strlen(text) AS BIGINT), text FROM benchmark)"""

_MANIFEST = f"""{_BLOBS},
manifest AS (
  SELECT report_id, version, file_type, refs.filename, blob_id,
    CASE WHEN content IS NULL THEN 'error' WHEN 'sha256:' || sha256(content) = blob_id THEN 'ok'
      ELSE 'mismatch' END AS status, content
  FROM refs LEFT JOIN blobs USING (blob_id))"""


def _decision(force: bool) -> str:
    status = "'forced'" if force else "'aborted'"
    lost = "0" if force else "n_mismatch"
    return f"""{_MANIFEST},
per_version AS (
  SELECT report_id, version, count(*) FILTER (WHERE status <> 'error') AS n_files,
    count(*) FILTER (WHERE status = 'error') AS n_errors,
    count(*) FILTER (WHERE status = 'ok') AS n_verified,
    count(*) FILTER (WHERE status IN ('ok', 'mismatch')) AS n_checked,
    count(*) FILTER (WHERE status = 'mismatch') AS n_mismatch,
    coalesce(string_agg(file_type, ', ' ORDER BY file_type) FILTER (WHERE status = 'mismatch'), '')
      AS failed_types
  FROM manifest GROUP BY ALL),
decision AS (
  SELECT *, CASE WHEN n_mismatch = 0 THEN 'exported' ELSE {status} END AS report_status,
    n_files - {lost} AS n_exported FROM per_version)"""


_DAMAGED = f"""{_SUB_ROUTED},
damaged AS (
  SELECT * REPLACE (CASE WHEN region = 'UK' THEN 'report_0.json' ELSE json_name END AS json_name,
    CASE WHEN name <> 'R4' THEN sql_sum END AS sql_sum)
  FROM (FROM v UNION ALL FROM v WHERE version = 1 AND region = 'US')
  WHERE NOT (version = 3 AND regulation = 'ERROR')),
standing AS (
  SELECT d.* FROM damaged d ANTI JOIN damaged n
    ON n.report_id = d.report_id AND n.version = d.version + 1)"""

# --- pushed forms --------------------------------------------------------------

_REQUESTS = f"""{SUBMISSIONS},
requests AS (
  SELECT seq, csi_id, json_name AS json_config_filename, sql_name AS sql_file_filename,
    CASE WHEN seq % 5 <> 0 THEN tpl_name END AS template_filename,
    to_base64(encode(json_text)) AS json64, to_base64(encode(tpl_text)) AS tpl64,
    CASE WHEN seq % 47 = 0 THEN to_base64(encode(sql_text)) || 'A'
      WHEN seq % 53 = 0 THEN '*' || to_base64(encode(sql_text))
      ELSE to_base64(encode(sql_text)) END AS sql64
  FROM submissions),
decoded AS (
  SELECT *, regexp_extract(regexp_replace(sql64, '[^A-Za-z0-9+/=]', '', 'g'),
    '^([A-Za-z0-9+/]*={{0,2}})', 1) AS clean FROM requests)"""

_PATCH_REQUESTS = f"""{_PATCHES},
made AS (
  SELECT seq, CASE WHEN seq % 7 = 0 THEN report_id[1:20] WHEN seq % 11 <> 0 THEN report_id
      END AS report_id,
    seq % 13 = 0 AND sql_text IS NOT NULL AS torn,
    json_name, json_text, CASE WHEN seq % 5 <> 0 THEN sql_name END AS sql_name, sql_text,
    tpl_name, tpl_text FROM patches)"""


def _entry_json() -> str:
    own = (
        "{'action': CASE WHEN version = 1 THEN 'CREATED' ELSE 'MODIFIED' END,"
        " 'timestamp': strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S.%f+00:00'), 'details': change}"
    )
    end = (
        "{'action': 'DEACTIVATED',"
        " 'timestamp': strftime(superseded_at, '%Y-%m-%dT%H:%M:%S.%f+00:00'),"
        " 'details': 'Superseded by version ' || (version + 1)}"
    )
    return f"CASE WHEN active THEN [{own}] ELSE [{own}, {end}] END"


def _per_file(column: str, suffix: str = "") -> str:
    return (
        f"{{'json_config{suffix}': json_{column}, 'sql_file{suffix}': sql_{column},"
        f" 'template{suffix}': tpl_{column}}}"
    )


_OWN_TEXT = (
    "CASE WHEN version = 1 THEN 'CREATED' ELSE 'MODIFIED' END || '; ' ||"
    " strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') ||"
    " CASE WHEN microsecond(uploaded_at) % 1000000 = 0 THEN '' ELSE"
    " '.' || rtrim(strftime(uploaded_at, '%f'), '0') END || '; ' || change"
)
_END_TEXT = (
    "' | DEACTIVATED; ' || strftime(superseded_at, '%Y-%m-%d %H:%M:%S') ||"
    " CASE WHEN microsecond(superseded_at) % 1000000 = 0 THEN '' ELSE"
    " '.' || rtrim(strftime(superseded_at, '%f'), '0') END ||"
    " '; Superseded by version ' || (version + 1)"
)


def oracle_sql() -> dict[str, str]:
    routed = f"WITH {_SUB_ROUTED} SELECT "
    reg = f"WITH {_REG} SELECT "
    out = {
        "route_status": routed + "seq, status, version FROM routed",
        "route_reason": routed + "seq, reason, changed FROM routed",
        "report_ids": routed + f"seq, {_KEY}, report_id FROM routed",
        "version_chain": routed + f"{_FLAT}, change FROM v",
        "carried_files": routed + "seq, version, e_sql_name AS stored_sql_name, e_tpl_name AS"
        " stored_tpl_name, e_tpl_sum AS stored_tpl_sum, e_tpl_size AS stored_tpl_size FROM routed",
        "route_snapshot": f"WITH {_SECOND} SELECT seq, status, reason, report_id, version,"
        " e_sql_name AS stored_sql_name FROM b_routed",
        "route_documents": f"WITH {_DOC} SELECT seq, csi_id, region, regulation, status, reason,"
        " version, sql_sum, sql_size FROM routed",
        "route_chats": f"WITH {CHATS},{route_sql('chats')} SELECT seq, csi_id, status, reason,"
        " version, name, sql_sum FROM routed",
        "create_only": f"""WITH {SUBMISSIONS},
  ids AS (SELECT *, {_uuid("csi_id", "region", "regulation", "json_name", "'0'", "seq")} AS own
    FROM submissions),
  held AS (SELECT *, first_value(own) OVER k AS report_id, row_number() OVER k AS rn
    FROM ids WINDOW k AS (PARTITION BY {_KEY} ORDER BY seq))
  SELECT seq, report_id, CASE WHEN rn = 1 THEN 'created' ELSE 'failed' END AS status,
    CASE WHEN rn > 1 THEN 'An active record already exists for csi_id=''' || csi_id ||
      ''' regulation=''' || regulation || ''' region=''' || region || ''' json_config=''' ||
      json_name || ''' (internal report_id=' || report_id || '). Use ''modify'' to update it.'
      END AS error FROM held""",
        "create_duplicates": f"""WITH {_REG},{ORDER_BUNDLES},
  ids AS (SELECT o.*, a.report_id AS held_by,
      {_uuid("csi_id", "region", "regulation", "json_name", "'1'", "o.seq")} AS own
    FROM order_bundles o LEFT JOIN act a USING ({_KEY})),
  held AS (SELECT *, coalesce(held_by, first_value(own) OVER k) AS report_id,
      held_by IS NOT NULL OR row_number() OVER k > 1 AS dup
    FROM ids WINDOW k AS (PARTITION BY {_KEY} ORDER BY seq))
  SELECT seq, report_id, 'An active record already exists for csi_id=''' || csi_id ||
      ''' regulation=''' || regulation || ''' region=''' || region || ''' json_config=''' ||
      json_name || ''' (internal report_id=' || report_id || '). Use ''modify'' to update it.'
      AS error FROM held WHERE dup""",
        "active_snapshot": reg + f"{_FLAT} FROM act",
        "audit_log": reg
        + """report_id, version, CASE WHEN version = 1 THEN 'CREATED' ELSE 'MODIFIED' END AS action,
    uploaded_at AS timestamp, change AS details FROM c
  UNION ALL SELECT report_id, version, 'DEACTIVATED', superseded_at,
    'Superseded by version ' || (version + 1) FROM c WHERE NOT active""",
        "point_lookup": f"""WITH {_PATCHES}, asked AS (
    SELECT report_id FROM patches WHERE report_id IN (SELECT report_id FROM v)
    ORDER BY seq LIMIT 8)
SELECT {_FLAT}, change FROM v WHERE report_id IN (SELECT report_id FROM asked)""",
        "current_state": f"""WITH {_REG},{ORDER_BUNDLES} SELECT {_FLAT} FROM act
WHERE (csi_id, region, regulation) IN (
  SELECT (csi_id, region, regulation) FROM order_bundles WHERE right(csi_id, 1) = '3')""",
        "records_deep_page": reg + f"{_FLAT}, active FROM c ORDER BY {_PAGE_ORDER}"
        " LIMIT 100 OFFSET (SELECT count(*) // 2 FROM c)",
        "history_not_found": f"""WITH {_PATCHES},
  q AS (SELECT DISTINCT report_id FROM patches),
  totals AS (SELECT {_K3}, count(*) AS total_versions FROM v GROUP BY ALL),
  homes AS (SELECT DISTINCT report_id, {_K3} FROM v)
  SELECT q.report_id, h.report_id IS NOT NULL AS found, total_versions,
    CASE WHEN h.report_id IS NULL THEN 'No records found with report_id ''' || q.report_id || ''''
      END AS error
  FROM q LEFT JOIN homes h USING (report_id) LEFT JOIN totals USING ({_K3})""",
        "purge_not_found": f"""WITH {_PATCHES},{_purge(2)},
  q AS (SELECT DISTINCT report_id FROM patches),
  homes AS (SELECT DISTINCT report_id, {_K3} FROM v)
  SELECT q.report_id, purged, kept,
    CASE WHEN h.report_id IS NULL THEN 'No records found with report_id ''' || q.report_id || ''''
      END AS error
  FROM q LEFT JOIN homes h USING (report_id) LEFT JOIN counts USING ({_K3})""",
        "corrupt_records": f"""WITH {_REG},{ORDER_BUNDLES},
  met AS (
    SELECT o.seq, a.report_id, a.report_id[1] IN ('0', '1', '2', '3') AS no_json,
      a.report_id[1] IN ('3', '4', '5', '6') AS no_sql,
      'sha256:' || sha256(o.json_text) <> a.json_sum AS cj,
      'sha256:' || sha256(o.sql_text) <> a.sql_sum AS cs,
      'sha256:' || sha256(o.tpl_text) IS DISTINCT FROM a.tpl_sum AS ct
    FROM order_bundles o JOIN act a USING ({_KEY})),
  judged AS (
    SELECT *, (NOT cj AND no_json) OR (NOT cs AND no_sql) AS bad FROM met WHERE cj OR cs OR ct),
  timed AS (
    SELECT *, min(seq) FILTER (WHERE NOT bad) OVER (PARTITION BY report_id) AS mended FROM judged)
  SELECT seq, report_id, 'Modify failed for report_id=''' || report_id ||
    ''': Corrupt record report_id=''' || report_id || ''': missing ' ||
    CASE WHEN NOT cj AND no_json THEN 'json_config' ELSE 'sql_file' END ||
    '_id in file_contents' AS error
  FROM timed WHERE bad AND (mended IS NULL OR seq < mended)""",
        "clean_registry": f"""WITH {_REG},{_purge(2)},
  kept AS (SELECT c.* FROM c ANTI JOIN plan USING (report_id, version))
  SELECT json_sum AS blob_id, json_size AS length FROM kept
  UNION SELECT sql_sum, sql_size FROM kept
  UNION SELECT tpl_sum, tpl_size FROM kept WHERE tpl_sum IS NOT NULL""",
        "blob_ledger": f"""WITH {_REG},{_purge(2)},
  used AS (
    SELECT report_id, version, unnest([json_sum, sql_sum, tpl_sum]) AS blob_id FROM c)
  SELECT blob_id, count(*) FILTER (WHERE p.report_id IS NULL) AS refs
  FROM used LEFT JOIN plan p USING (report_id, version) WHERE blob_id IS NOT NULL
  GROUP BY blob_id""",
        "import_records": reg + """report_id || '_v' || version AS place, CASE WHEN ok THEN report_id END AS report_id,
    CASE WHEN ok THEN csi_id END AS csi_id, CASE WHEN ok THEN region END AS region,
    CASE WHEN ok THEN regulation END AS regulation, CASE WHEN ok THEN name END AS name,
    CASE WHEN ok THEN json_name END AS json_name, CASE WHEN ok THEN sql_name END AS sql_name,
    CASE WHEN ok THEN tpl_name END AS tpl_name, CASE WHEN ok THEN json_sum END AS json_sum,
    CASE WHEN ok THEN sql_sum END AS sql_sum, CASE WHEN ok THEN tpl_sum END AS tpl_sum,
    CASE WHEN ok THEN json_size END AS json_size, CASE WHEN ok THEN sql_size END AS sql_size,
    CASE WHEN ok THEN tpl_size END AS tpl_size,
    CASE WHEN ok THEN CASE WHEN report_id[1] IN ('5', '6') THEN date_trunc('millisecond', uploaded_at)
      ELSE uploaded_at END END AS uploaded_at,
    CASE WHEN ok THEN version END AS version, CASE WHEN ok THEN change END AS change,
    CASE WHEN ok THEN active END AS active,
    CASE report_id[1] WHEN '0' THEN 'not a JSON document'
      WHEN '1' THEN 'missing or of another type: csi_id' END AS error
  FROM (SELECT *, report_id[1] NOT IN ('0', '1') AS ok FROM c WHERE report_id[1] <> '2')""",
        "stream_audit": reg
        + """version, CASE WHEN version = 1 THEN 'CREATED' ELSE 'MODIFIED' END AS action,
    uploaded_at AS timestamp, change AS details FROM c
  UNION ALL SELECT version, 'DEACTIVATED', superseded_at,
    'Superseded by version ' || (version + 1) FROM c WHERE NOT active""",
        "audit_arrays": reg
        + f"report_id, version, active, {_OWN_TEXT} || CASE WHEN active THEN '' ELSE {_END_TEXT}"
        " END AS entries FROM c",
        "history": reg
        + f"{_FLAT}, count(*) OVER (PARTITION BY csi_id, region, regulation) AS total_versions"
        " FROM v",
        "history_view": reg
        + """csi_id, region, regulation, report_id, version, active,
    strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded,
    'config: ' || json_name || coalesce(chr(10) || 'template: ' || tpl_name, '') || chr(10) ||
      'sql: ' || sql_name AS files,
    '[' || CASE WHEN version = 1 THEN 'CREATED' ELSE 'MODIFIED' END || '] ' || change ||
      CASE WHEN active THEN '' ELSE chr(10) || '[DEACTIVATED] Superseded by version ' ||
      (version + 1) END AS audit FROM c""",
        "chat_history": f"WITH {CHATS},{route_sql('chats')} SELECT csi_id, name, version,"
        " count(*) OVER (PARTITION BY csi_id, region, regulation) AS total_versions, sql_sum,"
        " change FROM v",
        "patch_by_id": f"WITH {_PATCHED} SELECT seq, report_id, status, error, version, changed,"
        " name, json_name, sql_name, tpl_name, json_sum, sql_sum, tpl_sum, json_size, sql_size,"
        " tpl_size FROM patched",
        "patched_versions": f"WITH {_PATCHED} SELECT {_FLAT}, 'Updated ' || changed || ' (v' ||"
        " (version - 1) || ' → v' || version || ')' AS change FROM patched"
        " WHERE status = 'updated'",
        "patch_by_key": f"WITH {_KEY_PATCHED} SELECT seq, report_id, status, version, changed,"
        " sql_name, tpl_sum FROM patched",
        "mixed_batch": f"""WITH {_MIXED}
SELECT seq, kind, report_id, status, error, rec.v AS version, changed, rec.jn AS json_name,
  rec.sn AS sql_name, rec.tn AS tpl_name, rec.ts AS tpl_sum FROM steps WHERE n > 0""",
        "patch_not_found": f"WITH {_PATCHES} SELECT seq, {_KEY}, 'No active record found for"
        " csi_id=''' || csi_id || ''' regulation=''' || regulation || ''' region=''' || region ||"
        " ''' json_config=''' || json_name || '''' AS error FROM key_patches"
        " WHERE report_id IS NULL",
        "list_active": reg + f"{_IDS}, name, version, uploaded_at FROM act"
        f" ORDER BY {_PAGE_ORDER} LIMIT 500",
        "list_all": reg + f"{_IDS}, name, version, uploaded_at, active FROM c",
        "listing_view": reg + f"{_IDS}, name, version, active,"
        " strftime(uploaded_at, '%Y-%m-%d %H:%M') AS uploaded FROM c",
        "detail_view": reg + f"{_IDS}, name, version, active,"
        " json_name || ' (' || json_size || ' bytes)' AS json_config,"
        " coalesce(tpl_name, 'N/A') || ' (' || coalesce(tpl_size, 0) || ' bytes)' AS template,"
        " sql_name || ' (' || sql_size || ' bytes)' AS sql_file,"
        " json_sum AS json_config_checksum, coalesce(tpl_sum, 'N/A') AS template_checksum,"
        " sql_sum AS sql_file_checksum FROM c",
        "fetch_by_ids": f"WITH {_PATCHES} SELECT q.report_id, * EXCLUDE (report_id, change,"
        " superseded_at, active), a.report_id IS NOT NULL AS found"
        " FROM (SELECT DISTINCT report_id FROM patches) q LEFT JOIN act a"
        " ON a.report_id = q.report_id",
        "fetch_by_csi": reg + f"{_FLAT}, active FROM act WHERE csi_id = 'CSI-0008'"
        f" ORDER BY {_PAGE_ORDER} LIMIT 500",
        "fetch_by_region": reg + f"{_FLAT}, active FROM c WHERE region = 'APAC'"
        f" ORDER BY {_PAGE_ORDER} LIMIT 500",
        "fetch_by_regulation": reg + f"{_FLAT}, active FROM act WHERE regulation = 'PURCHASE'",
        "fetch_composite": reg
        + f"{_FLAT}, active FROM c WHERE region = 'EMEA' AND regulation = 'VIEW'",
        "records_page": reg + f"{_FLAT}, active FROM act WHERE region = 'UK'"
        f" ORDER BY {_PAGE_ORDER} LIMIT 100 OFFSET 10",
        "records_total": reg + "count(*) AS total FROM act WHERE region = 'UK'",
        "record_version": f"""WITH {_PATCHES},
  asked AS (SELECT DISTINCT report_id, CASE WHEN sql_name IS NOT NULL THEN 1
    WHEN tpl_name IS NOT NULL THEN 2 END AS asked_version FROM patches)
  SELECT q.report_id, c.* EXCLUDE (report_id, change, superseded_at, active, version),
    coalesce(c.version, q.asked_version) AS version, q.asked_version,
    c.report_id IS NOT NULL AS found
  FROM asked q LEFT JOIN c ON c.report_id = q.report_id AND
    (c.version = q.asked_version OR (q.asked_version IS NULL AND c.active))""",
        "records_json": reg + f"""report_id, version, CAST(to_json({{
    'id': report_id || '_v' || version, 'report_id': report_id, 'csi_id': csi_id,
    'region': region, 'regulation': regulation, 'name': name,
    'original_files': {_per_file("name")}, 'file_contents': {_per_file("sum", "_id")},
    'checksums': {_per_file("sum")}, 'file_sizes': {_per_file("size")},
    'uploaded_at': strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S.%f+00:00'), 'active': active,
    'version': version, 'audit_log': {_entry_json()}}}) AS VARCHAR) AS record FROM c""",
        "logical_records": reg + "csi_id, region, regulation, count(*) AS n_versions FROM v"
        " GROUP BY ALL",
        "manifest_explode": f"WITH {MANIFESTS} SELECT source, index, is_mapping, csi_id, region,"
        " regulation, json_config, sql_file, template FROM manifest_entries",
        "validate_manifest": f"""WITH {MANIFESTS} SELECT source,
    CAST(coalesce(len(bundles), 0) AS INT) AS n_bundles,
    CASE WHEN bundles IS NULL THEN source || ': missing required top-level key ''bundles'''
      WHEN len(bundles) = 0 THEN source || ': ''bundles'' list is empty — nothing to seed' END
      AS error FROM manifests""",
        "payload_build": f"""WITH {SUBMISSIONS} SELECT seq, uploaded_at AS submitted_at, csi_id,
    region, regulation, json_name AS json_config_filename,
    to_base64(encode(json_text)) AS json_config_content, sql_name AS sql_file_filename,
    to_base64(encode(sql_text)) AS sql_file_content, tpl_name AS template_filename,
    to_base64(encode(tpl_text)) AS template_content
  FROM submissions WHERE regulation <> 'VIEW'""",
        "inline_decode": f"""WITH {_REQUESTS} SELECT seq, csi_id, json_config_filename AS json_name,
    sql_file_filename AS sql_name,
    CASE WHEN tpl64 IS NOT NULL THEN template_filename END AS tpl_name,
    decode(from_base64(json64)) AS json_text,
    CASE WHEN length(clean) % 4 = 0 THEN decode(from_base64(clean)) END AS sql_text,
    CASE WHEN template_filename IS NOT NULL THEN decode(from_base64(tpl64)) END AS tpl_text,
    CASE WHEN length(clean) % 4 <> 0 THEN 'sql_file' END AS undecodable FROM decoded""",
        "inline_requests": f"""WITH {SUBMISSIONS},
  t AS (SELECT * REPLACE (CASE WHEN seq % 13 <> 0 THEN region END AS region), seq // 8 AS body,
    CAST(row_number() OVER (PARTITION BY seq // 8 ORDER BY seq) - 1 AS INT) AS index
    FROM submissions)
  SELECT body, index, csi_id, region, region IS NOT NULL AS valid,
    CASE WHEN region IS NULL THEN 'Bundle #' || index || ': missing required field ''region''' END
      AS error,
    'sha256:' || sha256(sql_text) AS sql_sum FROM t""",
        "patch_requests": f"""WITH {_PATCH_REQUESTS} SELECT seq, report_id,
    CASE WHEN report_id IS NULL
        OR NOT regexp_full_match(replace(report_id, '-', ''), '[0-9A-Fa-f]{{32}}') THEN
        'Invalid report_id format: ''' || coalesce(report_id, 'None') || ''' must be a UUID'
      WHEN json_text IS NULL AND sql_text IS NULL AND tpl_text IS NULL THEN
        'At least one file must be provided.'
      WHEN json_text IS NULL AND tpl_text IS NULL AND sql_name IS NULL THEN
        'At least one file must be provided for modification.'
      WHEN sql_name IS NOT NULL AND torn THEN 'Cannot decode sql_file' END AS error,
    json_name, sql_name, tpl_name, json_text,
    CASE WHEN sql_name IS NOT NULL AND NOT torn THEN sql_text END AS sql_text, tpl_text
    FROM made""",
        "content_types": f"WITH {FLAWED} SELECT seq, sql_name, tpl_name,"
        f" {_type('sql_name')} AS sql_type, {_type('tpl_name')} AS tpl_type FROM flawed",
        "validate_tokens": _finding_query(FLAWED, "flawed", _token_checks()),
        "validate_page_tokens": _finding_query(PAGES, "page_bundles", _token_checks()),
        "validate_files": _finding_query(FLAWED, "flawed", _file_checks()),
        "validate_disk_files": _DISK,
        "validate_ext": _finding_query(FLAWED, "flawed", _ext_checks()),
        "validate_sql_text": _finding_query(FLAWED, "flawed", _sql_checks()),
        "validate_config": _finding_query(FLAWED, "flawed", _config_checks()),
        "validate_config_strict": _finding_query(FLAWED, "flawed", _config_checks()),
        "validate_bundles": _finding_query(FLAWED, "flawed", *_MANIFEST_LAYERS),
        "validate_pages": _finding_query(PAGES, "page_bundles", *_MANIFEST_LAYERS),
        "validate_inline": _finding_query(
            FLAWED, "flawed", _request_checks(), _config_checks(), _sql_checks()
        ),
        "validate_create": _finding_query(FLAWED, "flawed", _request_checks(), _config_checks()),
        "batch_details": f"WITH {_DETAILS} SELECT * FROM details",
        "batch_summary": f"""WITH {_DETAILS} SELECT
    count(*) FILTER (WHERE status = 'created') AS created,
    count(*) FILTER (WHERE status = 'updated') AS updated,
    count(*) FILTER (WHERE status = 'skipped') AS skipped,
    count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM details""",
        "batch_errors": f"WITH {_DETAILS} SELECT index, error AS message FROM details"
        " WHERE status = 'failed'",
        "purge_plan": f"WITH {_REG},{_purge(3)} SELECT {_FLAT} FROM plan",
        "purge_plan_by_record": f"WITH {_REG},{_purge(5, 'report_id')} SELECT {_FLAT} FROM plan",
        "purge_one": f"WITH {_REG},{_purge(2)} SELECT {_FLAT} FROM plan WHERE"
        " (csi_id, region, regulation) IN (SELECT (csi_id, region, regulation) FROM v"
        " WHERE report_id = (SELECT min(report_id) FROM v))",
        "purge_by_age": reg + f"{_FLAT} FROM c WHERE NOT active AND"
        " uploaded_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY",
        "purge_counts": f"WITH {_REG},{_purge(3)} SELECT * FROM counts",
        "purge_totals": f"WITH {_REG},{_purge(2)} SELECT CAST(sum(purged) AS BIGINT) AS"
        " total_purged, count(*) AS records_processed FROM counts",
        "blob_gc": f"WITH {_FATES} SELECT blob_id, purged_refs FROM fates"
        " WHERE purged_refs > 0 AND kept_refs = 0",
        "blob_gc_unsafe": f"WITH {_FATES} SELECT blob_id, purged_refs, kept_refs FROM fates"
        " WHERE purged_refs > 0 AND kept_refs > 0",
        "check_active_report": f"WITH {_DAMAGED} SELECT report_id, count(*) AS n_active"
        " FROM standing GROUP BY ALL HAVING count(*) > 1",
        "check_active_key": f"WITH {_DAMAGED} SELECT {_KEY}, count(*) AS n_active"
        " FROM standing GROUP BY ALL HAVING count(*) > 1",
        "check_chain": f"""WITH {_DAMAGED},
  s AS (SELECT *, lag(version) OVER (PARTITION BY report_id ORDER BY version) AS prior
    FROM damaged),
  t AS (SELECT report_id, min(version) AS first_version, max(version) AS last_version,
    count(*) AS n_versions, count(*) FILTER (WHERE json_sum IS NULL OR sql_sum IS NULL)
      AS missing_refs, bool_or(prior IS NOT NULL AND version <> prior + 1) AS broken
    FROM s GROUP BY report_id)
  SELECT * EXCLUDE (broken) FROM t WHERE first_version < 1 OR missing_refs > 0 OR broken""",
        "purge_then_active": f"""WITH {_REG},
  s AS (SELECT * REPLACE (uploaded_at - (version % 3) * INTERVAL 20 DAY AS uploaded_at) FROM c),
  rest AS (SELECT * EXCLUDE (active), version = max(version) OVER (PARTITION BY report_id)
    AS active FROM s WHERE active OR uploaded_at >= TIMESTAMP '2024-01-21')
  SELECT {_FLAT}, active FROM rest""",
        "route_cut": f"""WITH {_CUT_ROUTED}
  SELECT seq, region, status, reason, version, e_sql_name AS stored_sql_name FROM routed""",
        "blob_upload_plan": f"WITH {_SECOND},{_REFS},"
        + _upload_plan("b_routed", "SELECT blob_id FROM refs")
        + " SELECT * FROM upload_plan",
        "document_uploads": f"WITH {_DOC},{_upload_plan('routed')} SELECT * FROM upload_plan",
        "blob_read": f"""WITH {_BLOBS} SELECT blob_id, content IS NOT NULL AS found,
    b.filename, content_type, length, CAST(strlen(content) AS BIGINT) AS stored_length
  FROM (SELECT DISTINCT blob_id FROM refs) LEFT JOIN blobs b USING (blob_id)""",
        "checksum_verify": f"WITH {_BLOBS} SELECT blob_id, blob_id AS checksum,"
        " 'sha256:' || sha256(content) = blob_id AS verified FROM blobs",
        "orphan_blobs": f"WITH {_BLOBS} SELECT blob_id, filename, length FROM blobs"
        " WHERE blob_id NOT IN (SELECT blob_id FROM refs)",
        "dangling_refs": f"WITH {_BLOBS} SELECT blob_id, report_id, version, file_type, filename,"
        " blob_id AS expected FROM refs WHERE blob_id NOT IN (SELECT blob_id FROM blobs)",
        "export_select": f"""WITH {_DOC},
  asked AS (SELECT report_id, CASE WHEN max(version) >= 2 THEN 2 END AS asked_version FROM c
    GROUP BY report_id)
  SELECT q.report_id, c.* EXCLUDE (report_id, change, superseded_at, active),
    q.asked_version, c.report_id IS NOT NULL AS found
  FROM asked q LEFT JOIN c ON c.report_id = q.report_id AND
    (c.version = q.asked_version OR (q.asked_version IS NULL AND c.active))""",
        "export_verify": f"WITH {_MANIFEST} SELECT * EXCLUDE (content) FROM manifest",
        "export_subset": f"WITH {_MANIFEST} SELECT report_id, version, file_type, filename,"
        " blob_id, CASE WHEN content IS NULL THEN 'error' ELSE 'unverified' END AS status"
        " FROM manifest WHERE file_type <> 'sql_file'",
        "export_decision": f"WITH {_decision(False)} SELECT * FROM decision",
        "export_forced": f"WITH {_decision(True)} SELECT * FROM decision",
        "export_summary": f"""WITH {_decision(False)} SELECT count(*) AS n_versions,
    count(*) FILTER (WHERE report_status = 'aborted') AS n_aborted,
    CAST(sum(n_exported) AS BIGINT) AS n_exported, CAST(sum(n_errors) AS BIGINT) AS n_errors,
    CAST(sum(n_verified) AS BIGINT) AS n_verified, CAST(sum(n_checked) AS BIGINT) AS n_checked
  FROM decision""",
        "export_files": f"""WITH {_MANIFEST} SELECT report_id, version, file_type, filename,
    CAST(strlen(content) AS BIGINT) AS length, 'sha256:' || sha256(content) AS checksum
  FROM manifest WHERE status = 'ok'""",
        "export_folder": f"""WITH {_MANIFEST} SELECT report_id, version, filename,
    CAST(strlen(content) AS BIGINT) AS length, 'sha256:' || sha256(content) AS checksum
  FROM manifest WHERE status = 'ok'""",
        "export_zip": f"""WITH {_MANIFEST} SELECT report_id, version,
    report_id || '_v' || version || '.zip' AS zip_name, CAST(count(*) AS INT) AS n_files
  FROM manifest WHERE status = 'ok' GROUP BY ALL""",
        "stream_route": routed + "seq, status, reason, version FROM routed",
        "stream_state_route": routed + "seq, status, reason, report_id, version FROM routed",
    }
    out["validate_fields"] = _fields_oracle()
    return out


def _fields_oracle() -> str:
    """Entries of manifests, where an entry may be missing altogether."""
    lead = "'Bundle #' || index || "
    checks = _field_checks()[0].replace(_LEAD, lead)
    return f"""WITH {MANIFESTS},
f AS (
  SELECT source, index, is_mapping, csi_id,
    CASE WHEN regulation = 'CLICK' THEN ' ' || chr(9) ELSE region END AS region, regulation,
    json_config AS json_name, CASE WHEN region <> 'UK' THEN sql_file END AS sql_name
  FROM manifest_entries),
g AS (
  SELECT *, CASE WHEN NOT is_mapping THEN {lead}': must be a mapping/dict' ELSE {checks} END AS error
  FROM f)
SELECT source, index, error IS NULL AS valid, error, coalesce(error, '') AS errors FROM g"""

"""SQL of the core queries, for the tables as views. Queries whose steps SQL cannot state have none."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from graphloom.functions.text import STOPWORDS
from graphloom.operators.documents import SEARCH_FIELDS
from graphloom.operators.catalog import ANALYTICS_MARKERS, AUDIT_COLUMNS, SECURITY_MARKERS
from graphloom.operators.graph import EDGE_WEIGHTS, NODE_LAYERS
from graphloom.operators.lexical import AUXILIARY_TERMS, TYPE_BOOSTS

_REFERENCES = """
    WITH refs AS (
        SELECT DISTINCT 'validated_rules' AS table_name, id AS record_id, 'joins.right' AS field_name, j."right" AS ref_value, 'c' AS kind, loaded_at AS "at"
        FROM (SELECT id, loaded_at, unnest(joins) AS j FROM validated_rules)
        UNION SELECT DISTINCT 'entity_aliases', entity_id, 'tables', v, 't', loaded_at FROM (SELECT entity_id, loaded_at, unnest(tables) AS v FROM entity_aliases)
        UNION SELECT DISTINCT 'entity_aliases', entity_id, 'rest_resources', v, 'r', loaded_at FROM (SELECT entity_id, loaded_at, unnest(rest_resources) AS v FROM entity_aliases)
    ), parents AS (
        SELECT 'c' AS kind, lower(trim(table_name || '.' || name)) AS key, min(loaded_at) AS born, CASE WHEN count(deleted_at) = count(*) THEN max(deleted_at) END AS gone FROM physical_column GROUP BY 2
        UNION ALL SELECT 't', lower(trim(table_name)), min(loaded_at), CASE WHEN count(deleted_at) = count(*) THEN max(deleted_at) END FROM physical_table GROUP BY 2
        UNION ALL SELECT 'r', lower(trim(name)), min(loaded_at), CASE WHEN count(deleted_at) = count(*) THEN max(deleted_at) END FROM rest_resource GROUP BY 2
    ), judged AS (
        SELECT r.*, CASE WHEN p.key IS NULL THEN 'missing' WHEN p.born > r."at" THEN 'late' WHEN p.gone <= r."at" THEN 'deleted' ELSE 'valid' END AS status
        FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.key = lower(trim(r.ref_value))
        WHERE trim(r.ref_value) <> ''
    )
"""


@lru_cache(maxsize=1)
def _compatible() -> str:
    """Rows (character, replacement) of all characters that compatibility decomposition changes; NFC of the replaced text is NFKC."""
    rows = []
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        if not 0xD800 <= cp < 0xE000 and not 0xAC00 <= cp < 0xD7A4:
            flat = unicodedata.normalize("NFKD", ch)
            if flat != unicodedata.normalize("NFD", ch):
                rows.append(f"({_quoted(ch)}, {_quoted(flat)})")
    return ", ".join(rows)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nfkc(name: str, source: str, key: str, text: str) -> str:
    """Common table expressions ending in ``name`` (key, text): the NFKC of an expression over ``source``; only texts beyond ASCII are taken apart."""
    return rf"""{name}_in AS (SELECT {key}, {text} AS text FROM {source}), {name}_flat(ch, flat) AS (VALUES {_compatible()}),
    {name}_pieces AS (SELECT {key}, unnest(regexp_extract_all(text, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS place FROM {name}_in WHERE regexp_matches(text, '[^\x00-\x7F]')),
    {name}_out AS (SELECT {key}, nfc_normalize(string_agg(coalesce(flat, ch), '' ORDER BY place)) AS text FROM {name}_pieces LEFT JOIN {name}_flat USING (ch) GROUP BY 1),
    {name} AS (SELECT i.{key}, coalesce(o.text, i.text, '') AS text FROM {name}_in i LEFT JOIN {name}_out o USING ({key}))"""


def _semantic_documents() -> str:
    """Common table expressions ending in semantic_documents (doc_id, s): the semantic text of each document."""
    removed = r"[\x{FEFF}\x{200B}\x{200C}\x{200D}\x{2060}]"
    return rf"""{_nfkc('composed', 'documents', 'doc_id', 'text')},
    semantic_documents AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{removed}', '', 'g'), '\s+', ' ', 'g')) AS s FROM composed)"""


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _space(c: str) -> str:
    blank = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return f"trim(regexp_replace(coalesce({c}, ''), '{blank}', ' ', 'g'))"


def _normal(c: str) -> str:
    return _space(f"lower(strip_accents(coalesce({c}, '')))")


def _tokens(c: str) -> str:
    """The search tokens of a text as a list."""
    spaced = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
    parts = f"string_split(lower({spaced}), ' ')"
    word = f"list_concat([lower(w)], list_concat(CASE WHEN len({parts}) > 1 THEN {parts} ELSE [] END, CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '') ELSE [] END))"
    return f"list_filter(flatten(list_transform(regexp_extract_all(strip_accents(coalesce({c}, '')), '[A-Za-z0-9_]+'), lambda w: {word})), lambda t: length(t) > 1 AND t NOT IN ({_list(STOPWORDS)}))"


def _case(column: str, values: dict, other: str) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item')"
_SCORE = "CASE lower(trim({0})) WHEN 'very_high' THEN 1.0 WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.45 WHEN 'unknown' THEN 0.3 ELSE 0.6 END"


def _catalog() -> str:
    """Nodes and edges of the catalog tables as common table expressions."""
    key = lambda c: f"upper(trim({c}))"
    w = EDGE_WEIGHTS
    live = lambda name: f"(SELECT * FROM (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL)"
    return f"""
    live_table AS {live('physical_table')}, live_column AS {live('physical_column')}, live_resource AS {live('rest_resource')},
    keys AS (SELECT DISTINCT l[1] AS source_table, r[1] AS target_table FROM (SELECT string_split(upper(trim(j."left")), '.') AS l, string_split(upper(trim(j."right")), '.') AS r FROM (SELECT unnest(joins) AS j FROM validated_rules)) WHERE len(l) = 2 AND len(r) = 2),
    nodes AS (
        SELECT DISTINCT 'physical_table:' || target_table AS id, 'physical_table_stub' AS node_type, target_table AS title, target_table AS name, NULL::VARCHAR AS qualified_name, target_table AS object_name, target_table AS search_text, NULL::VARCHAR AS module_id, []::VARCHAR[] AS aliases, 0.3 AS conf, 'data_dictionary' AS source_type FROM keys WHERE target_table NOT IN (SELECT upper(table_name) FROM live_table WHERE table_name IS NOT NULL)
        UNION ALL SELECT DISTINCT id, 'physical_table' AS node_type, table_name AS title, table_name AS name, NULL::VARCHAR AS qualified_name, table_name AS object_name, concat_ws(' ', table_name, description) AS search_text, module_id, []::VARCHAR[] AS aliases, 0.6 AS conf, 'data_dictionary' AS source_type FROM live_table
        UNION ALL SELECT DISTINCT id, 'physical_column', concat_ws('.', table_name, name), name, concat_ws('.', table_name, name), table_name, concat_ws(' ', table_name, name, description), module_id, [], 0.6, 'data_dictionary' FROM live_column
        UNION ALL SELECT DISTINCT id, 'rest_resource', title, name, NULL, NULL, concat_ws(' ', title, description), module_id, [], {_SCORE.format('confidence')}, source.source_type FROM live_resource
        UNION ALL SELECT DISTINCT id, 'rest_operation', title, NULL, NULL, NULL, concat_ws(' ', title, method, endpoint_path, description), module_id, [], {_SCORE.format('confidence')}, source.source_type FROM rest_operation
        UNION ALL SELECT DISTINCT 'validated_rule:' || id, 'validated_rule', name, name, NULL, NULL, concat_ws(' ', name, description), module_id, [], {_SCORE.format('confidence')}, 'validated_rule' FROM validated_rules
        UNION ALL SELECT DISTINCT 'business_entity:' || entity_id, 'business_entity', name, name, NULL, NULL, concat_ws(' ', name, description), module_id, coalesce(aliases, []), 0.6, 'entity_map' FROM entity_aliases
        UNION ALL SELECT DISTINCT id, 'functional_section', coalesce(title, ''), NULL, NULL, NULL, concat_ws(' ', title, text), module_id, [], {_SCORE.format('confidence')}, source.source_type FROM functional_section WHERE coalesce(node_type, '') <> 'collection_error'
    ), t AS (SELECT DISTINCT id, table_name FROM live_table), c AS (SELECT DISTINCT id, table_name, name FROM live_column),
    r AS (SELECT DISTINCT id, name, parent_resource FROM live_resource), o AS (SELECT DISTINCT id, resource_name FROM rest_operation),
    edges AS (
        SELECT DISTINCT * FROM (
        SELECT 'physical_table:' || source_table AS source, 'physical_table:' || target_table AS target, 'foreign_key_to' AS type, 1.0::DOUBLE AS weight FROM keys
        UNION ALL SELECT t.id AS source, c.id AS target, 'contains_column' AS type, {w['contains_column']}::DOUBLE AS weight FROM t JOIN c USING (table_name)
        UNION ALL SELECT r.id, o.id, 'has_operation', {w['has_operation']}::DOUBLE FROM r JOIN o ON {key('r.name')} = {key('o.resource_name')}
        UNION ALL SELECT p.id, r.id, 'parent_of', {w['parent_of']}::DOUBLE FROM r JOIN r p ON {key('r.parent_resource')} = {key('p.name')} WHERE p.id <> r.id
        UNION ALL SELECT 'validated_rule:' || x.id, t.id, 'uses_table', 1.0::DOUBLE FROM (SELECT id, unnest(tables) AS v FROM validated_rules) x JOIN t ON {key('x.v')} = {key('t.table_name')} WHERE trim(x.v) <> ''
        UNION ALL SELECT 'validated_rule:' || x.id, c.id, 'uses_column', 1.0::DOUBLE FROM (SELECT id, unnest(columns) AS v FROM validated_rules) x JOIN c ON {key('x.v')} = {key("concat_ws('.', c.table_name, c.name)")} WHERE trim(x.v) <> ''
        UNION ALL SELECT 'business_entity:' || x.entity_id, t.id, 'mapped_to_entity', 1.0::DOUBLE FROM (SELECT entity_id, unnest(tables) AS v FROM entity_aliases) x JOIN t ON {key('x.v')} = {key('t.table_name')} WHERE trim(x.v) <> ''
        UNION ALL SELECT 'business_entity:' || x.entity_id, r.id, 'mapped_to_entity', 1.0::DOUBLE FROM (SELECT entity_id, unnest(rest_resources) AS v FROM entity_aliases) x JOIN r ON {key('x.v')} = {key('r.name')} WHERE trim(x.v) <> ''
        UNION ALL SELECT 'business_entity:' || x.entity_id, 'validated_rule:' || v.id, 'mapped_to_entity', 1.0::DOUBLE FROM (SELECT entity_id, unnest(validated_rules) AS v FROM entity_aliases) x JOIN validated_rules v ON {key('x.v')} = {key('v.id')} WHERE trim(x.v) <> ''
        UNION ALL SELECT x.id, t.id, 'mentions_table', 0.8::DOUBLE FROM (SELECT id, unnest(table_mentions) AS v FROM functional_section WHERE coalesce(node_type, '') <> 'collection_error') x JOIN t ON {key('x.v')} = {key('t.table_name')} WHERE trim(x.v) <> ''
        )
    ), ids AS (SELECT DISTINCT id FROM nodes), whole AS (SELECT * FROM edges WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)),
    near AS (SELECT a, b, max(weight) AS weight FROM (SELECT source AS a, target AS b, weight FROM edges UNION ALL SELECT target, source, weight FROM edges) GROUP BY 1, 2)
    """


def _scored(queries: list[tuple[int, str]]) -> str:
    """Common table expressions from ``nodes`` to ``keyed``: keyword and title score, penalty and factor of every node for every query."""
    rows = ", ".join(f"({i}, '{_quoted(x)[1:-1]}')" for i, x in queries)
    names = f"list_filter(list_transform(list_concat([name, qualified_name], aliases), lambda a: {_normal('a')}), lambda a: a <> '')"
    boost = _case("node_type", TYPE_BOOSTS, "1.0")
    return f"""
    qs AS (SELECT query_id, {_normal('text')} AS query, {_tokens('text')} AS qt FROM (VALUES {rows}) AS v(query_id, text)),
    {_nfkc('searched', 'nodes', 'id', "coalesce(nullif(search_text, ''), title)")},
    kwc AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest({_tokens('text')}) AS token FROM searched) GROUP BY ALL),
    kw AS (SELECT id, list(token) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, token) AS k FROM kwc) WHERE k <= 30 GROUP BY 1),
    plain AS (SELECT n.*, coalesce(keywords, []) AS keywords, {names} AS names, {_normal('title')} AS nt, {_normal('qualified_name')} AS nq, {_normal('name')} AS nn, list_distinct({_tokens('title')}) AS tt, upper(coalesce(object_name, '')) AS ob FROM nodes n LEFT JOIN kw USING (id)),
    keyed AS (SELECT *, len(list_intersect(dq, keywords)) + 2.5::DOUBLE * len(list_filter(names, lambda a: contains(query, a))) + 1.2::DOUBLE * len(list_filter(names, lambda a: contains(a, query))) AS keyword,
        CASE WHEN nt = '' THEN 0.0 WHEN nt = query OR (nq <> '' AND nq = query) OR (nn <> '' AND nn = query) THEN 30.0 WHEN starts_with(nt, query || '.') OR starts_with(nt, query || ' ') THEN 2.5 WHEN contains(nt, query) THEN 2.0 WHEN contains(query, nt) THEN 3.0
            WHEN len(dq) > 0 THEN 1.5::DOUBLE * len(list_intersect(dq, tt)) / len(dq) ELSE 0.0 END::DOUBLE AS title_score,
        CASE WHEN node_type NOT IN ('physical_table', 'physical_column') OR (ob <> '' AND contains(query, {_normal('ob')})) OR len(list_intersect(qt, [{_list(AUXILIARY_TERMS)}])) > 0 THEN 1.0 WHEN list_contains(string_split(ob, '_'), 'INTERFACE') OR regexp_matches(ob, '_(INT|GT|TMP|TEMP|STG)$') THEN 0.35
            WHEN list_contains(string_split(ob, '_'), 'DRAFT') THEN 0.45 WHEN len(list_intersect(string_split(ob, '_'), ['ARCHIVE', 'HISTORY', 'HIST'])) > 0 THEN 0.55 ELSE 1.0 END::DOUBLE AS penalty,
        greatest(0.35, coalesce(conf, 0.6))::DOUBLE * {boost}::DOUBLE AS factor FROM plain, (SELECT *, list_distinct(qt) AS dq FROM qs))"""


def _direct(queries: list[tuple[int, str]]) -> str:
    """``_scored`` and BM25 over all nodes, ending in direct (query_id, id, direct)."""
    text = "concat_ws(' ', title, qualified_name, name, search_text, array_to_string(aliases, ' '))"
    return f"""{_scored(queries)},
    {_nfkc('wholes', 'nodes', 'id', text)},
    dt AS (SELECT id, {_tokens('text')} AS toks FROM wholes), st AS (SELECT greatest(count(*), 1) AS n, greatest(avg(len(toks)), 1.0) AS avgdl FROM dt),
    po AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM dt) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
    qn AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(qt) AS term FROM qs) GROUP BY ALL),
    bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qn * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM qn JOIN dfs USING (term) JOIN po USING (term), st GROUP BY 1, 2),
    direct AS (SELECT query_id, id, (0.58::DOUBLE * bm25 + 0.27::DOUBLE * keyword + 0.15::DOUBLE * title_score) * factor * penalty AS direct FROM bm JOIN keyed USING (query_id, id) WHERE (0.58::DOUBLE * bm25 + 0.27::DOUBLE * keyword + 0.15::DOUBLE * title_score) * factor * penalty > 0)"""


def _hybrid(query: str, limit: int) -> str:
    near = "near2 AS (SELECT a, b, max(weight) AS weight FROM (SELECT source AS a, target AS b, weight FROM whole UNION ALL SELECT target, source, weight FROM whole) GROUP BY 1, 2)"
    return f"""WITH {_catalog()}, {_direct([(0, query)])}, {near}, sd AS (SELECT id, direct FROM direct ORDER BY direct DESC, id LIMIT 12),
        g1 AS (SELECT b AS id, max(direct * 0.68::DOUBLE * weight) AS score FROM sd JOIN near2 ON id = a GROUP BY 1), g2 AS (SELECT b AS id, max(score * 0.68::DOUBLE * weight) AS score FROM g1 JOIN near2 ON id = a GROUP BY 1),
        gs AS (SELECT id, max(score) AS graph FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY 1),
        tot AS (SELECT k.id, title, nt, query, coalesce(direct, 0.0) AS direct, coalesce(graph, 0.0) AS graph, round(coalesce(direct, 0.0) + 0.42::DOUBLE * coalesce(graph, 0.0) * penalty, 6) AS total FROM keyed k LEFT JOIN direct d ON d.id = k.id LEFT JOIN gs ON gs.id = k.id)
        SELECT id, title, round(direct, 6) AS direct_score, round(graph, 6) AS graph_score, total AS total_score FROM tot WHERE total > 0 ORDER BY (nt <> query), total DESC, title, id LIMIT {limit}"""


_PAIRS = """
    pairs AS (SELECT DISTINCT string_split(l, '.')[1] AS table_name, string_split(l, '.')[2] AS column_name, string_split(r, '.')[1] AS target_table, string_split(r, '.')[2] AS target_column
        FROM (SELECT upper(trim(j."left")) AS l, upper(trim(j."right")) AS r FROM (SELECT unnest(joins) AS j FROM validated_rules))
        WHERE l IS NOT NULL AND r IS NOT NULL AND r <> '' AND len(string_split(l, '.')) = 2 AND len(string_split(r, '.')) = 2)
"""


def _distinct_text(fields: list[str], separator: str = "' '") -> str:
    """Non-blank fields in order, each text once, joined."""
    values = f"list_filter([{', '.join(fields)}], lambda v: v IS NOT NULL AND trim(v) <> '')"
    return f"array_to_string(list_filter({values}, lambda v, i: list_position({values}, v) = i), {separator})"


def _bm25() -> str:
    return f"""
    d AS (SELECT doc_id AS id, {_tokens('text')} AS toks FROM documents), stats AS (SELECT greatest(count(*), 1) AS n, greatest(avg(len(toks)), 1.0) AS avgdl FROM d),
    p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT sample_id AS query_id, unnest({_tokens('text')}) AS term FROM lang_samples) GROUP BY ALL),
    scored AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qn * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN df USING (term) JOIN p USING (term), stats GROUP BY 1, 2)
    """


def oracle_sql() -> dict[str, str]:
    cat, tok = _catalog(), _tokens
    first = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
    scores = f"s AS (SELECT vec_id AS id, label AS parent, round(list_cosine_similarity(embedding::DOUBLE[], {first}::DOUBLE[]), 5) AS score FROM embeddings)"
    seeds = "seeds AS (SELECT DISTINCT 'business_entity:' || entity_id AS id FROM entity_aliases ORDER BY 1 LIMIT 12)"
    hop1 = "h1 AS (SELECT b AS node, max(0.68 * weight) AS score FROM seeds JOIN near ON id = a GROUP BY 1)"
    hop2 = "h2 AS (SELECT b AS node, max(score * 0.68 * weight) AS score FROM h1 JOIN near ON node = a GROUP BY 1)"
    entity = "e AS (SELECT module_id AS query_id, id, node_type, title, length(title) * 1.0 + length(id) / 100.0 AS score FROM nodes WHERE node_type IN ('business_entity', 'validated_rule'))"
    seeded = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS seed_rank FROM e),
        sd AS (SELECT query_id, id, node_type, seed_rank, 1.0::DOUBLE / seed_rank AS seed_score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ranked WHERE seed_rank <= 12) WHERE score >= 0.1 * best)"""
    routed = """ends AS (SELECT source AS a, target AS b, type FROM edges UNION ALL SELECT target, source, type FROM edges),
        found AS (SELECT query_id, id AS node, 1.0 + seed_score AS score, 'seed' AS reason FROM sd
            UNION ALL SELECT query_id, b, 0.85 + seed_score, 'bridge' FROM sd JOIN ends ON a = id WHERE node_type = 'business_entity' AND type IN ('mapped_to_entity', 'uses_table', 'uses_column')
            UNION ALL SELECT query_id, b, 0.90 + seed_score, 'bridge' FROM sd JOIN ends ON a = id WHERE node_type = 'validated_rule' AND type IN ('uses_table', 'uses_column')),
        rt AS (SELECT query_id, node, score, reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY score DESC, reason) AS k FROM found) WHERE k = 1)"""
    semantic = _semantic_documents()
    states = f"""WITH {semantic}, o AS (SELECT doc_id AS id, sha256(s) AS h FROM semantic_documents WHERE doc_id % 10 <> 0),
        n AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 7 = 0 THEN trim(s || ' changed') ELSE s END) AS h FROM semantic_documents WHERE doc_id % 11 <> 0)"""
    page = _normal("concat_ws(' ', title, text, url)")
    raw = _space("concat_ws(' ', title, text, url)")
    address = f"translate({_normal('url')}, '-_', '  ')"
    said = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
    q1 = "'ledger periods'"
    results = f"""res AS (SELECT module_id AS query_id, id, title, (length(id) * 37 % 101) / 101.0::DOUBLE + length(title) / 10.0::DOUBLE AS score, (length(id) * 53 % 97) / 97.0::DOUBLE AS semantic,
        CASE node_type WHEN 'validated_rule' THEN 'validated_rules' WHEN 'physical_table' THEN 'physical_tables' WHEN 'business_entity' THEN 'business_context' ELSE 'service' END AS g
        FROM nodes WHERE node_type IN ('physical_table', 'business_entity', 'rest_resource', 'validated_rule'))"""
    return {
        "scan_filter_project_lineitem": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03",
        "json_props_extract": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "collection_errors_dropped": "SELECT module_id, count(DISTINCT id) AS n FROM functional_section WHERE coalesce(node_type, '') <> 'collection_error' GROUP BY 1",
        "html_title_and_text": f"SELECT DISTINCT id, {_space('title')} AS title, 1::INTEGER AS level, 'body' AS body FROM functional_section WHERE title IS NOT NULL AND {_space('title')} <> ''",
        "html_links": "SELECT DISTINCT 'https://docs.kb.example/' || guide_id || '/toc.html' AS page, source.url AS url, 'x' AS label FROM functional_section WHERE source.url IS NOT NULL AND starts_with(source.url, 'https://docs.kb.example/' || guide_id || '/')",
        "url_parts_release": "SELECT doc_id, 'docs.kb.example' AS host, string_split(url, '/')[-1] AS file, '24B' AS release FROM documents WHERE url IS NOT NULL",
        "text_normalize_space": f"SELECT doc_id, md5({_space('text')}) AS h FROM documents",
        "text_normalize": f"SELECT doc_id, {_normal('title')} AS t FROM documents",
        "text_tokenize_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
        "text_tokens_exploded": f"SELECT id, term, count(*) AS tf, dl::BIGINT AS dl FROM (SELECT sample_id AS id, unnest(t) AS term, len(t) AS dl FROM (SELECT sample_id, {tok('text')} AS t FROM lang_samples)) GROUP BY id, term, dl",
        "text_slugify_stable_id": f"SELECT DISTINCT table_name, {_SLUG.format(_normal('description'))} AS slug, 'table:' || left({_SLUG.format(_normal('table_name'))}, 48) || ':' || left(sha1(table_name || '|' || coalesce(description, '')), 16) AS sid FROM physical_table",
        "text_merge_fields": f"SELECT p_partkey, {_space('p_name || chr(32) || p_brand || chr(32) || p_type || chr(32) || p_size')} AS merged FROM part",
        "text_mentions": r"SELECT id, h, array_to_string(m, ',') AS tables FROM (SELECT DISTINCT id, md5(text) AS h, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[^\P{L}\x00-\x7F]', 'x', 'g'), '\b[A-Z][A-Z0-9$#]{1,15}_[A-Z0-9_$#]{2,}\b'))) AS m FROM functional_section WHERE text IS NOT NULL) WHERE len(m) > 0",
        "text_documented_references": r"""SELECT id, upper(regexp_extract(t, p, 1)) AS table_name, upper(regexp_extract(t, p, 2)) AS column_name FROM (SELECT DISTINCT id, 'The value references to ' || j."right" || ' always.' AS t, '(?i)\breferences?(?:\s+to)?\s+([A-Z][A-Z0-9_$#]*_[A-Z0-9_$#]+)\.([A-Z][A-Z0-9_$#]*)\b' AS p FROM (SELECT id, unnest(joins) AS j FROM validated_rules)) WHERE regexp_matches(t, p)""",
        "text_confidence_score": f"SELECT confidence, max({_SCORE.format('confidence')})::DOUBLE AS score, count(*) AS n FROM rest_operation GROUP BY 1",
        "text_semantic_normalize": f"WITH {semantic} SELECT doc_id, md5(s) AS h FROM semantic_documents",
        "text_sha256_dedupe": f"WITH {semantic} SELECT count(*) AS n_segments, count(DISTINCT sha256(s)) AS n_unique, count(*) - count(DISTINCT sha256(s)) AS n_deduplicated FROM semantic_documents",
        "text_keywords_top30": f"SELECT sample_id, coalesce(string_agg(token, ' ' ORDER BY n DESC, token), '') AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, token) AS k FROM (SELECT s.sample_id, x.token, count(x.token) AS n FROM lang_samples s LEFT JOIN (SELECT sample_id, unnest({tok('text')}) AS token FROM lang_samples) x USING (sample_id) GROUP BY 1, 2)) WHERE k <= 30 GROUP BY 1",
        "text_truncate_summary": f"SELECT doc_id, md5(CASE WHEN length(s) <= 500 THEN s ELSE rtrim(left(s, 499)) || '…' END) AS h FROM (SELECT doc_id, {_space('text')} AS s FROM documents)",
        "page_classifier": f"""SELECT doc_id, CASE WHEN {said("' ' || n", SECURITY_MARKERS)} OR contains(u, '_JOB') OR contains(u, '_DUTY') OR ends_with(t, ' duty') OR contains(n, 'transaction analysis duty') THEN 'security'
            WHEN t = 'get help' THEN 'excluded' WHEN t = 'overview' AND {said('a', ('subject areas chap', 'business questions chap'))} THEN 'analytics' WHEN t = 'overview' AND {said('a', ('job roles chap', 'duty roles chap'))} THEN 'security' WHEN t = 'overview' THEN 'excluded'
            WHEN {said('n', ANALYTICS_MARKERS)} THEN 'analytics' WHEN length(n) >= 80 THEN 'analytics' ELSE 'excluded' END AS kind
            FROM (SELECT doc_id, {page} AS n, {_normal('title')} AS t, {address} AS a, upper({raw}) AS u FROM documents)""",
        "catalog_column_roles": f"""WITH {_PAIRS}, k AS (SELECT table_name, any_value(primary_key) AS pk FROM physical_table WHERE primary_key IS NOT NULL GROUP BY 1),
            p AS (SELECT DISTINCT table_name, column_name FROM pairs),
            c AS (SELECT DISTINCT c.id, c.table_name, c.name, upper(coalesce(c.datatype, '')) AS dt, coalesce(c.description, '') AS d, coalesce(list_contains(k.pk, c.name), false) AS ispk, p.column_name IS NOT NULL AS isfk FROM physical_column c LEFT JOIN k USING (table_name) LEFT JOIN p ON p.table_name = c.table_name AND p.column_name = c.name),
            roles AS (SELECT id, md5(d) AS h, list_filter([CASE WHEN ispk THEN 'primary_key' END, CASE WHEN isfk THEN 'foreign_key' END, CASE WHEN name IN ({_list(AUDIT_COLUMNS)}) THEN 'audit' END, CASE WHEN name = 'OBJECT_VERSION_NUMBER' THEN 'optimistic_lock' END,
                CASE WHEN name IN ('LANGUAGE', 'SOURCE_LANG') THEN 'language' END, CASE WHEN ends_with(name, '_FLAG') THEN 'categorical_flag' END, CASE WHEN ends_with(name, '_STATUS') OR ends_with(name, '_STATUS_CODE') OR name = 'STATUS' THEN 'status' END,
                CASE WHEN ends_with(name, '_DATE') OR ends_with(name, '_DATETIME') OR contains(dt, 'TIMESTAMP') OR dt = 'DATE' THEN 'temporal' END, CASE WHEN ends_with(name, '_ID') AND NOT isfk THEN 'identifier' END, CASE WHEN ends_with(name, '_CODE') OR name = 'CODE' THEN 'business_code' END,
                CASE WHEN contains(lower(d), 'percent') OR ends_with(name, '_PERCENT') OR ends_with(name, '_PERCENTAGE') THEN 'percentage' END, CASE WHEN contains(lower(d), 'amount') OR ends_with(name, '_AMOUNT') OR ends_with(name, '_AMT') THEN 'amount' END,
                CASE WHEN contains(lower(d), 'quantity') OR ends_with(name, '_QUANTITY') OR ends_with(name, '_QTY') THEN 'quantity' END, CASE WHEN name IN ('NAME', 'DESCRIPTION') OR ends_with(name, '_NAME') OR ends_with(name, '_DESCRIPTION') THEN 'descriptive_attribute' END], lambda x: x IS NOT NULL) AS l FROM c)
            SELECT id, h, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'attribute' END AS roles, CASE WHEN len(l) > 0 THEN l[1] ELSE 'attribute' END AS role FROM roles""",
        "catalog_grain": "SELECT DISTINCT table_name, CASE WHEN len(coalesce(primary_key, [])) > 0 THEN 'One row for each combination of ' || array_to_string(primary_key, ', ') || '.' END AS grain, CASE WHEN len(coalesce(primary_key, [])) > 0 THEN 'high' ELSE 'unknown' END AS confidence FROM physical_table",
        "catalog_table_rules": f"""WITH {_PAIRS}, tb AS (SELECT table_name, any_value(primary_key) FILTER (primary_key IS NOT NULL) AS pk, any_value(description) FILTER (description IS NOT NULL) AS d FROM physical_table GROUP BY 1),
            nm AS (SELECT DISTINCT table_name, name FROM physical_column), fl AS (SELECT DISTINCT table_name, name FROM physical_column WHERE ends_with(name, '_FLAG') AND coalesce(description, '') <> ''),
            rules AS (SELECT table_name, 'documented_business_context' AS rule_type, 0 AS n FROM tb WHERE coalesce(d, '') <> '' UNION ALL SELECT table_name, 'uniqueness', len(pk) FROM tb WHERE len(pk) > 0
                UNION ALL SELECT table_name, 'optimistic_locking', 1 FROM tb SEMI JOIN (SELECT table_name FROM nm WHERE name = 'OBJECT_VERSION_NUMBER') USING (table_name)
                UNION ALL SELECT table_name, 'effective_dating', 2 FROM tb SEMI JOIN (SELECT table_name FROM nm WHERE name IN ('START_DATE_ACTIVE', 'END_DATE_ACTIVE') GROUP BY 1 HAVING count(*) = 2) USING (table_name)
                UNION ALL SELECT table_name, 'effective_dating', 2 FROM tb SEMI JOIN (SELECT table_name FROM nm WHERE name IN ('EFFECTIVE_START_DATE', 'EFFECTIVE_END_DATE') GROUP BY 1 HAVING count(*) = 2) USING (table_name)
                UNION ALL SELECT table_name, 'translation', 2 FROM tb SEMI JOIN (SELECT table_name FROM nm WHERE name IN ('LANGUAGE', 'SOURCE_LANG') GROUP BY 1 HAVING count(*) = 2) USING (table_name)
                UNION ALL SELECT table_name, 'audit', n FROM tb JOIN (SELECT table_name, count(*) AS n FROM nm WHERE name IN ({_list(AUDIT_COLUMNS)}) GROUP BY 1) USING (table_name)
                UNION ALL SELECT table_name, 'referential_integrity', 1 FROM tb JOIN (SELECT DISTINCT table_name, column_name FROM pairs) USING (table_name)
                UNION ALL SELECT table_name, 'flag_domain', 1 FROM tb JOIN fl USING (table_name))
            SELECT rule_type, count(*) AS n_rules, count(DISTINCT table_name) AS n_tables, sum(n)::BIGINT AS n_columns FROM rules GROUP BY 1""",
        "catalog_ranking_rules": r"""WITH c AS (SELECT DISTINCT table_name, regexp_replace(regexp_replace(regexp_replace(name, '_NO$', '_NUMBER'), '_FLG$', '_CURRENT_FLAG'), '^CHANGE_TS$', 'LAST_UPDATE_DATE') AS name FROM physical_column)
            SELECT purpose, "column", count(*) AS n FROM (SELECT 'latest_business_version_candidate' AS purpose, name AS "column" FROM c WHERE (name = 'VERSION_NUMBER' OR ends_with(name, '_VERSION_NUMBER') OR ends_with(name, '_VERSION_NUM')) AND name <> 'OBJECT_VERSION_NUMBER'
            UNION ALL SELECT 'current_record_candidate', name FROM c WHERE ends_with(name, '_FLAG') AND (starts_with(name, 'CURRENT_') OR starts_with(name, 'LATEST_') OR contains(name, '_CURRENT_') OR contains(name, '_LATEST_'))
            UNION ALL SELECT 'most_recent_update_candidate', name FROM c WHERE name = 'LAST_UPDATE_DATE') GROUP BY 1, 2""",
        "rule_latest_version": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING') WHERE k = 1",
        "rule_latest_event": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "rule_current_flag": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag IN ('N', 'R')",
        "node_union_merge": "SELECT 'nation:' || n_nationkey AS id, 'nation' AS node_type, n_name AS title, array_to_string(list_sort(list_distinct(list_append(list(c_mktsegment), 'core'))), ',') AS modules, 0.9::DOUBLE AS confidence_score, n_name AS search_text FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
        "edge_last_write_wins": "SELECT 'part:' || l_partkey AS source, 'supplier:' || l_suppkey AS target, 'mentions_table' AS type, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS weight, arg_max(l_orderkey || '-' || l_linenumber, l_orderkey * 10 + l_linenumber) AS evidence FROM lineitem GROUP BY l_partkey, l_suppkey",
        "reference_edges": f"WITH {_PAIRS} SELECT 'physical_table:' || table_name AS source, 'physical_table:' || target_table AS target, column_name AS source_column, target_column, 1.0::DOUBLE AS weight FROM pairs",
        "reference_stubs": f"WITH {_PAIRS} SELECT DISTINCT 'physical_table:' || target_table AS id, 'physical_table_stub' AS node_type, target_table AS table_name FROM pairs WHERE target_table NOT IN (SELECT upper(table_name) FROM physical_table WHERE sub_module IS NOT NULL)",
        "edges_with_both_ends": "SELECT DISTINCT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' AND p_size < 20",
        "same_module_names": f"WITH r AS (SELECT DISTINCT id, {_normal('name')} AS k, module_id AS m FROM rest_resource), o AS (SELECT DISTINCT id, {_normal('resource_name')} AS k, module_id AS m FROM rest_operation), j AS (SELECT o.id AS left_id, r.id AS right_id, coalesce(o.m = r.m, false) AS same FROM o JOIN r USING (k) WHERE k <> '') SELECT DISTINCT left_id, right_id FROM (SELECT *, bool_or(same) OVER (PARTITION BY left_id) AS any_same FROM j) WHERE same OR NOT any_same",
        "catalog_edges": f"WITH {cat} SELECT source, target, type, weight FROM edges",
        "module_overlap_filter": f"WITH {cat} SELECT node_type, count(*) AS n FROM nodes WHERE module_id IN ('prc', 'tax') GROUP BY 1",
        "alias_contains": f"WITH a AS (SELECT DISTINCT alias_id, trim(regexp_replace({_normal('alias')}, '[^a-z0-9]+', ' ', 'g')) AS alias FROM (SELECT entity_id AS alias_id, unnest(aliases) AS alias FROM entity_aliases)), x AS (SELECT DISTINCT id, trim(regexp_replace({_normal('description')}, '[^a-z0-9]+', ' ', 'g')) AS text FROM validated_rules WHERE description IS NOT NULL) SELECT alias_id, id, count(*) AS n, round(least(0.9, 0.55 + 0.08 * count(*)), 6)::DOUBLE AS weight FROM a JOIN x ON contains(' ' || text || ' ', ' ' || alias || ' ') WHERE length(alias) >= 4 GROUP BY 1, 2",
        "graph_layer_split": f"WITH {cat} SELECT {_case('s.node_type', {k: repr(v) for k, v in NODE_LAYERS.items()}, 'NULL')} AS graph_layer, type, count(*) AS n FROM whole w JOIN nodes s ON s.id = w.source JOIN nodes d ON d.id = w.target WHERE {_case('s.node_type', {k: repr(v) for k, v in NODE_LAYERS.items()}, 'NULL')} = {_case('d.node_type', {k: repr(v) for k, v in NODE_LAYERS.items()}, 'NULL')} GROUP BY 1, 2",
        "graph_master": f"WITH {cat}, core AS (SELECT id FROM nodes WHERE node_type IN ('business_entity', 'business_attribute', 'validated_rule')) SELECT DISTINCT source, target, type FROM whole WHERE type IN ('has_attribute', 'mapped_to_entity', 'mapped_to_attribute', 'uses_table', 'uses_column', 'environment_variant_of') AND (source IN (SELECT id FROM core) OR target IN (SELECT id FROM core))",
        "graph_stats": f"WITH {cat} SELECT 'node_type' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge_type', type, count(*) FROM whole GROUP BY 2 UNION ALL SELECT 'module', module_id, count(*) FROM nodes WHERE node_type <> 'physical_table_stub' GROUP BY 2 UNION ALL SELECT 'layer', {_case('node_type', {k: repr(v) for k, v in NODE_LAYERS.items()}, 'NULL')}, count(*) FROM nodes GROUP BY 2",
        "graph_adjacency_degree": f"WITH {cat} SELECT from_id, count(*) AS degree, round(sum(weight), 4) AS total FROM (SELECT source AS from_id, weight FROM edges UNION ALL SELECT target, weight FROM edges) GROUP BY 1",
        "graph_expand_1hop": f"WITH {cat}, {seeds}, {hop1} SELECT node, round(score, 6) AS score FROM h1",
        "graph_expand_2hop": f"WITH {cat}, {seeds}, {hop1}, {hop2} SELECT node, round(max(score), 6) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1",
        "document_frequencies": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY 1",
        "corpus_length": f"SELECT greatest(count(*), 1) AS n_docs, round(greatest(avg(len({tok('text')})), 1.0), 6) AS avgdl FROM documents",
        "bm25_topk": f"WITH {_bm25()} SELECT query_id, id, score, rank FROM (SELECT query_id, id, round(bm25, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 5) DESC, id) AS rank FROM scored) WHERE rank <= 10",
        "root_scores_minmax": f"WITH {_bm25()}, page AS (SELECT * FROM (SELECT query_id, id, round(bm25, 6) AS b, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS rank FROM scored) WHERE rank <= 20) SELECT query_id, id, rank, round(CASE WHEN hi > lo THEN (b - lo) / (hi - lo) ELSE 1.0 END, 4) AS score FROM (SELECT *, max(b) OVER (PARTITION BY query_id) AS hi, min(b) OVER (PARTITION BY query_id) AS lo FROM page)",
        "title_scores": f"""WITH {cat} SELECT id, score FROM (SELECT id, round(CASE WHEN t = '' THEN 0.0 WHEN t = {q1} OR q = {q1} OR n = {q1} THEN 30.0 WHEN starts_with(t, {q1} || '.') OR starts_with(t, {q1} || ' ') THEN 2.5 WHEN contains(t, {q1}) THEN 2.0 WHEN contains({q1}, t) THEN 3.0
            ELSE 1.5 * len(list_intersect(tk, ['ledger', 'periods'])) / 2 END, 6)::DOUBLE AS score FROM (SELECT id, {_normal('title')} AS t, {_normal('qualified_name')} AS q, {_normal('name')} AS n, list_distinct({tok('title')}) AS tk FROM nodes)) WHERE score > 0""",
        "auxiliary_penalties": f"SELECT DISTINCT table_name, CASE WHEN list_contains(p, 'INTERFACE') OR regexp_matches(table_name, '_(INT|GT|TMP|TEMP|STG)$') THEN 0.35 WHEN list_contains(p, 'DRAFT') THEN 0.45 WHEN len(list_intersect(p, ['ARCHIVE', 'HISTORY', 'HIST'])) > 0 THEN 0.55 ELSE 1.0 END::DOUBLE AS penalty FROM (SELECT table_name, string_split(upper(table_name), '_') AS p FROM physical_table)",
        "evidence_groups": f"WITH {cat} SELECT CASE WHEN node_type = 'validated_rule' THEN 'validated_rules' WHEN node_type = 'physical_column' THEN 'physical_columns' WHEN node_type IN ('physical_table', 'physical_table_stub') THEN 'physical_tables' WHEN node_type = 'business_entity' THEN 'business_context' WHEN starts_with(node_type, 'rest_') THEN 'service' ELSE 'functional_documentation' END AS evidence_group, count(*) AS n FROM nodes GROUP BY 1",
        "children_prefilter": f"WITH {cat}, op AS (SELECT DISTINCT id, title, description AS d FROM rest_operation) SELECT source, id, rank FROM (SELECT source, op.id, row_number() OVER (PARTITION BY source ORDER BY (m IS NULL), m DESC NULLS LAST, title, op.id) AS rank FROM (SELECT DISTINCT source, target FROM edges WHERE type = 'has_operation') e JOIN (SELECT *, CASE WHEN contains(lower(d), 'approval history') THEN length(d) END AS m FROM op) op ON op.id = e.target) WHERE rank <= 4",
        "semantic_rerank": f"""WITH {cat}, {results}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS search_rank, max(score) OVER w AS top, min(semantic) OVER w AS lo, max(semantic) OVER w AS hi FROM res WINDOW w AS (PARTITION BY query_id)),
            b AS (SELECT *, round(0.72 * CASE WHEN hi - lo > 1e-6 THEN (semantic - lo) / (hi - lo) ELSE 1.0 END + 0.28 * CASE WHEN top > 0 THEN sqrt(greatest(score, 0.0) / top) ELSE 0.0 END, 6) AS ctx FROM a),
            cc AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY ctx DESC, search_rank) AS gr, max(score) OVER (PARTITION BY query_id, g) AS gb, max(ctx) OVER (PARTITION BY query_id) AS best FROM b),
            k AS (SELECT * FROM cc WHERE search_rank <= 4 OR (gr = 1 AND (gb >= 0.10 * top OR g = 'validated_rules')) OR ctx >= 0.45 * best)
            SELECT query_id, id, round(ctx, 5) AS context_score, row_number() OVER (PARTITION BY query_id ORDER BY ctx DESC, search_rank, title) AS rank, search_rank FROM k""",
        "context_rendering": "SELECT query_id, md5(c) AS h, length(c)::BIGINT AS characters FROM (SELECT guide_id AS query_id, string_agg('[' || rank || '] ' || coalesce(node_type, '') || ': ' || coalesce(title, '') || chr(10) || 'Source: ' || st || chr(10) || 'Relevance: 0.5', chr(10) || chr(10) ORDER BY rank) AS c FROM (SELECT *, row_number() OVER (PARTITION BY guide_id ORDER BY id, coalesce(title, '')) AS rank FROM (SELECT DISTINCT guide_id, id, node_type, title, source.source_type AS st FROM functional_section)) GROUP BY 1)",
        "vector_topk_roots": f"WITH {scores} SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10",
        "vector_segment_mean_top2": f"WITH {scores} SELECT parent, round(avg(score), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC) AS k FROM s) WHERE k <= 2 GROUP BY 1",
        "vector_group_topk": f"WITH {scores} SELECT parent, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3",
        "vector_shape_check": """WITH v AS (SELECT vector_id, any_value(embedding) AS e, any_value(dimensions) AS d FROM semantic_embeddings GROUP BY 1), f AS (SELECT *, len(list_filter(e, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0 AS finite FROM v)
            SELECT count(*) AS n_vectors, count(*) FILTER (e IS NULL) AS n_null, count(*) FILTER (e IS NOT NULL AND len(e) <> d) AS n_wrong_size, count(*) FILTER (e IS NOT NULL AND NOT finite) AS n_not_finite, count(*) FILTER (e IS NOT NULL AND finite AND abs(sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) - 1) > 1e-3) AS n_not_unit FROM f""",
        "federated_seeds": f"WITH {cat}, {entity}, {seeded} SELECT query_id, id, seed_rank, round(seed_score, 6) AS seed_score FROM sd",
        "federated_routes": f"WITH {cat}, {entity}, {seeded}, {routed} SELECT query_id, node, round(score, 6) AS score, reason FROM rt",
        "corpus_snapshot_diff": f"{states} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'reused' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.id = n.id",
        "corpus_unreferenced_texts": f"{states} SELECT DISTINCT h AS text_hash FROM o WHERE h NOT IN (SELECT h FROM n)",
        "corpus_upsert": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
        "embedding_pending": "SELECT DISTINCT normalized_text_hash AS text_hash FROM semantic_embeddings WHERE normalized_text_hash NOT IN (SELECT normalized_text_hash FROM semantic_embeddings WHERE model_name = 'kb-encoder-base' AND embedding_profile_version = 'profile-2' AND embedding IS NOT NULL)",
        "embedding_reuse": "SELECT count(*) AS n, min(dimensions)::BIGINT AS least, max(dimensions)::BIGINT AS most, min(dimensions) = max(dimensions) AS consistent FROM semantic_embeddings WHERE model_name = 'kb-encoder-base' AND embedding_profile_version = 'profile-2'",
        "run_latest_by_status": "SELECT signature, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY CASE status WHEN 'running' THEN 1 WHEN 'interrupted' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END, ts DESC, run_id) AS k FROM (SELECT user_id AS signature, event_id AS run_id, ['completed', 'failed', 'interrupted', 'running'][event_id % 4 + 1] AS status, ts FROM events)) WHERE k = 1",
        "stream_corpus_refresh": f"WITH {semantic} SELECT DISTINCT sha256(s) AS text_hash FROM semantic_documents WHERE s <> ''",
        "check_duplicates": "WITH d AS (SELECT id FROM physical_column GROUP BY 1 HAVING count(*) > 1) SELECT (SELECT count(*) FROM d) AS n_duplicates, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM d ORDER BY id LIMIT 10)) AS sample",
        "check_orphans": f"WITH {cat}, n AS (SELECT id FROM nodes WHERE node_type <> 'rest_resource') SELECT DISTINCT source, target, type FROM edges WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)",
        "check_environment_catalog": """WITH n AS (SELECT lower(trim(name)) AS name FROM rest_resource), w AS (SELECT lower(trim(v)) AS name FROM (SELECT unnest(rest_resources) AS v FROM entity_aliases)), m AS (
            SELECT 'ENVIRONMENT_RESOURCE_DUPLICATES' AS code, (SELECT count(*) FROM (SELECT name FROM n WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS v, 'ERROR' AS bad UNION ALL SELECT 'ENVIRONMENT_MODULE_UNKNOWN_RESOURCES', (SELECT count(*) FROM w WHERE name IS NULL OR name NOT IN (SELECT name FROM n WHERE name IS NOT NULL)), 'ERROR' UNION ALL SELECT 'ENVIRONMENT_MODULES_MISSING', (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM entity_aliases), 'WARNING')
            SELECT CASE WHEN v <> 0 THEN bad ELSE 'OK' END AS status, code, v::VARCHAR AS value FROM m""",
        "check_mojibake": r"SELECT id, count(*) AS n FROM (SELECT DISTINCT id, text FROM functional_section) WHERE regexp_matches(text, '[├┬\x{FFFD}]|Ã[\x{80}-\x{BF}]') GROUP BY 1",
        "layer_signature": "SELECT g, sha256('[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']') AS signature FROM (SELECT n_regionkey AS g, n_nationkey, n_name FROM nation) GROUP BY 1",
        "check_vectors": """WITH v AS (SELECT vector_id AS id, any_value(embedding) AS e, any_value(dimensions) AS d FROM semantic_embeddings GROUP BY 1)
            SELECT CASE WHEN (SELECT count(*) FROM v WHERE e IS NULL OR len(e) <> d) > 0 THEN 'ERROR' ELSE 'OK' END AS status, 'INDEX_SEMANTIC_VECTOR_SHAPE' AS code UNION ALL SELECT 'OK', 'INDEX_SEMANTIC_ROOT_COVERAGE' UNION ALL SELECT 'OK', 'INDEX_SEMANTIC_UNKNOWN_IDS'""",
        "check_graph": f"""WITH {cat}, m AS (SELECT 'GRAPH_INVALID_NODES' AS code, 'GRAPH_INVALID_NODES' AS fine, (SELECT count(*) FROM nodes WHERE coalesce(id, '') = '' OR node_type IS NULL) AS v, 'ERROR' AS bad
            UNION ALL SELECT 'GRAPH_DUPLICATE_NODE_IDS', 'GRAPH_UNIQUE_NODE_IDS', (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY 1 HAVING count(*) > 1)), 'ERROR' UNION ALL SELECT 'GRAPH_INVALID_EDGES', 'GRAPH_INVALID_EDGES', (SELECT count(*) FROM whole WHERE source IS NULL OR target IS NULL OR type IS NULL), 'ERROR'
            UNION ALL SELECT 'GRAPH_ORPHAN_EDGES', 'GRAPH_NO_ORPHAN_EDGES', (SELECT count(*) FROM whole WHERE source NOT IN (SELECT id FROM ids) OR target NOT IN (SELECT id FROM ids)), 'ERROR'
            UNION ALL SELECT 'GRAPH_FORBIDDEN_EDGES', 'GRAPH_NO_FORBIDDEN_EDGES', (SELECT count(*) FROM whole WHERE type IN ('mentions_entity', 'related_by_alias', 'incoming_foreign_key_from')), 'ERROR'
            UNION ALL SELECT 'GRAPH_DUPLICATE_EDGES', 'GRAPH_DUPLICATE_EDGES', (SELECT count(*) FROM (SELECT 1 FROM whole GROUP BY source, target, type HAVING count(*) > 1)), 'WARNING'
            UNION ALL SELECT 'GRAPH_PHYSICAL_STUBS', 'GRAPH_PHYSICAL_STUBS', (SELECT count(*) FROM nodes WHERE node_type = 'physical_table_stub'), 'WARNING' UNION ALL SELECT 'GRAPH_COUNTS', 'GRAPH_COUNTS', 0, 'ERROR')
            SELECT 'all' AS subject, CASE WHEN v <> 0 THEN bad ELSE 'OK' END AS status, CASE WHEN v <> 0 THEN code ELSE fine END AS code FROM m""",
        "index_rebuild_decisions": f"WITH {cat} SELECT DISTINCT graph_layer, CASE WHEN graph_layer = 'business' THEN 'skip' ELSE 'rebuild' END AS action FROM (SELECT {_case('node_type', {k: repr(v) for k, v in NODE_LAYERS.items()}, 'NULL')} AS graph_layer FROM nodes) UNION ALL SELECT 'security', 'drop'",
        "keyword_scores": f"WITH {cat}, {_scored([(0, 'delivery schedule and the stock count')])} SELECT id, round(keyword, 4)::DOUBLE AS score FROM keyed WHERE node_type = 'business_entity' AND keyword > 0",
        "direct_scores": f"""WITH {cat}, {_direct([(1, 'rate types'), (2, 'stock count of the site directory')])}
            SELECT query_id, id, score, rank FROM (SELECT query_id, id, round(direct, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(direct, 5) DESC, id) AS rank FROM direct) WHERE rank <= 50""",
        "hybrid_search": _hybrid("ledger periods of the budget version", 20),
        "federated_fallback": """WITH r AS (SELECT DISTINCT id, name FROM rest_resource), x AS (SELECT q, id, round(length(name) / 40.0, 4) AS sim FROM r, (VALUES ('prc'), ('pay'), ('tax')) AS v(q))
            SELECT q AS query_id, id AS node, round(0.70 + 0.20 * sim, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC NULLS LAST, id) AS k FROM x) WHERE k <= 3""",
        "federated_candidates": f"""WITH {cat}, {entity}, {seeded}, {routed}, sim AS (SELECT q AS query_id, id AS child, round(length(title) / 60.0, 4)::DOUBLE AS similarity, title FROM nodes, (VALUES ('prc'), ('pay'), ('tax')) AS v(q) WHERE node_type IN ('physical_column', 'rest_operation')),
            typed AS (SELECT rt.*, node_type FROM rt JOIN nodes ON nodes.id = rt.node), holds AS (SELECT source AS tbl, target AS col FROM edges WHERE type = 'contains_column'),
            explicit AS (SELECT DISTINCT query_id, tbl AS node FROM typed JOIN holds ON col = node WHERE node_type = 'physical_column'),
            tables AS (SELECT query_id, node FROM typed WHERE node_type = 'physical_table'), bare AS (SELECT * FROM tables EXCEPT SELECT * FROM explicit),
            cols AS (SELECT b.query_id, col, similarity, row_number() OVER (PARTITION BY b.query_id, b.node ORDER BY similarity DESC NULLS LAST, title, col) AS k FROM bare b JOIN holds ON tbl = node LEFT JOIN sim ON sim.query_id = b.query_id AND sim.child = col),
            reach AS (SELECT * FROM tables UNION SELECT * FROM explicit),
            ops AS (SELECT t.query_id, t.node, e.target AS op, similarity, title, row_number() OVER (PARTITION BY t.query_id, t.node ORDER BY similarity DESC NULLS LAST, title, e.target) AS k FROM typed t JOIN edges e ON e.source = t.node AND e.type = 'has_operation' LEFT JOIN sim ON sim.query_id = t.query_id AND sim.child = e.target WHERE t.node_type = 'rest_resource'),
            every AS (SELECT query_id, node, score, reason, CASE WHEN reason = 'seed' THEN 0 ELSE 1 END AS priority FROM rt
                UNION ALL SELECT query_id, node, 0.95, 'bridge', 2 FROM typed WHERE node_type IN ('physical_table', 'physical_column') UNION ALL SELECT query_id, node, 0.90, 'parent_table', 3 FROM explicit
                UNION ALL SELECT query_id, col, 0.70 + 0.20 * coalesce(similarity, 0.0), 'semantic_column', 3 FROM cols WHERE k <= 5
                UNION ALL SELECT DISTINCT query_id, e.target, 0.82, 'foreign_key', 3 FROM reach JOIN edges e ON e.source = node AND e.type = 'foreign_key_to'
                UNION ALL SELECT query_id, op, 0.65 + 0.20 * coalesce(similarity, 0.0), 'semantic_operation', 3 FROM ops WHERE k <= 3),
            once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY priority, score DESC, reason) AS k FROM every) WHERE k = 1)
            SELECT query_id, node, round(score, 6)::DOUBLE AS score, reason, priority::BIGINT AS priority, row_number() OVER (PARTITION BY query_id ORDER BY priority, score DESC, node) AS rank FROM once""",
        "vector_block_scan": """WITH q AS (SELECT row_number() OVER (ORDER BY label) - 1 AS query_no, v FROM (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1)),
            s AS (SELECT query_no, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM q, embeddings)
            SELECT query_no, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY round(score, 6) DESC, id) AS rank FROM s) WHERE rank <= 5""",
        "node_search_texts": " UNION ALL ".join(
            f"SELECT DISTINCT '{t}' AS node_type, {key} AS id, md5({_space(_distinct_text(list(SEARCH_FIELDS[t])))}) AS h FROM {table}" + (" WHERE coalesce(node_type, '') <> 'collection_error'" if t == "functional_section" else "")
            for table, t, key in (("rest_resource", "rest_resource", "id"), ("rest_operation", "rest_operation", "id"), ("validated_rules", "validated_rule", "id"), ("entity_aliases", "business_entity", "entity_id"), ("functional_section", "functional_section", "id"))
        ),
        "node_semantic_texts": f"WITH {cat} SELECT id, md5({_distinct_text(['title', 'qualified_name', 'search_text'], 'chr(10)')}) AS h FROM nodes",
        "operation_texts": "SELECT DISTINCT id, md5(concat_ws(chr(10), nullif(title, ''), nullif(concat_ws(' ', method, endpoint_path), ''), nullif(left(description, 1200), ''))) AS h FROM rest_operation",
        "summary_sources": f"SELECT DISTINCT id, md5({_distinct_text(['text', 'search_text', 'title'], 'chr(10)')}) AS h FROM functional_section",
        "table_evidence": f"""WITH {cat}, f AS (SELECT source AS id, array_to_string(list_sort(list(DISTINCT target))[1:6], ',') AS targets FROM edges WHERE type = 'foreign_key_to' GROUP BY 1)
            SELECT l.id, array_to_string(primary_key, ',') AS primary_key, CASE WHEN len(coalesce(primary_key, [])) > 0 THEN 'One row for each combination of ' || array_to_string(primary_key, ', ') || '.' END AS grain, coalesce(targets, '') AS targets FROM live_table l LEFT JOIN f ON f.id = l.id""",
        "profile_texts": "SELECT sample_id, 'base' AS profile, md5('query: ' || coalesce(text, '')) AS as_query, md5('passage: ' || coalesce(text, '')) AS as_passage FROM lang_samples UNION ALL SELECT sample_id, 'large', md5('Instruct: Given a search query, retrieve relevant passages that answer the query' || chr(10) || 'Query: ' || coalesce(text, '')), md5(coalesce(text, '')) FROM lang_samples",
        "canonical_json_hash": """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation""",
        "configured_sources": "SELECT module_id, bool_or(len(list_filter(list_concat(coalesce(tables, []), coalesce(rest_resources, [])), lambda v: v IS NOT NULL AND trim(v) <> '')) > 0) AS configured FROM entity_aliases GROUP BY 1",
        "nodes_of_modules": f"WITH {cat} SELECT id, node_type FROM nodes WHERE module_id IN ('prc', 'tax')",
        "nodes_fetched": f"WITH {cat}, {seeds} SELECT id, node_type, title FROM nodes WHERE id IN (SELECT id FROM seeds)",
        "resource_children": f"WITH {cat}, rr AS (SELECT id FROM nodes WHERE node_type = 'rest_resource') SELECT source AS origin, target AS id, 'child' AS kind FROM whole WHERE type = 'has_operation' AND source IN (SELECT id FROM rr) UNION ALL SELECT target, source, 'parent' FROM whole WHERE type = 'parent_of' AND target IN (SELECT id FROM rr)",
        "module_projection": f"""WITH {cat}, g AS (SELECT lower(trim(v)) AS k, list(DISTINCT module_id) FILTER (module_id IS NOT NULL) AS given FROM (SELECT unnest(rest_resources) AS v, module_id FROM entity_aliases) WHERE trim(v) <> '' GROUP BY 1)
            SELECT id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN module_id IS NULL THEN [] ELSE [module_id] END, coalesce(given, [])))), ',') AS modules FROM live_resource LEFT JOIN g ON k = lower(trim(name))""",
        "environment_variants": f"WITH {cat}, en AS (SELECT DISTINCT lower(trim(resource_name)) AS name FROM rest_operation WHERE resource_name IS NOT NULL) SELECT DISTINCT l.id AS source, 'environment_resource:' || en.name AS target, 'environment_variant_of' AS type, 1.0::DOUBLE AS weight FROM en JOIN live_resource l ON {_normal('l.name')} = {_normal('en.name')} WHERE {_normal('l.name')} <> ''",
        "question_subjects": f"SELECT DISTINCT 'business_question:' || entity_id AS source, 'subject_area:' || {_normal('v')} AS target, 'answered_by' AS type, 1.0::DOUBLE AS weight FROM (SELECT entity_id, unnest(subject_areas) AS v FROM entity_aliases) WHERE trim(v) <> '' AND {_normal('v')} <> ''",
        "federated_analytics": f"""WITH qs AS (SELECT DISTINCT 'business_question:' || entity_id AS q, name, 'subject_area:' || {_normal('v')} AS s FROM (SELECT entity_id, name, unnest(subject_areas) AS v FROM entity_aliases) WHERE trim(v) <> '')
            SELECT DISTINCT s AS node, 0.95::DOUBLE AS score, 'bridge' AS reason FROM qs UNION ALL SELECT q, round(0.65 + 0.20 * coalesce(round(length(name) / 40.0, 4), 0.0), 6)::DOUBLE, 'semantic_question' FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(length(name) / 40.0, 4) DESC NULLS LAST, name, q) AS k FROM qs) WHERE k <= 2""",
        "graph_migrated_edges": f"WITH {cat} SELECT type, count(*) AS n FROM edges WHERE type NOT IN ('mentions_table', 'mentions_entity', 'related_by_alias', 'incoming_foreign_key_from') GROUP BY 1",
        "vectors_reused_by_content": """WITH v AS (SELECT vector_id, any_value(model_name) AS m, any_value(normalized_text_hash) AS h, any_value(dimensions) AS d, any_value(embedding_profile_version) AS p, any_value(embedding) AS e FROM semantic_embeddings GROUP BY 1), s AS (SELECT DISTINCT m, h, d FROM v WHERE p <> 'profile-2' AND e IS NOT NULL)
            SELECT vector_id, CASE WHEN s.h IS NULL THEN 'pending' ELSE 'reused' END AS status FROM v LEFT JOIN s ON v.m = s.m AND v.h = s.h AND v.d = s.d WHERE p = 'profile-2'""",
        "eligible_node_counts": f"WITH {cat} SELECT {_case('node_type', {k: repr(v) for k, v in NODE_LAYERS.items()}, 'NULL')} AS graph_layer, node_type, count(*) AS n, count(*) FILTER (trim(coalesce(search_text, '')) = '') AS n_without_text FROM nodes WHERE node_type IN ('physical_table', 'physical_column', 'rest_resource', 'rest_operation', 'business_entity', 'validated_rule') GROUP BY 1, 2",
        "collection_counts": "SELECT module_id AS kind, count(*) AS n, count(*) FILTER (node_type = 'collection_error') AS n_errors FROM functional_section GROUP BY 1",
        "run_log_states": """WITH RECURSIVE l AS (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, ['running', 'interrupted', 'failed', 'completed'][event_id % 4 + 1] AS st FROM events),
            f AS (SELECT run_id, k, n, CASE WHEN st = 'running' THEN st END AS status, CASE WHEN st = 'running' THEN 0 ELSE 1 END AS bad FROM l WHERE k = 1
            UNION ALL SELECT l.run_id, l.k, l.n, CASE WHEN ok THEN st ELSE status END, bad + CASE WHEN ok THEN 0 ELSE 1 END FROM (SELECT l.*, f.status, f.bad, CASE WHEN f.status IS NULL THEN l.st = 'running' WHEN f.status = 'running' THEN true WHEN f.status = 'interrupted' THEN l.st IN ('running', 'failed') WHEN f.status = 'failed' THEN l.st = 'running' ELSE false END AS ok FROM f JOIN l ON l.run_id = f.run_id AND l.k = f.k + 1) l)
            SELECT run_id, status, n::BIGINT AS n_steps, bad::BIGINT AS n_invalid FROM f WHERE k = n""",
        "text_chunk": f"WITH {semantic} SELECT DISTINCT sha256(s) AS text_hash FROM semantic_documents WHERE sha256(s) > '8' ORDER BY 1 LIMIT 100",
        "index_metadata": f"WITH {cat}, la AS (SELECT id, {_case('node_type', {k: repr(v) for k, v in NODE_LAYERS.items()}, 'NULL')} AS g FROM nodes) SELECT DISTINCT tb AS \"table\", g AS graph_layer FROM (SELECT unnest(['nodes', 'postings']) AS tb, g FROM la UNION ALL SELECT 'edges', a.g FROM whole JOIN la a ON a.id = source JOIN la b ON b.id = target WHERE a.g = b.g)",
        "semantic_join": f"WITH {cat} SELECT n.id, n.title, len(e.embedding)::BIGINT AS size FROM nodes n JOIN embeddings e ON e.vec_id = (length(n.id) * 37 + length(n.title)) % 100 WHERE n.node_type = 'business_entity' AND n.module_id IN ('prc', 'tax')",
        "check_bundle": f"WITH {cat}, ly AS (SELECT unnest(['business', 'physical', 'service', 'analytics']) AS g), la AS (SELECT id, node_type, {_case('node_type', {k: repr(v) for k, v in NODE_LAYERS.items()}, 'NULL')} AS g FROM nodes), el AS (SELECT w.source, w.target, w.type, a.g FROM whole w JOIN la a ON a.id = source JOIN la b ON b.id = target WHERE a.g = b.g AND w.type NOT IN ('mentions_entity', 'related_by_alias', 'incoming_foreign_key_from'))"
            + """, m AS (SELECT g, 'GRAPH_INVALID_NODES' AS code, 'GRAPH_INVALID_NODES' AS fine, (SELECT count(*) FROM la WHERE la.g = ly.g AND coalesce(id, '') = '') AS v, 'ERROR' AS bad FROM ly
            UNION ALL SELECT g, 'GRAPH_DUPLICATE_NODE_IDS', 'GRAPH_UNIQUE_NODE_IDS', (SELECT count(*) - count(DISTINCT id) FROM la WHERE la.g = ly.g), 'ERROR' FROM ly UNION ALL SELECT g, 'GRAPH_INVALID_EDGES', 'GRAPH_INVALID_EDGES', (SELECT count(*) FROM el WHERE el.g = ly.g AND type IS NULL), 'ERROR' FROM ly
            UNION ALL SELECT g, 'GRAPH_ORPHAN_EDGES', 'GRAPH_NO_ORPHAN_EDGES', (SELECT count(*) FROM el WHERE el.g = ly.g AND source NOT IN (SELECT id FROM la)), 'ERROR' FROM ly UNION ALL SELECT g, 'GRAPH_FORBIDDEN_EDGES', 'GRAPH_NO_FORBIDDEN_EDGES', (SELECT count(*) FROM el WHERE el.g = ly.g AND type = 'mentions_entity'), 'ERROR' FROM ly
            UNION ALL SELECT g, 'GRAPH_DUPLICATE_EDGES', 'GRAPH_DUPLICATE_EDGES', (SELECT count(*) FROM (SELECT 1 FROM el WHERE el.g = ly.g GROUP BY source, target, type HAVING count(*) > 1)), 'WARNING' FROM ly UNION ALL SELECT g, 'GRAPH_PHYSICAL_STUBS', 'GRAPH_PHYSICAL_STUBS', (SELECT count(*) FROM la WHERE la.g = ly.g AND node_type = 'physical_table_stub'), 'WARNING' FROM ly
            UNION ALL SELECT g, 'GRAPH_NODE_LAYER_MISMATCH', 'GRAPH_NODE_LAYER_MISMATCH', 0, 'ERROR' FROM ly UNION ALL SELECT g, 'GRAPH_COUNTS', 'GRAPH_COUNTS', 0, 'ERROR' FROM ly)
            SELECT g AS subject, CASE WHEN v <> 0 THEN bad ELSE 'OK' END AS status, upper(g) || '_' || CASE WHEN v <> 0 THEN code ELSE fine END AS code FROM m UNION ALL SELECT 'layers', 'OK', 'BUNDLE_UNKNOWN_LAYERS'""",
        "physical_object_columns": f"WITH {cat} SELECT DISTINCT upper(trim(l.table_name)) AS table_name, upper(trim(c.name)) AS name, nullif(trim(c.datatype), '') AS datatype FROM live_column c JOIN (SELECT DISTINCT table_name FROM live_table) l ON l.table_name = c.table_name WHERE c.position IS NOT NULL AND coalesce(trim(c.name), '') <> ''",
        "physical_manifest": f"WITH {cat} SELECT upper(trim(l.table_name)) AS table_name, (SELECT count(*) FROM live_column c WHERE c.table_name = l.table_name AND c.position IS NOT NULL AND coalesce(trim(c.name), '') <> '') AS n_columns, nullif(array_to_string(l.primary_key, ','), '') AS primary_key FROM live_table l WHERE l.table_name IN (SELECT table_name FROM live_column WHERE position IS NOT NULL)",
        "pages_to_fetch": "SELECT DISTINCT url, sha256(url) AS key FROM documents WHERE url IS NOT NULL AND url NOT IN (SELECT source.url FROM functional_section WHERE source.url IS NOT NULL)",
        "p5_found": _REFERENCES + "SELECT DISTINCT table_name, record_id, field_name, ref_value FROM judged WHERE status <> 'valid'",
        "p5_report": _REFERENCES + "SELECT table_name, field_name, strftime(judged.at, '%Y-%m') AS month, status, count(*) AS n_refs FROM judged WHERE status <> 'valid' GROUP BY ALL",
    }

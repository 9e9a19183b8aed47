"""SQL (DuckDB) of the derived knowledge-base tables, for use in front of oracle queries."""

KB = """kb AS (
  SELECT doc_id, 'w'||(doc_id%3) AS workspace_id, 'doc/'||doc_id AS source_path, 'doc '||doc_id AS title, lang, source,
    list_concat(['u'||(doc_id%5)], CASE WHEN doc_id%2=0 THEN ['role:reader'] ELSE []::VARCHAR[] END) AS acl_allow,
    ['lang:'||lang] AS tags, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS updated_at, text,
    substr(sha1('w'||(doc_id%3)||':doc/'||doc_id),1,16) AS doc_key,
    'kb://doc/'||substr(sha1('w'||(doc_id%3)||':doc/'||doc_id),1,16) AS doc_uri
  FROM documents)"""

CHUNKS = (
    KB
    + """, numbered AS (
  SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text)-800)/680.0) AS INT)))) AS chunk_idx FROM kb WHERE length(text) > 0),
chunks AS (
  SELECT 'kb://chunk/'||doc_key||'_'||chunk_idx AS uri, * EXCLUDE (text), chunk_idx*680 AS span_start, least(length(text), chunk_idx*680+800) AS span_end,
    substr(text, chunk_idx*680+1, 800) AS text FROM numbered)"""
)

QUERIES = "queries AS (SELECT 'q'||item_id AS qid, text AS query FROM benchmark)"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> ''))"


LEXICAL = (
    CHUNKS
    + ", "
    + QUERIES
    + f""", asked AS (SELECT qid, len(words) AS n, unnest(words) AS token FROM (SELECT qid, {tokens('query')} AS words FROM queries)),
have AS (SELECT uri, unnest({tokens('text')}) AS token FROM chunks),
lexical AS (SELECT qid, uri, count(*)/any_value(n) AS score FROM have JOIN asked USING (token) GROUP BY qid, uri)"""
)
HITS = LEXICAL + """, hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uri) AS rank FROM lexical) WHERE rank <= 20)"""

SYMBOLS = r"list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))"
STOP = "('the','and','with','from','that','this','for','are','class','def','import','return','true','false','none')"

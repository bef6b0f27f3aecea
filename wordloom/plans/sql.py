"""DuckDB SQL for the catalog: the same results by other means (plain theta joins, no prefix keys)."""

from __future__ import annotations

from ..functions.stopwords import ENGLISH
from ..functions.text import MARKUP

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    for pattern, to in MARKUP:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    return x


def tok(x: str) -> str:
    return rf"list_filter(str_split(lower(regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{Nl}}'']', ' ', 'g')), ' '), lambda t: t <> '')"


D = "d as (select doc_id, left(split_part(text, chr(10), 1), 80) as title, '/' || source || '/' || doc_id as url, lang || ' ' || source as meta, text as body from documents)"
PAGES = "d as (select page_id as doc_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, url, '' as meta, html as body from pages)"
PARTS = "d as (select p_partkey as doc_id, p_name as title, '/part/' || p_partkey as url, p_brand || ' ' || p_size as meta, p_name || ' ' || p_type as body from part)"
#: all: index terms; tt: title tokens; x: terms that are posted
TERMS = f"""allt as (select distinct doc_id, term from (select doc_id, unnest({tok(strip('title'))} || {tok(strip('meta'))} || {tok(strip('body'))}) as term from d) where term not in ({STOP})),
tt as (select distinct doc_id, term from (select doc_id, unnest({tok('title')}) as term from d)),
x as (select * from allt anti join tt using (doc_id, term))"""


def queries(query: str) -> str:
    """qs (query_id, pos, q) of one literal query."""
    return f"qs as (select 0 as query_id, generate_subscripts(ws, 1) - 1 as pos, unnest(ws) as q from (select {tok(quoted(query))} as ws))"


def scored(content: str = "x", whole: bool = False) -> str:
    """hit (query_id, doc_id, score)."""
    match = "term = q" if whole else "(term = q or (length(q) >= 3 and starts_with(term, q)))"
    return f"""c1 as (select distinct query_id, pos, doc_id, 1 as pts from qs join {content} on {match}),
t1 as (select query_id, pos, doc_id, max(case when term = q then 3 else 2 end) as pts from qs join tt on term = q or (length(q) >= 3 and starts_with(term, q)) group by all),
hit as (select query_id, doc_id, cast(sum(pts) as bigint) as score from (select * from c1 union all select * from t1) group by all)"""


def search(query: str, n: int, base: str = D, key: str = "doc_id", content: str = "x", whole: bool = False) -> str:
    return f"with {base}, {TERMS}, {queries(query)}, {scored(content, whole)} select row_number() over (order by score desc, doc_id) as rank, doc_id as {key}, score from hit order by score desc, doc_id limit {n}"

"""One query per operator, with production parameters, over whole tables; and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.llm import chat, collocations, decontaminate, jaccard, lexical, licenses, near_vectors, neighbours, packing, personal_data, quality, token_files, urls
from rollcall.llm.common import stored
from rollcall.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark = apply_settings(spark)
            return fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


@query()
def op1_personal_data(table):
    return personal_data.report(table("documents"))


@query(
    f"""
with items as (select item_id, {WORDS_SQL.format(text='text')} as w from benchmark),
grams as (
  select distinct item_id, least(len(w), 10) as n, list_slice(w, p, p + least(len(w), 10) - 1) as gram
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as p from items where len(w) > 0)
),
docs as (select doc_id, {WORDS_SQL.format(text='text')} as w from documents),
sizes as (select distinct n from grams),
spans as (
  select doc_id, n, p, list_slice(w, p, p + n - 1) as gram
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as p from docs, sizes where len(w) >= n)
),
found as (select s.doc_id, s.p, s.n, g.item_id from spans s join grams g using (n, gram)),
hit as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(generate_series(p, p + n - 1)) as x from found) group by doc_id),
ids as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as l
  from (select distinct doc_id, cast(item_id as varchar) as i from found) group by doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hit using (doc_id) left join ids using (doc_id)
"""
)
def op3_decontamination(table):
    return decontaminate.report(table("documents"), table("benchmark"))


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    r"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages
),
r(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from u join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p) group by page_id
)
select u.page_id, u.host, u.path, rule, coalesce(v, 'allow') as verdict from u left join best using (page_id)
"""
)
def op4_url_filter(table):
    pages = table("pages")
    rules = pages.sparkSession.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules)


@query()
def op2_quality(table):
    return quality.judge(table("documents"), table("labels"))


@query()
def op5_jaccard(table):
    return jaccard.groups(table("documents"))


SAYS_MARKS = "</s>[INST] ok [/INST]"


@query()
def op6_chat(table):
    told = table("conversations").select("conv_id", "turn", "role", "text")
    extra = told.sparkSession.createDataFrame(
        [(-7, 0, "user", SAYS_MARKS), (-7, 1, "assistant", SAYS_MARKS)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(stored(chat.windows(told.unionByName(extra)), "windows"))


@query()
def op7_token_files(table):
    import public_tokenizers

    return token_files.read(token_files.write(table("documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query()
def op8_licenses(table):
    return licenses.scan(table("documents"))


@query()
def op9_neighbours(table):
    vectors = table("embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


@query()
def op10_packing(table):
    docs = table("documents")
    return packing.pack(docs.select("doc_id", packing.text_tokens(F.col("text")).alias("n_tokens")))


@query(
    r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l on l.a = e.vec_id left join n on n.a = e.vec_id
"""
)
def op11_near_vectors(table):
    return near_vectors.near_copies(table("embeddings"))


TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    f"""
with docs as (select row_number() over () as d, doc_id, {TERMS_SQL} as ts from documents),
total as (select count(*) filter (where len(ts) > 0) as n, cast(sum(len(ts)) as bigint) as l from docs),
said as (select d, term, count(*) as tf from (select d, unnest(ts) as term from docs) group by d, term),
held as (select term, count(*) as df from said group by term),
asked as (select item_id, term, count(*) as n from (select item_id, unnest({TERMS_SQL}) as term from benchmark) group by item_id, term),
weights as (select term, cast(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) as bigint) as w from held, total),
lengths as (select d, doc_id, 100 - 75 + ((75 * len(ts) * n) // l) as m from docs, total where len(ts) > 0),
scores as (
  select a.item_id, g.doc_id, g.d, cast(sum(a.n * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked a join said using (term) join weights using (term) join lengths g using (d) group by a.item_id, g.doc_id, g.d
)
select item_id, cast(r as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id, d) as r from scores where score > 0) where r <= 10
"""
)
def op12_lexical_search(table):
    return lexical.search(table("documents"), table("benchmark"))


@query(
    r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece
  from documents
),
ws as (select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') as w from pieces),
total as (select lang, cast(sum(len(w)) as bigint) as n from ws group by lang),
grams as (
  select lang, list_slice(w, p, p + k - 1) as g
  from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from ws, (values (1), (2), (3), (4)) as sizes(k) where len(w) >= k)
),
f as (select lang, g, count(*) as f from grams group by lang, g having count(*) >= 30),
candidates as (select lang, g, f as a from f where len(g) > 1),
cuts as (
  select c.lang, c.g, c.a, k, x.f as l, y.f as r, (2000000 * cast(c.a as hugeint)) // (x.f + y.f) as score
  from (select *, unnest(generate_series(1, len(g) - 1)) as k from candidates) c
  join f x on x.lang = c.lang and x.g = list_slice(c.g, 1, k) join f y on y.lang = c.lang and y.g = list_slice(c.g, k + 1, len(c.g))
),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_ as (
  select distinct q.lang, p.g
  from (select lang, a, size, p, list_slice(g, p, p + size - 1) as part
        from (select *, unnest(generate_series(1, len(g) - size + 1)) as p from candidates, (values (2), (3)) as sizes(size) where size < len(g))) q
  join candidates p on p.lang = q.lang and p.g = q.part where 100 * q.a >= 80 * p.a
)
select lang, rank, phrase, a, l, r, n, score from (
  select b.lang, row_number() over (partition by b.lang order by score desc, a desc, array_to_string(b.g, ' ')) as rank, array_to_string(b.g, ' ') as phrase,
    a, l, r, n, cast(score as bigint) as score
  from best b join total using (lang) where not exists (select 1 from inner_ i where i.lang = b.lang and i.g = b.g)
) where rank <= 2000
"""
)
def op13_collocations(table):
    return collocations.top(collocations.mine(table("documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Every operator as a query over the test tables, beside the DuckDB SQL that gives the same rows.

The tables stand in for notes: a document is a note's text, a page's links are edges, events are link or view events.
Each query reads whole tables. Roles that need two tables (an old and a new snapshot) are made by rules on all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote import session
from loomnote.functions import text as X
from loomnote.operators import events, graph, lifecycle, notes, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = ["the", "and", "der", "une", "idiot"]
_LIST = "array[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on at length."""
    return session.spread(table(spark, sf_dir, name))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _similar(spark: SparkSession, d: str) -> DataFrame:
    """(id, raw_sim) of all vectors."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), search.dot(F.col("embedding"), _query_vector(spark, d)).alias("raw_sim"))


_SIM = "select vec_id as id, list_dot_product(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]) as raw_sim from embeddings"
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_FOLDED = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


@query(f"select id as vec_id, round(raw_sim, 6) as raw_sim from ({_SIM}) order by round(raw_sim, 6) desc, id limit 10")
def cosine_topk(spark, d):
    rows = _similar(spark, d).select(F.col("id").alias("vec_id"), F.round("raw_sim", 6).alias("raw_sim"))
    return rows.orderBy(F.col("raw_sim").desc(), "vec_id").limit(10)


_VEC50 = f"select id, round(raw_sim, 6) as raw_sim, row_number() over (order by round(raw_sim, 6) desc, id)::int as vec_rank from ({_SIM}) qualify vec_rank <= 50"


def _vec50(spark, d):
    rows = _similar(spark, d).select("id", F.round("raw_sim", 6).alias("raw_sim"))
    return search.ranked(rows, [F.col("raw_sim").desc(), F.col("id")], 50, "vec_rank")


@query(_VEC50)
def vector_rank50(spark, d):
    return _vec50(spark, d)


@query(f"select vec_id, n, l2, round(raw_sim, 6) as raw_sim from (select vec_id, len(embedding)::int as n, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as l2 from embeddings where embedding is not null) join ({_SIM}) on id = vec_id")
def vector_scan(spark, d):
    """Every valid vector with its length, norm and similarity: the scan behind both searches."""
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").where("embedding is not null")
    return rows.select("vec_id", F.size(e).alias("n"), F.round(search.norm(e), 5).alias("l2"), F.round(search.dot(e, _query_vector(spark, d)), 6).alias("raw_sim"))


def _bm25_sql(source: str, key: str, words: str, terms: list[str]) -> str:
    listed = ", ".join(f"('{t}')" for t in terms)
    return f"""with doc as (select {key} as id, {_FOLDED.format(words)} as tok from {source}),
stat as (select count(*) as docs, avg(len(tok)) as mean from doc),
hit as (select id, len(tok) as len, term, len(list_filter(tok, lambda t: t = term)) as f from doc, (values {listed}) v(term) where list_contains(tok, term)),
num as (select term, count(*) as n from hit group by term),
bm as (select id, -sum(case when ln((docs - n + 0.5) / (n + 0.5)) > 0 then ln((docs - n + 0.5) / (n + 0.5)) else 1e-6 end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) as score from hit join num using (term), stat group by id),
lex as (select id, round(score, 5) as score, row_number() over (order by round(score, 5), id)::int as lex_rank from bm qualify lex_rank <= 50)"""


def _lex50(docs: DataFrame, key: str, text, terms: list[str]) -> DataFrame:
    rows = search.scan_bm25(docs, key, text, terms).select("id", F.round("score", 5).alias("score"))
    return search.ranked(rows, [F.col("score"), F.col("id")], 50, "lex_rank")


@query(_bm25_sql("documents", "doc_id", "text", TERMS) + " select * from lex")
def bm25_topk(spark, d):
    return _lex50(texts(spark, d, "documents"), "doc_id", F.col("text"), TERMS)


@query(_bm25_sql("documents", "doc_id", "text", TERMS) + " select id, round(score, 5) as score from bm")
def bm25_index(spark, d):
    """All matches by way of the inverted index; the terms are pushed down to the postings."""
    docs = texts(spark, d, "documents")
    index = session.cut(search.postings(docs, "doc_id", F.col("text")))
    return search.bm25(index, search.statistics(docs, index), [[t] for t in TERMS]).select("id", F.round("score", 5).alias("score"))


_PHRASE = "with doc as (select doc_id, ' ' || array_to_string({}, ' ') || ' ' as s from documents) select doc_id, ((length(s) - length(replace(s, ' of the ', ''))) / 8)::int as at_least_one from doc where contains(s, ' of the ')".format(_FOLDED.format("text"))


@query(f"select doc_id from ({_PHRASE})")
def phrase_match(spark, d):
    """Documents that have two tokens next to each other, by positions in the index."""
    index = search.postings(texts(spark, d, "documents"), "doc_id", F.col("text")).where(F.col("term").isin("of", "the"))
    return search._phrase_hits(index, [["of", "the"]]).select(F.col("id").alias("doc_id"))


@query(f"select term, count(*) as docs, sum(tf)::bigint as tf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_FOLDED.format('text')}) as term from documents) group by all) group by term")
def term_statistics(spark, d):
    index = search.postings(texts(spark, d, "documents"), "doc_id", F.col("text"))
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("tf"))


_TITLES = "(select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)"


def _titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


@query(_bm25_sql(_TITLES, "page_id", "title", ["the", "of", "la"]) + " select id as page_id, score, lex_rank as title_rank from lex where lex_rank <= 5")
def title_bm25(spark, d):
    rows = search.scan_bm25(_titles(spark, d), "page_id", F.col("title"), ["the", "of", "la"]).select("id", F.round("score", 5).alias("score"))
    return search.ranked(rows, [F.col("score"), F.col("id")], 5, "title_rank").withColumnRenamed("id", "page_id")


_RRF = "coalesce(1.0 / (60 + lex_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0)"


@query(_bm25_sql("documents", "doc_id", "text", TERMS) + f", vec as ({_VEC50}) select id, lex_rank, vec_rank, raw_sim, round({_RRF}, 9) as score from lex full join vec using (id)")
def rrf_hybrid(spark, d):
    """The fused candidates of both legs, 100 at most."""
    lex = _lex50(texts(spark, d, "documents"), "doc_id", F.col("text"), TERMS).select("id", "lex_rank")
    return search.fuse(lex, _vec50(spark, d)).select("id", "lex_rank", "vec_rank", "raw_sim", F.round("score", 9).alias("score"))


@query(_bm25_sql("documents", "doc_id", "text", TERMS) + " select id, lex_rank, null::int as vec_rank, null::double as raw_sim, round(1.0 / (60 + lex_rank), 9) as score from lex order by score desc, id limit 10")
def hybrid_lexical_only(spark, d):
    lex = _lex50(texts(spark, d, "documents"), "doc_id", F.col("text"), TERMS).select("id", "lex_rank")
    none = spark.createDataFrame([], "id long, raw_sim double, vec_rank int")
    return search.fuse(lex, none).select("id", "lex_rank", "vec_rank", "raw_sim", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(10)


@query(_bm25_sql(_TITLES, "page_id", "title", ["the", "of", "la"]) + f""", t as (select id, lex_rank from lex where lex_rank <= 5), sem as (select id, raw_sim from ({_VEC50}))
select id as path, lex_rank as title_rank, raw_sim from t full join sem using (id) order by lex_rank is null, coalesce(lex_rank, 999), case when raw_sim is null or raw_sim = 0 then -1 else raw_sim end desc, id limit 5""")
def duplicate_check(spark, d):
    t = title_bm25(spark, d).select(F.col("page_id").alias("path"), "title_rank")
    sem = _vec50(spark, d).select(F.col("id").alias("path"), "raw_sim", F.col("vec_rank").alias("rank"))
    return search.duplicate_candidates(t, sem)


@query("select label, max_by(vec_id, (round(s, 6), -vec_id)) as vec_id, round(max(s), 6) as best from (select label, vec_id, list_dot_product(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]) as s from embeddings) group by label")
def best_per_path(spark, d):
    """Arg-max of similarity for each label, the first id among equals."""
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id")).join(_similar(spark, d), "id").withColumn("s", F.round("raw_sim", 6))
    return rows.groupBy("label").agg(F.max_by("id", F.struct("s", -F.col("id"))).alias("vec_id"), F.max("s").alias("best"))


@query("select doc_id, sha256(text) as sha256, md5(text) as md5 from documents")
def doc_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("select sha256(text) as sha256, count(*) as n, max(doc_id) as last_id from documents group by 1 having count(*) > 1")
def hash_reuse_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id")).where("n > 1")


def _snapshots(spark, d):
    """All documents as new sections, and an old snapshot of the same ids: by doc_id % 3, 0 unchanged, 1 without vector
    and 2 with the hash of the next document's text, as if texts had moved."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    after = docs.select((F.col("id") - 1).alias("id"), F.col("sha256").alias("moved"))
    vector = F.when(F.col("id") % 3 != 1, F.array(F.lit(1.0).cast("float")))
    was = F.when(F.col("id") % 3 == 2, F.coalesce("moved", F.lit("none"))).otherwise(F.col("sha256"))
    old = docs.join(after, "id", "left").select("id", was.alias("sha256"), vector.alias("vector"), F.lit("m").alias("embedding_model"), F.lit("v").alias("chunking_version"))
    return docs, old


_OLD = """with fresh as (select doc_id as id, sha256(text) as sha256 from documents),
old as (select f.id, case when f.id % 3 = 2 then coalesce(n.sha256, 'none') else f.sha256 end as sha256, f.id % 3 <> 1 as has from fresh f left join fresh n on n.id = f.id + 1),
a as (select fresh.id from fresh join old using (id, sha256) where has), b as (select distinct sha256 from old where has)"""


@query(_OLD + " select id from a")
def cache_hit_by_id(spark, d):
    new, old = _snapshots(spark, d)
    return lifecycle.by_id(new, old, "m", "v").select("id")


@query(_OLD + " select id from fresh join b using (sha256) where id not in (from a)")
def cache_hit_by_hash(spark, d):
    new, old = _snapshots(spark, d)
    return lifecycle.reuse(new, old, "m", "v").where("reused = 'hash'").select("id")


@query(_OLD + " select id from fresh where id not in (from a) and sha256 not in (from b)")
def to_embed_anti(spark, d):
    new, old = _snapshots(spark, d)
    return lifecycle.reuse(new, old, "m", "v").where("vector is null").select("id")


@query("select l.doc_id, quality from labels l anti join documents d on d.doc_id = l.doc_id and d.n_chars > 1000")
def stale_rows(spark, d):
    return lifecycle.stale(table(spark, d, "labels"), table(spark, d, "documents").where("n_chars > 1000"), "doc_id").select("doc_id", "quality")


@query("select doc_id, quality, toxic, true as new from labels union all select vec_id, label, 0, false from embeddings anti join labels on doc_id = vec_id")
def upsert_rows(spark, d):
    new = table(spark, d, "labels").withColumn("new", F.lit(True))
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("quality"), F.lit(0).alias("toxic"), F.lit(False).alias("new"))
    return lifecycle.upsert(old, new, "doc_id")


@query("select conv_id, role, max(turn) as turn, max_by(text, turn) as text from conversations group by conv_id, role")
def replace_latest_turn(spark, d):
    rows = table(spark, d, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "role"))
    return lifecycle.replace_latest(rows, "key", "turn").select("conv_id", "role", "turn", "text")


_EST = r"select {} as k, coalesce(list_sum(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{Mn}}_]+|[^\p{{L}}\p{{N}}\p{{Mn}}_\s]'), lambda w: case when regexp_full_match(w, '[\p{{L}}\p{{N}}]+') then (length(w) + 3) // 4 else 1 end)), 0)::bigint as estimate from {}"


@query("select k as doc_id, estimate from (" + _EST.format("doc_id", "text", "documents") + ")")
def token_estimate(spark, d):
    return texts(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("estimate"))


_PATH = r"regexp_replace(url, '^[a-z]+://[^/]+/', '')"


@query(f"""with p as (select page_id, replace(regexp_replace({_PATH}, '^en/', 'work/'), 'fr/', 'work/fr/') as path from pages)
select page_id, case when regexp_extract(path, '([^/]*)$', 1) like 'day %' then 'daily' when regexp_extract(path, '([^/]*)$', 1) like 'review %' then 'review' when path like 'work/%' then case when len(string_split(path, '/')) > 2 then 'work/' || string_split(path, '/')[2] else 'work' end else 'general' end as category from p""")
def category_case(spark, d):
    path = F.replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]+/", ""), "^en/", "work/"), F.lit("fr/"), F.lit("work/fr/"))
    return table(spark, d, "pages").select("page_id", X.category(path).alias("category"))


def page_links(spark, d):
    """(page_id, raw_target, start_line) of each link of each page, the line by the newlines before it."""
    pages = table(spark, d, "pages").select("page_id", F.split("html", "<a href=\"").alias("parts"))
    each = pages.select("page_id", F.posexplode("parts").alias("i", "part"), "parts").where("i > 0")
    line = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(1), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    return each.select("page_id", F.substring_index("part", "\"", 1).alias("raw_target"), line.alias("start_line"), "i")


_HREF = """href as (select page_id, regexp_extract(parts[i + 1], '^([^"]*)', 1) as raw_target, (1 + length(array_to_string(parts[1:i], '')) - length(replace(array_to_string(parts[1:i], ''), chr(10), '')))::int as start_line, i
from (select page_id, string_split(html, '<a href="') as parts, unnest(range(1, len(string_split(html, '<a href="')))) as i from pages))"""


@query(f"with {_HREF} select page_id, raw_target, start_line, i::int as i from href")
def edges_extract(spark, d):
    return page_links(spark, d)


def _edges(spark, d):
    return graph.distinct_edges(page_links(spark, d).select(F.col("page_id").cast("string").alias("source_path"), "raw_target", "start_line", F.col("raw_target").alias("resolved_target_path")))


_EDGE = f"{_HREF}, edge as (select distinct page_id::varchar as source_path, raw_target, start_line, raw_target as resolved_target_path from href)"


@query(f"with {_EDGE} select source_path, raw_target, start_line from edge")
def edges_dedup(spark, d):
    return _edges(spark, d).select("source_path", "raw_target", "start_line")


@query(f"with {_EDGE} select resolved_target_path, count(*) as links, count(distinct source_path) as sources from edge group by 1")
def backlinks(spark, d):
    return _edges(spark, d).groupBy("resolved_target_path").agg(F.count("*").alias("links"), F.countDistinct("source_path").alias("sources"))


@query(f"with {_EDGE} select raw_target, resolved_target_path, start_line from edge where source_path = '1'")
def outbound(spark, d):
    return graph.outbound(_edges(spark, d), "1")


@query(f"with {_EDGE} select source_path, raw_target, start_line from edge where resolved_target_path = '/the'")
def inbound(spark, d):
    return graph.inbound(_edges(spark, d), "/the")


@query(f"with {_EDGE} select node, sum(o)::bigint as n_out, sum(i)::bigint as n_in from (select source_path as node, 1 as o, 0 as i from edge union all select resolved_target_path, 0, 1 from edge) group by node")
def degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query(r"""with l as (select doc_id, i::bigint as n, line, (length(line) < 30)::int as head from (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from documents)),
s as (select *, sum(head) over (partition by doc_id order by n)::bigint as section from l) select doc_id, section, min(n) as first, max(n) as last from s group by doc_id, section""")
def sections_split(spark, d):
    """Sections of lines, where a line of under 30 characters counts as a heading, as the texts have none."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("long"))
    return notes.split_sections(lines, "doc_id", "n", "line", lambda x: F.length(x) < 30)


@query(f"with {_EDGE} select (select count(*) from documents) as notes, (select count(*) from embeddings) as sections, (select count(embedding) from embeddings) as vectors, (select count(*) from edge) as edges")
def index_stats(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding").alias("vector"))
    return lifecycle.statistics(table(spark, d, "documents").select("doc_id"), e, _edges(spark, d))


@query("select event_id as id, ts, event_type as status from events order by event_id desc limit 1")
def latest_run(spark, d):
    return lifecycle.latest_run(table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("status")))


def _link_events(spark, d):
    """Events as link events: the user is the source, the property k the target, clicks and purchases add, the rest removes."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("target"), F.when(F.col("event_type").isin("click", "purchase"), "add").otherwise("remove").alias("event"))


_LINK = "le as (select event_id, ts, user_id as source, (props->>'$.k')::bigint as target, case when event_type in ('click', 'purchase') then 'add' else 'remove' end as event from events)"


@query(f"with {_LINK} select source, target, min(ts) as born, max(ts) as died, count(*) filter (event = 'add') as adds, datediff('day', min(ts), max(ts))::int as days from le group by source, target having max_by(event, (ts, event_id)) = 'remove'")
def link_event_lifetime(spark, d):
    return events.lifetimes(_link_events(spark, d), "source", "target", "event", "ts", ["event_id"])


@query(f"with {_LINK} select source, target, count(*) filter (event = 'add') as adds, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::bigint as seconds from le group by source, target")
def link_weights(spark, d):
    return events.weights(_link_events(spark, d), "source", "target", "event", "ts")


@query(f"with {_LINK} select date_trunc('hour', ts)::timestamp as hour, count(*) as events, count(distinct source) as sources from le group by 1 having count(*) >= 5 and count(distinct source) >= 3")
def link_churn(spark, d):
    return events.churn(_link_events(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "hour", "source", 5, 3)


@query("""with r as (select *, coalesce((lag(event_type) over w <> event_type)::int, 1) as new from events window w as (partition by user_id order by event_id)),
s as (select *, sum(new) over (partition by user_id order by event_id)::bigint as run from r) select user_id, run, event_type, min(event_id) as first, max(event_id) as last, count(*) as rows from s group by all""")
def contiguous_runs(spark, d):
    return events.islands(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("select conv_id, turn, count(*) over (partition by conv_id) - row_number() over (partition by conv_id order by turn) as remaining_turns, round(length(text) * (1.25::double + 0.1::double * (count(*) over (partition by conv_id) - row_number() over (partition by conv_id order by turn))), 4) as cost from conversations")
def effective_token_cost(spark, d):
    rows = events.effective_cost(table(spark, d, "conversations"), "conv_id", "turn", F.length("text"))
    return rows.select("conv_id", "turn", "remaining_turns", F.round("cost", 4).alias("cost"))


@query("select l_orderkey, l_linenumber, round(l_tax * 0.1 + l_discount * 1.25 + l_quantity * 5 + l_extendedprice, 4) as units from lineitem")
def cost_units(spark, d):
    units = events.cost_units(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(units, 4).alias("units"))


@query("select event_id, ts, event_type from events order by ts desc, event_id desc limit 20")
def latest_n(spark, d):
    return events.latest(table(spark, d, "events"), "ts", "event_id", 20).select("event_id", "ts", "event_type")


@query("select event_id, ts, event_type from events where event_type = 'signup' order by ts, event_id limit 10")
def first_n(spark, d):
    """The next ten of a calendar."""
    return table(spark, d, "events").where("event_type = 'signup'").orderBy("ts", "event_id").limit(10).select("event_id", "ts", "event_type")


@query("with c as (select user_id, event_id, ts from events where event_type = 'click'), v as (select user_id, ts as since, event_id as rev from events where event_type = 'view') select c.user_id, c.event_id, c.ts, v.rev from c asof left join v on c.user_id = v.user_id and c.ts >= v.since")
def as_of_link(spark, d):
    """Each click with the user's last view at the time."""
    e = table(spark, d, "events")
    v = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("rev"))
    return graph.as_of(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), v, "user_id", "ts", "since", "rev").select("user_id", "event_id", "ts", "rev")


_CALLS = """with c as (select event_id, case when event_id % 4 in (0, 2) then strftime(ts, '%Y-%m-%d %H:%M:%S') end as s, case when event_id % 4 in (0, 1) then strftime(ts + interval 90 second, '%Y-%m-%d %H:%M:%S') end as e, floor(value) as sec, case when event_type = 'error' then '' else event_type end as who from events),
f as (select event_id, sec, who, case when s is null and sec > 0 then e::timestamp - to_seconds(sec) else s::timestamp end as start, case when e is null and sec > 0 then s::timestamp + to_seconds(sec) else e::timestamp end as "end" from c)
select event_id, 'WhatsApp Calls' as calendar, 'WhatsApp call: ' || case when who = '' then 'Unknown' else who end as title, start, "end", 'direction: unknown' || chr(10) || 'durationSeconds: ' || sec::bigint || chr(10) || 'source: android' as description,
start is not null and "end" is not null as ok, case when start is null or "end" is null then 'Missing or invalid start/end time' end as error from f"""


@query(_CALLS)
def call_interval_fill(spark, d):
    """Events as call records: start, end or both are given by turns, the value is the duration."""
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    form = "yyyy-MM-dd HH:mm:ss"
    none = F.lit(None).cast("string")
    call = F.struct(
        none.alias("calendarName"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("contact"),
        F.when(k.isin(0, 2), F.date_format("ts", form)).alias("start"), F.when(k.isin(0, 1), F.date_format(F.col("ts") + F.expr("interval 90 seconds"), form)).alias("end"),
        F.floor("value").cast("double").alias("durationSeconds"), none.alias("direction"), none.alias("source"),
    )
    rows = events.calls(e.select("event_id", call.alias("call")))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select user_id, count(*) as views from events where event_type = 'view' group by user_id order by views desc, user_id limit 20")
def top_views(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("views")).orderBy(F.col("views").desc(), "user_id").limit(20)


@query("select l_orderkey, l_linenumber, round(100 * l_discount * (6.112 * exp(17.62 * l_quantity / (243.12 + l_quantity))) / (6.112 * exp(17.62 * (l_quantity + 5) / (243.12 + (l_quantity + 5)))), 2) as rh from lineitem")
def relative_humidity(spark, d):
    rh = X.relative_humidity_after(F.col("l_quantity"), 100 * F.col("l_discount"), F.col("l_quantity") + 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rh.alias("rh"))


def page_graph(spark, d):
    return page_links(spark, d).select(F.concat(F.lit("p"), "page_id").alias("src"), F.col("raw_target").alias("dst")).distinct()


_GRAPH = f"{_HREF}, g as (select distinct 'p' || page_id as src, raw_target as dst from href), u as (select src, dst from g union select dst, src from g)"


@query(f"with recursive {_GRAPH}, r(node, hops) as (select 'p1', 0 union select dst, hops + 1 from r join u on src = node where hops < 2) select node, min(hops)::int as hops from r group by node")
def n_hop(spark, d):
    """What is at most two steps from page 1."""
    return graph.n_hop(page_graph(spark, d), spark.createDataFrame([("p1",)], "node string"), 2)


@query(f"with {_EDGE} select page_id::varchar as path from pages where page_id::varchar not in (select source_path from edge) and page_id::varchar not in (select resolved_target_path from edge)")
def orphans(spark, d):
    return graph.orphans(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path")), _edges(spark, d))


@query(f"with {_EDGE} select page_id::varchar as path from pages where list_contains({_TOKENS.format('html')}, 'that') and page_id::varchar not in (select source_path from edge where resolved_target_path = '/that')")
def unlinked_mentions(spark, d):
    """Pages that have the word and don't link to its page."""
    found = table(spark, d, "pages").where(F.array_contains(X.tokens(F.col("html")), "that")).select(F.col("page_id").cast("string").alias("path"))
    return graph.unlinked_mentions(found, _edges(spark, d), "/that")


@query(f"with {_EDGE} select source_path, raw_target, start_line from edge where raw_target not in (select '/' || term from (values ('the'), ('and'), ('to')) t(term))")
def unresolved_links(spark, d):
    """Links whose target isn't among three known pages."""
    known = spark.createDataFrame([("/the",), ("/and",), ("/to",)], "raw_target string")
    e = _edges(spark, d).drop("resolved_target_path").join(known.withColumn("resolved_target_path", F.col("raw_target")), "raw_target", "left")
    return graph.unresolved(e).select("source_path", "raw_target", "start_line")


@query("""with buy as (select distinct props, user_id from events where event_type = 'purchase'), p as (select distinct a, b from (select min(user_id) over (partition by props) as a, user_id as b from buy) where a < b),
n as (select distinct user_id as a, (props->>'$.k')::bigint as b from events where event_type = 'error') select a, b from p where not exists (select 1 from n where (n.a = p.a and n.b = p.b) or (n.a = p.b and n.b = p.a))""")
def anti_links(spark, d):
    """Buyers of a thing beside its first buyer, without those that an error event rules out."""
    e = table(spark, d, "events")
    buy = e.where("event_type = 'purchase'").select("props", F.col("user_id").alias("b")).distinct()
    first = buy.groupBy("props").agg(F.min("b").alias("a"))
    pairs = buy.join(first, "props").where("a < b").select("a", "b").distinct()
    anti = e.where("event_type = 'error'").select(F.col("user_id").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b"))
    return graph.without_anti_links(pairs, anti, "a", "b")


@query("select date_trunc('day', ts)::timestamp as period, part, count(*) as rows, min(event_id) as first, max(event_id) as last from (select *, ceil(row_number() over (partition by date_trunc('day', ts) order by event_id) / 40)::bigint as part from events) group by all")
def period_rollup(spark, d):
    return events.rollup(table(spark, d, "events"), "day", "ts", "event_id").withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("select c_custkey from customer where c_custkey not in (select user_id from events where event_type = 'view') and c_custkey not in (select o_custkey from orders)")
def dead_synapses(spark, d):
    """Customers whom nobody viewed and no order mentions."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("2000-01-01").alias("created"))
    v = table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return events.dead(c, v, o, "k", "created", F.lit("2024-01-01").cast("date")).select(F.col("k").alias("c_custkey"))

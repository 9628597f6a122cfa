"""Every named query with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import html as H, tags as G, urls as U
from ..functions.resolve import resolve
from ..functions.sqltext import DUCK, SPARK, cases
from ..operators import attempts, cache, changes, compliance, context, crawl, mcc, navigation, outline, pages, planner, policy, reports, research, risk, signals, sitemaps, tasks
from ..rules import changes as CR, mcc as MR, pages as PR, policies as PO, risk as RR
from ..session import keep_until_release, scratch
from ..sources import files
from ..sources.views import VIEWS, cte, read_table, view
from ..streaming import events as events_, lifetimes, upserts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF_TASKS = "TIMESTAMP '1998-01-01 00:00:00'"
AS_OF_CACHE = "TIMESTAMP '2024-01-31 00:00:00'"
D = DUCK


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ntz(text: str):
    """A time literal without zone, as the generic tables have them."""
    return F.expr(text.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


# --- tasks and agents

_COUNTS = ", ".join(f"count(t.id) FILTER (WHERE t.status = '{s}') AS {s}_tasks" for s in tasks.STATUSES)
_SECONDS = "epoch_us(t.completed_at) - epoch_us(t.started_at)"


@query(f"WITH {cte('tasks', 'agents')} SELECT a.id AS agent_id, a.type AS agent_type, {_COUNTS}, count(t.id) AS total_tasks, avg(({_SECONDS}) / 1e6) FILTER (WHERE t.status = 'completed') AS avg_duration FROM agents a LEFT JOIN tasks t ON a.id = t.agent_id GROUP BY 1, 2")
def task_agent_statistics(spark, d):
    return tasks.agent_statistics(view(spark, d, "agents"), view(spark, d, "tasks"))


@query(f"WITH {cte('tasks')} SELECT s.status, count(t.id) AS n FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed')) AS s(status) LEFT JOIN tasks t ON t.status = s.status AND t.agent_id = 3 GROUP BY 1")
def task_status_counts(spark, d):
    return tasks.status_counts(view(spark, d, "tasks"), 3)


@query(f"WITH {cte('tasks')} SELECT t.agent_id, {_COUNTS}, count(*) AS total_tasks FROM tasks t GROUP BY 1")
def agent_metrics(spark, d):
    return tasks.agent_metrics(view(spark, d, "tasks"))


@query(f"WITH {cte('tasks')} SELECT agent_id, id, status, rank_ FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id DESC) AS rank_ FROM tasks) x WHERE rank_ <= 10")
def agent_latest_tasks(spark, d):
    return tasks.latest_per_agent(view(spark, d, "tasks"))


@query(f"WITH {cte('tasks', 'agents')}, x AS (SELECT count(*) AS total_tasks, {_COUNTS} FROM tasks t), y AS (SELECT count(*) FILTER (WHERE status = 'active') AS active_agents, count(*) AS total_agents FROM agents) SELECT y.*, x.*, CASE WHEN completed_tasks + failed_tasks > 0 THEN 100.0::DOUBLE * completed_tasks / (completed_tasks + failed_tasks) ELSE 0 END AS efficiency, completed_tasks * 5 / 60.0::DOUBLE AS hours_saved FROM x, y")
def task_metrics(spark, d):
    return tasks.system_metrics(view(spark, d, "tasks"), view(spark, d, "agents"))


@query(f"WITH {cte('tasks')} SELECT id, agent_id, status FROM tasks WHERE agent_id = 2 AND status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def task_page(spark, d):
    return tasks.task_page(view(spark, d, "tasks"), "completed", 2, 50, 100).select("id", "agent_id", "status")


@query(f"WITH {cte('tasks')} SELECT count(*) AS n FROM tasks WHERE status = 'failed'")
def task_matching_count(spark, d):
    return tasks.matching_count(view(spark, d, "tasks"), "failed")


_STUCK = f"status = 'processing' AND (started_at < {AS_OF_TASKS} - INTERVAL '1' HOUR OR (started_at IS NULL AND created_at < {AS_OF_TASKS} - INTERVAL '1' HOUR))"


@query(f"WITH {cte('tasks')} SELECT id, action, 'failed' AS status, '{tasks.STUCK_ERROR}' AS error FROM tasks WHERE {_STUCK}")
def task_stuck_sweep(spark, d):
    return tasks.stuck_tasks(view(spark, d, "tasks"), _ntz(AS_OF_TASKS))


@query(f"WITH {cte('tasks')} SELECT status, count(*) AS n, count(completed_at) AS ended FROM (SELECT CASE WHEN {_STUCK} THEN 'failed' ELSE status END AS status, CASE WHEN {_STUCK} THEN {AS_OF_TASKS} ELSE completed_at END AS completed_at FROM tasks) x GROUP BY 1")
def task_after_sweep(spark, d):
    return tasks.sweep(view(spark, d, "tasks"), _ntz(AS_OF_TASKS)).groupBy("status").agg(F.count("*").alias("n"), F.count("completed_at").alias("ended"))


@query(f"WITH {cte('tasks')} SELECT id, agent_id, CASE status WHEN 'failed' THEN 'error' WHEN 'completed' THEN 'success' ELSE 'processing' END AS level, concat(action, ': ', status) AS message FROM tasks")
def task_log_projection(spark, d):
    return tasks.activity_log(view(spark, d, "tasks")).drop("created_at")


@query(f"WITH {cte('tasks')} SELECT id, CASE status WHEN 'failed' THEN 'error' WHEN 'completed' THEN 'success' ELSE 'processing' END AS level FROM tasks ORDER BY created_at DESC, id DESC LIMIT 20")
def activity_top20(spark, d):
    return tasks.activity_log(view(spark, d, "tasks"), 20).select("id", "level")


def _task_changes(t: DataFrame) -> DataFrame:
    return t.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "completed").otherwise("processing").alias("new_status"))


_NEW = "CASE WHEN id % 8 = 0 THEN 'completed' WHEN id % 4 = 0 THEN 'processing' END"


@query(f"WITH {cte('tasks')} SELECT id, coalesce({_NEW}, status) AS status, CASE WHEN {_NEW} IS NOT NULL THEN coalesce(started_at, {AS_OF_TASKS}) ELSE started_at END AS started_at, CASE WHEN {_NEW} = 'completed' THEN {AS_OF_TASKS} ELSE completed_at END AS completed_at FROM tasks")
def task_conditional_update(spark, d):
    t = view(spark, d, "tasks")
    return tasks.update_status(t, _task_changes(t), _ntz(AS_OF_TASKS)).select("id", "status", "started_at", "completed_at")


@query(f"WITH {cte('tasks')} SELECT id, coalesce({_NEW}, status) AS status, CASE WHEN {_NEW} IS NOT NULL THEN {AS_OF_TASKS} ELSE started_at END AS started_at FROM tasks")
def task_mark_status(spark, d):
    t = view(spark, d, "tasks")
    return tasks.mark_status(t, _task_changes(t), _ntz(AS_OF_TASKS)).select("id", "status", "started_at")


@query(f"WITH {cte('agents')} SELECT id, type, CASE WHEN id % 2 = 0 THEN 'paused' ELSE status END AS status FROM agents")
def agent_partial_update(spark, d):
    a = view(spark, d, "agents").drop("created_at")
    return tasks.merge_fields(a, a.select("id", F.when(F.col("id") % 2 == 0, "paused").alias("status")))


@query(f"WITH {cte('tasks')} SELECT status, count(*) AS n, count(started_at) AS started FROM (SELECT status, started_at FROM tasks UNION ALL SELECT 'pending', NULL FROM customer) x GROUP BY 1")
def task_insert(spark, d):
    new = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("agent_id"), F.lit("scan").alias("action"), F.lit("low").alias("priority"))
    return tasks.insert_tasks(view(spark, d, "tasks"), new, _ntz(AS_OF_TASKS)).groupBy("status").agg(F.count("*").alias("n"), F.count("started_at").alias("started"))


@query(f"WITH {cte('tasks')} SELECT agent_id, status, count(*) AS n FROM tasks GROUP BY ROLLUP (agent_id, status)")
def task_rollup(spark, d):
    return tasks.task_rollup(view(spark, d, "tasks"))


@query(f"WITH {cte('agents')} SELECT id, type, status FROM agents WHERE type = 'market_research'")
def agent_lookup(spark, d):
    return view(spark, d, "agents").where("type = 'market_research'").select("id", "type", "status")


@query(f"WITH {cte('agents')} SELECT id, type, status, created_at FROM agents ORDER BY created_at DESC, id")
def agent_list(spark, d):
    """All agents, the newest first."""
    return view(spark, d, "agents").orderBy(F.col("created_at").desc(), "id").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


_END = f"CASE WHEN id % 12 = 0 THEN 'failed' WHEN id % 6 = 0 THEN 'completed' ELSE status END"


@query(f"WITH {cte('tasks')} SELECT id, {_END} AS status, CASE WHEN id % 6 = 0 THEN {AS_OF_TASKS} ELSE completed_at END AS completed_at, CASE WHEN id % 6 = 0 AND id % 12 <> 0 THEN 'done ' || id END AS output, CASE WHEN id % 12 = 0 THEN 'broken' END AS error FROM tasks")
def task_finish(spark, d):
    t = view(spark, d, "tasks")
    broken = F.col("id") % 12 == 0
    ends = t.where("id % 6 = 0").select("id", F.when(~broken, F.concat(F.lit("done "), F.col("id").cast("string"))).alias("output"), F.when(broken, "broken").alias("error"))
    return tasks.finish(t, ends, _ntz(AS_OF_TASKS)).select("id", "status", "completed_at", "output", "error")


@query(f"WITH {cte('agents')} SELECT id, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'paused' ELSE status END AS status, CASE WHEN id % 2 = 0 THEN {AS_OF_TASKS} END AS updated_at FROM agents")
def agent_update_stamp(spark, d):
    a = view(spark, d, "agents").drop("created_at").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    change = a.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 != 0, "paused").alias("status"))
    return tasks.merge_fields(a, change, as_of=_ntz(AS_OF_TASKS)).select("id", "status", "updated_at")


@query(f"SELECT s_suppkey AS scan_id, source, CASE WHEN source = 'review' THEN {AS_OF_TASKS} END AS timestamp FROM supplier, (VALUES ('import'), ('review')) AS t(source) WHERE source = 'import' OR s_suppkey % 3 = 0")
def audit_append(spark, d):
    rows = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("scan_id"))
    log = rows.select("scan_id", F.lit("import").alias("source"), F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    return tasks.append_rows(log, rows.where("scan_id % 3 = 0").withColumn("source", F.lit("review")), _ntz(AS_OF_TASKS))


@query(f"WITH {cte('tasks')}, n AS (SELECT agent_id, count(*) AS total FROM tasks GROUP BY 1), p AS (SELECT agent_id, total, 1 + agent_id AS page FROM n) SELECT agent_id, total, (page - 1) * 50 AS start, CAST(ceil(total / 50) AS BIGINT) AS pages, page > 1 AS has_previous, page * 50 < total AS has_next FROM p")
def task_page_bounds(spark, d):
    n = tasks.agent_metrics(view(spark, d, "tasks")).select("agent_id", F.col("total_tasks").alias("total"))
    b = tasks.page_bounds(F.col("total"), F.col("agent_id") + 1, 50)
    return n.select("agent_id", "total", b["offset"].alias("start"), *[b[k].alias(k) for k in ("pages", "has_previous", "has_next")])


@query(f"WITH {cte('tasks')} SELECT id, priority FROM tasks WHERE priority = 'high' ORDER BY created_at DESC, id DESC LIMIT 3")
def task_of_kind(spark, d):
    return tasks.of_kind(view(spark, d, "tasks"), "HIGH", "priority", 3).select("id", "priority")


# --- category codes

@query(f"WITH {cte('mcc_codes')} SELECT mcc, description FROM mcc_codes WHERE active ORDER BY mcc")
def mcc_active(spark, d):
    return mcc.listed(view(spark, d, "mcc_codes")).select("mcc", "description")


_BANDED = f"SELECT mcc, arg_max(description, ord) AS description, {mcc.band(D, 'mcc')} AS category, concat(CAST(mcc AS INT) // 100 * 100, '-', CAST(mcc AS INT) // 100 * 100 + 99) AS mcc_range FROM mcc_codes GROUP BY mcc"


@query(f"WITH {cte('mcc_codes')} {_BANDED}")
def mcc_category_bands(spark, d):
    return mcc.with_bands(view(spark, d, "mcc_codes"))


@query(f"WITH {cte('mcc_codes')} SELECT mcc, arg_min(description, ord) AS description FROM mcc_codes WHERE ord % 2 = 1 AND mcc NOT IN (SELECT mcc FROM mcc_codes WHERE ord % 2 = 0) GROUP BY mcc")
def mcc_seed_anti_join(spark, d):
    codes = view(spark, d, "mcc_codes")
    return mcc.insert_missing(codes.where("ord % 2 = 0"), codes.where("ord % 2 = 1"))


@query(f"""WITH {cte('mcc_codes', 'tasks')}, k AS (SELECT mcc, bool_or(active) AS active FROM mcc_codes GROUP BY mcc),
x AS (SELECT s_suppkey AS id, lpad(CAST(s_suppkey * 53 % 10000 AS VARCHAR), 4, '0') AS mcc, s_suppkey * 3 AS task_id FROM supplier)
SELECT x.id, x.mcc, x.task_id, CASE WHEN k.active IS NULL THEN 'unknown_code' WHEN NOT k.active THEN 'inactive_code' WHEN t.id IS NULL THEN 'unknown_task' ELSE 'ok' END AS result
FROM x LEFT JOIN k USING (mcc) LEFT JOIN tasks t ON t.id = x.task_id""")
def mcc_decision_audit(spark, d):
    made = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lpad((F.col("s_suppkey") * 53 % 10000).cast("string"), 4, "0").alias("mcc"), (F.col("s_suppkey") * 3).alias("task_id"))
    return mcc.decide(made, view(spark, d, "mcc_codes"), view(spark, d, "tasks"))


_MCC_ROWS = ", ".join(f"({i}, '{c}', {D.text(a)}, {D.text(b)})" for i, (a, b, c, _, _) in enumerate(MR.MCC))


@query(f"""WITH {cte('risk_pages')}, h AS (SELECT doc_id, {mcc.hits_sql(D, 'page_text')} AS hits FROM risk_pages),
m AS (SELECT doc_id, c.*, least(15 * h.hits[c.o + 1], 100) AS confidence FROM h, (VALUES {_MCC_ROWS}) AS c(o, mcc, category, subcategory)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, o) AS rank_ FROM m WHERE confidence > 0)
SELECT doc_id, mcc, category, subcategory, confidence, rank_, CASE WHEN rank_ = 1 THEN 'primary' WHEN rank_ = 2 AND confidence >= 30 THEN 'secondary' ELSE 'match' END AS role, rank_ = 1 AND confidence < 30 AS low_confidence FROM r WHERE rank_ <= 10""")
def mcc_classify(spark, d):
    return mcc.classify(view(spark, d, "risk_pages"), "doc_id")


# --- pages

@query(f"SELECT page_id, {H.content_hash(D, 'html')} AS content_hash FROM pages")
def page_content_hash(spark, d):
    return pages.content_hashes(read_table(spark, d, "pages"))


_SEO = ", ".join(f"{e} AS {n}" for n, e in H.seo_columns(D).items())


@query(f"WITH {cte('seo_pages')}, x AS (SELECT page_id, sitemap_found, robots_txt_found, {_SEO} FROM seo_pages), y AS (SELECT *, {H.seo_score_sql()} AS seo_score FROM x) SELECT page_id, title_len, desc_len, h1, has_canonical, indexable, seo_score, CASE WHEN seo_score >= 80 THEN 'good' WHEN seo_score >= 50 THEN 'fair' ELSE 'poor' END AS band FROM y")
def page_seo_score(spark, d):
    return pages.seo_score(view(spark, d, "seo_pages"))


@query(f"SELECT page_id, n FROM (SELECT page_id, {pages.link_counts_sql(D)} AS n FROM pages) x WHERE n > 0")
def page_link_extract(spark, d):
    return pages.extract_links(read_table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))


@query()
def page_nav_links(spark, d):
    links = pages.extract_links(read_table(spark, d, "pages").select("page_id", "url", "html"))
    rows = links.where("region in ('nav', 'header', 'footer')").select(F.col("page_id").alias("site_id"), "link_ord", "url", "anchor")
    return crawl.queue(crawl.link_candidates(rows), 50)


@query(f"SELECT page_id, {H.title(D, 'html')} AS title, {H.visible_text(D, 'html')} AS visible FROM pages")
def page_title_meta(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.expr(H.title(SPARK, "html")).alias("title"), F.expr(H.visible_text(SPARK, "html")).alias("visible"))


_TECH = ", ".join(f"{e} AS {n}" for n, e in pages.tech_columns_sql(D).items())


@query(f"SELECT page_id, {_TECH} FROM pages")
def tech_detect(spark, d):
    return pages.technologies(read_table(spark, d, "pages"))


# --- urls and crawl

@query(f"WITH {cte('site_links')} SELECT link_ord, {U.normalize(D, 'url')} AS norm, {U.domain(D, 'url')} AS domain, {U.clean_url(D, "concat(' url: ', url, ',x')")} AS cleaned FROM site_links")
def url_normalize(spark, d):
    links = view(spark, d, "site_links")
    return links.select("link_ord", F.expr(U.normalize(SPARK, "url")).alias("norm"), F.expr(U.domain(SPARK, "url")).alias("domain"), F.expr(U.clean_url(SPARK, "concat(' url: ', url, ',x')")).alias("cleaned"))


_BASE = "concat('site', CAST(site_id % 40 AS STRING), '.example.com')"


@query(f"WITH {cte('site_links')} SELECT link_ord, {U.is_internal(D, 'url', _BASE)} AS internal, {U.is_valid_link(D, 'url')} AS valid FROM site_links")
def url_internal(spark, d):
    return view(spark, d, "site_links").select("link_ord", F.expr(U.is_internal(SPARK, "url", _BASE)).alias("internal"), F.expr(U.is_valid_link(SPARK, "url")).alias("valid"))


_SCORES = U.type_scores(D, "url", "anchor")
_COLS = ", ".join(f"{e} AS s_{k}" for k, e in _SCORES)
_BEST = "greatest(" + ", ".join(f"s_{k}" for k, _ in _SCORES) + ")"
_KIND = cases([("skip_", "'skip'"), (f"{_BEST} <= 0", "'other'"), *[(f"s_{k} = {_BEST}", f"'{k}'") for k, _ in _SCORES]], "NULL")
_TYPED = f"scored AS (SELECT *, {U.normalize(D, 'url')} AS norm, {U.is_skipped(D, 'url')} AS skip_, {_COLS} FROM site_links), typed AS (SELECT site_id, link_ord, url, anchor, status, norm, {_KIND} AS page_type, CASE WHEN skip_ THEN 1 ELSE round({_BEST}, 2) END AS confidence FROM scored)"


@query(f"WITH {cte('site_links')}, {_TYPED} SELECT link_ord, page_type, confidence, {U.priority(D, 'page_type')} AS priority FROM typed")
def page_classify(spark, d):
    return crawl.classify(view(spark, d, "site_links")).select("link_ord", "page_type", "confidence", F.expr(U.priority(SPARK, "page_type")).alias("priority"))


_CAND = f"cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, norm ORDER BY confidence DESC, link_ord) AS k FROM typed WHERE page_type <> 'skip' AND {U.is_valid_link(D, 'url')}) x WHERE k = 1)"


@query(f"WITH {cte('site_links')}, {_TYPED}, {_CAND} SELECT site_id, link_ord, norm, page_type, rank_ FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {U.priority(D, 'page_type')} DESC, link_ord) AS rank_ FROM cand) x WHERE rank_ <= 19")
def crawl_queue_topn(spark, d):
    return crawl.queue(crawl.link_candidates(view(spark, d, "site_links"))).select("site_id", "link_ord", "norm", "page_type", "rank_")


@query(f"WITH {cte('site_links')}, {_TYPED}, {_CAND} SELECT site_id, norm, CASE WHEN link_ord % 2 = 0 THEN 0 ELSE 1 END AS src_ord FROM cand WHERE link_ord % 5 <> 0")
def crawl_merged_queue(spark, d):
    c = crawl.link_candidates(view(spark, d, "site_links"))
    return crawl.merge_queues(c.where("link_ord % 2 = 0"), c.where("link_ord % 2 = 1"), c.where("link_ord % 5 = 0")).select("site_id", "norm", "src_ord")


def _crawled(spark: SparkSession, d: str) -> DataFrame:
    typed = crawl.classify(view(spark, d, "site_links").where(f"not {U.is_skipped(SPARK, 'url')}"))
    return typed.select("site_id", F.col("link_ord").alias("ord"), "url", F.when(F.col("link_ord") % 3 == 0, F.expr(U.normalize(SPARK, "url"))).alias("canonical"), "page_type", "confidence", "status")


_CRAWLED = "crawled AS (SELECT site_id, link_ord AS ord, url, CASE WHEN link_ord % 3 = 0 THEN norm END AS canonical, page_type, confidence, status FROM typed WHERE page_type <> 'skip')"


@query(f"""WITH {cte('site_links')}, {_TYPED}, {_CRAWLED},
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, coalesce(canonical, '#' || ord) ORDER BY ord) AS k FROM crawled) x WHERE k = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id, CASE WHEN page_type = 'other' THEN 'u:' || url ELSE 't:' || page_type END ORDER BY CASE WHEN page_type = 'other' THEN -ord::DOUBLE ELSE -confidence END, ord) AS m FROM a)
SELECT site_id, ord, page_type, confidence FROM b WHERE m = 1""")
def page_canonical_dedupe(spark, d):
    return crawl.admit(_crawled(spark, d)).select("site_id", "ord", "page_type", "confidence")


_REQ = " + ".join(f"max(CASE WHEN page_type = '{t}' AND confidence >= 0.7 THEN 1 ELSE 0 END) OVER w" for t in crawl.REQUIRED)
_HIGH = ", ".join(f"'{t}'" for t in crawl.HIGH_VALUE)


@query(f"""WITH {cte('site_links')}, {_TYPED}, {_CRAWLED},
a AS (SELECT *, CASE WHEN count(*) OVER w >= 10 AND {_REQ} = 2 AND max(CASE WHEN page_type IN ({_HIGH}) AND status = 200 THEN 1 ELSE 0 END) OVER w = 1 THEN ord END AS stop FROM crawled WINDOW w AS (PARTITION BY site_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, min(stop) OVER (PARTITION BY site_id) AS until FROM a) SELECT site_id, ord, page_type FROM b WHERE until IS NULL OR ord <= until""")
def crawl_early_exit(spark, d):
    return crawl.early_exit(_crawled(spark, d)).select("site_id", "ord", "page_type")


_NEED = " + ".join(f"max(CASE WHEN page_type = '{t}' AND confidence >= 0.7 THEN 1 ELSE 0 END)" for t in crawl.REQUIRED)


@query(f"WITH {cte('site_links')}, {_TYPED}, {_CRAWLED} SELECT site_id, count(*) AS attempted, count(*) FILTER (WHERE status = 200) AS success, count(*) FILTER (WHERE status IN (401, 403, 429)) AS blocked, count(*) FILTER (WHERE status NOT IN (200, 401, 403, 429)) AS failed, {_NEED} = 2 AS has_required FROM crawled GROUP BY 1")
def crawl_summary(spark, d):
    return crawl.summary(_crawled(spark, d))


@query(f"WITH {cte('site_links')}, {_TYPED}, {_CRAWLED} SELECT site_id, page_type, count(*) AS n FROM crawled WHERE status = 200 GROUP BY 1, 2")
def page_type_counts(spark, d):
    return crawl.type_counts(_crawled(spark, d))


@query("""WITH s AS (SELECT c_custkey AS site_id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 401 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 503 WHEN 5 THEN 404 ELSE 200 END AS status, CASE WHEN c_custkey % 7 = 2 THEN 'SSL handshake' END AS error FROM customer),
o AS (SELECT *, CASE WHEN status IS NULL THEN 'DNS_FAIL' WHEN status IN (401, 403) THEN 'HTTP_403' WHEN status = 0 AND error LIKE '%SSL%' THEN 'SSL_ERROR' WHEN status = 0 THEN 'TIMEOUT' WHEN status >= 400 THEN 'HTTP_' || status ELSE 'ok' END AS outcome FROM s)
SELECT site_id, outcome, outcome IN ('DNS_FAIL', 'TIMEOUT') OR status >= 500 AS retryable FROM o""")
def crawl_gate(spark, d):
    k = F.col("c_custkey") % 7
    home = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("site_id"), F.when(k == 1, 401).when(k.isin(2, 3), 0).when(k == 4, 503).when(k == 5, 404).when(k == 6, 200).alias("status"), F.when(k == 2, "SSL handshake").alias("error")
    )
    return crawl.gate(home).select("site_id", "outcome", "retryable")


_ROBOTS = "concat('# robots', chr(10), 'User-agent: *', chr(10), 'Disallow: /private', chr(10), 'Disallow: /*-policy', chr(10), 'Allow: /privacy', chr(10), 'Disallow:', chr(10), 'User-agent: other', chr(10), 'Disallow: /', chr(10), CASE WHEN site_id % 2 = 0 THEN concat('User-agent: *', chr(10), 'Disallow: /blog') ELSE '' END)"


@query(f"WITH {cte('site_links')}, p AS (SELECT *, lower(coalesce(nullif({U.path(D, 'url')}, ''), '/')) AS p FROM site_links) SELECT link_ord, CASE WHEN starts_with(p, '/privacy') THEN true ELSE NOT (starts_with(p, '/private') OR regexp_matches(p, '^/.*-policy') OR (site_id % 2 = 0 AND starts_with(p, '/blog'))) END AS allowed FROM p")
def robots_filter(spark, d):
    links = view(spark, d, "site_links")
    files = links.select("site_id").distinct().withColumn("content", F.expr(_ROBOTS))
    return crawl.allowed(links.select("site_id", "link_ord", "url"), crawl.robots_rules(files)).select("link_ord", "allowed")


@query(f"WITH {cte('site_links')}, f AS (SELECT site_id, link_ord, url, row_number() OVER (PARTITION BY site_id ORDER BY link_ord) - 1 AS ord FROM site_links) SELECT site_id, ord, url FROM f WHERE ord < 100")
def sitemap_extract(spark, d):
    one = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    files = view(spark, d, "site_links").groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_ord", one.alias("x")))), lambda r: r["x"]), "\n").alias("content"))
    return crawl.sitemap_urls(files)


_MAP_URLS = "SELECT site_id, link_ord AS ord, CASE WHEN link_ord % 10 = 0 THEN replace(url, '://', '://blog.') ELSE url END AS url, concat('https://www.site', CAST(site_id AS VARCHAR(9)), '.example.com/') AS base FROM {links}"
_URL_SCORES = U.type_scores(D, "url")
_URL_BEST = "greatest(" + ", ".join(f"s_{k}" for k, _ in _URL_SCORES) + ")"


@query(f"""WITH {cte('site_links')}, m AS ({_MAP_URLS.replace('{links}', 'site_links')}),
own AS (SELECT site_id, url, min(ord) AS ord FROM m WHERE {U.domain(D, 'url')} = {U.domain(D, 'base')} AND NOT {U.is_skipped(D, 'url')} GROUP BY 1, 2),
scored AS (SELECT *, {', '.join(f'{e} AS s_{k}' for k, e in _URL_SCORES)} FROM own), typed AS (SELECT *, {cases([(f'{_URL_BEST} <= 0', "'other'"), *[(f's_{k} = {_URL_BEST}', f"'{k}'") for k, _ in _URL_SCORES]], 'NULL')} AS page_type FROM scored),
p AS (SELECT *, {U.priority(D, 'page_type')} AS priority FROM typed), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority DESC, ord) AS rank_ FROM p) SELECT site_id, rank_, url, page_type, priority FROM r WHERE rank_ <= 100""")
def sitemap_queue(spark, d):
    return crawl.sitemap_queue(spark.sql(_MAP_URLS, links=view(spark, d, "site_links")))


# --- what a crawl of every host of pages would do, from a log of fetch attempts

@query()
def crawl_plan(spark, d):
    out = planner.plan(view(spark, d, "crawl_sites"), view(spark, d, "crawl_log"))[0]
    return out.select("site_id", "ord", "url", "source", "depth", "status", "page_type", "confidence", "canonical", "error_type", "retries", "kept")


@query()
def crawl_plan_rounds(spark, d):
    """The same crawl, going on with the menus of what it fetched."""
    out = planner.plan(view(spark, d, "crawl_sites"), view(spark, d, "crawl_log"), rounds=3)[0]
    return out.select("site_id", "ord", "url", "depth", "status", "page_type", "error_type", "kept")


@query()
def crawl_plan_summary(spark, d):
    return planner.plan(view(spark, d, "crawl_sites"), view(spark, d, "crawl_log"))[1]


_FINAL = """final AS (SELECT *, attempt AS retries, failure IS NULL AND status < 500 OR attempt >= 1 AS ends, row_number() OVER (PARTITION BY site_id, url ORDER BY CASE WHEN failure IS NULL AND status < 500 OR attempt >= 1 THEN attempt END NULLS LAST, attempt DESC) AS k FROM crawl_log),
outcome AS (SELECT site_id, url, CASE WHEN failure IS NULL THEN status ELSE 0 END AS status, CASE WHEN failure IS NULL AND status < 500 AND status <> 410 AND contains(lower(content_type), 'text/html') THEN body ELSE '' END AS body,
  CASE WHEN failure = 'timeout' THEN 'timeout' WHEN status >= 400 THEN 'http_error' END AS error_type,
  CASE WHEN failure = 'timeout' THEN 'Page timeout (12s) after ' || retries || ' retries' WHEN status BETWEEN 400 AND 499 THEN 'HTTP ' || status WHEN status >= 500 THEN 'HTTP ' || status || ' after ' || retries || ' retries' END AS message,
  retries, (2000 * (2 ** retries - 1))::BIGINT AS waited_ms, NOT ends AS pending FROM final WHERE k = 1)"""


@query(f"WITH {cte('crawl_log')}, {_FINAL} SELECT site_id, url, status, md5(body) AS body, error_type, message, retries, waited_ms, pending FROM outcome")
def fetch_outcomes(spark, d):
    out = attempts.outcomes(view(spark, d, "crawl_log"))
    return out.select("site_id", "url", "status", F.md5("body").alias("body"), "error_type", "message", "retries", "waited_ms", "pending")


@query(f"""WITH {cte('crawl_log')}, {_FINAL} SELECT site_id, count(*) AS urls, count(*) FILTER (WHERE status = 200) AS success, count(*) FILTER (WHERE status <> 200 AND NOT pending) AS failed,
count(*) FILTER (WHERE retries > 0) AS retried, count(*) FILTER (WHERE contains(lower(message), 'timeout')) AS timeouts, sum(waited_ms)::BIGINT AS waited_ms, count(*) FILTER (WHERE pending) AS pending FROM outcome GROUP BY 1""")
def fetch_counters(spark, d):
    return attempts.counters(attempts.outcomes(view(spark, d, "crawl_log")))


@query(f"""WITH RECURSIVE {cte('crawl_sites', 'crawl_log')},
files AS (SELECT site_id, url, body AS content FROM crawl_log WHERE attempt = 0 AND status = 200),
asked AS (SELECT s.site_id, 0 AS stage, i AS ord, trim(regexp_extract(l[i], '^[^:]*:(.*)$', 1)) AS url FROM (SELECT site_id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '(?i)^sitemap\\s*:')) AS l FROM files WHERE url LIKE '%/robots.txt') s, unnest(range(1, 4)) AS u(i) WHERE i <= len(l)
  UNION ALL SELECT site_id, i + 1, 1, rtrim(url, '/') || p FROM crawl_sites, (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(sitemaps.STANDARD))}) AS v(i, p)),
tree AS (SELECT a.site_id, stage, ord, [0] AS place, a.url, 0 AS level, content FROM asked a JOIN files f ON f.site_id = a.site_id AND f.url = a.url
  UNION ALL SELECT t.site_id, stage, ord, list_append(place, i), f.url, level + 1, f.content FROM (SELECT *, regexp_extract_all(content, '(?i)<loc>\\s*(https?://[^<]+?)\\s*</loc>', 1) AS locs FROM tree WHERE contains(lower(content), '<sitemapindex') AND level < {sitemaps.LEVELS}) t, unnest(range(1, 4)) AS u(i) JOIN files f ON true WHERE i <= len(locs) AND f.site_id = t.site_id AND f.url = locs[i]),
urls AS (SELECT site_id, stage, ord, list_append(place, i) AS place, locs[i] AS url FROM (SELECT *, regexp_extract_all(content, '(?i)<loc>\\s*(https?://[^<]+?)\\s*</loc>', 1) AS locs FROM tree WHERE NOT contains(lower(content), '<sitemapindex')) t, unnest(range(1, 101)) AS u(i) WHERE i <= len(locs))
SELECT site_id, stage, ord, url, row_number() OVER (PARTITION BY site_id, stage, ord ORDER BY place) AS n FROM urls QUALIFY n <= 100""")
def sitemap_discovery(spark, d):
    log = view(spark, d, "crawl_log")
    raw = attempts.raw_bodies(log)
    start = planner.seeds(view(spark, d, "crawl_sites")).select("site_id", "root")
    robots = start.join(raw, "site_id").where("url = concat(root, '/robots.txt')").select("site_id", "content")
    homes = start.join(raw, "site_id").where("url = concat(root, '/')").select("site_id", F.col("content").alias("html"))
    found = sitemaps.listed(sitemaps.candidates(start, robots, homes), raw)
    return found.select("site_id", "stage", "ord", "url", F.row_number().over(W.partitionBy("site_id", "stage", "ord").orderBy("place")).alias("n"))


@query()
def nav_discovery(spark, d):
    """Both tiers of every page's links, as if there were no sitemap on every other page."""
    some = read_table(spark, d, "pages").select("page_id", "url", "html", (F.col("page_id") % 2 == 0).alias("found"))
    return navigation.links(some, sitemap_found="found")


@query()
def crawl_breadth(spark, d):
    """A crawl by breadth over the links of pages, three levels deep, at most 25 pages a host."""
    own = read_table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.concat(F.lit("https://"), F.split_part("url", F.lit("/"), F.lit(3)), F.regexp_extract("url", "^[^/]*//[^/?#]*([^?#]*)", 1)).alias("url"), "page_id", "html")
    first = own.groupBy("host").agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("site_id"))
    listed = own.join(first.select("host", "site_id"), "host")
    roots = first.select("site_id", "url")
    # A host's pages link to each other: each to the three after it in the order of their numbers.
    ranked = listed.groupBy("site_id", "url").agg(F.min("page_id").alias("page_id")).withColumn("k", F.row_number().over(W.partitionBy("site_id").orderBy("page_id")))
    links = ranked.select("site_id", F.col("url").alias("src"), "k").withColumn("link_ord", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    to = ranked.select("site_id", F.col("url").alias("dst"), F.col("k").alias("at"))
    links = links.join(to, (links["site_id"] == to["site_id"]) & (F.col("at") == F.col("k") * 2 + F.col("link_ord"))).select(links["site_id"], "src", "link_ord", "dst")
    status = ranked.select("site_id", "url", F.when(F.col("k") % 5 == 4, 404).otherwise(200).alias("status"))
    return planner.by_breadth(roots, links, status, depth=4, max_pages=25)


_HREFS = f"regexp_extract_all({H.without_code(D, 'html')}, '(?i)<a [^>]*href=\"([^\"]*)\"', 1)"


@query(f"""WITH l AS (SELECT page_id, url, {_HREFS} AS hrefs FROM pages)
SELECT page_id, i - 1 AS link_ord, {H.unescape(D, 'hrefs[i]')} AS href, regexp_extract(url, '^[^/]*//[^/?#]*') || {H.unescape(D, 'hrefs[i]')} AS target FROM l, unnest(range(1, 10000)) AS u(i) WHERE i <= len(hrefs)""")
def page_links_resolved(spark, d):
    """Every link with its target, without a Python worker."""
    found = read_table(spark, d, "pages").select("page_id", "url", F.filter(G.tags(F.col("html"), "a"), lambda t: F.map_contains_key(t["attrs"], F.lit("href"))).alias("links"))
    each = found.select("page_id", "url", F.posexplode("links").alias("link_ord", "link")).select("page_id", "link_ord", "url", F.element_at("link.attrs", "href").alias("href"))
    return each.select("page_id", "link_ord", "href", resolve(F.col("url"), F.col("href")).alias("target"))


@query(f"""WITH {cte('seo_pages')} SELECT page_id, nullif({H.meta_content(D, 'html', 'description')}, '') AS description, nullif({H.meta_content(D, 'html', 'robots')}, '') AS robots,
nullif({H.canonical(D, 'html')}, '') AS canonical, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM seo_pages""")
def page_head(spark, d):
    """What a page's head says, whatever the order of attributes and their quotes."""
    read = view(spark, d, "seo_pages").select("page_id", "url", G.tags(F.col("html"), "meta", "link", "html").alias("tags"))
    read = read.select(
        "page_id", "url", G.first_attribute(F.col("tags"), "content", ("name", "description")).alias("description"), G.first_attribute(F.col("tags"), "content", ("name", "robots")).alias("robots"),
        G.first_attribute(F.col("tags"), "href", ("rel", "canonical")).alias("href"), F.element_at(F.get(F.filter("tags", lambda t: t["tag"] == "html"), F.lit(0))["attrs"], "lang").alias("lang"),
    )
    return read.select("page_id", "description", "robots", resolve(F.col("url"), F.col("href")).alias("canonical"), "lang")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey * 2 AS dst FROM customer UNION SELECT c_custkey, c_custkey * 3 + 1 FROM customer),
b AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY 1""")
def bfs_depth(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    links = c.select("src", (F.col("src") * 2).alias("dst")).unionByName(c.select("src", (F.col("src") * 3 + 1).alias("dst")))
    return crawl.breadth_first(spark.range(1, 2).withColumnRenamed("id", "node"), links)


# --- policies

def _policy_sql() -> str:
    route, label = f"lower({U.path(D, 'url')})", "trim(coalesce(anchor, ''))"
    rows = []
    for policy_, patterns in PO.SCORED:
        for k, (p, w) in enumerate(patterns):
            rows.append(f"SELECT site_id, '{policy_}' AS policy, url, CASE WHEN {D.match('route', p)} THEN 'url_pattern' ELSE 'anchor_text' END AS method, CASE WHEN {D.match('route', p)} THEN {w} ELSE {w} * 0.8::DOUBLE END::DOUBLE * 100 AS confidence, 1 AS pass, link_ord, {k} AS rule FROM plain WHERE {D.match('route', p)} OR {D.match('label', '(?i)' + p)}")
    for policy_, patterns in PO.FALLBACK:
        p = "(?i)" + "|".join(f"(?:{x})" for x in patterns)
        rows.append(f"SELECT site_id, '{policy_}', url, CASE WHEN {D.match('label', p)} THEN 'anchor_text' ELSE 'url_pattern' END, 60, 2, link_ord, 0 FROM plain WHERE {D.match('label', p)} OR {D.match('route', p)}")
    for policy_, names in PO.NAV_LABELS.items():
        rows.append(f"SELECT site_id, '{policy_}', url, 'nav_dropdown', 75, 3, link_ord, 0 FROM links WHERE lower(label) IN ({', '.join(D.text(n) for n in names)})")
    return f"""links AS (SELECT *, {route} AS route, {label} AS label FROM site_links), plain AS (SELECT * FROM links WHERE NOT {U.is_content(D, 'url')}),
c AS ({' UNION ALL '.join(rows)}), detected AS (SELECT site_id, policy, url, method, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY site_id, policy ORDER BY pass, CASE WHEN pass = 1 THEN -confidence ELSE 0 END, link_ord, rule) AS k FROM c) x WHERE k = 1)"""


_POLICY = _policy_sql()


@query(f"WITH {cte('site_links')}, {_POLICY} SELECT * FROM detected")
def policy_detect(spark, d):
    return policy.detect(view(spark, d, "site_links"))


_MAP = ", ".join(f"('{a}', '{b}')" for a, b in PO.PAGE_TYPE_OF.items())


@query(f"""WITH {cte('site_links')}, {_POLICY}, {_TYPED}, {_CRAWLED},
graph AS (SELECT site_id, m.policy, url AS page_url, status AS page_status FROM (SELECT *, row_number() OVER (PARTITION BY site_id, page_type ORDER BY confidence DESC, ord) AS k FROM crawled) x JOIN (VALUES {_MAP}) AS m(policy, page_type) USING (page_type) WHERE k = 1),
known AS (SELECT site_id, url, max(CASE WHEN status = 200 THEN 1 ELSE 0 END) AS ok FROM site_links GROUP BY 1, 2),
j AS (SELECT coalesce(a.site_id, g.site_id) AS site_id, coalesce(a.policy, g.policy) AS policy, a.url, a.method, a.confidence, page_url, page_status FROM detected a FULL JOIN graph g ON a.site_id = g.site_id AND a.policy = g.policy),
k AS (SELECT j.*, page_status = 200 AS taken, regexp_matches(j.url, '^https?://') AND coalesce(ok, 1) = 1 AS own FROM j LEFT JOIN known USING (site_id, url))
SELECT site_id, policy, coalesce(taken OR own, false) AS found, CASE WHEN taken THEN page_url WHEN own THEN url END AS url, CASE WHEN taken THEN 'page_graph' WHEN own THEN method END AS method, CASE WHEN taken THEN 100.0::DOUBLE WHEN own THEN confidence END AS confidence FROM k""")
def policy_reconcile(spark, d):
    links = view(spark, d, "site_links")
    best = _crawled(spark, d).groupBy("site_id", "page_type").agg(F.max_by(F.struct("url", "status"), F.struct("confidence", -F.col("ord"))).alias("r")).select("site_id", "page_type", "r.*")
    return policy.reconcile(policy.detect(links), best, links.select("site_id", "url", "status"))


# --- content

_WORDS = [(n, c, k) for n, (c, k) in enumerate((c, k) for c, words in RR.RESTRICTED for k in words)]
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT site_id, page_url, doc_id, {n} AS kw_ord, '{c}' AS category, {D.text(k)} AS keyword, instr(page_text, {D.text(k)}) AS pos, page_text FROM risk_pages WHERE {risk.keyword_test(D, 'page_text', k)}" for n, c, k in _WORDS) + ")"


@query(f"WITH {cte('risk_pages')}, {_FOUND} SELECT site_id, page_url, kw_ord, category, keyword, pos FROM found")
def risk_keywords(spark, d):
    return risk.findings(view(spark, d, "risk_pages")).drop("snippet")


@query(f"WITH {cte('risk_pages')}, {_FOUND}, w AS (SELECT *, greatest(pos - 100, 1) AS a FROM found), s AS (SELECT *, trim(substr(page_text, a, pos + length(keyword) + 100 - a), ' ' || chr(9) || chr(10) || chr(13)) AS cut FROM w) SELECT page_url, kw_ord, CASE WHEN pos = 0 THEN 'Keyword ''' || keyword || ''' found in ' || category || ' category' WHEN length(cut) > 200 THEN substr(cut, 1, 197) || '...' ELSE cut END AS snippet FROM s")
def snippet_extract(spark, d):
    return risk.findings(view(spark, d, "risk_pages")).select("page_url", "kw_ord", "snippet")


@query(f"WITH {cte('risk_pages')}, {_FOUND}, w AS (SELECT *, count(DISTINCT page_url) OVER (PARTITION BY site_id, category, keyword) > 1 AS corroborated FROM found) SELECT site_id, page_url, kw_ord, corroborated, CASE WHEN corroborated AND category IN ('gambling', 'adult', 'child_pornography') THEN 'critical' ELSE 'moderate' END AS severity FROM w")
def risk_corroborated(spark, d):
    return risk.corroborate(risk.findings(view(spark, d, "risk_pages"))).select("site_id", "page_url", "kw_ord", "corroborated", "severity")


_LOREM = D.match("page_text", "|".join(f"(?:{p})" for p in RR.LOREM))
_RISK = f"lorem AS (SELECT site_id, bool_or({_LOREM}) AS has_dummy FROM risk_pages GROUP BY 1), nf AS (SELECT site_id, count(*) AS n FROM found GROUP BY 1)"


@query(f"WITH {cte('risk_pages')}, {_FOUND}, {_RISK}, s AS (SELECT site_id, coalesce(n, 0) AS n_findings, has_dummy, coalesce(n, 0) * 20 + CASE WHEN has_dummy THEN 50 ELSE 0 END AS risk_score FROM lorem LEFT JOIN nf USING (site_id)) SELECT *, CASE WHEN risk_score >= 100 THEN 'high' WHEN risk_score >= 50 THEN 'moderate' ELSE 'low' END AS risk_band FROM s")
def risk_scores(spark, d):
    return risk.site_scores(view(spark, d, "risk_pages"))


@query(f"WITH {cte('risk_pages')}, {_FOUND} SELECT site_id, category, string_agg(keyword, ',' ORDER BY kw_ord) FILTER (WHERE k = 1) AS keywords, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY site_id, category, keyword) AS k FROM found) x GROUP BY 1, 2")
def risk_by_category(spark, d):
    return risk.by_category(risk.findings(view(spark, d, "risk_pages")))


@query(f"WITH {cte('risk_pages')}, p AS (SELECT DISTINCT site_id, i, p FROM risk_pages, (VALUES {', '.join(f'({i}, {D.text(p)})' for i, p in enumerate(RR.LOREM))}) AS t(i, p) WHERE regexp_matches(page_text, p)) SELECT site_id, string_agg(p, ' ' ORDER BY i) AS patterns FROM p GROUP BY 1")
def placeholder_patterns(spark, d):
    return risk.placeholder_patterns(view(spark, d, "risk_pages")).select("site_id", F.array_join("patterns", " ").alias("patterns"))


_EV = ", ".join(f"{e} AS {n}" for n, e in context.evidence_sql(D, "page_text").items())
_S = context.score_sql(D)
_SC = ", ".join(f"{s} AS s_{k}" for k, s in _S)
_ARR = "[" + ", ".join(f"{{'score': s_{k}, 'o': {-i}, 'name': '{k}'}}" for i, (k, _) in enumerate(_S)) + "]"
_CTX = f"""ev AS (SELECT doc_id, site_id, {_EV} FROM risk_pages), sc AS (SELECT *, {_SC} FROM ev), rk AS (SELECT *, list_sort({_ARR}, 'DESC') AS r FROM sc),
ctx AS (SELECT *, r[1].score AS score, r[2].score AS second_score, r[1].name AS best FROM rk),
contexts AS (SELECT doc_id, site_id, CASE WHEN score <= 1 THEN 'UNKNOWN' ELSE best END AS primary_context, CASE WHEN score > 0 AND score - second_score < 1 THEN 'LOW_CONFIDENCE' WHEN score <= 1 THEN 'UNDETERMINED' WHEN score < 3 THEN 'LOW_CONFIDENCE' ELSE 'DETERMINED' END AS status, least(score / 10, 1) AS confidence,
  CASE WHEN login_detected THEN CASE WHEN has_cart THEN 'FULL_COMMERCE' ELSE 'AUTH_GATED' END WHEN has_cart THEN 'FULL_COMMERCE' WHEN n_developer_docs > 0 AND best = 'DEVELOPER_PLATFORM' THEN 'API_DOCS' WHEN n_content > 0 AND best = 'CONTENT_MEDIA' THEN 'CONTENT_ONLY' ELSE 'MARKETING_SITE' END AS surface,
  score, second_score, pricing_model, audience FROM ctx)"""


@query(f"WITH {cte('risk_pages')}, {_CTX} SELECT * EXCLUDE (site_id) FROM contexts")
def context_score(spark, d):
    return context.classify(view(spark, d, "risk_pages"))


# --- compliance

def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, d, "risk_pages")
    found = risk.findings(rows)
    sites = rows.groupBy("site_id").agg(F.bool_or(risk.has_lorem(F.col("page_text"))).alias("has_dummy")).select(
        "site_id", (F.col("site_id") % 7 != 0).alias("ssl_ok"), F.when(F.col("site_id") % 5 != 0, F.col("site_id") * 60).alias("age_days"), "has_dummy"
    )
    # A site's home page is its page with the smallest id.
    home = rows.join(rows.groupBy("site_id").agg(F.min("doc_id").alias("doc_id")), ["site_id", "doc_id"])
    home = context.classify(home).join(home.select("doc_id", "site_id"), "doc_id")
    policies_ = policy.detect(view(spark, d, "compliance_links"))
    return compliance.facts_of(sites, policies_, found, home), found


_FACTS = f"""facts AS (SELECT s.site_id, s.site_id % 7 <> 0 AS ssl_ok, CASE WHEN s.site_id % 5 <> 0 THEN s.site_id * 60 END AS age_days, s.has_dummy, coalesce(c.primary_context, 'UNKNOWN') AS primary_context, coalesce(c.status, 'DETERMINED') AS context_status,
  {', '.join(f"EXISTS (SELECT 1 FROM detected p WHERE p.site_id = s.site_id AND p.policy = '{p}') AS found_{p}" for p, _ in PO.SCORED_POLICIES)},
  {', '.join(f"(SELECT count(*) FROM found f WHERE f.site_id = s.site_id AND f.category = '{c}') AS n_{c}" for c in RR.PENALTY)}
  FROM lorem s LEFT JOIN (SELECT * FROM contexts WHERE doc_id IN (SELECT min(doc_id) FROM risk_pages GROUP BY site_id)) c ON c.site_id = s.site_id)"""
_ALL = f"{cte('risk_pages', 'compliance_links')}, {_FOUND}, {_RISK}, {_CTX}, {_POLICY.replace('FROM site_links)', 'FROM compliance_links)', 1)}, {_FACTS}"
_SCORE = "scores AS (SELECT site_id, " + ", ".join(f"{e} AS {n}" for n, e in compliance.score_columns_sql(D).items()) + " FROM facts)"


@query(f"WITH {_ALL}, {_SCORE} SELECT * FROM scores")
def compliance_score(spark, d):
    return compliance.score(_facts(spark, d)[0])


def _issue_sql() -> str:
    parts = ["SELECT site_id, 0 AS ord, 'COMPLIANCE' AS category, 'Compliance issue: NO_HTTPS' AS title, 'HIGH' AS severity, 'Enable HTTPS with valid SSL certificate' AS fix FROM facts WHERE NOT ssl_ok"]
    for n, (p, name) in enumerate(PO.SCORED_POLICIES, 1):
        e = compliance.expectation_sql(D, p)
        parts.append(f"SELECT site_id, {n}, 'POLICY', '{name} missing', CASE {e} WHEN 'required' THEN 'HIGH' WHEN 'optional' THEN 'MEDIUM' ELSE 'LOW' END, 'Add {name} page accessible from site navigation' FROM facts WHERE NOT found_{p}")
    parts.append("SELECT site_id, 1000000, 'QUALITY', 'Dummy/placeholder text detected', 'MEDIUM', 'Replace placeholder text with actual content before going live' FROM facts WHERE has_dummy")
    expected = ", ".join(f"'{c}'" for c in RR.CRYPTO_EXPECTED)
    parts.append(f"SELECT f.site_id, kw_ord + 100, 'CONTENT_RISK', 'Restricted content detected: ' || f.category, CASE WHEN f.category = 'crypto' AND primary_context IN ({expected}) THEN 'LOW' WHEN f.category IN ('gambling', 'adult') THEN 'HIGH' ELSE 'MEDIUM' END, 'Review content for ''' || keyword || ''' - may require special compliance' FROM found f JOIN facts USING (site_id)")
    return "issues AS (SELECT *, severity = 'HIGH' AS required FROM (" + " UNION ALL ".join(parts) + ") x)"


@query(f"WITH {_ALL}, {_issue_sql()} SELECT * FROM issues")
def issue_model(spark, d):
    return compliance.issues(*_facts(spark, d))


@query(f"WITH {_ALL}, {_issue_sql()} SELECT site_id, count(*) AS issues, count(*) FILTER (WHERE severity = 'HIGH') AS critical FROM issues GROUP BY 1")
def severity_rules(spark, d):
    return compliance.issues(*_facts(spark, d)).groupBy("site_id").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "HIGH").alias("critical"))


_FIXES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, severity ORDER BY ord, fix) AS k FROM issues),
firsts AS (SELECT site_id, fix, min(CASE severity WHEN 'HIGH' THEN k ELSE 10 + k END) AS place FROM ranked WHERE (severity = 'HIGH' AND k <= 3) OR (severity = 'MEDIUM' AND k <= 2) GROUP BY 1, 2),
fixes AS (SELECT site_id, string_agg(fix, '; ' ORDER BY place) AS fixes FROM firsts GROUP BY 1),
counted AS (SELECT site_id, count(*) AS issues, count(*) FILTER (WHERE severity = 'HIGH') AS critical FROM issues GROUP BY 1)"""


@query(f"""WITH {_ALL}, {_SCORE}, {_issue_sql()}, {_FIXES}
SELECT site_id, '{{"site_id":' || site_id || ',"scores":{{"technical_score":' || technical_score || ',"policy_score":' || policy_score || ',"trust_score":' || trust_score || ',"total_score":' || total_score || ',"rating":"' || rating || '"}},"pass":' || CASE WHEN rating <> 'Poor' AND coalesce(critical, 0) = 0 THEN 'true' ELSE 'false' END
  || ',"summary":{{"issues":' || coalesce(issues, 0) || ',"critical":' || coalesce(critical, 0) || '}},"recommendations":"' || coalesce(fixes, '') || '"}}' AS report FROM scores LEFT JOIN counted USING (site_id) LEFT JOIN fixes USING (site_id)""")
def report_json(spark, d):
    facts, found = _facts(spark, d)
    return compliance.report(compliance.score(facts), compliance.issues(facts, found))


@query(f"WITH {_ALL}, {_SCORE} SELECT site_id, '# Site ' || site_id || chr(10) || chr(10) || '**' || total_score || '/100 – ' || rating || '**' || chr(10) || chr(10) || '| Part | Score |' || chr(10) || '|-|-|' || chr(10) || '| Technical | ' || technical_score || ' / 30 |' || chr(10) || '| Policy | ' || policy_score || ' / 40 |' || chr(10) || '| Trust | ' || trust_score || ' / 30 |' AS report FROM scores")
def report_markdown(spark, d):
    return compliance.markdown(compliance.score(_facts(spark, d)[0]))


def _report_parts(spark, d):
    facts, found = _facts(spark, d)
    sites = facts.select("site_id", F.concat(F.lit("https://site"), F.col("site_id").cast("string"), F.lit(".example.com/")).alias("url"), F.lit("2024-01-31").alias("scanned_at"))
    raised = reports.alerts(facts.select("site_id", (F.col("site_id") % 4).cast("int").alias("redirect_count"), F.col("ssl_ok").alias("https"), F.when(F.col("site_id") % 9 == 0, "certificate expired").alias("ssl_error"), "age_days"))
    contexts = facts.select("site_id", "primary_context", F.lit(None).cast("double").alias("confidence"), F.col("context_status").alias("status"), F.lit(None).cast("string").alias("surface"))
    none = facts.select("site_id", *[F.lit(None).cast(k).alias(c) for c, k in (("mcc", "string"), ("description", "string"), ("band", "string"), ("mcc_confidence", "double"), ("keywords", "array<string>"))])
    return facts, found, sites, raised, contexts, none


@query()
def alert_issues(spark, d):
    """Every issue of every site with its reason: alerts, policies, content, placeholders."""
    facts, found, _, raised, _, _ = _report_parts(spark, d)
    return reports.all_issues(facts, raised, found)


@query()
def report_model(spark, d):
    """The whole report of every site, as JSON and as Markdown."""
    facts, found, sites, raised, contexts, none = _report_parts(spark, d)
    built = reports.model(sites, compliance.score(facts), reports.all_issues(facts, raised, found), contexts, none)
    return reports.as_json(built).join(reports.as_markdown(built).withColumnRenamed("report", "markdown"), "site_id")


@query("SELECT c_custkey, 'site_scan_' || left(regexp_replace(concat(c_name, ' /', c_custkey), '[^A-Za-z0-9.-]', '_', 'g'), 50) || '.json' AS filename FROM customer")
def report_filenames(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", compliance.report_filename(F.concat("c_name", F.lit(" /"), F.col("c_custkey").cast("string"))).alias("filename"))


# --- snapshots and cache

_HASHED = ("home", "privacy_policy", "terms_conditions", "product", "pricing", "about")
_LAG = "l AS (SELECT *, lag(id) OVER w AS p_id, " + ", ".join(f"lag({p}_hash) OVER w AS p_{p}" for p in _HASHED) + ", lag(pricing_model) OVER w AS p_model, lag(product_count) OVER w AS p_count FROM snapshots WINDOW w AS (PARTITION BY target_url ORDER BY scan_timestamp, id))"
_PAGES = [("Home", "minor"), ("Privacy Policy", "minor"), ("Terms Conditions", "minor"), ("Product", "moderate"), ("Pricing", "moderate"), ("About", "minor")]
_CHG = "chg AS (" + " UNION ALL ".join(
    f"SELECT target_url, id, {k} AS ord, 'content_change' AS type, '{p}' AS where_, '{s}' AS severity, '{t} page content has changed.' AS description FROM l WHERE p_{p} IS NOT NULL AND {p}_hash IS DISTINCT FROM p_{p}" for k, (p, (t, s)) in enumerate(zip(_HASHED, _PAGES))
) + """ UNION ALL SELECT target_url, id, 6, 'pricing_change', 'pricing', 'critical', 'Pricing model changed from ' || coalesce(p_model, 'Unknown') || ' to ' || coalesce(pricing_model, 'Unknown') || '.' FROM l WHERE p_id IS NOT NULL AND pricing_model IS DISTINCT FROM p_model
UNION ALL SELECT target_url, id, 7, 'product_change', 'product', 'moderate', 'Number of detected products changed from ' || p_count || ' to ' || product_count || '.' FROM l WHERE p_id IS NOT NULL AND product_count <> p_count)"""


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots view with its hashes as a map of page type to hash."""
    rows = view(spark, d, "snapshots")
    return rows.withColumn("page_hashes", F.create_map(*[x for p in _HASHED for x in (F.lit(p), F.col(f"{p}_hash"))])).drop(*[f"{p}_hash" for p in _HASHED])


_RULES = ", ".join(f"({D.text(t)}, {D.text(s)}, {D.text(i)}, {D.text(a)}, {c}::DOUBLE)" for t, s, i, a, c in CR.CHANGE_RULES)
_PAGE_RULE = cases([(f"type = 'content_change' AND where_ = '{p}'", f"'{r}'") for p, r in CR.PAGE_RULES], "type")
_ENR = f"enr AS (SELECT c.target_url, c.id, c.ord, c.type, c.where_, c.description, coalesce(r.severity, 'minor') AS severity, coalesce(r.impact, 'Unclassified change detected') AS business_impact, coalesce(r.action, 'Review manually') AS recommended_action, coalesce(r.confidence, 0.5) AS confidence FROM (SELECT *, {_PAGE_RULE} AS rule FROM chg) c LEFT JOIN (VALUES {_RULES}) AS r(rule, severity, impact, action, confidence) ON r.rule = c.rule)"


@query(f"WITH {cte('snapshots')}, {_LAG}, {_CHG} SELECT * FROM chg")
def snapshot_change_detect(spark, d):
    return changes.detect(_snapshots(spark, d))


@query(f"WITH {cte('snapshots')}, {_LAG}, {_CHG}, {_ENR} SELECT * FROM enr")
def change_rules(spark, d):
    return changes.enrich(changes.detect(_snapshots(spark, d)))


@query(f"""WITH {cte('snapshots')}, {_LAG}, {_CHG}, {_ENR}, o AS (SELECT *, CASE severity WHEN 'critical' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END AS k FROM enr),
a AS (SELECT target_url, id, count(*) FILTER (WHERE k = 3) AS c, count(*) FILTER (WHERE k = 2) AS m, count(*) FILTER (WHERE k = 1) AS n, floor((2 * sum(round(confidence * 100)::BIGINT) + count(*)) / (2 * count(*))) / 100 AS confidence, first(description ORDER BY k DESC, ord) AS de, first(recommended_action ORDER BY k DESC, ord) AS ac FROM o GROUP BY 1, 2)
SELECT l.target_url, l.id, p_id IS NOT NULL AS since_last_scan, CASE WHEN p_id IS NULL THEN 'none' WHEN c > 0 THEN 'critical' WHEN m > 0 THEN 'moderate' ELSE 'minor' END AS overall_severity,
CASE WHEN p_id IS NULL THEN 'No significant changes detected' WHEN a.id IS NULL THEN 'No changes detected.' ELSE 'Detected ' || concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN m > 0 THEN m || ' moderate' END, CASE WHEN n > 0 THEN n || ' minor' END) || ' changes' || CASE WHEN c > 0 THEN ' — dominated by ' || de WHEN m > 0 THEN ' — notably ' || de ELSE '' END END AS summary,
CASE WHEN p_id IS NOT NULL THEN CASE WHEN c > 0 OR m > 0 THEN ac ELSE 'No immediate action required' END END AS recommended_action, CASE WHEN p_id IS NOT NULL THEN coalesce(a.confidence, 1) END AS confidence
FROM l LEFT JOIN a ON a.target_url = l.target_url AND a.id = l.id""")
def change_intelligence(spark, d):
    return changes.intelligence(_snapshots(spark, d))


@query(f"WITH {cte('snapshots')} SELECT target_url, id, pricing_model FROM (SELECT *, row_number() OVER (PARTITION BY target_url ORDER BY scan_timestamp DESC, id DESC) AS k FROM snapshots) x WHERE k = 1")
def snapshot_asof_prev(spark, d):
    return changes.latest(_snapshots(spark, d)).select("target_url", "id", "pricing_model")


_TTL = f"created_at + {U.ttl_seconds(D, 'page_type')} * INTERVAL '1' SECOND"


@query(f"WITH {cte('page_cache')} SELECT page_id, {_TTL} AS expires_at FROM page_cache WHERE {_TTL} > {AS_OF_CACHE}")
def cache_valid(spark, d):
    return cache.valid(view(spark, d, "page_cache"), F.expr(AS_OF_CACHE)).select("page_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query(f"""WITH {cte('page_cache')}, new AS (SELECT page_id, url, page_type, md5(content_hash) AS content_hash, CASE WHEN page_id % 5 = 0 THEN 500 ELSE 200 END AS status, created_at + INTERVAL '1' DAY AS created_at FROM page_cache WHERE page_id % 2 = 0),
b AS (SELECT *, 0 AS turn FROM page_cache UNION ALL SELECT *, 1 FROM new WHERE status = 200 AND content_hash IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY turn DESC, created_at DESC, page_id DESC) AS k, min(created_at) OVER (PARTITION BY url) AS first_ FROM b) SELECT url, first_ AS created_at, created_at AS updated_at, page_id, content_hash FROM r WHERE k = 1""")
def cache_upsert(spark, d):
    return _cached(cache.upsert(*_cache_batches(spark, d)))


def _cache_batches(spark, d):
    old = view(spark, d, "page_cache")
    new = old.where("page_id % 2 = 0").withColumns({"content_hash": F.md5("content_hash"), "status": F.when(F.col("page_id") % 5 == 0, 500).otherwise(200), "created_at": F.col("created_at") + F.expr("INTERVAL '1' DAY")})
    return old, new


def _cached(out):
    return out.select("url", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "page_id", "content_hash")


# --- texts

@query(f"SELECT conv_id, turn, {pages.lead_score_sql(D, "coalesce(text, '')")} AS score, coalesce(nullif(trim(regexp_extract(text, '(?im)^\\s*subject:(.*)$', 1)), ''), 'Follow-up from our conversation') AS subject FROM conversations")
def lead_score(spark, d):
    return pages.lead_scores(read_table(spark, d, "conversations"))


_CONTACTS = ", ".join(f"{e} AS {n}" for n, e in pages.contacts_sql(D, "coalesce(text, '')").items())


@query(f"SELECT doc_id, {_CONTACTS} FROM documents")
def email_contact_extract(spark, d):
    rows = read_table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return pages.contacts(rows)


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
i AS (SELECT doc_id, s, unnest(range(0, len(s))) AS sent FROM s) SELECT doc_id, sent, CASE WHEN sent > 0 THEN s[sent] END AS before, regexp_replace(s[sent + 1], '(tion)', '**\\1**', 'gi') AS sentence, s[sent + 2] AS after FROM i WHERE contains(lower(s[sent + 1]), 'tion')""")
def keyword_context(spark, d):
    return pages.keyword_context(read_table(spark, d, "documents"), "tion")


assert set(PR.TTL) and len(ORACLES) <= len(QUERIES)


# --- signals and products

_SIGNALS = "SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber WHEN 1 THEN 'domain_age' WHEN 2 THEN 'ssl_https_presence' WHEN 3 THEN 'seo_score' ELSE 'other' END AS signal FROM {lineitem}"


@query(f"SELECT id, n, {signals.signal_class_sql('signal')} AS class, signal = 'ssl_https_presence' AS decides FROM ({_SIGNALS.replace('{lineitem}', 'lineitem')}) x")
def signal_classes(spark, d):
    rows = spark.sql(_SIGNALS, lineitem=read_table(spark, d, "lineitem"))
    return rows.select("id", "n", F.expr(signals.signal_class_sql("signal")).alias("class"), signals.can_decide(F.col("signal")).alias("decides"))


@query("""WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS url, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'r' END AS rule, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS conf, CASE WHEN c_custkey % 7 = 0 THEN 'critical' END AS sev FROM customer),
m AS (SELECT *, coalesce(url, '') = '' OR rule = '' AS missing FROM e)
SELECT id, CASE WHEN missing OR (conf IS NULL AND sev IS NULL) THEN 0 WHEN conf IS NULL THEN 0 ELSE greatest(0, least(100, conf)) END AS confidence, CASE WHEN missing OR (conf IS NULL AND sev IS NULL) THEN 'info' ELSE sev END AS severity, missing AS missing_fields FROM m""")
def evidence_downgrade(spark, d):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    e = signals.evidence(F.when(k % 3 != 0, F.col("c_name")), F.when(k % 5 == 0, "").otherwise("r"), F.lit("s"), F.when(k % 2 == 0, bal), F.when(k % 7 == 0, "critical"))
    return read_table(spark, d, "customer").select(k.alias("id"), e.alias("e")).select("id", F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"), "e.severity", "e.missing_fields")


@query("SELECT c_custkey AS site_id, CASE WHEN c_custkey % 5 > 1 THEN 'EXCESSIVE_REDIRECTS' END AS code, CASE WHEN c_custkey % 5 > 1 THEN (c_custkey % 5) || ' redirects detected.' END AS description FROM customer")
def redirect_alerts(spark, d):
    rows = read_table(spark, d, "customer").select(F.col("c_custkey").alias("site_id"), signals.redirect_alert(F.col("c_custkey") % 5).alias("a"))
    return rows.select("site_id", "a.code", "a.description")


@query("SELECT c_custkey AS id, c_custkey * 11 AS days, CASE WHEN c_custkey * 11 > 1095 THEN 'Good' WHEN c_custkey * 11 > 365 THEN 'Moderate' ELSE 'Low' END AS band FROM customer")
def domain_age_bands(spark, d):
    days = F.col("c_custkey") * 11
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), days.alias("days"), signals.age_band(days).alias("band"))


@query("SELECT c_custkey AS id, 'https://a.test/domain/' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' https://b.test/r/domain/' || c_custkey END AS urls FROM customer")
def registry_urls(spark, d):
    bases = F.array(F.lit("https://a.test/"), F.when(F.col("c_custkey") % 2 == 0, "https://a.test").otherwise("https://b.test/r//"), F.lit("https://a.test"))
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(files.registry_urls(F.col("c_custkey").cast("string"), bases), " ").alias("urls"))


@query("""WITH f AS (SELECT c_custkey AS site_id, c_custkey % 2 = 0 AS r, c_custkey % 3 = 0 AS t, c_custkey % 5 = 0 AS s, c_custkey % 7 = 0 AS p FROM customer)
SELECT site_id, r AND t AS passes, CASE WHEN r AND t THEN '' ELSE concat_ws(' ', CASE WHEN NOT r THEN 'Refund/Return Policy is missing. Please add a clear Refund Policy page.' END, CASE WHEN NOT t THEN 'Terms & Conditions are missing. Please add a Terms of Service page.' END, CASE WHEN NOT s AND p THEN 'Shipping Policy is recommended for e-commerce sites.' END) END AS actions FROM f""")
def payment_terms(spark, d):
    k = F.col("c_custkey")
    facts = read_table(spark, d, "customer").select(k.alias("site_id"), (k % 2 == 0).alias("has_returns"), (k % 3 == 0).alias("has_terms"), (k % 5 == 0).alias("has_shipping"), (k % 7 == 0).alias("mentions_product"))
    return signals.payment_terms(facts)


_IND = ", ".join(f"{e} AS {n}" for n, e in signals.product_indicators_sql(D, "page_text").items())


@query(f"WITH {cte('risk_pages')} SELECT doc_id, {_IND} FROM risk_pages")
def product_indicators(spark, d):
    return signals.product_indicators(view(spark, d, "risk_pages"))


_ABOUT = ", ".join(f"{e} AS {n}" for n, e in signals.about_facts_sql(D, "x").items())
# The tables hold no such sentences, so the view adds some behind the text: only a search of the whole text finds them.
_ABOUT_TEXT = "concat(page_text, CASE doc_id % 3 WHEN 0 THEN ' Our mission: to build tools for every shop in town.' WHEN 1 THEN ' Services include repairs, cleaning and deliveries of all kinds.' ELSE '' END, ' 12 High Street, Old Town 12345')"


@query(f"WITH {cte('risk_pages')}, a AS (SELECT doc_id, {_ABOUT_TEXT} AS x FROM risk_pages) SELECT doc_id, {_ABOUT} FROM a")
def about_facts(spark, d):
    rows = view(spark, d, "risk_pages").select("doc_id", F.expr(_ABOUT_TEXT).alias("page_text"))
    return signals.about_facts(rows)


_BARS = {k: D.text("|".join(getattr(research, k))) for k in ("NO_PRODUCT", "NO_NAME", "LISTS", "PRODUCT_PATHS")}


@query(rf"""WITH {cte('site_links')}, r AS (SELECT site_id, link_ord, link_ord % 9 = 0 AS in_menu, lower({U.path(D, 'url')}) AS route, trim(coalesce(anchor, '')) AS label FROM site_links),
t AS (SELECT *, translate(regexp_extract(route, '([^/]+)/*$', 1), '-_', '  ') AS last FROM r),
n AS (SELECT *, CASE WHEN in_menu AND label <> '' THEN 1 WHEN regexp_matches(route, {_BARS['PRODUCT_PATHS']}) AND last <> '' THEN 2
  WHEN regexp_matches(label, '^\S+(\s+\S+){{0,4}}$') AND NOT regexp_matches(lower(label), {_BARS['NO_NAME']}) AND NOT regexp_matches(route, {_BARS['LISTS']}) AND length(route) > 1 THEN 3 END AS tier FROM t),
m AS (SELECT site_id, link_ord, tier, CASE WHEN tier = 2 THEN array_to_string(list_transform(string_split(last, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') ELSE label END AS name FROM n WHERE tier IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY site_id, lower(name) ORDER BY link_ord) AS k FROM m WHERE length(name) BETWEEN 2 AND 50 AND NOT regexp_matches(lower(name), {_BARS['NO_PRODUCT']})),
f AS (SELECT *, count(*) FILTER (WHERE tier < 3) OVER (PARTITION BY site_id) AS real FROM g WHERE k = 1),
o AS (SELECT site_id, name, tier, row_number() OVER (PARTITION BY site_id ORDER BY tier, link_ord) AS rank_ FROM f WHERE tier < 3 OR real < 15) SELECT site_id, rank_, name, tier FROM o WHERE rank_ <= 20""")
def product_extract(spark, d):
    links = view(spark, d, "site_links").withColumn("in_menu", F.col("link_ord") % 9 == 0)
    return research.products(links)


@query()
def product_outline(spark, d):
    """Products of every two pages taken as a site, its home page and its product page, by all tiers."""
    some = read_table(spark, d, "pages").select(F.expr("page_id div 2").alias("site_id"), (F.col("page_id") % 2 == 0).alias("home"), "url", "html")
    home, inner = some.where("home"), some.where("not home")
    named = navigation.links(home.where("site_id % 3 = 0"), "site_id").where("text <> ''").select("site_id", F.col("rank").alias("ord"), F.col("text").alias("name"))
    found = navigation.links(home.where("site_id % 3 = 1"), "site_id").select("site_id", F.col("rank").alias("link_ord"), "url", F.col("text").alias("anchor"), F.lit(False).alias("in_menu"))
    listed = research.products(found).select("site_id", F.col("rank_").alias("ord"), "name")
    return outline.extract(home, inner, named, listed)


@query("SELECT doc_id, len(k) AS n_matches, array_to_string(k, ',') AS matched, CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS excerpt FROM (SELECT doc_id, coalesce(text, '') AS t, list_filter(['the', 'license', 'tion'], lambda w: contains(lower(coalesce(text, '')), w)) AS k FROM documents) x")
def keyword_monitor(spark, d):
    return research.keyword_monitor(read_table(spark, d, "documents"), ("the", "license", "tion"))


@query(f"WITH {cte('site_links')} SELECT site_id, policy, arg_min(url, link_ord) AS url FROM site_links, (VALUES ('privacy', 'privacy'), ('terms', 'terms|conditions'), ('pricing', 'pricing|plans')) AS p(policy, re) WHERE regexp_matches(concat_ws(' ', lower(url), lower(anchor)), re) GROUP BY 1, 2")
def policy_first_match(spark, d):
    return research.first_match_policies(view(spark, d, "site_links"), (("privacy", "privacy"), ("terms", "terms|conditions"), ("pricing", "pricing|plans")))


@query("SELECT n_name AS topic, i AS ord, replace(q, '{}', n_name) AS query FROM nation, (VALUES (0, '{} competitors'), (1, '{} market share'), (2, 'news on {}')) AS t(i, q)")
def search_queries(spark, d):
    return research.query_plan(read_table(spark, d, "nation").select(F.col("n_name").alias("topic")), ("{} competitors", "{} market share", "news on {}"))


@query(f"WITH {cte('site_links')}, {_POLICY} SELECT s.site_id, p.policy, CASE WHEN d.policy IS NOT NULL THEN 'found' WHEN p.policy IN ('shipping_delivery', 'returns_refund') THEN 'n/a' ELSE 'missing' END AS state FROM (SELECT DISTINCT site_id FROM site_links) s CROSS JOIN (VALUES ('shipping_delivery'), ('returns_refund'), ('faq')) AS p(policy) LEFT JOIN detected d ON d.site_id = s.site_id AND d.policy = p.policy")
def policy_display(spark, d):
    links = view(spark, d, "site_links")
    wanted = links.select("site_id").distinct().withColumn("policy", F.explode(F.array(*map(F.lit, ("shipping_delivery", "returns_refund", "faq")))))
    both = wanted.join(policy.detect(links).select("site_id", "policy", F.lit(True).alias("f")), ["site_id", "policy"], "left")
    return both.select("site_id", "policy", policy.display_state(F.col("policy"), F.coalesce("f", F.lit(False)), F.lit(None).cast("string")).alias("state"))


# --- streams: run to the end of what is there, so that closed windows are the same every time

def _stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream of files. A stream reads a folder, so the glob names the one table."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


def _ended(stream: DataFrame, name: str) -> DataFrame:
    folder = keep_until_release(scratch(stream.sparkSession, name))
    return events_.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint")


@query("""WITH m AS (SELECT max(ts) - INTERVAL '1' HOUR AS w FROM events), x AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start, event_type, n FROM x, m WHERE start + INTERVAL '1' DAY <= w""")
def stream_task_windows(spark, d):
    out = events_.window_counts(events_.timed(_stream(spark, d)))
    return _ended(out, "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT max(ts) - INTERVAL '1' HOUR AS w FROM events), a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1' HOUR THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a), c AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '1' HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, k)
SELECT user_id, start, "end", n FROM c, m WHERE "end" <= w""")
def stream_sessions(spark, d):
    out = _ended(events_.sessions(events_.timed(_stream(spark, d))), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_url_dedupe(spark, d):
    return _ended(events_.first_seen(events_.timed(_stream(spark, d), "3650 days"), "user_id", "event_type"), "dedupe").select("user_id", "event_type")


@query(f"WITH {cte('snapshots')}, {_LAG} SELECT target_url, id, p_model AS previous, pricing_model AS current FROM l WHERE p_id IS NOT NULL AND pricing_model IS DISTINCT FROM p_model")
def stream_changes(spark, d):
    rows = spark.sql(VIEWS["snapshots"], events=_stream(spark, d)).select("target_url", "id", F.col("scan_timestamp").cast("timestamp").alias("ts"), "pricing_model")
    return _ended(events_.pricing_changes(rows), "changes")


@query("""WITH RECURSIVE e AS (SELECT user_id || '/' || event_type AS key, ts FROM events), f AS (SELECT key, min(ts) AS ts FROM e GROUP BY key
UNION ALL SELECT e.key, min(e.ts) FROM f JOIN e ON e.key = f.key AND e.ts >= f.ts + INTERVAL '5' DAY GROUP BY e.key) SELECT key, ts FROM f""")
def stream_lifetime_dedupe(spark, d):
    """An event of each user and type that isn't within five days of the last one given out."""
    some = events_.timed(_stream(spark, d)).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("id"), "ts")
    out = _ended(lifetimes.first_in_lifetime(some, "key", "5 days"), "lifetimes")
    return out.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {cte('snapshots')}, {_LAG}, m AS (SELECT max(scan_timestamp) - INTERVAL '1' HOUR AS w FROM snapshots)
SELECT target_url AS key, id, p_model AS previous, pricing_model AS current FROM l, m WHERE p_id IS NOT NULL AND pricing_model IS DISTINCT FROM p_model AND scan_timestamp <= w""")
def stream_changes_ordered(spark, d):
    """Pricing changes in the order of events, as far as the watermark has come. Watermarks are in whole
    milliseconds, so all times are moved by the microseconds that make the last one whole."""
    end = read_table(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    ts = F.timestamp_micros(F.unix_micros(F.col("scan_timestamp").cast("timestamp")) + -(end or 0) % 1000)
    rows = spark.sql(VIEWS["snapshots"], events=_stream(spark, d)).select("target_url", "id", ts.alias("ts"), "pricing_model")
    return _ended(lifetimes.changes_in_order(rows.withWatermark("ts", "1 hour"), "target_url", "pricing_model", "36500 days"), "ordered-changes")


@query(ORACLES["cache_upsert"])
def cache_upsert_buckets(spark, d):
    """cache_upsert() as two batches into a stored table, of which only touched buckets are written again."""
    old, new = (part.withColumn("updated_at", F.col("created_at")) for part in _cache_batches(spark, d))
    stored = upserts.BucketedTable(spark, keep_until_release(scratch(spark, "cache")), ", ".join(f"{c} {k}" for c, k in old.dtypes), "url", cache.upsert)
    for k, part in enumerate((old, new)):
        stored.apply(part, k)
    return _cached(stored.read())

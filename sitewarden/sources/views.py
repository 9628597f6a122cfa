"""Input views derived from the generic tables, as SQL that Spark and the checks share.

Live fetches, certificates and registry answers aren't made here: these views stand for
the tables that a crawler would write."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "tasks": """
SELECT id, agent_id, action, status, priority, created_at, started_at,
       CASE WHEN status IN ('completed', 'failed') AND started_at IS NOT NULL THEN started_at + (id % 600) * INTERVAL '1' SECOND END AS completed_at
FROM (SELECT id, agent_id, action, status, priority, created_at,
             CASE WHEN status <> 'pending' AND id % 13 <> 0 THEN created_at + (id % 3600) * INTERVAL '1' SECOND END AS started_at
      FROM (SELECT o_orderkey AS id, CAST(o_custkey % 9 AS INT) AS agent_id, o_orderpriority AS action,
                   CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'pending' END AS status,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
                   o_orderdate AS created_at FROM {orders}) a) b""",
    "agents": """
SELECT id, CASE id % 10 WHEN 0 THEN 'sales' WHEN 1 THEN 'support' WHEN 2 THEN 'hr' WHEN 3 THEN 'market_research' WHEN 4 THEN 'marketing' WHEN 5 THEN 'leads'
         WHEN 6 THEN 'intelligence' WHEN 7 THEN 'legal' WHEN 8 THEN 'finance' ELSE 'archive' END AS type,
       CASE WHEN balance < 0 THEN 'error' WHEN id % 4 = 1 THEN 'paused' ELSE 'active' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + (id * 7919 % 1000) * INTERVAL '1' HOUR AS created_at
FROM (SELECT CAST(s_suppkey - 1 AS INT) AS id, s_acctbal AS balance FROM {supplier}) a""",
    "snapshots": """
SELECT event_id AS id, concat('https://site', CAST(user_id AS STRING), '.example.com') AS target_url, ts AS scan_timestamp,
       md5(concat('home', CAST(event_id % 3 AS STRING))) AS home_hash,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE md5(concat('priv', CAST(event_id % 2 AS STRING))) END AS privacy_policy_hash,
       md5(concat('terms', CAST(event_id % 7 AS STRING))) AS terms_conditions_hash, CASE WHEN event_id % 4 = 1 THEN NULL ELSE md5(concat('prod', CAST(event_id % 3 AS STRING))) END AS product_hash,
       md5(concat('price', CAST(event_id % 2 AS STRING))) AS pricing_hash, md5(concat('about', CAST(event_id % 6 AS STRING))) AS about_hash,
       CASE event_type WHEN 'purchase' THEN 'Subscription' WHEN 'view' THEN 'Fixed Price' WHEN 'click' THEN 'Freemium' WHEN 'signup' THEN 'Quote-based' ELSE NULL END AS pricing_model,
       CAST(event_id % 4 AS INT) AS product_count FROM {events}""",
    "site_links": """
SELECT CAST(o_custkey % 50 AS INT) AS site_id, o_orderkey AS link_ord,
       concat('https://', CASE WHEN o_orderkey % 3 = 0 THEN 'WWW.' ELSE '' END, 'Site', CAST(o_custkey % 50 AS STRING), '.example.com',
         CASE o_orderkey % 16 WHEN 0 THEN '/privacy-policy' WHEN 1 THEN '/terms-of-service/' WHEN 2 THEN '/refund-policy#top' WHEN 3 THEN '/about-us' WHEN 4 THEN '/contact/'
           WHEN 5 THEN '/pricing' WHEN 6 THEN '/products/' WHEN 7 THEN '/solutions' WHEN 8 THEN '/faq' WHEN 9 THEN '/blog/privacy-policy-update' WHEN 10 THEN '/docs'
           WHEN 11 THEN '/brochure.pdf' WHEN 12 THEN '/shipping?utm=x&id=7' WHEN 13 THEN '/' WHEN 14 THEN '/idfy-story/' ELSE '/item?page=2&a=1&id=9' END) AS url,
       CASE o_orderkey % 5 WHEN 0 THEN 'Privacy Policy' WHEN 1 THEN 'terms' WHEN 2 THEN 'Our Story' WHEN 3 THEN 'products' ELSE '' END AS anchor,
       CASE WHEN o_orderkey % 7 = 0 THEN 404 WHEN o_orderkey % 11 = 0 THEN 403 ELSE 200 END AS status FROM {orders}""",
    "compliance_links": """
SELECT site_id, link_ord, concat('https://site', CAST(site_id AS STRING), '.example.com',
         CASE WHEN site_id % 4 = 1 THEN '/news' WHEN link_ord % 5 = 0 THEN '/privacy-policy' WHEN link_ord % 5 = 1 AND site_id % 3 <> 0 THEN '/terms-of-service/'
           WHEN link_ord % 5 = 2 AND site_id % 7 <> 0 THEN '/refund-policy' WHEN link_ord % 5 = 3 AND site_id % 2 = 0 THEN '/contact/' ELSE '/' END) AS url, '' AS anchor, 200 AS status
FROM (SELECT CAST(o_custkey % 50 AS INT) AS site_id, o_orderkey AS link_ord FROM {orders}) a""",
    "risk_pages": """
SELECT doc_id, CAST(doc_id % 40 AS INT) AS site_id, concat('https://site', CAST(doc_id % 40 AS STRING), '.example.com/p', CAST(doc_id AS STRING)) AS page_url,
       lower(concat(CASE doc_id % 12 WHEN 0 THEN 'Online casino and sports betting. ' WHEN 1 THEN 'Buy bitcoin with your crypto wallet. ' WHEN 2 THEN 'Lorem ipsum dolor sit amet. '
         WHEN 3 THEN 'Software platform with cloud api, subscription per month. ' WHEN 4 THEN 'Women dress fashion boutique, add to cart, checkout. '
         WHEN 5 THEN 'Banking and payments, credit card, insurance. ' WHEN 6 THEN 'Validator consensus mainnet whitepaper github. ' WHEN 7 THEN 'Hotel room booking, travel tour. '
         WHEN 8 THEN 'Online pharmacy with prescription drugs. ' WHEN 9 THEN 'Documentation and sdk, npm install. ' ELSE '' END, coalesce(text, ''))) AS page_text FROM {documents}""",
    "page_cache": """
SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'privacy_policy' WHEN 1 THEN 'about' WHEN 2 THEN 'home' ELSE 'other' END AS page_type, md5(html) AS content_hash, 200 AS status,
       CAST(TIMESTAMP '2024-01-30 00:00:00' AS TIMESTAMP) + (page_id * 997 % 86400) * INTERVAL '1' SECOND AS created_at FROM {pages}""",
    "seo_pages": """
SELECT page_id, url, replace(html, '<head>', concat('<head>',
         CASE page_id % 4 WHEN 0 THEN concat('<meta name="description" content="', repeat('d', CAST(100 + page_id % 70 AS INT)), '">') WHEN 1 THEN '<meta name="robots" content="NOINDEX, follow">' ELSE '' END,
         CASE WHEN page_id % 3 = 0 THEN concat('<link rel="canonical" href="', url, '">') ELSE '' END)) AS html,
       page_id % 2 = 0 AS sitemap_found, page_id % 5 <> 0 AS robots_txt_found FROM {pages}""",
    "crawl_sites": """
SELECT min(page_id) AS site_id, concat('https://', host, '/') AS url FROM (SELECT page_id, split_part(url, '/', 3) AS host FROM {pages}) a GROUP BY host""",
    "crawl_log": f"""
SELECT site_id, url, attempt, CAST(status AS INT) AS status, failure, CAST(NULL AS {{TEXT}}) AS final_url, content_type, body FROM (
  SELECT site_id, concat('https://', host, path) AS url, attempt,
         CASE k WHEN 0 THEN CASE attempt WHEN 0 THEN 503 ELSE 200 END WHEN 1 THEN NULL WHEN 2 THEN 404 ELSE 200 END AS status, CASE WHEN k = 1 THEN 'timeout' END AS failure, 'text/html; charset=utf-8' AS content_type,
         concat('<html><head><title>', title, '</title><link href=', path, ' rel=canonical></head><body><nav><a href=/deeper/', site_id, '>more</a></nav></body></html>') AS body
  FROM (SELECT h.*, p.*, (site_id + n) % 9 AS k FROM (SELECT min(page_id) AS site_id, host FROM (SELECT page_id, split_part(url, '/', 3) AS host FROM {{pages}}) a GROUP BY host) h,
        (VALUES (0, '/privacy-policy', 'Privacy policy'), (1, '/terms-of-service', 'Terms'), (2, '/about-us', 'About us'), (3, '/pricing', 'Pricing'), (4, '/products', 'Products'), (5, '/faq', 'FAQ'), (6, '/contact', 'Contact us'), (7, '/news/latest', 'News')) AS p(n, path, title)) x,
       (VALUES (0), (1)) AS t(attempt) WHERE attempt = 0 OR k < 2
  UNION ALL
  SELECT page_id, concat('https://', split_part(url, '/', 3), '/'), 0, 200, NULL, 'text/html',
         replace(html, '</body>', '<header class=site-nav><a href=/about-us>About us</a><a href="pricing">Pricing</a></header><footer><a href=/privacy-policy>Privacy Policy</a><a href=./terms-of-service>Terms of service</a><a href="/contact">Contact us</a><a href=/faq>FAQ</a></footer></body>')
  FROM {{pages}} WHERE page_id IN (SELECT min(page_id) FROM {{pages}} GROUP BY split_part(url, '/', 3))
  UNION ALL
  SELECT site_id, p.url, 0, 200, NULL, 'text/html', max(html) FROM (SELECT page_id, url, html, split_part(url, '/', 3) AS host FROM {{pages}}) p JOIN (SELECT min(page_id) AS site_id, host FROM (SELECT page_id, split_part(url, '/', 3) AS host FROM {{pages}}) a GROUP BY host) h ON h.host = p.host
  WHERE page_id % 3 <> 0 AND page_id <> site_id GROUP BY site_id, p.url
  UNION ALL
  SELECT site_id, concat('https://', host, CASE part WHEN 0 THEN '/robots.txt' WHEN 1 THEN '/maps.xml' WHEN 2 THEN '/map-1.xml' ELSE '/sitemap.xml' END), 0, 200, NULL, CASE part WHEN 0 THEN 'text/plain' ELSE 'application/xml' END,
         CASE part WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /t', chr(10), 'Allow: /terms', chr(10), CASE WHEN site_id % 4 < 2 THEN concat('Sitemap: https://', host, '/maps.xml') ELSE '' END)
           WHEN 1 THEN concat('<sitemapindex><sitemap><loc>https://', host, '/gone.xml</loc></sitemap><sitemap><loc>https://', host, '/map-1.xml</loc></sitemap></sitemapindex>')
           WHEN 2 THEN concat('<urlset><url><loc>', lo, '</loc></url><url><loc> ', hi, ' </loc></url><url><loc>https://', host, '/products</loc></url><url><loc>https://elsewhere.test/terms</loc></url></urlset>')
           ELSE concat('<urlset><url><loc>', hi, '</loc></url><url><loc>https://', host, '/news/latest</loc></url></urlset>') END
  FROM (SELECT min(page_id) AS site_id, host, min(url) AS lo, max(url) AS hi FROM (SELECT page_id, url, split_part(url, '/', 3) AS host FROM {{pages}}) a GROUP BY host) h, (VALUES (0), (1), (2), (3)) AS f(part)
  WHERE (part < 3 AND site_id % 2 = 0) OR (part = 3 AND site_id % 3 = 0)) y""".replace("{TEXT}", "VARCHAR(10)"),
    "mcc_codes": """
SELECT lpad(CAST(p_partkey * 37 % 10000 AS VARCHAR(9)), 4, '0') AS mcc, p_name AS description, p_partkey AS ord, p_partkey % 3 <> 0 AS active FROM {part}""",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in sf_dir; only the tables it names are opened."""
    text = VIEWS[name]
    return spark.sql(text, **{t: read_table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def cte(*names: str) -> str:
    """The views as common table expressions for the checks' SQL."""
    return ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)

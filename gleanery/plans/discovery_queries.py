"""Queries of urls, links and discovery."""

from pyspark.sql import functions as F

from gleanery.operators import discovery as op
from gleanery.plans.registry import query
from gleanery.sources.views import Views

HOST = r"lower(regexp_extract({}, '^(?:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)', 1, 'i'))"
CANON = rf"""cu AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS bare FROM urls),
cp AS (SELECT page_id, lower(regexp_extract(bare, '^(https?)://', 1, 'i')) AS scheme, regexp_replace({HOST.format('bare')}, '^www\.', '') AS host,
  regexp_extract(bare, '^https?://(?:\[[^\]]*\]|[^/?#:]+)(:\d+)', 1, 'i') AS port,
  regexp_replace(regexp_extract(bare, '^https?://[^/?#]+([^?]*)', 1, 'i'), '/+$', '') AS path,
  array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN
    ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src')),
    lambda p: {{'k': split_part(p, '=', 1), 'p': p || CASE WHEN contains(p, '=') THEN '' ELSE '=' END}})), lambda s: s.p), '&') AS params FROM cu),
ca AS (SELECT page_id, scheme || '://' || host || CASE WHEN scheme || port IN ('http:80', 'https:443') THEN '' ELSE port END || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN params = '' THEN '' ELSE '?' || params END AS canonical FROM cp WHERE scheme <> '' AND host <> '')"""


@query("h1_canonical_url_groups", f"WITH {CANON} SELECT canonical, min(page_id) AS page_id, count(*) AS n FROM ca GROUP BY 1")
def h1(v: Views):
    return op.canonical_url_groups(v.urls)


@query("h2_split_admissible", rf"""WITH h AS (SELECT url, {HOST.format('url')} AS host FROM urls),
a AS (SELECT *, CASE WHEN regexp_matches(host, '^\d+\.\d+\.\d+\.\d+$') THEN host ELSE regexp_extract(host, '^\[::ffff:(\d+\.\d+\.\d+\.\d+)\]$', 1) END AS ip FROM h),
o AS (SELECT *, TRY_CAST(split_part(ip, '.', 1) AS INT) AS a, TRY_CAST(split_part(ip, '.', 2) AS INT) AS b FROM a)
SELECT CASE WHEN NOT regexp_matches(url, '^https?://', 'i') THEN 'not http' WHEN host = '' THEN 'no host' WHEN host = 'localhost' OR regexp_matches(host, '\.(local|internal|localhost)$') THEN 'local'
  WHEN host IN ('[::]', '[::1]') OR regexp_matches(host, '^\[(f[cd]|fe[89ab])') OR a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127)
  THEN 'private address' ELSE 'admitted' END AS reason, count(*) AS n FROM o GROUP BY 1""")
def h2(v: Views):
    admitted, rejected = op.split_admissible(v.urls)
    return rejected.union(admitted.agg(F.lit("admitted").alias("reason"), F.count("*").alias("n")))


DOMAIN = """(CASE WHEN array_to_string(string_split({0}, '.')[-2:], '.') IN ('co.jp', 'or.jp', 'ne.jp', 'ac.jp', 'go.jp', 'co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'co.nz', 'com.br',
  'github.io', 'substack.com', 'wordpress.com', 'blogspot.com', 'hatenablog.com', 'hatenadiary.jp', 'ghost.io', 'netlify.app', 'vercel.app', 'pages.dev', 'bearblog.dev')
  THEN array_to_string(string_split({0}, '.')[-3:], '.') ELSE array_to_string(string_split({0}, '.')[-2:], '.') END)"""


@query("h3_domain_rollup", f"WITH h AS (SELECT {HOST.format('target_url')} AS host FROM links) SELECT {DOMAIN.format('host')} AS domain, count(*) AS pages, count(DISTINCT host) AS hosts FROM h GROUP BY 1")
def h3(v: Views):
    return op.domain_rollup(v.links.selectExpr("target_url as url"))


@query("h4_outbound_links", r"""WITH a AS (SELECT page_id, url AS source_url, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1, 'is')) AS href FROM pages)
SELECT page_id, source_url, regexp_extract(source_url, '^(https?://[^/?#]+)', 1, 'i') || href AS target_url, count(*) AS n FROM a WHERE href LIKE '/%' AND href NOT LIKE '//%' GROUP BY ALL""")
def h4(v: Views):
    return op.outbound_links(v.pages).groupBy("page_id", "source_url", "target_url").agg(F.count("*").alias("n"))


EVIDENCE = rf"""hl AS (SELECT {HOST.format('source_url')} AS from_host, {HOST.format('target_url')} AS host, target_url, page_id FROM links),
dl AS (SELECT *, CASE WHEN from_host <> '' THEN {DOMAIN.format('from_host')} END AS source, {DOMAIN.format('host')} AS domain FROM hl),
kn AS (SELECT DISTINCT {DOMAIN.format(HOST.format('url'))} AS domain FROM pages WHERE page_id % 50 = 0),
kl AS (SELECT * FROM dl WHERE source IS DISTINCT FROM domain AND domain NOT IN (SELECT domain FROM kn) AND domain NOT IN ('github.com', 'substack.com', 'medium.com')),
mh AS (SELECT domain, host, site FROM (SELECT domain, host, count(*) AS n, arg_min(regexp_extract(target_url, '^(https?://[^/?#]+)', 1), {{'p': page_id, 't': target_url}}) AS site FROM kl GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY host NOT LIKE 'blog.%', n DESC, length(host), host) = 1),
ev AS (SELECT kl.domain, count(DISTINCT source) AS sources, count(*) AS links, bool_or(kl.host LIKE 'blog.%') AS blog_host,
  bool_or(regexp_matches(lower(regexp_extract(target_url, '^https?://[^/?#]+([^?#]*)', 1)), '/(blog|posts?|writing|articles?|notes?|essays?)\b|/(19|20)\d\d/')) AS blog_path,
  min(page_id) AS origin, any_value(mh.host) AS main_host, any_value(mh.site) AS site FROM kl JOIN mh ON mh.domain = kl.domain GROUP BY 1),
gs AS (SELECT *, CAST(blog_host::INT + blog_path::INT + CASE WHEN regexp_matches(domain, '(^|\.)(github\.io|substack\.com|wordpress\.com|blogspot\.com|hatenablog\.com|hatenadiary\.jp|ghost\.io|bearblog\.dev|medium\.com|dev\.to|zenn\.dev|qiita\.com|note\.com|svbtle\.com|posthaven\.com)$') THEN 2 ELSE 0 END AS INT) AS blog_score FROM ev),
ga AS (SELECT *, sources >= 1 AND (sources >= 2 OR blog_score >= 2) AS passes FROM gs)"""


def evidence(v: Views):
    known = v.pages.where("page_id % 50 = 0").select(op.registrable(op.host_of(F.col("url"))).alias("domain"))
    return op.domain_evidence(v.links, known)


@query("h5_domain_evidence", f"WITH {EVIDENCE} SELECT * FROM ev")
def h5(v: Views):
    return evidence(v)


@query("h6_gate_domains", f"""WITH {EVIDENCE} SELECT count(*) AS examined, count(*) FILTER (passes) AS passed, count(*) FILTER (sources = 0) AS no_source, count(*) FILTER (NOT passes AND sources > 0) AS low_signal, count(*) FILTER (passes AND sources < 2) AS blog_escapes,
  count(*) FILTER (NOT passes AND sources > 0 AND blog_score = 0) AS low_signal_score_0, count(*) FILTER (NOT passes AND sources > 0 AND blog_score = 1) AS low_signal_score_1 FROM ga""")
def h6(v: Views):
    return op.gate_stats(op.gate_domains(evidence(v)))


@query("h7_rank_sites", f"""WITH {EVIDENCE} SELECT domain, site, 3 * sources + blog_score AS rank_score, concat('article-links:', sources, 'src') AS discovered_from FROM ga WHERE passes
ORDER BY rank_score DESC, sources DESC, domain LIMIT 40""")
def h7(v: Views):
    return op.rank_sites(op.gate_domains(evidence(v)))


#: Feeds found on pages: several of a domain, some of them under one url.
FOUND = f"""SELECT {{domain}} AS domain, concat('https://f', CAST(page_id % 90 AS STRING), '.example.org/feed') AS url, page_id AS pos FROM {{pages}}"""
SPARK_DOMAIN = "concat('d', CAST((page_id - page_id % 3) % 240 AS STRING))"
LANDED = f"""WITH f AS ({FOUND.format(domain=SPARK_DOMAIN, pages='pages')}), k AS (SELECT *, TRY_CAST(substr(domain, 2) AS INT) AS d, TRY_CAST(regexp_extract(url, 'f(\\d+)\\.', 1) AS INT) AS u FROM f),
o AS (SELECT *, d % 5 = 0 AS is_feed, d % 7 = 0 AS is_candidate, row_number() OVER (PARTITION BY domain ORDER BY pos, url) = 1 AS first FROM k),
n AS (SELECT *, NOT is_feed AND NOT is_candidate AND first AS new FROM o),
m AS (SELECT domain, url, pos, CASE WHEN is_feed THEN 'existing' WHEN NOT new THEN 'candidate' WHEN u % 11 = 0 OR row_number() OVER (PARTITION BY url, new ORDER BY pos, domain) > 1 THEN 'same url' ELSE 'inserted' END AS outcome FROM n)"""


def landed(v: Views):
    found = v.sql(FOUND.format(domain=SPARK_DOMAIN, pages="{pages}"))
    d, u = F.substring("domain", 2, 9).cast("int"), F.regexp_extract("url", r"f(\d+)\.", 1).cast("int")
    feeds = found.where(d % 5 == 0).select("domain")
    candidates = found.where(d % 7 == 0).select("domain", F.lit("https://old.example.org/feed").alias("url"))
    candidates = candidates.union(found.where(u % 11 == 0).select(F.concat(F.lit("old-"), "domain"), "url"))
    return op.land_discovered(found, feeds, candidates)


@query("h8_land_discovered", f"{LANDED} SELECT domain, url, pos, outcome, CASE WHEN outcome = 'inserted' THEN -0.3::DOUBLE END AS credibility FROM m")
def h8(v: Views):
    return landed(v)


@query("h8_landing_counts", f"{LANDED} SELECT count(*) AS discovered, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'existing') AS skipped_existing, count(*) FILTER (outcome = 'candidate') AS skipped_candidate FROM m")
def h8_counts(v: Views):
    return op.landing_counts(landed(v))


@query("h9_feed_links", """SELECT page_id, i - 1 AS pos, regexp_extract(url, '^(https?://[^/?#]+)', 1, 'i') || (['/feed', '/feed/', '/rss', '/rss.xml', '/feed.xml', '/atom.xml', '/index.xml', '/rss/', '/feed/atom', '/blog/feed', '/blog/rss', '/feeds/posts/default', '/?feed=rss2'])[i] AS feed_url
FROM pages CROSS JOIN (SELECT unnest(range(1, 14)) AS i)""")
def h9(v: Views):
    return op.feed_links(v.pages).withColumn("pos", F.col("pos").cast("long"))


#: Hits of themes: pages whose html has the theme's word, with urls that are none among them; what was selected of them, or not of them.
HITS = """SELECT concat('t', CAST(k AS STRING)) AS theme, k AS theme_pos, CASE WHEN page_id % 9 = 0 THEN concat(url, ' x') WHEN page_id % 10 = 0 THEN concat('ftp', substr(url, 5)) ELSE url END AS url, page_id
FROM {pages} JOIN (SELECT 0 AS k, 'the' AS word UNION ALL SELECT 1, 'and' UNION ALL SELECT 2, 'of' UNION ALL SELECT 3, 'is') w ON contains(lower(html), concat(' ', word, ' '))"""


@query("h10_merge_search_hits", f"""WITH h AS ({HITS.replace('{pages}', 'pages')}), s AS (SELECT theme, theme_pos, url FROM h WHERE page_id % 3 <> 0 UNION ALL SELECT 't0', 0, url FROM h WHERE theme = 't3' AND page_id % 5 = 0)
SELECT arg_min(s.theme, s.theme_pos) AS theme, s.url FROM s WHERE EXISTS (SELECT 1 FROM h WHERE h.theme = s.theme AND h.url = s.url) AND regexp_matches(s.url, '^https?://') AND NOT regexp_matches(s.url, '\\s') GROUP BY s.url""")
def h10(v: Views):
    hits = v.sql(HITS)
    selected = hits.where("page_id % 3 <> 0").select("theme", "theme_pos", "url")
    selected = selected.union(hits.where("theme = 't3' and page_id % 5 = 0").select(F.lit("t0"), F.lit(0), "url"))
    return op.merge_search_hits(hits.select("theme", "url"), selected)


def plain(html: str) -> str:
    """SQL of the text of HTML."""
    bare = f"regexp_replace(regexp_replace(regexp_replace({html}, '<script.*?</script>|<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '&nbsp;', ' ', 'gi')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({bare}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query("g19_validate_learn_sources", rf"""WITH {CANON},
p AS (SELECT page_id % 40 AS batch, page_id AS pos, canonical AS key, length({plain('html')}) AS chars,
  length({plain(r"array_to_string(regexp_extract_all(html, '<a\s[^>]*>(.*?)</a>', 1, 'is'), ' ')")}) AS inside FROM pages LEFT JOIN ca USING (page_id)),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY batch ORDER BY pos) <= 5),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) > 1 AS again FROM f)
SELECT batch, pos, key, CASE WHEN key IS NULL THEN 'invalid' WHEN key IN (SELECT canonical FROM ca WHERE page_id % 8 = 0) OR again THEN 'known' WHEN chars < 1500 THEN 'short' WHEN inside / greatest(chars, 1) > 0.02 THEN 'links' ELSE 'inserted' END AS outcome FROM a""")
def g19(v: Views):
    """Proposed urls of many forms, invalid ones too, with the pages they lead to."""
    proposals = v.urls.join(v.pages.select("page_id", "html"), "page_id").selectExpr("page_id % 40 as batch", "page_id as pos", "url", "html")
    known = v.urls.where("page_id % 8 = 0").select(op.canonical_url(F.col("url")).alias("key"))
    return op.validate_learn_sources(proposals, known, chars=1500, ratio=0.02)

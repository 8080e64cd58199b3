"""URLs, the link graph and discovery of new sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.operators.landing import plain_text
from gleanery.sources.shared import written

# Fixed values.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "ref_src")
FEED_PATHS = (
    "/feed", "/feed/", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/index.xml", "/rss/", "/feed/atom", "/blog/feed", "/blog/rss",
    "/feeds/posts/default", "/?feed=rss2",
)
SUFFIXES = (
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.nz", "com.br",
    "github.io", "substack.com", "wordpress.com", "blogspot.com", "hatenablog.com", "hatenadiary.jp", "ghost.io", "netlify.app", "vercel.app",
    "pages.dev", "bearblog.dev",
)
BLOG_PLATFORMS = (
    "github.io", "substack.com", "wordpress.com", "blogspot.com", "hatenablog.com", "hatenadiary.jp", "ghost.io", "bearblog.dev",
    "medium.com", "dev.to", "zenn.dev", "qiita.com", "note.com", "svbtle.com", "posthaven.com",
)
BLOCKED_DOMAINS = (
    "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "reddit.com", "youtube.com", "youtu.be", "t.me", "bsky.app",
    "threads.net", "news.ycombinator.com", "producthunt.com",
    "github.com", "gitlab.com", "bitbucket.org", "npmjs.com", "pypi.org", "crates.io", "rubygems.org", "packagist.org", "stackoverflow.com",
    "stackexchange.com",
    "wikipedia.org", "developer.mozilla.org", "w3.org", "readthedocs.io", "gitbook.io",
    "arxiv.org", "doi.org", "semanticscholar.org",
    "amazonaws.com", "cloudfront.net", "googleapis.com", "gstatic.com", "googleusercontent.com", "gravatar.com", "imgur.com", "wp.com",
    "substackcdn.com", "bit.ly", "t.co", "goo.gl", "buff.ly", "dlvr.it", "amzn.to", "feedburner.com", "web.archive.org", "archive.org",
    "substack.com", "medium.com",
    "google.com", "apple.com", "microsoft.com", "amazon.com", "amazon.co.jp", "notion.so", "figma.com", "slack.com",
)
BLOG_PATH = r"(?i)/(blog|posts?|writing|articles?|notes?|essays?)\b|/(19|20)\d\d/"


def host_of(url: Column) -> Column:
    """The host in lower case, with brackets if it is an IPv6 address; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?i:https?)://[^/?#]+([^?#]*)", 1)


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^((?i:https?)://[^/?#]+)", 1)


def canonical_url(url: Column) -> Column:
    """Scheme, host in lower case without one www., no default port, path without trailing slashes,
    parameters without tracking and in order of names; no fragment. Null if not http(s)."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^(?i)(https?)://", 1))
    user = F.regexp_extract(bare, r"^(?i:https?)://([^/?#@]*@)", 1)
    host = F.regexp_replace(host_of(bare), r"^www\.", "")
    port = F.regexp_extract(bare, r"^(?i:https?)://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]+)(:\d+)", 1)
    port = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
    path = F.regexp_replace(path_of(bare), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING))
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), p.alias("p"))))
    params = F.array_join(F.transform(keyed, lambda s: F.when(s["p"].contains("="), s["p"]).otherwise(F.concat(s["p"], F.lit("=")))), "&")
    made = F.concat(scheme, F.lit("://"), user, host, port, F.when(path == "", "/").otherwise(path), F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)))
    return F.when((scheme != "") & (host != ""), made)


def canonical_url_groups(pages: DataFrame) -> DataFrame:
    """Pages by canonical url: the first by page_id, and how many there are."""
    keyed = pages.select("page_id", canonical_url(F.col("url")).alias("canonical")).where("canonical is not null")
    return keyed.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def rejection(url: Column, reserved: bool = False) -> Column:
    """Why a url must not be fetched: not http, no host, local, or a private address (also one that an
    IPv6 address wraps). With `reserved`, multicast and reserved IPv4 addresses too."""
    host = host_of(url)

    def private(a: Column, b: Column) -> Column:
        inside = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
        return inside | (a >= 224) if reserved else inside

    octet = lambda h, k: F.split_part(h, F.lit("."), F.lit(k)).try_cast("int")
    is_v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    v6 = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    wrapped = F.regexp_extract(v6, r"^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    leading = F.conv(F.regexp_extract(v6, r"^::ffff:([0-9a-f]{1,4}):[0-9a-f]{1,4}$", 1), 16, 10).try_cast("int")
    private6 = (
        v6.isin("::", "::1") | v6.rlike(r"^f[cd]|^fe[89ab]") | ((wrapped != "") & private(octet(wrapped, 1), octet(wrapped, 2)))
        | F.coalesce(private(F.shiftright(leading, 8), leading.bitwiseAND(255)), F.lit(False))
    )
    return (
        F.when(~url.rlike(r"^(?i)https?://"), "not http").when((v6 != "") & private6, "private address").when(v6 != "", None).when(host == "", "no host")
        .when((host == "localhost") | host.rlike(r"\.(local|internal|localhost)$"), "local").when(is_v4 & private(octet(host, 1), octet(host, 2)), "private address")
    )


def split_admissible(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted rows, and counts of rejected ones by reason."""
    marked = pages.withColumn("reason", rejection(F.col("url")))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def registrable(host: Column) -> Column:
    """The last two labels of a host, three where those two are a suffix under which owners differ."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(n)), F.lit(n)), ".")
    return F.when(last(2).isin(*SUFFIXES), last(3)).otherwise(last(2))


def domain_rollup(pages: DataFrame) -> DataFrame:
    rows = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").withColumn("domain", registrable(F.col("host")))
    return rows.groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


def resolve(href: Column, base: Column) -> Column:
    """An absolute url of a link; null for fragments and other schemes."""
    origin = origin_of(base)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^(?i)https?://"), href).when(href.startswith("#") | (href == ""), None).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^((?i:https?):)", 1), href)).when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )


def outbound_links(pages: DataFrame) -> DataFrame:
    """(page_id, source_url, target_url, pos) of quoted hrefs of anchors."""
    hrefs = F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)).alias("pos", "href")
    rows = pages.select("page_id", F.col("url").alias("source_url"), hrefs).withColumn("target_url", resolve(F.col("href"), F.col("source_url")))
    return rows.where("target_url is not null").select("page_id", "source_url", "target_url", "pos")


def domain_evidence(links: DataFrame, known: DataFrame) -> DataFrame:
    """Per linked domain that is neither blocked, known, nor the source's own: distinct source domains,
    links, whether a host or path looks like a blog, its main host (blog. first, then most linked,
    shorter, by name) and that host's first origin. A source without a url counts as a link only."""
    from_host = host_of(F.col("source_url"))
    rows = links.select(
        F.when(from_host != "", registrable(from_host)).alias("source"), host_of(F.col("target_url")).alias("host"), "target_url", "page_id"
    ).where("host <> ''").withColumn("domain", registrable(F.col("host")))
    rows = written(rows)  # both counts below read it, instead of the urls again
    rows = rows.where(~F.col("domain").isin(*BLOCKED_DOMAINS) & ~F.col("source").eqNullSafe(F.col("domain")))
    rows = rows.join(known.select("domain").distinct(), "domain", "left_anti")
    hosts = rows.groupBy("domain", "host").agg(
        F.count("*").alias("n"), F.bool_or(path_of(F.col("target_url")).rlike(BLOG_PATH)).alias("path"),
        F.min(F.struct("page_id", "target_url")).alias("first"),
    )
    order = F.struct((~F.col("host").startswith("blog.")).alias("x"), -F.col("n"), F.length("host"), F.col("host"))
    sources = rows.where("source is not null").select("domain", "source").distinct().groupBy("domain").agg(F.count("*").alias("sources"))
    out = hosts.groupBy("domain").agg(
        F.sum("n").alias("links"),
        F.bool_or(F.col("host").startswith("blog.")).alias("blog_host"), F.bool_or("path").alias("blog_path"),
        F.min("first.page_id").alias("origin"), F.min_by("host", order).alias("main_host"), F.min_by(origin_of(F.col("first.target_url")), order).alias("site"),
    )
    return out.join(sources, "domain", "left").na.fill(0, ["sources"])


def gate_domains(evidence: DataFrame) -> DataFrame:
    """blog_score (platform 2, blog host 1, blog path 1) and whether a domain passes: two sources, or
    one and a score of two."""
    platform = F.lit(False)
    for p in BLOG_PLATFORMS:
        platform |= (F.col("domain") == p) | F.col("domain").endswith("." + p)
    score = F.when(platform, 2).otherwise(0) + F.col("blog_host").cast("int") + F.col("blog_path").cast("int")
    return evidence.withColumn("blog_score", score).withColumn("passes", (F.col("sources") >= 1) & ((F.col("sources") >= 2) | (F.col("blog_score") >= 2)))


def gate_stats(gated: DataFrame) -> DataFrame:
    dropped = ~F.col("passes") & (F.col("sources") > 0)
    return gated.agg(
        F.count("*").alias("examined"), F.count_if("passes").alias("passed"), F.count_if(F.col("sources") == 0).alias("no_source"),
        F.count_if(dropped).alias("low_signal"), F.count_if(F.col("passes") & (F.col("sources") < 2)).alias("blog_escapes"),
        *(F.count_if(dropped & (F.col("blog_score") == k)).alias(f"low_signal_score_{k}") for k in (0, 1)),
    )


def rank_sites(gated: DataFrame, k: int = K.DISCOVERY_SITES) -> DataFrame:
    """The k best passing domains by 3 x sources + blog score, then sources, then name."""
    rows = gated.where("passes").withColumn("rank_score", 3 * F.col("sources") + F.col("blog_score"))
    best = rows.orderBy(F.desc("rank_score"), F.desc("sources"), "domain").limit(k)
    return best.select("domain", "site", "rank_score", F.concat(F.lit("article-links:"), F.col("sources").cast("string"), F.lit("src")).alias("discovered_from"))


def land_discovered(found: DataFrame, feeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """outcome of every discovered feed (domain, url, pos): existing (a feed has its domain), candidate
    (a candidate has it, or an earlier one of the batch), same url (a candidate or an earlier
    insert has it), or inserted, pending."""
    first = F.row_number().over(Window.partitionBy("domain").orderBy("pos", "url")) == 1
    marked = found.withColumn("first", first).join(feeds.select("domain", F.lit(True).alias("is_feed")).distinct(), "domain", "left")
    marked = marked.join(candidates.select("domain", F.lit(True).alias("is_candidate")).distinct(), "domain", "left")
    new = F.col("is_feed").isNull() & F.col("is_candidate").isNull() & F.col("first")
    marked = marked.withColumn("new", new).join(candidates.select("url", F.lit(True).alias("url_known")).distinct(), "url", "left")
    taken = F.col("url_known").isNotNull() | (F.row_number().over(Window.partitionBy("url", "new").orderBy("pos", "domain")) > 1)
    outcome = F.when(F.col("is_feed"), "existing").when(~F.col("new"), "candidate").when(taken, "same url").otherwise("inserted")
    return marked.select("domain", "url", "pos", outcome.alias("outcome")).withColumn("credibility", F.when(F.col("outcome") == "inserted", K.CANDIDATE_CREDIBILITY))


def landing_counts(landed: DataFrame) -> DataFrame:
    """How many feeds were discovered, inserted, and skipped for a feed or a candidate of their domain."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return landed.agg(
        F.count("*").alias("discovered"), count("inserted").alias("inserted"), count("existing").alias("skipped_existing"), count("candidate").alias("skipped_candidate")
    )


def feed_links(pages: DataFrame) -> DataFrame:
    """Ordered feed candidates of each page's site: those that the page links, then conventional paths;
    admissible ones, once."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<link\b[^>]*>)"), 1)
    linked = F.filter(tags, lambda t: t.rlike(r"""(?is)rel\s*=\s*["']?[^"'>]*\balternate\b""") & t.rlike(r"""(?is)type\s*=\s*["']?application/(rss|atom)\+xml"""))
    origin = origin_of(F.col("url"))
    found = F.transform(linked, lambda t: resolve(F.regexp_extract(t, r"""(?is)href\s*=\s*["']([^"']+)["']""", 1), origin))
    usual = F.transform(F.array(*[F.lit(p) for p in FEED_PATHS]), lambda p: F.concat(origin, p))
    rows = pages.select("page_id", F.posexplode(F.array_distinct(F.concat(F.array_compact(found), usual))).alias("pos", "feed_url"))
    return rows.where(rejection(F.col("feed_url")).isNull())


def merge_search_hits(hits: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected urls (theme_pos, theme, url) that are hits of their theme; of one url the first theme wins."""
    fine = hits.where(F.col("url").rlike(r"^(?i)https?://[^\s\x00-\x1f]+$")).select("theme", "url").distinct()
    rows = selected.join(fine, ["theme", "url"], "left_semi")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("theme_pos"))).where("n = 1").select("theme", "url")


def link_text_ratio(html: Column) -> Column:
    """Length of the text in anchors as a share of all text."""
    inside = plain_text(F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>(.*?)</a>"), 1), " "))
    return F.length(inside) / F.greatest(F.length(plain_text(html)), F.lit(1))


def validate_learn_sources(proposals: DataFrame, known: DataFrame, chars: int = K.SOURCE_CHARS, ratio: float = K.SOURCE_LINK_RATIO, most: int = 5) -> DataFrame:
    """outcome of proposals (batch, pos, url, html): the first `most` of a batch with a new canonical
    url, enough text and few links are inserted."""
    rows = proposals.withColumns({"key": canonical_url(F.col("url")), "chars": F.length(plain_text(F.col("html"))), "ratio": link_text_ratio(F.col("html"))})
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("pos"))).where(F.col("place") <= most)
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("key").orderBy("pos")) > 1)
    rows = rows.join(known.select(F.col("key"), F.lit(True).alias("is_known")).distinct(), "key", "left")
    outcome = F.when(F.col("key").isNull(), "invalid").when(F.col("is_known") | F.col("again"), "known").when(F.col("chars") < chars, "short").when(F.col("ratio") > ratio, "links").otherwise("inserted")
    return rows.select("batch", "pos", "key", outcome.alias("outcome"))

"""Analysis of crawled pages. HTML is parsed once with the standard parser; everything after that is native."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.common import contains, edges, matches, true
from lodestar.operators.rules import match_rules

PARSED = "title string, headings array<string>, text string, links array<struct<href:string,text:string,context:string,in_nav:boolean>>, ol_items array<string>"
SKIPPED = frozenset(("script", "style", "nav", "footer", "header", "aside"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title, self.headings, self.text, self.links, self.items = [], [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.stack.append(tag)
        if tag in ("h1", "h2", "h3"):
            self.headings.append([])
        elif tag == "li" and "ol" in self.stack:
            self.items.append([])
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.links.append([href, [], " ".join(self.text[-3:])[-80:], any(t in ("nav", "header", "footer") for t in self.stack)])

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        data = " ".join(data.split())
        if not data or self.stack and self.stack[-1] in ("script", "style"):
            return
        if "title" in self.stack:
            self.title.append(data)
            return
        for tags, into in ((("h1", "h2", "h3"), self.headings), (("li",), self.items)):
            if into and any(t in self.stack for t in tags):
                into[-1].append(data)
        if self.links and "a" in self.stack:
            self.links[-1][1].append(data)
        if not SKIPPED.intersection(self.stack):
            self.text.append(data)


def parse_page(html: str | None) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.close()
    links = [{"href": h, "text": " ".join(t), "context": c, "in_nav": n} for h, t, c, n in page.links]
    return " ".join(page.title), [" ".join(h) for h in page.headings], " ".join(page.text), links, [" ".join(x) for x in page.items if x]


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, headings, text, links and the items of ordered lists."""

    @F.pandas_udf(PARSED)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(t) for t in texts], columns=["title", "headings", "text", "links", "ol_items"])

    return pages.withColumn("_p", parsed(F.col(html))).select(*pages.columns, "_p.*")


def html_text(pages: DataFrame, html: str = "html", size: int = 10_000) -> DataFrame:
    """Adds the visible text without menus, headers, footers and asides, cut at ``size`` characters."""
    return parse_pages(pages, html).withColumn("text", F.substring("text", 1, size)).drop("title", "headings", "links", "ol_items")


def classify_pages(pages: DataFrame, patterns: DataFrame, least: float = 0.2, valuable: float = 0.25, key: str = "page_id") -> DataFrame:
    """(page_id, page_type, confidence, is_valuable) from a pattern table (page_type, kind url | heading | keyword, pattern).

    A url pattern adds .4, a heading pattern .3, each of up to three keywords .15, being the homepage .5 to the type ``home``.
    """
    heads = F.concat_ws(" ", "title", F.array_join("headings", " "))
    rules = patterns.withColumn("_rule", F.struct("page_type", "kind", "pattern"))
    subjects = {"url": F.col("url"), "heading": heads, "keyword": F.col("text")}
    hit = match_rules(pages, key, subjects, rules, "_rule", "kind").select(key, "_rule.page_type", "_rule.kind")
    n = lambda kind: F.count_if(F.col("kind") == kind)
    score = F.when(n("url") > 0, 0.4).otherwise(0.0) + F.when(n("heading") > 0, 0.3).otherwise(0.0) + 0.15 * F.least(n("keyword"), F.lit(3))
    scores = hit.groupBy(key, "page_type").agg(F.round(score, 4).alias("s"))
    home = pages.where(F.regexp_like("url", F.lit(r"^[a-z]+://[^/?#]+/?$"))).select(key, F.lit("home").alias("page_type"), F.lit(0.5).alias("s"))
    best = scores.unionByName(home).groupBy(key, "page_type").agg(F.sum("s").alias("s")).groupBy(key).agg(F.max_by(F.struct("page_type", "s"), F.struct("s", "page_type")).alias("_b"))
    j = pages.select(key).join(best, key, "left")
    sure = true(F.col("_b.s") >= least)
    return j.select(key, F.when(sure, F.col("_b.page_type")).otherwise("unknown").alias("page_type"), F.round(F.coalesce("_b.s", F.lit(0.0)), 4).alias("confidence"), (sure & true(F.col("_b.s") >= valuable)).alias("is_valuable"))


def normalise_url(c: str | Column) -> Column:
    """With a scheme, without query, fragment and closing slash."""
    u = F.trim(F.col(c) if isinstance(c, str) else c)
    u = F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), "/+$", "")


def url_host(c: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"^[^:]+://([^/?#]+)", 1))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute address of a link on a page."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*):", 1), F.regexp_extract(base, r"^([^:]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([^:]+://[^/]+(?:/.*)?/)[^/]*$", 1)
    folder = F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder)
    return F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href)).when(href.startswith("#") | (href == ""), base).otherwise(F.concat(folder, href))


def prioritise_links(pages: DataFrame, text_rules: list[tuple[str, float]], url_rules: list[tuple[str, float]], context_rules: list[tuple[str, float]] = (), skip: str = r"\.(pdf|jpe?g|png|gif|zip|docx?|xlsx?)($|\?)|mailto:|tel:|javascript:|/(login|cart|wp-admin)\b", most: int = 15, least: float = 0.2, key: str = "page_id") -> DataFrame:
    """Best links of each page: same host, not skipped, the best priority per address, at most ``most`` of at least ``least``."""
    flat = pages.select(key, "url", F.explode("links").alias("l")).select(key, F.col("url").alias("_page"), "l.*")
    flat = flat.withColumn("link", resolve_link(F.col("_page"), F.trim("href"))).where(~matches(F.col("link"), skip) & (url_host("link") == url_host("_page")))
    flat = flat.withColumn("link", normalise_url("link")).where(F.col("link") != normalise_url("_page"))

    def best(c: Column, rules) -> Column:
        return F.greatest(F.lit(0.0), F.lit(-1.0), *(F.when(matches(c, p), float(w)).otherwise(0.0) for p, w in rules))

    score = F.greatest(best(F.col("text"), text_rules), best(F.col("link"), url_rules), best(F.col("context"), context_rules))
    score = score + F.when(F.col("in_nav") & (score > 0), 0.1).otherwise(0.0)
    one = flat.groupBy(key, "link").agg(F.round(F.max(score), 4).alias("priority")).where(F.col("priority") >= least)
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), "link"))).where(F.col("rank") <= most)


def extract_contacts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds distinct sorted phones, emails, hours and addresses of a text, without junk."""
    c = F.coalesce(F.col(text), F.lit(""))

    def found(pattern: str) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(edges(pattern)), F.lit(0))))

    emails = F.transform(found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lower)
    emails = F.filter(F.array_sort(F.array_distinct(emails)), lambda e: ~e.rlike(r"(?i)(example\.|\.png$|\.jpg$|sentry|noreply|no-reply)"))
    return df.withColumns({
        "phones": found(r"\(?\b\d{3}\)?[-. ]\d{3}[-.]\d{4}\b"),
        "emails": emails,
        "hours": found(r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s*(?:-|–|to)\s*(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*:?\s*\d{1,2}(?::\d{2})?\s*(?:am|pm)?\s*(?:-|–|to)\s*\d{1,2}(?::\d{2})?\s*(?:am|pm)?"),
        "addresses": found(r"\b\d{1,5}\s+(?:[A-Z0-9][\w.]*\s+){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Way|Lane|Court)\b"),
    })


def description_lines(text: str | Column, least: int = 50, most: int = 5, junk: str = r"(?i)(cookie|copyright|all rights reserved|privacy policy|javascript|skip to)") -> Column:
    """The first lines of more than ``least`` characters that say something."""
    lines = F.transform(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\n+"), lambda x: F.trim(x))
    return F.slice(F.filter(lines, lambda x: (F.length(x) > least) & ~x.rlike(junk)), 1, most)


def _first_number(c: Column, patterns: list[str], group: int) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, group), F.lit("")).cast("int") for p in patterns))


AGES = [r"(?i)\bages?\s+(\d{1,2})\s*(?:-|–|to)\s*(\d{1,3})\b", r"(?i)\b(\d{1,2})\s*(?:-|–|to)\s*(\d{1,3})\s+years?\b", r"(?i)\b(\d{1,2})\+()", r"(?i)\b(\d{1,2})\s+(?:years\s+)?(?:and|or)\s+(?:older|over)()", r"(?i)\bover\s+(\d{1,2})()\b", r"(?i)\bunder()\s+(\d{1,2})\b"]


def extract_eligibility(df: DataFrame, populations: list[tuple[str, str]], exclusions: list[tuple[str, str]], languages: list[str], text: str = "text") -> DataFrame:
    """Adds age_min, age_max, gender, residency, income_tested, populations, exclusions, languages."""
    c = F.coalesce(F.col(text), F.lit(""))
    pick = lambda rules: F.array_compact(F.array(*(F.when(matches(c, p), n) for n, p in rules)))
    return df.withColumns({
        "age_min": _first_number(c, AGES, 1),
        "age_max": _first_number(c, AGES, 2),
        "gender": F.when(matches(c, r"\b(women|female)[- ]only\b|\bfor women\b"), "women").when(matches(c, r"\b(men|male)[- ]only\b|\bfor men\b"), "men"),
        "residency": F.nullif(F.regexp_extract(c, r"(?i)\bresidents? of ((?:the )?[\p{L} ]{3,40}?)(?=[.,;]|$|\s+(?:who|and|aged|with)\b)", 1), F.lit("")),
        "income_tested": matches(c, r"\b(low[- ]income|income (limit|test|threshold)|financial need)\b"),
        "populations": pick(populations),
        "exclusions": pick(exclusions),
        "languages": pick([(x, rf"\b{x}\b") for x in languages]),
    })


def extract_intake(df: DataFrame, documents: list[tuple[str, str]], text: str = "text", ol_items: str = "ol_items", most: int = 3) -> DataFrame:
    """Adds up to three phones, whether referral, walk-in, appointment or online intake is named, documents, and steps.

    Self-referral overrides a needed referral. Steps are the items of an ordered list, else sentences that count or order steps.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    own = matches(c, r"\bself[- ]refer\w*")
    said = F.regexp_extract_all(c, F.lit(r"(?i)(?:\bstep\s*\d+\s*[:.)-]\s*|(?<!\d)\d\.\s+|\b(?:first|then|next|finally),?\s+)([^.\n]{5,200})"), F.lit(1))
    return df.withColumns({
        "phones": F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(edges(r"\(?\b\d{3}\)?[-. ]\d{3}[-.]\d{4}\b")), F.lit(0))), 1, most),
        "needs_referral": matches(c, r"\breferral\b") & ~own & ~matches(c, r"\bno referral\b"),
        "walk_in": matches(c, r"\b(walk|drop)[- ]?in\b"),
        "appointment": matches(c, r"\b(by )?appointment\b"),
        "online": matches(c, r"\b(apply|register|intake|application) online\b|\bonline (application|intake|form)\b"),
        "documents": F.array_compact(F.array(*(F.when(matches(c, p), n) for n, p in documents))),
        "steps": F.when(F.size(ol_items) > 0, F.col(ol_items)).otherwise(F.transform(said, lambda x: F.trim(x))),
    })


def site_rollup(pages: DataFrame, site: str = "site", intake: str = "intake", most: int = 5, size: int = 15_000) -> DataFrame:
    """Per site: pages, valuable pages, pages per type, mean confidence, best intake page, text of the best few pages."""
    order = F.struct((-F.col("confidence")).alias("c"), F.col("page_id").alias("p"), F.col("text").alias("t"))
    best = pages.where("is_valuable").withColumn("_k", F.row_number().over(Window.partitionBy(site).orderBy(F.desc("confidence"), "page_id"))).where(F.col("_k") <= most)
    texts = best.groupBy(site).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), "\n\n"), 1, size).alias("site_text"))
    types = pages.groupBy(site, "page_type").agg(F.count("*").alias("n")).groupBy(site).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_type", "n")))).alias("types"))
    stats = pages.groupBy(site).agg(
        F.count("*").alias("pages"),
        F.count_if("is_valuable").alias("valuable"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.max_by(F.when(F.col("page_type") == intake, F.col("url")), F.when(F.col("page_type") == intake, F.struct("confidence", -F.col("page_id")))).alias("intake_url"),
    )
    return stats.join(types, site, "left").join(texts, site, "left")


def extract_listings(pages: DataFrame, rules: dict[str, str], cities: list[str], region: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """(page_id, name, description, phone, link, location) of repeated blocks. rules: block, name, and further regexes with one group.

    A block without a name is left out; the location is the first city that its text names, else the region.
    """
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(f"(?is){rules['block']}"), F.lit(1))).alias("block_no", "_b"))

    def part(name: str) -> Column:
        if name not in rules:
            return F.lit(None).cast("string")
        raw = F.regexp_extract("_b", f"(?is){rules[name]}", 1)
        return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))

    where = F.coalesce(*(F.when(contains("_b", c), c) for c in cities), F.lit(region))
    out = blocks.select(key, "block_no", *(part(n).alias(n) for n in ("name", "description", "phone", "link")), where.alias("location"))
    return out.where("name IS NOT NULL")


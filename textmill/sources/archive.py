"""The archive's calendar and its pages; a caller's function makes the requests."""

import time
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED_TAGS, DROPPED_CLASSES = {"nav", "footer", "script", "style"}, {"advertisement", "pagination"}


def days(spark: SparkSession, start: str = "2017-01-01", end: str = "2025-12-31", root: str = "/archive") -> DataFrame:
    """(day, url) for each day of the archive."""
    df = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS day")
    return df.withColumn("url", F.concat(F.lit(root + "/"), F.date_format("day", "yyyy/MM/dd")))


def backoff(tries: int = 10, most: int = 60) -> Column:
    """Seconds to wait after each failed try."""
    return F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda a: F.least(F.pow(F.lit(2.0), a), F.lit(float(most))).cast("int"))


def fetched(url: str, get, tries: int = 10, most: int = 60, sleep=time.sleep) -> str | None:
    """The page at ``url`` by ``get(url) -> (status, bytes)``: a status other than 200 gives null at once;
    an exception is retried after min(2 ** attempt, ``most``) seconds, ``tries`` times in all."""
    for attempt in range(tries):
        try:
            status, body = get(url)
        except Exception:  # whatever a client raises: the connection failed
            sleep(min(2**attempt, most))
            continue
        return body.decode("utf-8", "replace") if status == 200 else None
    return None


def fetch(urls: DataFrame, get, tries: int = 10, most: int = 60, sleep=time.sleep, concurrent: int = 8) -> DataFrame:
    """``urls`` (url, ...) with html, fetched on the executors by at most ``concurrent`` tasks; failures give null."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(html=[fetched(url, get, tries, most, sleep) for url in pdf["url"]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.repartition(concurrent).mapInPandas(run, f"{fields}, html string")


def crawl(calendar: DataFrame, get, root: str = "", journal: str = "", **retries) -> DataFrame:
    """Articles of the days of ``calendar`` (day, url): each day's listing is fetched, then the pages that it
    links to. Pages that fail, or hold no article, are left out."""
    listed = fetch(calendar.select("day", "url"), get, **retries)
    linked = listed.where("html is not null").select("day", F.explode(links(F.col("html"), root)).alias("url"))
    return articles(fetch(linked, get, **retries).where("html is not null"), journal)


def crawl_counts(found: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, n) of each day, 0 where it has no article; the crawl's total is the sum."""
    per_day = found.groupBy("date").agg(F.count("*").alias("n"))
    return calendar.select(F.date_format("day", "yyyy-MM-dd").alias("date")).join(per_day, "date", "left").na.fill(0, ["n"])


class _Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> str:
        return self.attrs.get("class") or ""

    def all(self):
        """Nodes and strings below, in order; by a stack, as pages may be nested deeply."""
        stack = self.children[::-1]
        while stack:
            c = stack.pop()
            yield c
            if isinstance(c, _Node):
                stack += c.children[::-1]

    def walk(self):
        return (c for c in self.all() if isinstance(c, _Node))

    def strings(self):
        return (c.strip() for c in self.all() if isinstance(c, str) and c.strip())


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_article(html: str, least: int = 100) -> dict | None:
    """Fields of an article page, or None if its body is too short."""
    root = _Tree(html or "").root
    first = lambda test: next((n for n in root.walk() if test(n)), None)
    said = lambda node: "".join(node.strings()) if node else ""
    title = said(first(lambda n: n.tag == "h1" and "title" in n.classes))
    author = said(first(lambda n: "author" in n.classes))
    for node in list(root.walk()):
        if node.tag in DROPPED_TAGS or DROPPED_CLASSES & set(node.classes.split()):
            node.parent.children = [c for c in node.parent.children if c is not node]
    body = first(lambda n: n.tag == "div" and "content" in n.classes) or first(lambda n: n.tag == "article")
    text = "\n".join(body.strings()) if body else ""
    if len(text) < least:
        return None
    about = first(lambda n: n.tag == "meta" and n.attrs.get("name") == "description")
    return {"title": title, "author": author, "abstract": (about.attrs.get("content") or "") if about else "", "text": text, "category": said(first(lambda n: "category" in n.classes))}


FIELDS = ["title", "author", "abstract", "text", "category"]


def _tolerant(html: str) -> dict:
    try:
        return parse_article(html) or dict.fromkeys(FIELDS)
    except Exception:  # a page that cannot be parsed is no article
        return dict.fromkeys(FIELDS)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in FIELDS]))
def _article(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_tolerant(h) for h in html], columns=FIELDS)


def articles(pages: DataFrame, journal: str = "") -> DataFrame:
    """``pages`` (html, and columns to keep) as article records, with ``date`` from a column ``day``; short
    or failed pages are left out."""
    kept = [c for c in pages.columns if c not in ("html", "day")]
    date = [F.date_format("day", "yyyy-MM-dd").alias("date")] if "day" in pages.columns else []
    df = pages.select(*kept, *date, _article("html").alias("a")).where("a.text is not null")
    return df.select(*kept, *["date"] * len(date), "a.*", F.lit(journal).alias("journal"))


def links(html: Column, root: str = "") -> Column:
    """Distinct targets of article links: anchors of class article-link, in an h2 of class
    entry-title or in an element of class news-title; relative ones get the root."""
    anchor = r"""(?is)<a\b(?=[^>]*\bclass\s*=\s*["'][^"']*\barticle-link\b)[^>]*>|<h2\b[^>]*\bclass\s*=\s*["'][^"']*\bentry-title\b[^>]*>.*?</h2>|<(\w+)\b[^>]*\bclass\s*=\s*["'][^"']*\bnews-title\b[^>]*>.*?</\1>"""
    found = F.regexp_extract_all(html, F.lit(anchor), F.lit(0))
    hrefs = F.flatten(F.transform(found, lambda a: F.regexp_extract_all(a, F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))))
    return F.array_distinct(F.transform(hrefs, lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(root), h))))

"""Page events out of HTML bytes: title, description, text, links, social profiles and structured data."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporlake.functions.urls import SOCIAL

_SKIP = {"script", "style", "noscript", "template", "svg"}
_BLOCK = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "section", "article", "tr", "td", "header", "footer", "nav"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.text, self.links, self.data = "", None, [], [], []
        self._skip, self._in_title, self._json = 0, False, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self._json = []
        if tag in _SKIP:
            self._skip += 1
        elif tag == "title":
            self._in_title = True
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "meta" and (a.get("name") or a.get("property") or "").lower() in ("description", "og:description"):
            self.description = self.description or a.get("content")
        if tag in _BLOCK:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag == "script" and self._json is not None:
            self.data.append("".join(self._json))
            self._json = None
        if tag in _SKIP:
            self._skip = max(0, self._skip - 1)
        elif tag == "title":
            self._in_title = False
        if tag in _BLOCK:
            self.text.append(" ")

    def handle_data(self, data):
        if self._json is not None:
            self._json.append(data)
        elif self._in_title:
            self.title += data
        elif not self._skip:
            self.text.append(data)


def same_as(node, out: set) -> set:
    """Addresses under sameAs anywhere in structured data."""
    if isinstance(node, dict):
        v = node.get("sameAs")
        out.update(x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str))
        for x in node.values():
            same_as(x, out)
    elif isinstance(node, list):
        for x in node:
            same_as(x, out)
    return out


def typed_nodes(node, types: set[str]) -> list[dict]:
    """Nodes of structured data of the given types, in order of appearance."""
    if isinstance(node, list):
        return [y for x in node for y in typed_nodes(x, types)]
    if not isinstance(node, dict):
        return []
    kinds = node.get("@type")
    own = [node] if types & set(kinds if isinstance(kinds, list) else [kinds]) else []
    return own + [y for v in node.values() if isinstance(v, dict | list) for y in typed_nodes(v, types)]


def _social(url: str) -> str | None:
    p = urlsplit(url)
    h = (p.hostname or "").removeprefix("www.")
    name = next((n for n in SOCIAL if h == n or h.endswith("." + n)), None)
    return f"https://{name}/{p.path.strip('/')}" if name and p.path.strip("/") else None


def read_page(html: str | None, base: str, excerpt: int) -> dict:
    r = _Reader()
    r.feed(html or "")
    data = []
    for x in r.data:
        try:
            data.append(json.loads(x))
        except ValueError:
            continue
    links = list(dict.fromkeys(urljoin(base, x) for x in r.links if not x.lower().startswith(("mailto:", "javascript:", "tel:", "#"))))
    social = sorted({s for x in [*links, *same_as(data, set())] if (s := _social(x))})
    org = typed_nodes(data, {"Organization", "LocalBusiness", "Corporation"})
    return {
        "title": " ".join(r.title.split()) or None, "description": r.description, "text": " ".join("".join(r.text).split())[:excerpt] or None, "links": links, "social": social,
        "org_name": next((n["name"] for n in org if isinstance(n.get("name"), str)), None), "org_numbers": sorted(set(re.findall(r"\b\d{3}[ \u00a0]?\d{3}[ \u00a0]?\d{3}\b", " ".join("".join(r.text).split())))),
    }


_EVENT = "title string, description string, text string, links array<string>, social array<string>, org_name string, org_numbers array<string>"


def page_events(pages: DataFrame, html: str = "html", url: str = "url", excerpt: int = 20_000) -> DataFrame:
    """Adds status, the hash of the HTML and what a page says of itself. An empty page is not_found, not an error."""

    @F.pandas_udf(_EVENT)
    def parse(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(a, b or "", excerpt) for a, b in zip(h, u, strict=True)], columns=[x.split()[0] for x in _EVENT.split(", ")])

    e = pages.withColumn("event", parse(F.col(html), F.col(url))).withColumn("content_sha256", F.sha2(F.col(html), 256))
    return e.withColumn("page_status", F.when(F.coalesce(F.trim(html), F.lit("")) == "", "not_found").otherwise("available"))


def merge_pages(events: DataFrame, key: str = "organisation_number") -> DataFrame:
    """A row a company: latest homepage, number of distinct pages and the union of social profiles."""
    e = events.select(key, "url", "page_kind", "retrieved_at", F.col("event.title").alias("title"), F.col("event.social").alias("social"), "page_status")
    links = e.select(key, F.explode("social").alias("s")).distinct().groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("social"))
    base = e.groupBy(key).agg(F.max(F.when(F.col("page_kind") == "homepage", F.struct("retrieved_at", "url", "title"))).alias("homepage"), F.countDistinct("url").alias("pages"), F.count_if(F.col("page_status") != "available").alias("errors"))
    return base.join(links, key, "left")

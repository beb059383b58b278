"""Evidence from landed web pages: one Arrow UDF parses HTML, all else is expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordered
from ..functions import text as X
from ..functions import workers
from . import dedupe

PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("schema_text", T.StringType()),
    T.StructField("nav", T.StringType()), T.StructField("headings", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("internal_links", T.ArrayType(T.StringType())), T.StructField("external_links", T.ArrayType(T.StringType())),
    T.StructField("anchors", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())]))),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()),
])
# Fixed values, part of the evidence's definition: anchors of the navigation and its characters, headings and theirs, characters of body and schema text, links.
NAV, NAV_CHARS, HEADINGS, HEADING_CHARS, BODY, SCHEMA, INTERNAL, EXTERNAL = 150, 4000, 30, 2500, 5000, 4000, 8, 20
# The keys of structured data that are read.
_SCHEMA_KEYS = ("@type", "name", "category", "description", "brand")
# Parts of a path that make an internal link one to a category.
CATEGORY = (
    "shop", "collections", "collection", "category", "categories", "products", "product", "men", "women", "kids", "shoes", "apparel", "beauty", "home", "electronics", "jewelry", "bags", "wallet",
    "travel", "grill", "pest", "grocery", "audio",
)
# Parts of a path that make an internal link not worth reading.
UNREAD = ("account", "login", "cart", "checkout", "privacy", "terms", "return", "shipping", "contact", "help", "support")
_SILENT = {"script", "style", "noscript", "template", "svg", "iframe"}


def schema_text(value) -> list[str]:
    """Texts of the known keys of a JSON-LD tree, depth first, however deep it is."""
    out: list[str] = []
    left = [value]
    while left:
        node = left.pop()
        if isinstance(node, dict):
            for key in _SCHEMA_KEYS:
                v = node.get(key)
                if isinstance(v, str):
                    out.append(v)
                elif isinstance(v, list):
                    out += [x for x in v if isinstance(x, str)]
                elif isinstance(v, dict) and isinstance(v.get("name"), str):
                    out.append(v["name"])
        inside = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        left += reversed([x for x in inside if isinstance(x, (list, dict))])
    return out


def _joined(parts: list[str]) -> str:
    """Texts of nested elements with single blanks between."""
    return " ".join(" ".join(parts).split())


def _host(url: str) -> str:
    return urlparse(url).netloc.lower().removeprefix("www.")


#: The meta elements that describe a page, by attribute and its value, in order.
DESCRIPTIONS = (("name", "description"), ("property", "og:description"), ("name", "twitter:description"))


class _Page(HTMLParser):
    """Texts by element; an element left open is closed by the next of its kind or by the end."""

    def __init__(self, mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.mark = mark  # stands for an & that begins no reference
        self.title, self.body, self.headings, self.anchors, self.schema = [], [], [], [], []
        self.meta: dict[tuple[str, str], str] = {}
        self.inside: str | None = None
        self.silent, self.ld, self.link, self.head = 0, None, None, None
        self.items: list[list[str]] = []
        self.open_items: list[list[str] | None] = []  # None: a list within an item

    def handle_starttag(self, tag, attrs):
        a = {k: self._plain(v or "") for k, v in attrs}
        if tag == "script" and "application/ld+json" in a.get("type", "").lower():
            self.ld = []
        if tag in _SILENT:
            self.silent += 1
        elif tag == "title":
            self.inside = "title"
        elif tag == "meta":
            for kind in ("name", "property"):
                if kind in a:
                    self.meta.setdefault((kind, a[kind]), a.get("content", ""))
        elif tag == "a":
            self._close_link()
            self.link = [a.get("href", ""), []]
        elif tag in ("ul", "ol"):
            self.open_items.append(None)
        elif tag == "li":
            if self.open_items and self.open_items[-1] is not None:
                self.open_items.pop()
            self.items.append([])
            self.open_items.append(self.items[-1])
        elif tag in ("h1", "h2", "h3"):
            self._close_head()
            self.head = []

    def handle_endtag(self, tag):
        if tag == "script" and self.ld is not None:
            try:
                self.schema += schema_text(json.loads("".join(self.ld)))
            except (ValueError, RecursionError):
                pass  # malformed JSON-LD is no evidence
            self.ld = None
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.inside = None
        elif tag == "a":
            self._close_link()
        elif tag in ("ul", "ol") and None in self.open_items:
            while self.open_items.pop() is not None:
                pass
        elif tag == "li" and self.open_items and self.open_items[-1] is not None:
            self.open_items.pop()
        elif tag in ("h1", "h2", "h3"):
            self._close_head()

    def _close_link(self):
        if self.link:
            self.anchors.append((_joined(self.link[1]), self.link[0]))
            self.link = None

    def _close_head(self):
        if self.head is not None:
            self.headings.append(_joined(self.head))
            self.head = None

    def _plain(self, text: str) -> str:
        return text.replace(self.mark, "&") if self.mark else text

    def handle_data(self, data):
        data = self._plain(data)
        if self.ld is not None:
            self.ld.append(data)
        if self.silent:
            return
        self.body.append(data)
        if self.inside == "title":
            self.title.append(data)
            return
        for item in self.open_items:
            if item is not None:
                item.append(data)
        if self.link:
            self.link[1].append(data)
        if self.head is not None:
            self.head.append(data)

    def done(self):
        self.close()
        self._close_link()
        self._close_head()


#: An & with the reference that it begins, if that is closed by a semicolon; the commonest ones are passed over.
_REFERENCE = re.compile("&(?!amp;|quot;|lt;|gt;)(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _marked(html: str) -> tuple[str, str]:
    """html with a sign that it lacks for each & that begins no closed reference, and that sign."""
    mark = next((c for c in map(chr, range(0xE000, 0xF900)) if c not in html), "")
    sign = lambda m: m[0] if (m[1] or "").startswith("#") or m[1] in html5 else mark + (m[1] or "")
    return (_REFERENCE.sub(sign, html) if mark else html), mark


def parse(html: str | None, url: str | None, blocked: Sequence[str] = (), closed: bool = False) -> dict:
    """The evidence of one page; malformed input gives what could be read, and error names what went wrong.

    Character references are resolved as HTML has it, those of old names without a semicolon too; with closed, only those that a
    semicolon ends, and `&amp` stays as it is.

    Internal links are those of the page's own domain to a path of CATEGORY; external ones those to another domain that has no
    part of blocked. Both are distinct and in order; anchors without a href, or with one that is no URL, don't count.
    """
    text, mark = _marked(html or "") if closed else (html or "", "")
    p, error = _Page(mark), ""
    try:
        p.feed(text)
        p.done()
    except Exception as e:  # noqa: BLE001  one bad page must not end the job: it becomes a row with an error
        error = type(e).__name__
    own, links, inside, outside = "", [], [], []
    try:
        own = _host(url or "")
    except ValueError:
        error = error or "ValueError"
    for label, href in p.anchors:
        if not (href := " ".join(href.split())):
            continue
        try:
            full = urljoin(url or "", href)
            host, path = _host(full), urlparse(full).path.lower()
        except ValueError:
            continue
        links.append((label, full))
        if not full.lower().startswith(("http://", "https://")):
            continue
        if host and own and host != own and not any(part in host for part in blocked):
            outside.append(full)
        if host == own and any(part in path for part in CATEGORY):
            inside.append(full)
    described = next((p.meta[k] for k in DESCRIPTIONS if p.meta.get(k)), "")
    pieces = [" ".join(x.split()) for x in p.schema]
    return {
        "title": " ".join("".join(p.title).split()), "description": " ".join(described.split()), "schema_text": " | ".join(x for x in pieces if x)[:SCHEMA],
        "nav": " | ".join([x for x, _ in links if 2 <= len(x) <= 80][:NAV])[:NAV_CHARS], "headings": " | ".join([x for x in p.headings[:HEADINGS] if x])[:HEADING_CHARS],
        "body": _joined(p.body)[:BODY], "internal_links": list(dict.fromkeys(inside))[:INTERNAL], "external_links": list(dict.fromkeys(outside))[:EXTERNAL],
        "anchors": [{"text": x, "href": h} for x, h in links], "items": [x for x in map(_joined, p.items) if x], "error": error,
    }


#: Pages that are Python objects at a time: a batch's evidence is kept in Arrow's form, which takes about what its texts take.
AT_ONCE = 128
_LINKS = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))
_KIND = pa.struct([(f.name, _LINKS if f.name == "anchors" else pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.string()) for f in PAGE])


def parsed(html: pa.Array, url: pa.Array, blocked: Sequence[str] = (), closed: bool = False) -> pa.Array:
    """parse() of each page."""
    parts = [pa.array([], _KIND)]
    for k in range(0, len(html), AT_ONCE):
        some = zip(html.slice(k, AT_ONCE).to_pylist(), url.slice(k, AT_ONCE).to_pylist(), strict=True)
        parts.append(pa.array([parse(h, u, blocked, closed) for h, u in some], _KIND))
    return pa.concat_arrays(parts)


def page_evidence(blocked: Sequence[str] = (), closed: bool = False):
    """The UDF of (html, url) that gives a PAGE."""

    @F.arrow_udf(PAGE)
    def of(html: pa.Array, url: pa.Array) -> pa.Array:
        return parsed(html, url, blocked, closed)

    return of


def with_evidence(pages: DataFrame, html: str = "html", url: str = "url", out: str = "evidence", blocked: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """pages with a PAGE struct."""
    workers.ship(pages.sparkSession)
    return pages.withColumn(out, page_evidence(blocked, closed)(html, url))


def readable(pages: DataFrame, status: str = "status", kind: str = "content_type", html: str = "html") -> DataFrame:
    """Pages that were fetched without an error and hold HTML, by their type or by their first 500 characters."""
    text = F.coalesce(html, F.lit(""))
    ok = F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("text/html")) | F.contains(F.lower(F.left(text, F.lit(500))), F.lit("<html"))
    return pages.filter((F.coalesce(F.col(status), F.lit(200)) < 400) & ok)


def title(html: Column) -> Column:
    """The title alone, without Python."""
    return X.clean(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def listings(anchors: DataFrame, rules) -> DataFrame:
    """Anchors (text, href) that a provider's rule takes for listings, with name, slug and the keys that first_seen() goes by.

    rules: blocked names (regions too); optional: the longest name, blocked link parts, card (the name is the first line of the
    text), path, a part of the link, and signals, phrases of the text, either of which will do; hosts; prefix, what the path
    starts with before a slug; last, the segment before the slug; closed, starts of paths that aren't listings, and shut, whole
    ones; letter (names need one, the default); single (False: no names of one letter a to z); plain (no names that are links or
    addresses); seen, the keys by which a listing counts once.
    """
    text, href = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("href"), F.lit(""))
    name = X.card_fields(text)["title"] if rules.get("card") else X.clean(text)
    low, path = F.lower(name), F.regexp_replace(F.regexp_extract(href, "^[A-Za-z]+://[^/?#]*([^?#;]*)", 1), "/+$", "")
    ok = (name != "") & ~low.isin(list(rules["blocked"])) & ~name.rlike("^[0-9]+$") & ~X.contains_any(F.lower(href), rules.get("blocked_parts", []))
    if rules.get("longest"):
        ok = ok & (F.length(name) <= rules["longest"])
    if rules.get("path") or rules.get("signals"):
        part = F.contains(F.lower(href), F.lit(rules["path"].lower())) if rules.get("path") else F.lit(False)
        ok = ok & (part | X.contains_any(F.lower(text), rules.get("signals", [])))
    if rules.get("hosts"):
        ok = ok & F.regexp_extract(href, "^[A-Za-z]+://([^/?#]*)", 1).isin(list(rules["hosts"]))
    if rules.get("prefix"):
        ok = ok & F.startswith(path, F.lit(rules["prefix"])) & (F.length(path) > len(rules["prefix"]))
    if rules.get("last"):
        ok = ok & (X.last_slug(href, rules["last"]) != "")
    for start in rules.get("closed", []):
        ok = ok & ~F.startswith(path, F.lit(start))
    if rules.get("shut"):
        ok = ok & ~path.isin(list(rules["shut"]))
    if rules.get("letter", True):
        ok = ok & name.rlike("[A-Za-z]")
    if not rules.get("single", True):
        ok = ok & ~low.rlike("^[a-z]$")
    if rules.get("plain"):
        ok = ok & ~low.startswith("http") & ~F.contains(low, F.lit("@"))
    return anchors.filter(ok).withColumn("name", name).withColumn("slug", X.slug(F.col("href")))


def list_items(pages: DataFrame, rules, evidence: str = "evidence") -> DataFrame:
    """The list items of pages that a provider's names and no others stop: a second way to its listings, without links. Columns of pages, ordinal, text, href, name, slug."""
    from_page = {k: v for k, v in rules.items() if k in ("blocked", "longest", "letter", "single", "plain")}
    rows = pages.select("*", F.posexplode(f"{evidence}.items").alias("ordinal", "text")).withColumn("href", F.lit(""))
    return listings(rows, from_page)


def first_seen(found: DataFrame, ordinal: str | list[str], seen: Sequence[str] = ("low", "link"), within: Sequence[str] = ()) -> DataFrame:
    """Listings once each (within the groups of some columns): the first by ordinal of those alike in low (lower-cased name), link (lower-cased) or key (letters and digits of the name)."""
    made = {"low": F.lower("name"), "link": F.lower(F.coalesce("href", F.lit(""))), "key": X.key_lower(F.col("name"))}
    keys = [f"__{k}" for k in seen]
    rows = found.withColumns({f"__{k}": made[k] for k in seen})
    if "key" in seen:
        rows = rows.filter(F.col("__key") != "")
    order = [ordinal] if isinstance(ordinal, str) else list(ordinal)
    return dedupe.best(rows, [*within, *keys], [F.col(c) for c in order]).drop(*keys)


def official_site(results: DataFrame, key: str, blocked: Sequence[str], provider_domains: Sequence[str], retail: Sequence[str], legal: Sequence[str], name: str = "name") -> DataFrame:
    """key, href and points of the best search result (rank, title, body, href) of each key; the first of equals.

    Points are X.domain_score() of name and href, 2 for `official` and 1 for `shop` or `store` in title or body. Results of blocked
    domains and of providers don't count.
    """
    said = F.lower(F.concat_ws(" ", X.clean(F.col("title")), X.clean(F.col("body"))))
    points = X.domain_score(F.col(name), F.col("href"), retail, legal) + F.when(F.contains(said, F.lit("official")), 2).otherwise(0) + F.when(X.contains_any(said, ["shop", "store"]), 1).otherwise(0)
    href = X.clean(F.col("href"))
    ok = X.is_http(href) & ~X.blocked_domain(href, blocked) & ~X.within_domains(X.domain(href), provider_domains)
    good = results.filter(ok).withColumn("points", points)
    return good.groupBy(key).agg(F.min_by(F.struct("href", "points"), F.struct(-F.col("points"), F.col("rank"))).alias("b")).select(key, "b.href", "b.points")


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The results of a first source, and those of a second for the keys of which the first has none."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


#: What is asked about a name, {} standing for it; the first asks with the country's hint.
QUERIES = ('"{}" official website store', '"{}" products', '"{}" product categories', '"{}" what does it sell', '"{}" retailer brand products')


# The queries that some names' keys (key_plain) have of their own.
SPECIAL = {
    "hannaandersson": ['"Hanna Andersson" kids pajamas children clothing baby toddler', '"Hanna Andersson" childrens clothing pajamas official'],
    "bhphoto": ['"B&H Photo" cameras video audio computers electronics'],
    "farfetch": ['"Farfetch" luxury fashion designer clothing shoes accessories'],
    "bestbuy": ['"Best Buy" consumer electronics computers appliances cameras'],
    "lelabofragrances": ['"Le Labo" fragrances perfume cologne candles'],
    "lyft": ['"Lyft" rideshare ride hailing transportation app'],
    "nespresso": ['"Nespresso" coffee capsules espresso machines'],
    "officedepot": ['"Office Depot" office supplies printer ink business supplies'],
    "ouraring": ['"Oura Ring" smart ring sleep tracking wearable health tech'],
    "popsockets": ['"PopSockets" phone grip phone stand mobile accessories'],
    "shutterfly": ['"Shutterfly" photo books photo printing personalized gifts'],
    "sixflags": ['"Six Flags" theme park amusement park tickets season pass'],
    "surlatable": ['"Sur La Table" cookware kitchenware kitchen tools'],
    "tpsgaragellc": ['"TPS Garage" automotive parts performance parts garage'],
    "theprosclosetinc": ['"The Pro\'s Closet" used bikes cycling marketplace'],
    "williamsomona": ['"Williams Sonoma" cookware kitchenware home goods'],
    "williamssonoma": ['"Williams Sonoma" cookware kitchenware home goods'],
    "zara": ['"Zara" fashion apparel clothing official store'],
    "doordash": ['"DoorDash" food delivery restaurant delivery order food'],
    "tmobile": ['"T-Mobile" wireless carrier phone plans mobile network'],
    "llbean": ['"L.L.Bean" outdoor clothing outdoor gear boots'],
    "rei": ['"REI" outdoor gear camping hiking cycling apparel'],
    "patagonia": ['"Patagonia" outdoor clothing gear jackets'],
    "newbalancerunning": ['"New Balance" running shoes athletic footwear apparel'],
    "roomstogoinc": ['"Rooms To Go" furniture store sofas bedroom furniture'],
    "skiptomaincontent": ['"Skip to main content" navigation link'],
    "moreinformationaboutourcookiepolicy": ['"cookie policy" website privacy informational page'],
}


def search_queries(name: Column, friendly: Column, country: Column, special: dict[str, list[str]] | None = None) -> Column:
    """The queries about a name and, if it reads otherwise, its friendly form; then those that a few keys (key_plain) have of their own: SPECIAL unless given."""
    special = SPECIAL if special is None else special
    names = X.unique_items(X.filled(name, friendly))
    asked = F.flatten(F.transform(names, lambda n: F.array(*[F.concat(F.lit(a), n, F.lit(b), *([X.country_hint(country)] if k == 0 else [])) for k, (a, b) in enumerate(q.split("{}") for q in QUERIES)])))
    if not special:
        return asked
    own = F.create_map(*[x for k, qs in special.items() for x in (F.lit(k), F.array(*map(F.lit, qs)))])[X.key_plain(name)]
    return F.concat(asked, F.coalesce(own, F.array().cast("array<string>")))


def evidence_bundle(asked: DataFrame, results: DataFrame, key: str, blocked: Sequence[str], cap: int = 10000, most: int = 5) -> DataFrame:
    """key and what the results (query, rank, title, body, href) of its queries (an array) say, in order of query and rank.

    The first `most` results of a query count, but for those of blocked domains. The text is cut at cap characters; a key without results has the empty one.
    """
    each = asked.select(key, F.posexplode("queries").alias("nth", "query")).join(results.filter(F.col("rank") <= most), "query", "left")
    href = X.clean(F.col("href"))
    said = X.clean(F.concat(F.lit("TITLE: "), X.clean(F.col("title")), F.lit(" | SNIPPET: "), X.clean(F.col("body")), F.lit(" | URL: "), href))
    each = each.withColumn("said", F.when(F.col("rank").isNotNull() & ~((href != "") & X.blocked_domain(href, blocked)), said))
    return ordered.joined(each, key, ["nth", "rank"], F.col("said"), "evidence", " ", cap)


def worth_reading(links: Column, most: int) -> Column:
    """The first `most` internal links of which no part of the path tells that they hold no goods."""
    path = lambda u: F.lower(F.regexp_extract(u, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    return F.slice(F.filter(links, lambda u: ~X.contains_any(path(u), UNREAD)), 1, most)


def extra_evidence(pages: DataFrame, landed: DataFrame, key: str, most: int = 3, cap: int = 5000, evidence: str = "evidence") -> DataFrame:
    """key and what the landed pages (url and a PAGE struct) behind its internal links say, in the links' order; blank for none."""
    links = pages.select(key, F.posexplode_outer(worth_reading(F.col(f"{evidence}.internal_links"), most)).alias("nth", "url"))
    e = lambda c: F.coalesce(F.col(f"__e.{c}"), F.lit(""))
    said = X.clean(F.concat_ws(" ", *[e(c) for c in ("title", "description", "schema_text", "nav", "headings")], F.left(e("body"), F.lit(1200))))
    rows = links.join(landed.select("url", F.col(evidence).alias("__e")), "url", "left").withColumn("said", F.when(F.col("__e").isNotNull(), said))
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("nth", "said")))).alias("x"))
    return got.select(key, F.left(X.clean(F.array_join(F.transform("x", lambda r: r["said"]), " ")), F.lit(cap)).alias("extra"))

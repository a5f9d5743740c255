"""Extraction of products from captured pages and JSON responses.

JSON goes through typed ``from_json`` or VARIANT paths in the JVM; only element trees of
HTML and products at unknown depth of JSON need Python, read in Arrow batches.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from .resolve import priority

# page structure


def structure(html: Column) -> dict[str, Column]:
    h = F.coalesce(html, F.lit(""))
    return {
        "has_compare_cards": h.rlike(r"(?i)class=\"[^\"]*compare-card"),
        "has_data_cells": h.rlike(r"(?i)data-cell\s*="),
        "has_rate_selects": h.rlike(r"(?is)<option[^>]*>[^<]*%\s*p\.a"),
        "has_jsonld": h.rlike(r"(?i)<script[^>]*application/ld\+json"),
        "has_embedded_state": h.rlike(r"dataLayer|__NEXT_DATA__|__NUXT__"),
        "has_rate_tables": h.rlike(r"(?is)<t[dh][^>]*>[^<]*[\d.]+%\s*p\.a"),
    }


def strategies(found: dict[str, Column]) -> tuple[Column, Column]:
    """(all strategies a page offers, the one recommended)."""
    order = (("jsonld", "has_jsonld"), ("embedded_state", "has_embedded_state"), ("select_dropdowns", "has_rate_selects"), ("compare_cards", "has_compare_cards"), ("html_table", "has_rate_tables"))
    every = F.array_compact(F.array(*[F.when(found[c], F.lit(s)) for s, c in order], F.lit("dom_parsing")))
    return every, F.element_at(every, 1)


class _Tree(HTMLParser):
    """Elements in document order, with their text and the place of their parent."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        parent = self.stack[-1] if self.stack else None
        self.rows.append([len(self.rows), tag, {k: v or "" for k, v in attrs}, [], parent])
        if tag not in self.VOID:
            self.stack.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[i]][1] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        skip = {"script", "style"}
        for i in self.stack if not any(self.rows[j][1] in skip for j in self.stack) else self.stack[-1:]:
            self.rows[i][3].append(data)


def html_elements(pages: DataFrame, tags: tuple, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, idx, tag, attrs, text, parent) of the elements of the wanted tags, in document
    order; parent is the nearest enclosing element's idx."""
    names = [id_col, "idx", "tag", "attrs", "text", "parent"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = _Tree()
                t.feed(html or "")
                t.close()
                rows = [(page, i, tag, list(a.items()), " ".join("".join(x).split()), p) for i, tag, a, x, p in t.rows if tag in tags]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInArrow(run, f"`{id_col}` long, idx long, tag string, attrs map<string,string>, text string, parent long")


def headings(pages: DataFrame) -> DataFrame:
    """Product-like headings and the first rate of the text that follows up to the next
    heading; a comparison rate is the rate unless the text names one, the ratio 0.8 unless a
    percentage stands before "LVR"."""
    e = html_elements(pages, ("h1", "h2", "h3", "h4", "p", "td", "li", "span"))
    e = e.withColumn("is_h", F.col("tag").isin("h1", "h2", "h3", "h4"))
    w = Window.partitionBy("page_id").orderBy("idx")
    e = e.withColumn("section", F.sum(F.col("is_h").cast("int")).over(w))
    return (
        e.where("section > 0").groupBy("page_id", "section")
        .agg(F.min_by("text", "idx").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("body"))
        .where(P.is_heading(F.col("heading")))
        .select("page_id", "heading", P.plain_rate(F.col("body")).alias("rate"), F.coalesce(P.comparison_in_text(F.col("body")), P.plain_rate(F.col("body"))).alias("comparison_rate"), F.when(F.lower("body").rlike(r"\bfixed\b"), "Fixed").otherwise("Variable").alias("rate_type"), F.coalesce(P.number(F.col("body"), r"(?i)(\d+)%.*?LVR") / 100, F.lit(0.8)).alias("lvr_max"))
    )


# captured JSON responses


def responses(log: DataFrame) -> DataFrame:
    return log.where((F.col("status") == 200) & F.coalesce(F.col("content_type"), F.lit("")).contains("application/json"))


NAME_KEYS = ("name", "productName", "title", "loanName")
RATE_KEYS = ("rate", "interestRate", "comparisonRate")
LIST_KEYS = ("products", "items", "loans", "data", "results", "productList")
STRUCTURED_KEYS = ("loanProducts", "products", "items", "data", "results", "productList")


def find_products(log: DataFrame) -> DataFrame:
    """(call_id, seq, product json): objects that look like products, in document order,
    searched through top-level lists and the list keys.  The depth is the data's, so this is
    Python over Arrow batches."""

    def walk(x):
        if isinstance(x, dict):
            if any(k in x for k in ("name", "productName", "rate", "interestRate", "loanName")):
                yield x
            for k in LIST_KEYS:
                if isinstance(x.get(k), (list, dict)):
                    yield from walk(x[k])
        elif isinstance(x, list):
            for y in x:
                yield from walk(y)

    def run(batches):
        for b in batches:
            rows = []
            for call, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = list(walk(json.loads(body or "null")))
                except ValueError:
                    continue
                rows += [(call, i, json.dumps(x)) for i, x in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["call_id", "seq", "product"])

    return log.select(F.col("call_id").cast("long").alias("call_id"), "body").mapInArrow(run, "call_id long, seq long, product string")


def _probe(j: Column, keys: tuple) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{k}"), F.lit("")) for k in keys])


def generic_products(found: DataFrame, lender: str) -> DataFrame:
    """Name and rate by the first key that has one; a text rate gives its first number;
    both are needed."""
    j = F.col("product")
    raw = _probe(j, RATE_KEYS)
    rate = F.coalesce(raw.try_cast("double"), P.number(raw, r"(\d+\.?\d*)"))
    name = _probe(j, NAME_KEYS)
    out = found.select("call_id", "seq", F.concat_ws(" ", F.lit(lender), name).alias("name"), rate.alias("rate"), P.strategy_id(F.lit(lender), "network_api", name).alias("product_id"), name.isNotNull().alias("_ok"))
    return out.where("_ok AND rate IS NOT NULL AND rate <> 0").drop("_ok")


TIERS = "rateTiers: array<struct<lvrMin: double, lvrMax: double, interestRate: double, comparisonRate: double, rate: double>>"
ITEM = (
    "struct<productId: string, id: string, productName: string, name: string, rateType: string, "
    "eligibility: struct<loanPurpose: array<string>, repaymentType: array<string>, minLoanAmount: double, maxLoanAmount: double>, "
    f"{TIERS}, pricing: struct<{TIERS}>>"
)


def structured_products(log: DataFrame) -> DataFrame:
    """A row per product, tier, purpose and repayment type; percent ratios become fractions,
    the comparison rate is preferred; products without tiers give none.  The products are the
    body itself if it is a list, else its first list; tiers may lie under pricing."""
    body = F.from_json("body", ", ".join(f"{k} array<string>" for k in STRUCTURED_KEYS))
    listed = F.when(F.col("body").rlike(r"^\s*\["), F.from_json("body", "array<string>"))
    first = F.coalesce(listed, *[body[k] for k in STRUCTURED_KEYS])
    # item by item: one that is no object must not spoil its list
    p = log.select("call_id", F.posexplode(first).alias("seq", "item")).select("call_id", "seq", F.from_json("item", ITEM).alias("p"))
    t = p.select("call_id", "seq", "p", F.posexplode(F.coalesce("p.rateTiers", "p.pricing.rateTiers")).alias("tier", "t"))
    e = F.col("p.eligibility")
    none = lambda a, d: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(d)))
    u = t.select("*", F.explode(none(e["loanPurpose"], "OwnerOccupied")).alias("purpose"))
    v = u.select("*", F.explode(none(e["repaymentType"], "PrincipalAndInterest")).alias("repayment_type"))
    rate = F.coalesce(F.col("t.comparisonRate"), F.col("t.interestRate"), F.col("t.rate"))
    return v.select(
        "call_id",
        "seq",
        "tier",
        F.coalesce(*[F.nullif(F.col(f"p.{k}"), F.lit("")) for k in ("productName", "name", "productId", "id")], F.lit("Unknown Product")).alias("name"),
        F.col("p.rateType").alias("rate_type"),
        "purpose",
        "repayment_type",
        F.col("t.interestRate").alias("interest_rate"),
        rate.alias("rate"),
        P.as_fraction(F.col("t.lvrMin")).alias("lvr_min"),
        F.coalesce(P.as_fraction(F.col("t.lvrMax")), F.lit(0.8)).alias("lvr_max"),
    )


# script bodies


def scripts(pages: DataFrame, pattern: str, id_col: str = "page_id") -> DataFrame:
    return pages.select(id_col, F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("block", "body"))


def jsonld(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Products, financial products, loans and offers in JSON-LD blocks, single or listed.
    The rate is the first number of the (first) offer's price, else a percentage in the name or
    description; a name and a positive rate are needed."""
    s = scripts(pages, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", id_col)
    v = F.try_parse_json("body")
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    x = s.select(id_col, "block", F.posexplode(items).alias("seq", "v"))
    get = lambda p: F.try_variant_get("v", p, "string")
    price = F.coalesce(get("$.offers[0].price"), get("$.offers.price"))
    fallback = F.coalesce(P.plain_rate(get("$.name")), P.plain_rate(get("$.description")))
    rate = F.coalesce(P.number(price, r"(\d+\.?\d*)"), fallback)
    kind = get("$['@type']")
    out = x.select(id_col, "block", "seq", kind.alias("kind"), get("$.name").alias("name"), rate.alias("rate"))
    return out.where(F.col("kind").isin("Product", "FinancialProduct", "LoanOrCredit", "Offer") & (F.coalesce("name", F.lit("")) != "") & (F.col("rate") > 0))


def datalayer(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Items of a data layer: ecommerce.items, else products; name or item_name; a numeric
    price is the rate, any other price is 0."""
    s = scripts(pages, r"(?s)dataLayer\s*=\s*(\[.*?\]);", id_col)
    v = F.try_parse_json("body")
    entry = s.select(id_col, "block", F.posexplode(F.try_variant_get(v, "$", "array<variant>")).alias("entry", "e"))
    items = F.coalesce(F.try_variant_get("e", "$.ecommerce.items", "array<variant>"), F.try_variant_get("e", "$.products", "array<variant>"))
    x = entry.select(id_col, "block", "entry", F.posexplode(items).alias("seq", "i"))
    name = F.coalesce(F.try_variant_get("i", "$.name", "string"), F.try_variant_get("i", "$.item_name", "string"))
    kind = F.schema_of_variant(F.try_variant_get("i", "$.price", "variant"))
    rate = F.when(kind.rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT|SMALLINT|TINYINT)"), F.try_variant_get("i", "$.price", "double")).otherwise(0.0)
    return x.select(id_col, "block", "entry", "seq", name.alias("name"), rate.alias("rate")).where(F.coalesce("name", F.lit("")) != "")


def embedded_state(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Data layer products; the other embedded states are probed only, as by specification
    their parsers yield no products."""
    return datalayer(pages, id_col).withColumn("strategy", F.lit("embedded_state"))


# cards, options, tables


def compare_cards(cards: DataFrame) -> DataFrame:
    """cards(card_id, element_id, heading, head, cells array<struct<name, text>>): two rates by
    cell name; the comparison rate defaults to the advertised one."""
    cell = lambda pat: F.try_element_at(F.filter(F.transform(F.filter("cells", lambda c: F.lower(c["name"]).rlike(pat)), lambda c: P.number(c["text"], r"(\d+\.?\d*)")), lambda x: x.isNotNull()), F.lit(1))
    name = F.coalesce(F.nullif(F.col("heading"), F.lit("")), F.nullif(F.col("head"), F.lit("")), P.title_from_id(F.col("element_id")))
    c = cards.select("card_id", name.alias("name"), cell("^(?!.*comparison).*rate").alias("rate"), cell("comparison").alias("comparison_rate"))
    return c.where("rate > 0").select("card_id", "name", "rate", F.coalesce("comparison_rate", "rate").alias("comparison_rate"), P.rate_type_of_name(F.col("name")).alias("rate_type"))


def card_cells(html: Column) -> Column:
    """The data cells of a card's markup."""
    pattern = r"(?is)data-cell=\"([^\"]*)\"[^>]*>([^<]*)<"
    names, texts = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.zip_with(names, texts, lambda n, t: F.struct(n.alias("name"), t.alias("text")))


def options(html: Column) -> Column:
    """Texts of a page's options that carry a rate, placeholders left out."""
    every = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<option[^>]*>([^<]*)</option>"), F.lit(1)), lambda t: F.trim(t))
    return F.filter(every, lambda t: F.lower(t).rlike(r"%\s*p\.a") & ~P.is_placeholder(t))


def _cell_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for code, char in (("&le;", "≤"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tier_rows(pages: DataFrame) -> DataFrame:
    """(page_id, table_idx, row_idx, label, rate, fixed_term_months): the rows of a page's tier
    tables.  Such a table speaks of ratios and rates, and of ratios or tiers in its first
    row; its others have the tier and the rate in their first two cells."""
    every = lambda h, tag: F.regexp_extract_all(h, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    t = pages.select("page_id", F.posexplode(every(F.col("html"), "table")).alias("table_idx", "body"))
    t = t.select("page_id", "table_idx", F.lower(_cell_text(F.col("body"))).alias("text"), every(F.col("body"), "tr").alias("rows"))
    head = F.lower(_cell_text(F.col("rows")[0]))
    t = t.where((F.col("text").contains("lvr") | F.col("text").contains("loan to value")) & (F.col("text").contains("rate") | F.col("text").contains("%")))
    t = t.where((F.size("rows") >= 2) & (head.contains("lvr") | head.contains("tier")))
    r = t.select("page_id", "table_idx", F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row_idx", "row"))
    r = r.select("page_id", "table_idx", "row_idx", F.transform(every(F.col("row"), "t[dh]"), _cell_text).alias("c")).where(F.size("c") >= 2)
    tier = F.col("c")[0]
    term = F.coalesce(P.number(F.lower(tier), r"(\d+)\s*year") * 12, P.number(F.lower(tier), r"(\d+)\s*month")).cast("int")
    r = r.select("page_id", "table_idx", "row_idx", F.regexp_extract(tier, r"([≤<>]|Index)\s*(\d+)?%?", 0).alias("label"), P.number(F.col("c")[1], r"([\d.]+)%").alias("rate"), term.alias("fixed_term_months"))
    return r.where("label <> '' AND rate IS NOT NULL")


def dropdown_products(pages: DataFrame, lender: str) -> DataFrame:
    """The rates of a page's tier tables and of its rate selects, a row per component: (page_id,
    source, base_name, name, rate, rate_type, lvr_min, lvr_max, fixed_term_months).  Rows of
    one base name are one product; a component that repeats counts once."""
    rows = tier_rows(pages).withColumn("table_id", F.struct("page_id", "table_idx"))
    t = lvr_table(rows, ("label", "fixed_term_months"))
    base = F.lit(f"{lender} Variable Rate")
    tables = t.select("table_id.page_id", F.lit("table").alias("source"), base.alias("base_name"), F.concat_ws(" - ", base, F.when(F.col("rate_type") == "VariableIndex", "Index rate").otherwise(F.col("label"))).alias("name"), "rate", "rate_type", "lvr_min", "lvr_max", "fixed_term_months")
    selects = F.regexp_extract_all("html", F.lit(r"(?is)<select[^>]*id=\"[^\"]*(?:interest|rate)[^\"]*\"[^>]*>(.*?)</select>"), F.lit(1))
    text = pages.select("page_id", F.explode(selects).alias("s")).select("page_id", F.explode(options(F.col("s"))).alias("t"))
    o = text.withColumn("o", P.option(F.col("t"))).where("o IS NOT NULL")
    chosen = o.select("page_id", F.lit("select").alias("source"), P.base_name(F.col("o.name")).alias("base_name"), "o.name", "o.rate", "o.rate_type", "o.lvr_min", "o.lvr_max", P.ui_term_months(F.col("t")).alias("fixed_term_months"))
    return tables.unionByName(chosen).distinct()


def lvr_table(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows(table_id, row_idx, label, rate): bands of tier tables, with the columns ``keep``.  "≤ x" starts where the
    highest bound so far ends, "> x" runs to 1 exclusive, index rows cover all; tables of one
    tier are no tier tables."""
    # generated from one array, so a label is parsed once, not once for each use and filter
    found = F.filter(F.array(P.band_parts(F.col("label"))), P.is_band)
    t = rows.where("rate IS NOT NULL").select("table_id", "row_idx", "rate", *keep, F.inline(found))
    t = t.withColumn("lvr_max", F.when(F.col("kind").isin("gt", "index"), 1.0).otherwise(F.col("bound")))
    w = Window.partitionBy("table_id").orderBy("row_idx")
    before = F.coalesce(F.max("lvr_max").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    low = F.when(F.col("kind") == "gt", F.col("bound")).when(F.col("kind") == "index", 0.0).otherwise(before)
    kind = F.when(F.col("kind") == "index", "VariableIndex").otherwise("Variable")
    # a table has several tiers where one stands before or after
    several = F.lag(F.lit(True)).over(w).isNotNull() | F.lead(F.lit(True)).over(w).isNotNull()
    out = t.select("table_id", "row_idx", *keep, low.alias("lvr_min"), "lvr_max", F.col("kind").isin("gt", "lt").alias("lvr_exclusive_max"), "rate", kind.alias("rate_type"), several.alias("_n"))
    return out.where("_n").drop("_n")


# search results


# How engines wrap links, domains left out when unwrapped, and when plain.
ENGINES = {
    "google": ("/url?q=", r"/url\?q=(https?://[^&]+)", ("google.com", "youtube.com", "facebook.com", "maps.google"), ("google.com",)),
    "bing": (None, None, (), ("bing.com", "microsoft.com")),
    "yahoo": ("/u=", r"/u=(https?://[^&]+)", ("yahoo.com", "google.com", "youtube.com", "facebook.com"), ("yahoo.com",)),
}


def result_urls(html: Column, engine: str) -> Column:
    """Links of a search page: redirects unwrapped, the engine's and social domains left out,
    first of equals kept; of other engines the links to content."""
    hrefs = F.regexp_extract_all(html, F.lit(r"(?i)href=\"([^\"]+)\""), F.lit(1))
    if engine not in ENGINES:
        return F.array_distinct(F.filter(hrefs, P.is_content_url))
    mark, pattern, not_wrapped, not_plain = ENGINES[engine]
    free = lambda u, domains: ~P.has_any(u, domains)

    def link(u):
        plain = F.when(u.startswith("http") & free(u, not_plain), u)
        if mark is None:
            return plain
        target = F.nullif(F.regexp_extract(u, pattern, 1), F.lit(""))
        target = F.coalesce(F.try_url_decode(target), target)
        return F.when(u.contains(mark), F.when(free(target, not_wrapped), target)).otherwise(plain)

    return F.array_distinct(F.array_compact(F.transform(hrefs, link)))


def serp_links(pages: DataFrame) -> DataFrame:
    """(page_id, engine, position, url) of captured search pages (page_id, engine, html)."""
    urls = result_urls(F.col("html"), "")
    for engine in ENGINES:
        urls = F.when(F.col("engine") == engine, result_urls(F.col("html"), engine)).otherwise(urls)
    return pages.select("page_id", "engine", F.posexplode(urls).alias("position", "url"))


# choosing and uniting


def unite(frames: dict[str, DataFrame]) -> DataFrame:
    """All strategies' rows with their strategy and its priority."""
    out = None
    for s, df in frames.items():
        row = df.withColumn("strategy", F.lit(s))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out.withColumn("strategy_priority", priority(F.col("strategy")))


def census(pages: DataFrame) -> DataFrame:
    """How many pages show each structure."""
    s = structure(F.col("html"))
    return pages.agg(F.count("*").alias("pages"), *[F.count_if(c).alias(k) for k, c in s.items()])

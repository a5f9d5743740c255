"""Page controls: grouping captured options into axes, naming labels, exploring states.

The input is captured element rows, not a live page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import parsing as P
from .resolve import first_wins

METADATA_AXES = ("region_residency", "borrower_category")
# What is assumed where a page says nothing.
ELIGIBILITY = {"min_amount": 20000.0, "max_amount": 2000000.0, "min_age": 18, "property_types": ("House", "Apartment", "Townhouse")}


def distinct_options(options: DataFrame) -> DataFrame:
    """options(page_id, container, idx, text): placeholders go; of options equal but for case
    the first stays."""
    o = options.where(~P.is_placeholder(F.col("text")) & (F.trim("text") != "")).withColumn("_k", F.lower(F.trim("text")))
    return first_wins(o, ["page_id", "container", "_k"], ["idx"]).drop("_k")


def groups(options: DataFrame, lexicon: L.Lexicon = L.DEFAULT) -> DataFrame:
    """Containers with more than one option: their texts in order, the axis most of the options
    name (ties by name), and whether the axis prices."""
    o = distinct_options(options).withColumn("axis", L.option_type(F.col("text"), lexicon))
    g = o.groupBy("page_id", "container").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("options"))
    votes = o.where("axis IS NOT NULL").groupBy("page_id", "container", "axis").agg(F.count("*").alias("n"))
    top = first_wins(votes, ["page_id", "container"], [-F.col("n"), "axis"]).select("page_id", "container", "axis")
    j = g.where(F.size("options") > 1).join(top, ["page_id", "container"], "left")
    return j.select("page_id", "container", "options", "axis", (F.coalesce("axis", F.lit("")) != "").alias("known"), (~F.coalesce("axis", F.lit("")).isin(*METADATA_AXES)).alias("pricing"))


def near_labels(labels: DataFrame, options: DataFrame, distance: float = 200.0) -> DataFrame:
    """Options that belong to a label: in its container, else less than ``distance`` below or
    above it.  The range join is bucketed by distance, so it stays an equi-join."""
    same = labels.join(options, ["page_id", "container"]).select("page_id", "label_id", "option_id")
    cell = lambda y: F.floor(y / distance)
    left = labels.select("page_id", "label_id", F.col("container").alias("_c"), F.col("y").alias("_y"), F.explode(F.array(cell(F.col("y")) - 1, cell(F.col("y")), cell(F.col("y")) + 1)).alias("_b"))
    right = options.select("page_id", "option_id", "container", "y", cell(F.col("y")).alias("_b"))
    close = left.join(right, ["page_id", "_b"]).where((F.abs(F.col("_y") - F.col("y")) < distance) & ~F.col("_c").eqNullSafe(F.col("container"))).select("page_id", "label_id", "option_id")
    alone = close.join(same.select("page_id", "label_id").distinct(), ["page_id", "label_id"], "left_anti")
    return same.unionByName(alone)


def radio_label(for_text: Column, parent: Column, sibling: Column, aria: Column, value: Column) -> Column:
    """The first text that is there: label, parent, next sibling, aria label, value."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (for_text, parent, sibling, aria, value)])


def label_axis(text: Column, lexicon: L.Lexicon = L.DEFAULT) -> Column:
    """The first category whose label keywords a label holds."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for c in ("repayment_type", "rate_type", "loan_type", "loan_purpose", "product_segment", "region_residency", "rate_tier"):
        test = L.has_any(t, lexicon.labels(c))
        out = F.when(test, c) if out is None else out.when(test, c)
    return out


def numeric_input(name: Column) -> Column:
    """struct(field, value): what to enter into a numeric input, by its name."""
    t = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for k, (words, value) in L.NUMERIC_INPUTS.items():
        row = F.struct(F.lit(k).alias("field"), F.lit(value).alias("value"))
        out = F.when(L.has_any(t, words), row) if out is None else out.when(L.has_any(t, words), row)
    return out


def reachable_states(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(state, depth): states of a captured graph(source, target) within ``depth`` steps of the
    roots(state), each at its least depth; visited states are not expanded again."""
    seen = roots.select(F.col("state"), F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        front = front.join(edges, front["state"] == edges["source"]).select(F.col("target").alias("state"), F.lit(d).alias("depth")).distinct()
        front = front.join(seen.select("state"), "state", "left_anti")
        seen = seen.unionByName(front)
    return seen


def with_defaults(products: DataFrame) -> DataFrame:
    """Eligibility columns where extraction gave none."""
    kinds = F.array(*[F.lit(x) for x in ELIGIBILITY["property_types"]])
    d = {k: F.lit(v) for k, v in ELIGIBILITY.items() if k != "property_types"} | {"property_types": kinds}
    return products.select(*[c for c in products.columns if c not in d], *[(F.coalesce(k, v) if k in products.columns else v).alias(k) for k, v in d.items()])


def table_name(heading: Column, caption: Column, lender: Column) -> Column:
    """A tier table's product: the container's heading under 100 characters, the caption, else
    the lender's variable rate."""
    h = F.nullif(F.trim(heading), F.lit(""))
    return F.coalesce(F.when(F.length(h) < 100, h), F.nullif(F.trim(caption), F.lit("")), F.concat(lender, F.lit(" Variable Rate")))


CASCADE = ("jsonld", "embedded_state", "select_dropdowns", "compare_cards", "dom_parsing")


def cascade(rows: DataFrame, keys: list[str], order=CASCADE) -> DataFrame:
    """All rows of the first strategy, in order, that found any."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("strategy"))
    r = rows.withColumn("_o", place).where("_o > 0")
    first = r.groupBy(*keys).agg(F.min("_o").alias("_m"))
    return r.join(first, keys).where("_o = _m").drop("_o", "_m")

"""Precision, recall and F1 of predictions against gold rows, under three rules for empty denominators."""

from __future__ import annotations

from collections.abc import Callable
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import fold_groups
from ..functions.substrings import take_all, take_any
from ..functions.text import key


def _within(a: str, b: str) -> bool:
    return a in b or b in a


#: Which fields of a prediction and a gold row have to be within each other, and whether pages must agree. "norm" counts only
#: where gold has one.
MATCHES: dict[str, Callable[[list[dict], list[dict]], list[int | None]]] = {
    "rule": lambda p, g: take_any(p, g, [("text", "text", False), ("norm", "norm", True)], itemgetter("page")),
    "model": lambda p, g: take_any(p, g, [("text", "text", False)], itemgetter("page")),
    "entity": lambda p, g: take_any(p, g, [("text", "text", False), ("text", "norm", True)]),
    "relation": lambda p, g: take_all(p, g, [("text", "text"), ("norm", "norm")]),
}
#: Which columns a match reads; others don't reach Python.
READ = {"rule": ["page", "text", "norm"], "model": ["page", "text"], "entity": ["text", "norm"], "relation": ["text", "norm"]}
COUNTS = "document_id string, category string, tp long, fp long, fn long"


def matched_pairs(predicted: DataFrame, gold: DataFrame, match: str) -> DataFrame:
    """Counts per document and category of a greedy one-to-one match: each prediction in order takes the first gold row that
    is free and fits. A maximum matching could differ, so the order is kept; the groups are a document's rows of a category.

    predicted and gold: document_id, category, pos, page, text, norm.
    """
    take = MATCHES[match]

    def fold(group: tuple, rows: list[dict]) -> list[tuple]:
        own, known = ([r for r in rows if r["is_gold"] == x] for x in (False, True))
        tp = sum(k is not None for k in take(own, known))
        return [(*group, tp, len(own) - tp, len(known) - tp)]

    read = [c if c == "page" else F.coalesce(c, F.lit("")).alias(c) for c in READ[match]]
    return fold_groups(_both(predicted, gold, "document_id", "category", "pos", *read), ["document_id", "category"], ["is_gold", "pos"], fold, COUNTS)


def _both(predicted: DataFrame, gold: DataFrame, *columns: str | Column) -> DataFrame:
    return predicted.select(F.lit(False).alias("is_gold"), *columns).union(gold.select(F.lit(True).alias("is_gold"), *columns))


def scores(counts: DataFrame, empty: str = "null") -> DataFrame:
    """precision, recall and f1 of tp, fp, fn. empty: what stands for nothing over nothing: "one" (unrounded, 1 only where
    there is no tp either), "zero" (four digits), or "null" (four digits; null only if nothing was there at all)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(rest: Column) -> Column:
        value = tp / (tp + rest)
        if empty == "one":
            return F.when(tp + rest > 0, value).otherwise(1.0)
        value = F.when(tp + rest > 0, F.round(value, 4)).otherwise(0.0)
        return value if empty == "zero" else F.when(tp + fp + fn > 0, value)

    rows = counts.withColumn("precision", share(fp)).withColumn("recall", share(fn))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(0.0)
    if empty != "one":
        f1 = F.round(f1, 4)
    return rows.withColumn("f1", f1 if empty != "null" else F.when(p.isNotNull(), f1))


def by_category(pairs: DataFrame) -> DataFrame:
    """Sums per category and over all."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    counts = pairs.groupBy("category").agg(*sums)
    # The sums are made once: each counts for its category and for all. All have a row even where there is nothing to count.
    both = F.explode(F.array(F.struct(F.lit(False).alias("all"), "category"), F.struct(F.lit(True).alias("all"), F.lit("OVERALL").alias("category"))))
    rows = counts.select(both.alias("of"), "tp", "fp", "fn").select("of.*", "tp", "fp", "fn")
    none = [F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    rows = rows.union(pairs.sparkSession.range(1).select(F.lit(True), F.lit("OVERALL"), *none))
    return rows.groupBy("all", "category").agg(*sums).drop("all")


def resolution(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: pairs that the system put together or apart, as gold has it.

    entities: canonical_id, pos, texts (array; name, aliases, mentions): of several entities with a text the last counts.
    pairs: pair_id, text_1, text_2, are_equivalent.
    """
    texts = entities.select("canonical_id", "pos", F.explode("texts").alias("t")).withColumn("t", key(F.col("t"))).where("t <> ''").groupBy("t").agg(F.max_by("canonical_id", "pos").alias("id"))
    side = lambda n: texts.select(F.col("t").alias(f"k{n}"), F.col("id").alias(f"id{n}"))
    rows = pairs.withColumn("k1", key(F.col("text_1"))).withColumn("k2", key(F.col("text_2"))).join(side(1), "k1", "left").join(side(2), "k2", "left")
    same = F.coalesce(F.col("id1") == F.col("id2"), F.lit(False))
    is_same = F.col("are_equivalent")
    out = rows.agg(F.count_if(is_same & same).alias("tp"), F.count_if(~is_same & same).alias("fp"), F.count_if(is_same & ~same).alias("fn"), F.count_if(~is_same & ~same).alias("tn"))
    return scores(out).withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4))


def temporal(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: events matched by description (greedy, as above), of these with the same date, and with a date in part.

    predicted and gold: document_id, pos, description, date.
    """

    def fold(group: tuple, rows: list[dict]) -> list[tuple]:
        own, known = ([r for r in rows if r["is_gold"] == x] for x in (False, True))
        dates = [(known[k]["date"], p["date"]) for p, k in zip(own, take_any(own, known, [("description", "description", False)]), strict=True) if k is not None]
        both = [(a, b) for a, b in dates if a and b]
        exact = sum(a == b for a, b in both)
        partial = sum(a != b and (_within(a, b) or a[:4] == b[:4]) for a, b in both)
        return [(len(known), len(own), len(dates), exact, partial)]

    rows = _both(predicted, gold, "document_id", "pos", key(F.col("description")).alias("description"), F.coalesce("date", F.lit("")).alias("date"))
    found = fold_groups(rows, ["document_id"], ["is_gold", "pos"], fold, "total_gold long, total_predicted long, matched long, exact_dates long, partial_dates long")
    sums = found.agg(*[F.sum(c).alias(c) for c in found.columns])
    p, r = F.round(F.col("matched") / F.col("total_predicted"), 4), F.round(F.col("matched") / F.col("total_gold"), 4)
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, F.round(2 * (p * r) / (p + r), 4)).otherwise(0.0))


def validation_rate(worst: DataFrame) -> DataFrame:
    """One row: share of items that are invalid. worst: worst_status."""
    bad = F.count_if(F.col("worst_status") == "INVALID")
    n = F.count(F.lit(1))
    return worst.agg(n.alias("total_items"), bad.alias("invalid_items"), F.round(bad / n, 4).alias("invalid_rate"), F.round((n - bad) / n, 4).alias("valid_rate"))


def provenance(items: DataFrame) -> DataFrame:
    """One row: items with a page, with a span in order, with a text, and with all three."""
    page = F.coalesce(F.col("page_number") >= 1, F.lit(False))
    span = F.coalesce(F.col("end_offset") >= F.col("start_offset"), F.lit(False))
    text = F.coalesce(F.trim("text"), F.lit("")) != ""
    n = F.count(F.lit(1))
    full = F.count_if(page & span & text)
    return items.agg(n.alias("total"), F.count_if(page).alias("with_page"), F.count_if(span).alias("with_offsets"), F.count_if(text).alias("with_text"), full.alias("complete"), F.round(full / n, 4).alias("completeness"))


def escalation(candidates: DataFrame, review_items: DataFrame) -> DataFrame:
    """One row: how many candidates went to review."""
    n = candidates.agg(F.count(F.lit(1)).alias("total"))
    e = review_items.agg(F.count(F.lit(1)).alias("escalated"))
    return n.crossJoin(e).select("total", "escalated", F.greatest(F.lit(0), F.col("total") - F.col("escalated")).alias("approved"), F.when(F.col("total") > 0, F.round(F.col("escalated") / F.col("total"), 4)).alias("escalation_rate"))  # one row each


def report_lines(rows: DataFrame) -> DataFrame:
    """A table of metrics as text lines. rows: category, precision, recall, f1."""
    cell = lambda c: F.lpad(F.coalesce(F.format_number(F.col(c), 4), F.lit("n/a")), 8, " ")
    return rows.select("category", F.concat(F.rpad(F.substring("category", 1, 24), 24, " "), F.lit(" |"), cell("precision"), F.lit(" |"), cell("recall"), F.lit(" |"), cell("f1")).alias("line"))

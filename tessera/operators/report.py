"""Findings as documents: one a page, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """A text as it may stand in HTML, within elements and within quoted attributes."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.coalesce(text, F.lit(""))


def html_report(findings: DataFrame) -> DataFrame:
    """page_id, report: a section a severity, the worst first, its findings in the page's order. A page has a bounded number of findings."""
    lit = F.lit
    item = F.concat(lit('<li class="'), "severity", lit('"><code>'), escaped(F.col("selector")), lit("</code> "), "code", lit(": "), escaped(F.col("fix")), lit("</li>"))
    sections = findings.groupBy("page_id", "severity", "severity_rank").agg(F.sort_array(F.collect_list(F.struct("document_index", "code", item.alias("item")))).alias("items"))
    part = F.concat(lit("<section><h2>"), "severity", lit(" ("), F.size("items").cast("string"), lit(")</h2><ul>"), F.array_join(F.transform("items", lambda x: x["item"]), ""), lit("</ul></section>"))
    pages = sections.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("severity_rank", part.alias("part")))).alias("parts"))
    title = F.concat(lit("Page "), F.coalesce(F.col("page_id").cast("string"), lit("")))
    head = F.concat(lit('<!doctype html><html><head><meta charset="utf-8"><title>'), title, lit("</title></head><body><h1>"), title, lit("</h1>"))
    return pages.select("page_id", F.concat(head, F.array_join(F.transform("parts", lambda x: x["part"]), ""), lit("</body></html>")).alias("report"))

"""From pages to their findings: one parse, one shuffle by page, one ordered list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import dims
from tessera.operators.decide import findings
from tessera.operators.groups import detect_groups
from tessera.operators.rules import predict, signals, visible
from tessera.sources import forest


def fields(pages: DataFrame, now_year: int = 2026) -> DataFrame:
    """What an audit reads of ``pages`` (page_id, html): a row a control, blind spot or canvas, with signals, group_role and group_id.

    A page's groups are found over all its controls, hidden ones too. Canvases stand behind the controls."""
    return detect_groups(signals(forest.nodes(pages).filter("kind <> 'page'")), now_year)


def incomplete_split() -> Column:
    """Whether a row is the first half of a split expiry whose halves do not both declare what they hold."""
    group = Window.partitionBy("page_id", "group_id")
    half = F.col("group_role").isin("cc_exp_month", "cc_exp_year")
    wanted = F.when(F.col("group_role") == "cc_exp_month", "cc-exp-month").otherwise("cc-exp-year")
    right = F.every(~F.coalesce(half, F.lit(False)) | F.coalesce(F.col("declared.token") == wanted, F.lit(False))).over(group)
    return F.coalesce(half & ~right & (F.col("document_index") == F.min("document_index").over(group)), F.lit(False))


def audit_pages(pages: DataFrame, key: DataFrame | None = None, honeypots: bool = False, thresholds: tuple[float, float] = dims.RULE_THRESHOLDS) -> DataFrame:
    """All findings of ``pages`` in order (finding_ordinal, from 1, on each page): of controls, blind spots, canvases and split
    expiries; with an answer key (page_id, selector, expected) also where a prediction differs from it.

    Honeypots are audited on request only. A page has at most 500 controls, so its window is bounded."""
    rows = fields(pages)
    predicted = predict(rows if honeypots else visible(rows))
    predicted = predicted.withColumn("split", incomplete_split())
    more = F.array(F.when(F.col("split"), "SPLIT_FIELD"))
    if key is not None:
        predicted = predicted.join(key.select("page_id", "selector", "expected"), ["page_id", "selector"], "left")
        more = F.concat(more, F.array(F.when(F.col("expected") != F.col("label"), "KEY_MISMATCH")))
    found = findings(predicted, thresholds, more)
    order = Window.partitionBy("page_id").orderBy("document_index", "severity_rank", "code", "selector")
    return found.withColumn("finding_ordinal", F.row_number().over(order))


def page_notes(pages: DataFrame) -> DataFrame:
    """page_id, controls_seen, roots, truncated, unreadable_frames: what an audit of the page should say about its own limits."""
    return forest.nodes(pages, "page_id", "kind", "controls_seen", "roots", "truncated", "unreadable_frames").filter("kind = 'page'").select("page_id", "controls_seen", "roots", "truncated", "unreadable_frames")

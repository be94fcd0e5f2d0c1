"""The rule classifier: tiers of attribute and wording rules, decided in the control's own row."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import dims
from tessera.functions.text import declaration, identifier_tokens, label_source, tokens

LABEL_SOURCES = ("label_for", "label_ancestor", "aria_label", "aria_labelledby_text", "title", "placeholder")
_MATCHES = "array<struct<pos:int,label:string,weight:int>>"


#: What identifies a control and what surrounds it, in order; columns that a table lacks say nothing.
IDENTIFIER_SOURCES = ("name", "element_id", "css_classes", "data_keys", "framework_values")
CONTEXT_SOURCES = ("preceding_text", "legend", "section_heading", "form_accessible_name", "aria_describedby_text")


def signals(controls: DataFrame) -> DataFrame:
    """Controls with label_source, the token streams and the parsed declaration; null texts are not blank ones."""
    known = dict(controls.dtypes)
    texts = [F.array_join(c, " ") if known[c].startswith("array") else F.col(c) for c in IDENTIFIER_SOURCES if c in known]
    made = F.struct(
        label_source(*LABEL_SOURCES).alias("label_source"),
        F.array_join(tokens(F.coalesce(*map(F.col, LABEL_SOURCES))), " ").alias("label_stream"),
        F.array_join(F.concat(*map(identifier_tokens, texts)), " ").alias("identifier_stream"),
        F.array_join(F.concat(*(tokens(F.col(c)) for c in CONTEXT_SOURCES if c in known)), " ").alias("context_stream"),
        declaration(F.col("autocomplete_raw")).alias("declared"),
    )
    return controls.select("*", F.inline(F.array(made)))  # a generator: later uses read columns and do not repeat the work


def visible(controls: DataFrame) -> DataFrame:
    """The controls without honeypots: those that the page hides by style, size or place. Unknown is visible."""
    traps = [c for c in ("style_hidden", "zero_size", "offscreen") if c in controls.columns]
    return controls.filter(~F.greatest(*(F.coalesce(c, F.lit(False)) for c in [*traps, *traps]))) if traps else controls


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@functools.cache
def wording_sql(stream: str) -> str:
    """SQL for the wording rules that a token stream meets, in rule order: those whose phrases are among its runs of tokens.

    A set of all phrases sorts the runs out; what is left, mostly nothing, is looked up. (One text, as an expression of
    hundreds of literals is slow to build from Python.)"""
    phrases = dims.wording_phrases()
    most = max(len(p.split()) for p in phrases)
    runs = ", ".join(f"IF(size(w) >= {n}, transform(sequence(1, size(w) - {n - 1}), k -> concat_ws(' ', slice(w, k, {n}))), array())" for n in range(2, most + 1))
    hits = f"filter(transform(array(split({stream}, ' ')), w -> concat(w, {runs}))[0], run -> run IN ({', '.join(map(_text, phrases))}))"
    known = json.dumps({p: [{"pos": k, "label": label, "weight": weight} for k, label, weight in met] for p, met in phrases.items()}, ensure_ascii=False)
    looked_up = f"array_sort(array_distinct(flatten(transform(h, run -> from_json({_text(known)}, 'map<string,{_MATCHES}>')[run]))))"
    return f"coalesce(IF({stream} = '', NULL, transform(array({hits}), h -> IF(size(h) > 0, {looked_up}, NULL))[0]), cast(array() AS {_MATCHES}))"


def wording_matches(stream: str) -> Column:
    """The wording rules that a token stream (in SQL) meets, in rule order."""
    return F.expr(wording_sql(stream))


def attribute_matches(columns: list[str]) -> Column:
    hits = [
        F.when(F.col(attribute) == value, F.struct(F.lit(k).alias("pos"), F.lit(label).alias("label"), F.lit(weight).alias("weight")))
        for k, (attribute, value, label, weight, _) in enumerate(dims.INTRINSIC)
        if attribute in columns
    ]
    return F.array_compact(F.array(*hits)).cast(_MATCHES)


def verdict(matches: Column, tier: str) -> Column:
    """The tier's decision: the label whose greatest weight is greater than every other label's; null on ties."""

    def decide(found: Column) -> Column:
        top = F.array_max(F.transform(found, lambda m: m["weight"]))
        winners = F.array_distinct(F.transform(F.filter(found, lambda m: m["weight"] == top), lambda m: m["label"]))
        rest = F.filter(found, lambda m: (m["weight"] < top) & (m["label"] != winners[0]))
        second = F.array_min(F.transform(rest, lambda m: F.struct((-m["weight"]).alias("w"), m["pos"].alias("p"), m["label"].alias("label"))))
        return F.when(
            F.size(winners) == 1,
            F.struct(winners[0].alias("label"), F.lit(dims.TIERS[tier]).alias("confidence"), F.lit(tier).alias("tier"), second["label"].alias("runner_up")),
        )

    return F.get(F.transform(F.filter(F.array(matches), lambda f: F.size(f) > 0), decide), F.lit(0))


#: The wording tiers in order, with the stream that each reads, in SQL.
_STREAMS = (
    ("label", "IF(label_source = 'placeholder', '', label_stream)"),
    ("identifier", "identifier_stream"),
    ("placeholder", "IF(label_source = 'placeholder', label_stream, '')"),
    ("context", "context_stream"),
)


def _steps(controls: DataFrame) -> list[tuple[str, Column]]:
    """The tiers in order with the rules that a control meets there."""
    return [("intrinsic", attribute_matches(controls.columns)), *((tier, wording_matches(stream)) for tier, stream in _STREAMS)]


def with_evidence(predicted: DataFrame) -> DataFrame:
    """Predictions and signals: tier:label of every rule met up to the deciding tier, in rule order, each once."""
    steps = _steps(predicted)
    names = [tier for tier, _ in steps]
    last = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("tier")), F.lit(0).cast("long")), F.lit(len(names)))

    def named(tier: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.concat(F.lit(f"{tier}:"), m["label"]))

    none = F.array().cast("array<string>")
    met = F.flatten(F.array(*(F.when(last > k, named(tier, found)).otherwise(none) for k, (tier, found) in enumerate(steps))))
    blind = F.array(F.concat(F.lit("undetectable:"), F.col("undetectable_reason")))
    return predicted.withColumn("signals", F.when(F.col("undetectable_reason").isNotNull(), blind).otherwise(F.array_distinct(met)))


def shown(signals: Column, most: int = 6) -> Column:
    """The first signals in words, and how many more there are."""
    more = F.when(F.size(signals) > most, F.concat(F.lit(" and "), (F.size(signals) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(signals, 1, most), ", "), more)


def _decision(met: str, tier: str) -> str:
    """verdict() as SQL text, for rules met that are SQL text."""
    second = "array_min(transform(filter(met, m -> m.weight < top AND m.label <> winners[0]), m -> named_struct('w', -m.weight, 'p', m.pos, 'label', m.label))).label"
    one = f"named_struct('label', winners[0], 'confidence', cast({dims.TIERS[tier]} AS double), 'tier', '{tier}', 'runner_up', {second})"
    winners = "array_distinct(transform(filter(met, m -> m.weight = top), m -> m.label))"
    decided = f"transform(array(array_max(transform(met, m -> m.weight))), top -> transform(array({winners}), winners -> IF(size(winners) = 1, {one}, NULL))[0])[0]"
    return f"transform(array({met}), met -> IF(size(met) > 0, {decided}, NULL))[0]"


def predict(controls: DataFrame) -> DataFrame:
    """Controls (with signals) and label, confidence, tier, runner_up. A later tier is evaluated only where the earlier ones
    leave a control open; blind spots are UNKNOWN at 0."""
    nothing = "named_struct('label', 'UNKNOWN', 'confidence', cast(0 AS double), 'tier', 'none', 'runner_up', cast(NULL AS string))"
    tiers = ", ".join([_decision("met_intrinsic", "intrinsic"), *(_decision(wording_sql(stream), tier) for tier, stream in _STREAMS)])
    made = F.expr(f"IF(undetectable_reason IS NOT NULL, {nothing}, coalesce({tiers}, {nothing}))")
    matched = controls.withColumn("met_intrinsic", attribute_matches(controls.columns))
    return matched.select(*controls.columns, F.inline(F.array(made)))  # as in signals()

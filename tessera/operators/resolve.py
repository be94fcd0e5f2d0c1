"""Resolving selectors: which elements of a page a selector names, through frames and shadow roots.

A selector's boundaries name its root; within the root its last step picks candidates by an equality join (id, name, or tag
and place), and its steps are folded over each candidate's own path from the root: a child step needs the element before, a
descendant step any before it. So a page's selectors and elements meet once, whatever the number of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = "array<struct<child:boolean,tag:string,id:string,name:string,nth:int>>"
_TOKENS = r'(> )?((?:[^ "]|"[^"]*")+)'


def parts(selector: Column) -> Column:
    """root (the selector's way through frames and shadow roots), inner (what is looked for there). A blind frame is named
    by its element: what stands in ``frame[...]``."""
    framed = F.when(selector.rlike(r"^frame\[[^\[\]]*\]$|^frame\[.*\]\]?$") & ~selector.rlike(r"\] >> "), F.regexp_extract(selector, r"^frame\[(.*)\]$", 1)).otherwise(selector)
    last = F.regexp_extract(framed, r"^(.*) >>>? (?!.* >>>? )(.*)$", 2)
    root = F.regexp_extract(framed, r"^(.*) >>>? (?!.* >>>? )(.*)$", 1)
    return F.struct(root.alias("root"), F.when(last != "", last).otherwise(framed).alias("inner"))


def steps(inner: Column) -> Column:
    """The steps of a selector: ``#id``, ``tag``, ``[name="..."]``, ``:nth-of-type(n)`` and what joins them; nulls ask for nothing."""
    blank = lambda x: F.nullif(x, F.lit(""))

    def step(token: Column) -> Column:
        own = F.regexp_replace(token, "^> ", "")
        is_id = own.startswith("#")
        plain = F.regexp_replace(own, r'\[name="[^"]*"\]', "")
        return F.struct(
            token.startswith("> ").alias("child"),
            F.when(~is_id, blank(F.regexp_extract(plain, r"^([A-Za-z][\w-]*)", 1))).alias("tag"),
            F.when(is_id, F.substring(own, 2, 1 << 20)).alias("id"),
            F.when(~is_id, blank(F.regexp_extract(own, r'\[name="([^"]*)"\]', 1))).alias("name"),
            F.when(~is_id, F.regexp_extract(plain, r":nth-of-type\((\d+)\)", 1).try_cast("int")).alias("nth"),
        )

    return F.transform(F.regexp_extract_all(inner, F.lit(_TOKENS), F.lit(0)), step).cast(STEPS)


def _named(step: Column) -> Column:
    """The strongest thing that a step asks for, as a text."""
    return F.coalesce(F.concat(F.lit("#"), step["id"]), F.concat(F.lit("="), step["name"]), F.concat(step["tag"], F.lit(":"), F.coalesce(step["nth"].cast("string"), F.lit("*"))))


def _met(path: Column, wanted: Column) -> Column:
    """Whether the last element of a path is what the steps lead to."""

    def fold(reached: Column, s: Column) -> Column:
        def holds(i: Column) -> Column:
            e = path[i - 1]
            same = lambda name: s[name].isNull() | F.coalesce(e[name] == s[name], F.lit(False))
            joined = F.when(s["child"], F.array_contains(reached, i - 1)).otherwise(i > F.array_min(reached))
            return same("tag") & same("id") & same("name") & same("nth") & F.coalesce(joined, F.lit(False))

        return F.filter(F.sequence(F.lit(1), F.size(path)), holds)

    return F.array_contains(F.aggregate(wanted, F.array(F.lit(0)), fold), F.size(path))


def resolve(elements: DataFrame, selectors: DataFrame) -> DataFrame:
    """page_id, selector, ordinal, and the columns tag, element_id of each element that a selector (page_id, selector) names.

    ``elements``: page_id, root, ordinal, path (array of tag, id, name, nth from the root down to the element)."""
    asked = selectors.select("page_id", "selector").distinct().select("*", parts(F.col("selector")).alias("p")).select("page_id", "selector", "p.root", steps(F.col("p.inner")).alias("steps"))
    asked = asked.withColumn("key", _named(F.element_at("steps", -1)))
    own = F.element_at("path", -1)
    keys = F.array_distinct(F.array_compact(F.array(F.concat(F.lit("#"), own["id"]), F.concat(F.lit("="), own["name"]), F.concat(own["tag"], F.lit(":"), own["nth"].cast("string")), F.concat(own["tag"], F.lit(":*")))))
    known = elements.select("page_id", "root", "ordinal", "path", F.explode(keys).alias("key"))
    met = asked.join(known, ["page_id", "root", "key"]).filter(_met(F.col("path"), F.col("steps")))
    return met.select("page_id", "selector", "ordinal", own["tag"].alias("tag"), own["id"].alias("element_id"))


def resolution(elements: DataFrame, selectors: DataFrame) -> DataFrame:
    """page_id, selector, n_elements, tag, element_id: how many elements each selector names (one is right), and the first of them."""
    found = resolve(elements, selectors).groupBy("page_id", "selector").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ordinal", "tag", "element_id")).alias("first"))
    joined = selectors.select("page_id", "selector").distinct().join(found, ["page_id", "selector"], "left")
    return joined.select("page_id", "selector", F.coalesce("n", F.lit(0)).alias("n_elements"), "first.tag", "first.element_id")

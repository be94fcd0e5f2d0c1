"""Controls as JSON documents: one nested form, written with its keys in order at every depth, read strictly or with defaults.

The form is data (MEMBERS). Writing is ``to_json`` of a struct in the order of the keys; reading goes through variants, so a broken
member costs itself and not its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The members of a document and their kinds; a question mark: may be null; an object: nested.
MEMBERS: dict = {
    "autocomplete_raw": "string?", "css_classes": "strings", "data_keys": "strings", "disabled": "bool", "document_index": "int", "element_id": "string?", "fieldset_index": "int?", "form_index": "int?",
    "frame_path": "strings", "group_id": "string?", "group_role": "string?", "input_type": "string?", "inputmode": "string?", "maxlength": "int?", "name": "string?", "option_labels": "strings", "option_values": "strings",
    "pattern": "string?", "readonly": "bool", "required": "bool", "selector": "string", "shadow_path": "strings", "tag": "string",
    "text": {name: "string?" for name in sorted(("label_for", "label_ancestor", "aria_label", "aria_labelledby_text", "aria_describedby_text", "title", "placeholder", "preceding_text", "legend", "section_heading", "form_accessible_name"))},
    "undetectable_reason": "string?",
}
_TYPES = {"string": "string", "int": "int", "bool": "boolean", "strings": "array<string>"}
_DEFAULTS = {"string": "''", "int": "0", "bool": "false", "strings": "cast(array() AS array<string>)"}


def written(members: dict = MEMBERS) -> Column:
    """A control's columns as canonical JSON: keys in order at every depth, nulls said, no blanks. Nested members are columns too."""

    def struct(members: dict) -> Column:
        of = lambda name, kind: struct(kind) if isinstance(kind, dict) else F.coalesce(F.col(name).cast(_TYPES[kind]), F.expr(_DEFAULTS[kind])) if not kind.endswith("?") else F.col(name).cast(_TYPES[kind[:-1]])
        return F.struct(*(of(name, members[name]).alias(name) for name in sorted(members)))

    return F.to_json(struct(members), {"ignoreNullFields": "false"})


def _kind(of: Column) -> Column:
    """What a variant of a schema holds, in the words of MEMBERS; an absent one is 'absent'."""
    return (
        F.when(of.isNull(), "absent").when(of == "VOID", "null").when(of == "STRING", "string").when(of == "BOOLEAN", "bool").when(of.rlike("^(BIGINT|DECIMAL\\(\\d+,0\\))$"), "int")
        .when(of.isin("ARRAY<STRING>", "ARRAY<VOID>"), "strings").when(of.startswith("OBJECT"), "object").otherwise("other")
    )


def _paths(members: dict, path: str = "$") -> list[str]:
    return [x for name, kind in members.items() for x in (f"{path}.{name}", *(_paths(kind, f"{path}.{name}") if isinstance(kind, dict) else ()))]


def read(rows: DataFrame, members: dict = MEMBERS, content: str = "content") -> DataFrame:
    """``rows`` with ``problem`` and ``document``. problem: why a strict reader refuses the text (not_json, not_object, or the first
    member, by name, that is missing, of another kind or unknown), else null. document: a struct of what can be read, defaults for the rest."""
    places = {path: k for k, path in enumerate(("$", *_paths(members)))}
    # Generators, as in rules.signals(): a text is parsed once, and a member's kind is found once.
    parsed = rows.select("*", F.inline(F.array(F.struct(F.try_parse_json(content).alias("variant")))))
    found_at = F.array(*(F.schema_of_variant(F.try_variant_get("variant", path, "variant")) for path in places))
    parsed = parsed.select("*", F.inline(F.array(F.struct(F.transform(found_at, _kind).alias("variant_kinds")))))

    def at(path: str) -> Column:
        return F.col("variant_kinds")[places[path]]

    def walk(members: dict, path: str) -> tuple[list[Column], Column]:
        problems, values = [], []
        for name in sorted(members):
            kind, here = members[name], f"{path}.{name}"
            found, said = at(here), here[2:]
            if isinstance(kind, dict):
                inner, value = walk(kind, here)
                problems += [F.when(found == "absent", f"{said}: missing").when(found != "object", f"{said}: object expected"), *inner]
            else:
                plain, optional = kind.rstrip("?"), kind.endswith("?")
                fits = (found == plain) | (found == "null") & F.lit(optional)
                problems.append(F.when(found == "absent", f"{said}: missing").when(~fits, f"{said}: {plain} expected"))
                value = F.when(found == plain, F.try_variant_get("variant", here, _TYPES[plain]))
                value = value if optional else F.coalesce(value, F.expr(_DEFAULTS[plain]))
            values.append(value.alias(name))
        keys = F.map_keys(F.try_variant_get("variant", path, "map<string,variant>"))
        unknown = F.array_min(F.array_except(keys, F.array(*map(F.lit, members))))
        prefix = f"{path[2:]}." if path != "$" else ""
        problems.append(F.when(unknown.isNotNull(), F.concat(F.lit(prefix), unknown, F.lit(": unknown"))))
        return problems, F.struct(*values)

    problems, document = walk(members, "$")
    whole = at("$")
    first = F.when(whole == "absent", "not_json").when(whole != "object", "not_object").otherwise(F.coalesce(*problems))
    return parsed.withColumns({"problem": first, "document": document}).drop("variant", "variant_kinds")


def refused(rows: DataFrame) -> DataFrame:
    """The strict reader's end: rows that were read with a problem stop the query, naming it."""
    return rows.withColumn("document", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("descriptor: "), "problem"))).otherwise(F.col("document")))

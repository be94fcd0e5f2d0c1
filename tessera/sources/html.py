"""Static HTML: pages to element rows and form controls, parsed in Arrow batches (no operator of Spark parses markup)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, subtrees that hold no controls, input types and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style template noscript svg".split())
NO_CONTROL = frozenset("hidden submit button image reset".split())
ROLES = frozenset("textbox combobox listbox searchbox spinbutton checkbox radio switch slider".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OWN_TEXT = frozenset("select optgroup option textarea button script style".split())
#: Element rows after which a batch of whole pages goes back to Spark.
MOST_ROWS = 4096
#: Elements that get a selector.
ADDRESSED = frozenset("input select textarea canvas".split())

ELEMENTS = "page_id string, ordinal int, parent int, tag string, nth int, element_id string, heading string, attributes map<string,string>, text string, skipped boolean, label_ancestor string, aria_labelledby_text string, selector string"

#: Ids that a framework made up: four digits in a row, or eight hexadecimal digits between delimiters.
GENERATED = re.compile(r"\d{4}|(?<![0-9A-Za-z])[0-9a-f]{8,}(?![0-9A-Za-z])")


class _Tree(HTMLParser):
    """Element rows in document order; end tags close up to their match, void elements hold nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.of_type: dict[tuple[int, str], int] = {}
        self.heading: str | None = None
        self.pieces: list[tuple[int, str]] = []
        self.span: list[list[int | None]] = []
        self.label: list[int | None] = []
        self.form: list[int | None] = []

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else -1
        nth = self.of_type[parent, tag] = self.of_type.get((parent, tag), 0) + 1
        own = {k: v or "" for k, v in reversed(attrs)}
        skipped = tag in SKIPPED or parent >= 0 and self.rows[parent]["skipped"]
        self.rows.append({"ordinal": len(self.rows), "parent": parent, "tag": tag, "nth": nth, "element_id": own.get("id"), "heading": self.heading, "attributes": own, "text": "", "skipped": skipped})
        self.label.append(len(self.rows) - 1 if tag == "label" else self.label[parent] if parent >= 0 else None)
        self.form.append(len(self.rows) - 1 if tag == "form" else self.form[parent] if parent >= 0 else None)
        self.span.append([len(self.pieces), len(self.pieces) if tag in VOID else None])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]]["tag"] == tag:
                if tag in HEADINGS:
                    self.heading = " ".join(self.rows[self.open[k]]["text"].split())
                for closed in self.open[k:]:
                    self.span[closed][1] = len(self.pieces)
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open:  # own text; headings and labels also take their descendants'
            self.pieces.append((self.open[-1], data))
            self.rows[self.open[-1]]["text"] += data
            for k in self.open[:-1]:
                if self.rows[k]["tag"] in HEADINGS or self.rows[k]["tag"] in ("label", "legend"):
                    self.rows[k]["text"] += data

    def whole_text(self, ordinal: int) -> str | None:
        """The text of an element and its descendants, without that of controls in it; None if blank."""
        first, end = self.span[ordinal]
        own = "".join(data for at, data in self.pieces[first:end] if at == ordinal or self.rows[at]["tag"] not in OWN_TEXT)
        return " ".join(own.split()) or None

    def name_all(self):
        """Each row's text of the label around it (unless that is for another one) and of the elements it names."""
        by_id: dict[str, int] = {}
        for row in self.rows:
            by_id.setdefault(row["element_id"], row["ordinal"])
        of_label: dict[int, str | None] = {}
        for row, label in zip(self.rows, self.label, strict=True):
            own = row["tag"] == "label" or label is None or "for" in self.rows[label]["attributes"]
            if not own and label not in of_label:
                of_label[label] = self.whole_text(label)
            row["label_ancestor"] = None if own else of_label[label]
            named = [self.whole_text(by_id[i]) for i in row["attributes"].get("aria-labelledby", "").split() if i in by_id]
            row["aria_labelledby_text"] = " ".join(filter(None, named)) or None

    def address_all(self):
        """The selector of each control and canvas: its own id, else its name in a named form, else the path from the nearest
        ancestor with an id, else from the named form, else from the document. Ids that repeat or look generated do not count."""
        ids = Counter(row["element_id"] for row in self.rows)
        named = Counter((self.form[row["ordinal"]], row["attributes"].get("name")) for row in self.rows)
        known = lambda i: bool(i) and ids[i] == 1 and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", i) and not GENERATED.search(i)
        for row in self.rows:
            at = row["attributes"]
            row["selector"] = None
            if row["tag"] not in ADDRESSED and "role" not in at and "contenteditable" not in at:
                continue
            form = self.form[row["ordinal"]]
            title = self.rows[form]["attributes"].get("name") if form is not None and form != row["ordinal"] else None
            if known(row["element_id"]):
                row["selector"] = f"#{row['element_id']}"
            elif title and at.get("name") and named[form, at["name"]] == 1:
                row["selector"] = f'form[name="{title}"] [name="{at["name"]}"]'
            else:
                row["selector"] = self.path(row, known, form if title else None)

    def path(self, row: dict, known, form: int | None) -> str:
        steps: list[str] = []
        to_form: tuple[int, str] | None = None
        while True:
            if row["tag"] != "html" or row["parent"] >= 0:
                steps.append(f"{row['tag']}:nth-of-type({row['nth']})")
            if row["parent"] < 0:
                break
            row = self.rows[row["parent"]]
            if known(row["element_id"]):
                return " > ".join([f"#{row['element_id']}", *reversed(steps)])
            if row["ordinal"] == form:
                to_form = len(steps), f'form[name="{row["attributes"]["name"]}"]'
        anchor, kept = (to_form[1], steps[: to_form[0]]) if to_form else ("html", steps)
        return " > ".join([anchor, *reversed(kept)])


def parse(html: str | None) -> list[dict]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree.name_all()
    tree.address_all()
    return tree.rows


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ELEMENTS.split(", ")]
    for batch in batches:
        rows: list[dict] = []
        for page, html in zip(batch["page_id"], batch["html"], strict=True):
            rows += ({"page_id": page, **row} for row in parse(html))
            if len(rows) >= MOST_ROWS:
                yield pd.DataFrame(rows)[columns]
                rows = []
        if rows:
            yield pd.DataFrame(rows)[columns]


def elements(pages: DataFrame) -> DataFrame:
    """One row an element of each page (page_id, html)."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInPandas(_elements, ELEMENTS)
    return rows.withColumn("page_id", F.col("page_id").cast("long"))


def is_control():
    """Whether an element row is a form control."""
    role, kind = F.lower(F.col("attributes")["role"]), F.lower(F.coalesce(F.col("attributes")["type"], F.lit("text")))
    editable = F.col("attributes")["contenteditable"]
    native = (F.col("tag") == "input") & ~kind.isin(*NO_CONTROL) | F.col("tag").isin("select", "textarea")
    return ~F.col("skipped") & (native | F.coalesce(editable != "false", F.lit(False)) | F.coalesce(role.isin(*ROLES), F.lit(False)))


def controls(pages: DataFrame) -> DataFrame:
    """One row a form control with the texts that name it; element rows meet their labels by page and id."""
    rows = elements(pages)
    labels = rows.filter("tag = 'label' and attributes['for'] is not null").groupBy("page_id", F.col("attributes")["for"].alias("element_id")).agg(F.min_by(F.trim(F.regexp_replace("text", r"\s+", " ")), "ordinal").alias("label_for"))
    found = rows.filter(is_control())
    firsts = found.filter("element_id is not null").groupBy("page_id", "element_id").agg(F.min("ordinal").alias("ordinal"))
    named = firsts.join(labels, ["page_id", "element_id"]).select("page_id", "ordinal", "label_for")
    at = F.col("attributes")
    return found.join(named, ["page_id", "ordinal"], "left").select(
        "page_id", "ordinal", "selector", "tag", at["type"].alias("input_type"), at["inputmode"].alias("inputmode"), at["name"].alias("name"), "element_id", "label_for",
        "label_ancestor", at["aria-label"].alias("aria_label"), "aria_labelledby_text", at["title"].alias("title"),
        at["placeholder"].alias("placeholder"), F.col("heading").alias("section_heading"), at["autocomplete"].alias("autocomplete_raw"), at["maxlength"].try_cast("int").alias("maxlength"),
    )

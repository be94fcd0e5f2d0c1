"""Rules by hand-written rows: what labels, identifiers and headings in five languages ask for."""

from tessera.operators import rules

COLUMNS = "selector string, label_for string, placeholder string, name string, element_id string, section_heading string, input_type string, wanted string, tier string"
NULLS = ("label_ancestor", "aria_label", "aria_labelledby_text", "title", "autocomplete_raw", "undetectable_reason")
ROWS = [
    ("メールアドレス", None, None, None, None, None, "email", "label"), ("郵便番号", None, None, None, None, None, "postal-code", "label"), ("姓", None, None, None, None, None, "family-name", "label"),
    ("お名前（必須）", None, None, None, None, None, "name", "label"), ("Ｅｍａｉｌ", None, None, None, None, None, "email", "label"), ("ＺＩＰ　Ｃｏｄｅ", None, None, None, None, None, "postal-code", "label"),
    ("Your E-mail address *", None, None, None, None, None, "email", "label"), ("First Name", None, "lastName", None, None, None, "given-name", "label"), ("Company name", None, None, None, None, None, "organization", "label"),
    ("Straße und Hausnummer", None, None, None, None, None, "address-line1", "label"), ("Code postal", None, None, None, None, None, "postal-code", "label"), ("Fecha de nacimiento", None, None, None, None, None, "bday", "label"),
    (None, None, "ccNumber", None, None, None, "cc-number", "identifier"), (None, None, "ctl00$input_postalCode", None, None, None, "postal-code", "identifier"), (None, "Last name", None, None, None, None, "family-name", "placeholder"),
    (None, None, None, None, "Delivery address", None, "street-address", "context"), ("Password", None, None, None, None, "password", "UNKNOWN", "none"), ("Choose a password", None, None, None, None, "password", "new-password", "label"),
    (None, None, "x", None, None, "email", "email", "intrinsic"), ("name and address", None, None, None, None, None, "COMPOSITE_UNSPLIT", "label"), ("unnamed", None, None, None, None, None, "UNKNOWN", "none"), ("renaming", "", "", "", "", "", "UNKNOWN", "none"),
    ("Surname and first name", None, None, None, None, None, "given-name", "label"), ("Coupon code", None, None, None, None, None, "NOT_AUTOFILLABLE", "label"), ("E MAIL E MAIL", None, None, None, None, None, "email", "label"),
]


def test_wording_by_hand(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f"#{k}", *r) for k, r in enumerate(ROWS)], COLUMNS)
    for name in NULLS:
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    got = {r.selector: (r.label, r.tier) for r in rules.predict(rules.signals(rows)).collect()}
    assert got == {f"#{k}": r[-2:] for k, r in enumerate(ROWS)}

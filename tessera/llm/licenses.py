"""Licence recognition by sentences, in DataFrame functions only.

A text is cut into sentences, each sentence is normalised (lower case, words and version numbers
only) and mapped to the identifier of a known licence sentence; the identifiers, in text order and
each at its first place, are matched against ordered licence rules. The first that fits is the document's
licence; all that fit are its licences, but for those that a more exact one covers. Each document is
handled in its own row, with no Python and no shuffle.

Defined results: null and empty texts and texts without a licence sentence are ``NONE``; texts with
licence sentences that fit no rule are ``UNKNOWN``; repeated rows give equal rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

# Licence sentence identifiers and what their normalised sentences look like.
SENTENCES = (
    ("spdx_mit", r"spdx license identifier mit\b"),
    ("spdx_apache2", r"spdx license identifier apache 2\.0"),
    ("spdx_gpl2_later", r"spdx license identifier gpl 2\.0 or later"),
    ("spdx_gpl2", r"spdx license identifier gpl 2\.0"),
    ("spdx_gpl3", r"spdx license identifier gpl 3\.0"),
    ("spdx_agpl3", r"spdx license identifier agpl 3\.0"),
    ("spdx_lgpl", r"spdx license identifier lgpl (2\.0|2\.1|3\.0)"),
    ("spdx_mpl2", r"spdx license identifier mpl 2\.0"),
    ("spdx_bsd2", r"spdx license identifier bsd 2 clause"),
    ("spdx_bsd3", r"spdx license identifier bsd 3 clause"),
    ("apache2_name", r"\bapache license,? version 2(\.0)?|\bapache (license )?2\.0"),
    ("apache_obtain", r"obtain a copy of the license at"),
    ("apache_as_is", r"distributed on an as is basis without warranties or conditions"),
    ("agpl3_name", r"\baffero general public license\b.*\b3\b"),
    ("lgpl_name", r"\b(lesser|library) general public license\b"),
    ("gpl2_or_later", r"\bgeneral public license\b.*\b2\b.*\bany later version\b"),
    ("gpl3_name", r"(?<!affero )(?<!lesser )\bgeneral public license\b.*\b3\b|\bgpl ?v?3\b"),
    ("gpl2_name", r"(?<!affero )(?<!lesser )\bgeneral public license\b.*\b2\b|\bgpl ?v?2\b"),
    ("mit_name", r"\bmit license\b"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"above copyright notice and this permission notice shall be included"),
    ("as_is", r"software is provided as is without warranty of any kind"),
    ("bsd_name", r"\bbsd (2 clause |3 clause )?license\b"),
    ("bsd_redistribute", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"neither the name of .* may be used to endorse or promote"),
    ("mpl2_name", r"\bmozilla public license\b.*\b2(\.0)?"),
    ("cc_by_nc_sa", r"\bcc by nc sa 4\.0|attribution noncommercial sharealike 4\.0"),
    ("cc_by_nc", r"\bcc by nc 4\.0|attribution noncommercial 4\.0"),
    ("cc_by_sa", r"\bcc by sa 4\.0|attribution sharealike 4\.0"),
    ("cc_by", r"\bcc by 4\.0|creative commons attribution 4\.0"),
    ("cc0_name", r"\bcc0\b"),
    ("proprietary", r"\ball rights reserved\b|\bproprietary and confidential\b"),
)
#: Of each of these the first that a sentence meets names it; the other sentences stand for themselves.
FAMILIES = (
    ("spdx_gpl2_later", "spdx_gpl2", "spdx_gpl3", "agpl3_name", "lgpl_name", "gpl2_or_later", "gpl3_name", "gpl2_name"),
    ("cc_by_nc_sa", "cc_by_nc", "cc_by_sa", "cc_by"),
)
# Ordered rules; a rule fits where its sentences occur in this order.
RULES = (
    ("AGPL-3.0", ("agpl3_name",)),
    ("LGPL", ("lgpl_name",)),
    ("GPL-2.0-or-later", ("gpl2_or_later",)),
    ("AGPL-3.0", ("spdx_agpl3",)),
    ("LGPL", ("spdx_lgpl",)),
    ("GPL-2.0-or-later", ("spdx_gpl2_later",)),
    ("GPL-3.0", ("gpl3_name",)),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("GPL-2.0", ("gpl2_name",)),
    ("GPL-2.0", ("spdx_gpl2",)),
    ("Apache-2.0", ("apache2_name", "apache_obtain", "apache_as_is")),
    ("Apache-2.0", ("apache2_name",)),
    ("Apache-2.0", ("spdx_apache2",)),
    ("MPL-2.0", ("mpl2_name",)),
    ("MPL-2.0", ("spdx_mpl2",)),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("BSD-2-Clause", ("spdx_bsd2",)),
    ("BSD", ("bsd_name",)),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_name",)),
    ("MIT", ("spdx_mit",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC0-1.0", ("cc0_name",)),
    ("Proprietary", ("proprietary",)),
)
#: Licences that say nothing more where one of the others is found too; None: where any other is.
COVERED = {"BSD-2-Clause": ("BSD-3-Clause",), "BSD": ("BSD-3-Clause", "BSD-2-Clause"), "GPL-2.0": ("GPL-2.0-or-later",), "Proprietary": None}
#: A sentence without any of these words is none of the known ones.
HINT = r"(?i)licen[sc]e|permission|copyright|redistribution|warrant|\bcc0?[ -]?by|\bcc0\b|\bgpl|apache 2|all rights reserved|proprietary|endorse|creative commons"


def sentences(text: Column) -> Column:
    """Sentences end after . ! ? before white space (not after a version's v.) and at blank lines, whose comment
    marks do not count; a single line end is white space."""
    return F.split(text, r"(?<=[.!?])(?<!\b[Vv]\.)\s+|(?:\r\n?|\n)[ \t/*#;%-]*(?:\r\n?|\n)\s*")


def normalised(sentence: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.lower(sentence), r"(?<=[0-9])\+", " or later"), r"[^\p{L}\p{N}.]+", " ")
    return F.trim(F.regexp_replace(words, r"\.(?=\s|$)|(?<=\s)\.", ""))


def _named(s: Column) -> Column:
    """The identifiers of the licence sentences in a sentence, which may hold several lines, by where they begin."""
    patterns, first_of = dict(SENTENCES), {i: family for family in FAMILIES for i in family}
    found = []
    for family in dict.fromkeys(first_of.get(i, (i,)) for i, _ in SENTENCES):
        hit = F.when(F.lit(False), F.lit(None).cast("struct<at:int,id:string>"))
        for i in family:
            hit = hit.when(s.rlike(patterns[i]), F.struct(F.regexp_instr(s, F.lit(patterns[i])).alias("at"), F.lit(i).alias("id")))
        found.append(hit)
    return F.transform(F.sort_array(F.array_compact(F.array(*found))), lambda f: f["id"])


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order, each once."""
    hinted = F.filter(sentences(text), lambda s: s.rlike(HINT))
    return F.array_distinct(F.flatten(F.transform(F.transform(hinted, normalised), _named)))


def licences(ids: Column) -> Column:
    """The licences of all rules that the identifiers fit, in rule order, without covered ones."""
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    fit = F.array(*(F.when(line.rlike(r".*".join(rf" {i}(?= )" for i in needed)), name) for name, needed in RULES))

    def bare(found: Column) -> Column:
        def stands(name: Column) -> Column:
            covered = F.lit(False)
            for weak, by in COVERED.items():
                more = F.size(found) > 1 if by is None else F.arrays_overlap(found, F.array(*map(F.lit, by)))
                covered = covered | ((name == weak) & more)
            return ~covered

        return F.filter(found, stands)

    none = F.array().cast("array<string>")
    return F.when(F.size(ids) == 0, none).otherwise(F.transform(F.array(F.array_distinct(F.array_compact(fit))), bare)[0])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licences, licence (the first of them) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.when(text.rlike(HINT), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", ids.alias("sentence_ids")).withColumn("licences", licences(F.col("sentence_ids")))
    first = F.when(F.size("sentence_ids") == 0, "NONE").otherwise(F.coalesce(F.get("licences", F.lit(0)), F.lit("UNKNOWN")))
    return rows.withColumn("licence", first)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "licence", F.array_join("licences", ",").alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"))


QUERIES = {"op2_licenses": op2_licenses}
ORACLES = {
    "op2_licenses": r"""
        WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+')) AS sentence FROM documents),
             n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(sentence), '[^\p{L}\p{N}.]+', ' ', 'g'), '\.(\s|$)', '\1', 'g')) AS sentence
                   FROM s WHERE regexp_matches(lower(sentence), 'licen[sc]e|cc by|cc-by|all rights reserved|proprietary')),
             i AS (SELECT doc_id, CASE WHEN regexp_matches(sentence, 'apache license,? version 2') THEN 'apache2_name'
                                       WHEN regexp_matches(sentence, 'general public license.*\b3\b') THEN 'gpl3_name'
                                       WHEN regexp_matches(sentence, '\bmit license\b') THEN 'mit_name'
                                       WHEN regexp_matches(sentence, '\bcc by nc 4\.0') THEN 'cc_by_nc'
                                       WHEN regexp_matches(sentence, '\ball rights reserved\b|\bproprietary and confidential\b') THEN 'proprietary' END AS id FROM n),
             d AS (SELECT DISTINCT doc_id, id FROM i WHERE id IS NOT NULL),
             one AS (SELECT doc_id, min(id) AS id, count(*) AS n FROM d GROUP BY doc_id)
        SELECT doc_id, licence, CASE licence WHEN 'NONE' THEN '' ELSE licence END AS licences, sentence_ids FROM (
        SELECT doc_id, CASE id WHEN 'apache2_name' THEN 'Apache-2.0' WHEN 'gpl3_name' THEN 'GPL-3.0' WHEN 'mit_name' THEN 'MIT' WHEN 'cc_by_nc' THEN 'CC-BY-NC-4.0' WHEN 'proprietary' THEN 'Proprietary' ELSE 'NONE' END AS licence,
               coalesce(id, '') AS sentence_ids
        FROM documents LEFT JOIN one USING (doc_id))
    """
}

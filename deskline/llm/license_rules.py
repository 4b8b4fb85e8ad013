"""Licences by sentence rules.  DataFrame functions only.

Comment marks are taken off and a text is cut into sentences, which may run over
several lines; those that speak of licensing are normalised line by line.  Each
sentence rule in turn takes the lines that it recognises, first those it finds
on one line, then those it finds over several, and leaves its identifier in
their place, so a wrapped notice is read whole and a line has one identifier.
Lines no rule knows have none.  The document's sequence of identifiers is then matched against licence rules in
order: each rule names a licence and takes the identifiers it has used out of
the sequence, so a rule for a longer notice comes before those for its parts.
Everything is a projection of one row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?;]+\s+|\n\s*\n"
COMMENT = r"""(?im)^[ \t]*(?:(?:[#*/%;|>"!]+|<!--|-{2,}|\(\*|dnl\b|rem\b)[ \t]*)+"""  # marks before a line's text
TOPIC = r"(?i)licen[cs]e|copyright|permission|warrant|redistribut|copyleft|public domain|spdx"
# Every text that a sentence rule or TOPIC can recognise has one of these.
HINT = TOPIC.replace("public domain", "domain") + r"|reserved|\bcc0|\bcc\W+by|attribution|clause|neither"
NOISE = r"[^A-Za-z0-9.+-]+"  # becomes one space

# Identifiers of licence sentences, and what a normalised sentence has that means it.
SENTENCES = [
    ("spdx-apache-2.0", r"spdx-license-identifier apache-2\.0"),
    ("spdx-mit", r"spdx-license-identifier mit\b"),
    ("spdx-bsd-3", r"spdx-license-identifier bsd-3-clause"),
    ("spdx-bsd-2", r"spdx-license-identifier bsd-2-clause"),
    ("spdx-gpl-3.0", r"spdx-license-identifier gpl-3\.0"),
    ("spdx-gpl-2.0", r"spdx-license-identifier gpl-2\.0"),
    ("spdx-mpl-2.0", r"spdx-license-identifier mpl-2\.0"),
    ("spdx-other", r"spdx-license-identifier"),
    ("cc-by-nc-sa-4.0", r"\bcc[ -]by-nc-sa[ -]4\.0|attribution-?noncommercial-?sharealike 4\.0"),
    ("cc-by-nc-4.0", r"\bcc[ -]by-nc[ -]4\.0|attribution-?noncommercial 4\.0"),
    ("cc-by-sa-4.0", r"\bcc[ -]by-sa[ -]4\.0|attribution-?sharealike 4\.0"),
    ("cc-by-4.0", r"\bcc[ -]by[ -]4\.0|creative commons attribution 4\.0"),
    ("cc0", r"\bcc0\b|dedicated to the public domain|released into the public domain"),
    ("apache-2-grant", r"licensed under the apache license version 2\.0"),
    ("apache-2-copy", r"you may not use this file except in compliance with the license|you may obtain a copy of the license"),
    ("apache-as-is", r"distributed under the license is distributed on an as is basis"),
    ("lgpl", r"gnu lesser general public license|gnu library general public license"),
    ("agpl-3", r"gnu affero general public license"),
    ("gpl-3-or-later", r"gnu general public license.*version 3.*(any later version)"),
    ("gpl-3", r"gnu general public license,? version 3|version 3 of the gnu general public license"),
    ("gpl-2-or-later", r"gnu general public license.*version 2.*(any later version)"),
    ("gpl-2", r"gnu general public license,? version 2|version 2 of the gnu general public license"),
    ("gpl", r"gnu general public license"),
    ("mpl-2", r"mozilla public license.*2\.0"),
    ("mit-name", r"\bmit license\b"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included"),
    ("isc-grant", r"permission to use copy modify and.or distribute this software for any purpose"),
    ("bsd-name-3", r"\b3-clause bsd|\bbsd 3-clause|new bsd license"),
    ("bsd-name-2", r"\b2-clause bsd|\bbsd 2-clause|simplified bsd license"),
    ("bsd-grant", r"redistribution and use in source and binary forms"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-names", r"neither the name of .* may be used to endorse"),
    ("as-is", r"provided as is.*without warranty|without warranties or conditions of any kind|without any warranty"),
    ("all-rights", r"all rights reserved"),
    ("copyright", r"copyright (c )?[0-9]{4}|copyright \(?c"),
]

# Licences, and the identifiers (each between commas) that make one, first match first.
LICENCES = [
    ("BSD-3-Clause", r",bsd-grant,bsd-source,bsd-binary,bsd-names,|,(bsd-name-3|spdx-bsd-3),"),
    ("BSD-2-Clause", r",bsd-grant,bsd-source,bsd-binary,|,(bsd-name-2|spdx-bsd-2),"),
    ("MIT", r",mit-name,mit-grant,mit-notice,|,mit-grant,mit-notice,|,(mit-name|mit-grant|spdx-mit),"),
    ("ISC", r",isc-grant,"),
    ("Apache-2.0", r",apache-2-grant,apache-2-copy,(apache-2-copy,)?(apache-as-is,)?|,(apache-2-grant|apache-2-copy|spdx-apache-2\.0),"),
    ("AGPL-3.0", r",agpl-3,"),
    ("LGPL", r",lgpl,"),
    ("GPL-3.0-or-later", r",gpl-3-or-later,"),
    ("GPL-3.0", r",(gpl-3|spdx-gpl-3\.0),"),
    ("GPL-2.0-or-later", r",gpl-2-or-later,"),
    ("GPL-2.0", r",(gpl-2|spdx-gpl-2\.0),"),
    ("GPL", r",gpl,"),
    ("MPL-2.0", r",(mpl-2|spdx-mpl-2\.0),"),
    ("CC-BY-NC-SA-4.0", r",cc-by-nc-sa-4\.0,"),
    ("CC-BY-NC-4.0", r",cc-by-nc-4\.0,"),
    ("CC-BY-SA-4.0", r",cc-by-sa-4\.0,"),
    ("CC-BY-4.0", r",cc-by-4\.0,"),
    ("CC0-1.0", r",cc0,"),
    ("Other", r",spdx-other,"),
    ("Proprietary", r",copyright,all-rights,|,all-rights,"),
]

# What is left over from the notices of other licences is no licence of its own.
ONLY_ALONE = ["Proprietary"]


def normalised(sentence: Column) -> Column:
    """The lines of a sentence that have words, each normalised by itself."""
    lines = F.transform(F.split(sentence, r"[\r\n]+", -1), lambda x: F.trim(F.regexp_replace(x, NOISE, " ")))
    joined = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return F.lower(F.regexp_replace(joined, r"[. \n]+$", ""))


def _lines_with(pattern: str) -> str:
    return rf"(?m)^[^\n\x01]*(?:{pattern})[^\n\x01]*$"


def _over_lines(pattern: str) -> str:
    """The pattern where a line may end at any space or gap; a gap does not pass the pattern's own beginning."""
    ways = []
    for way in pattern.split("|"):
        pieces = [re.sub(r"(?<!\\)\.", r"[^\\x01]", piece).replace(" ", r"[ \n]") for piece in way.split(".*")]
        ways.append(rf"(?:(?!{pieces[0]})[^\x01])*".join(pieces))
    return "|".join(ways)


def identifiers(sentence: Column) -> Column:
    """The identifiers of a normalised sentence, in order."""
    for name, pattern in SENTENCES:
        sentence = F.regexp_replace(sentence, _lines_with(pattern), f"\x01{name}\x01")
        sentence = F.regexp_replace(sentence, _lines_with(_over_lines(pattern)), f"\x01{name}\x01")
    return F.regexp_extract_all(sentence, F.lit(r"\x01([^\x01]+)\x01"), F.lit(1))


def licences(documents: DataFrame) -> DataFrame:
    """`doc_id, n_sentences, identifiers, licences` per document.

    n_sentences counts the sentences about licensing, by a word or by a rule
    that knows them; identifiers are the recognised ones in order, licences those of the rules that matched in rule
    order, both comma-joined and empty if there are none.  The line of a copyright holder
    and "all rights reserved" make a licence only where nothing else does.  A rule is used once,
    however often its sentences come; a null text has no sentences.  Every row
    gives one row; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    # Few texts speak of licensing at all, and one pass over the text tells.
    sentences = F.when(text.rlike(HINT), F.split(F.regexp_replace(text, COMMENT, ""), SENTENCE_END, -1))
    sentences = F.transform(F.filter(sentences, lambda s: s.rlike(HINT)), normalised)
    read = F.transform(sentences, lambda s: F.struct(F.regexp_replace(s, "\n", " ").rlike(TOPIC).alias("topic"), identifiers(s).alias("names")))
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(read, lambda s: s["topic"] | (F.size(s["names"]) > 0)).alias("about"))
    found = found.select(
        "doc_id",
        F.coalesce(F.when(F.col("about").isNotNull(), F.size("about")), F.lit(0)).cast("long").alias("n_sentences"),
        F.coalesce(F.array_join(F.flatten(F.transform("about", lambda s: s["names"])), ","), F.lit("")).alias("identifiers"),
    )
    # Each identifier has commas of its own, so that neighbours share none.
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern.replace(",", ",+")).alias("pattern"), F.lit(name in ONLY_ALONE).alias("alone")) for name, pattern in LICENCES])
    start = F.struct(F.concat(F.lit(","), F.replace("identifiers", F.lit(","), F.lit(",,")), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["rest"], rule["pattern"]) & (~rule["alone"] | (F.size(acc["names"]) == 0))
        return F.struct(
            F.when(hit, F.regexp_replace(acc["rest"], rule["pattern"], F.lit(","))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.concat(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"),
        )

    matched = F.when(F.col("identifiers") != "", F.array_join(F.aggregate(rules, start, apply)["names"], ","))
    return found.withColumn("licences", F.coalesce(matched, F.lit("")))

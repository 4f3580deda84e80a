"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences, each normalised (lower case, runs of letters and digits between single blanks) and mapped
to the number of the known licence sentence it equals, or zero.  The numbers in order are matched against rules: an
ordered list of sentence numbers with few foreign sentences between.  The tables are fixed and small, so everything
happens inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as their licences print them, and the rules over them.
SENTENCES = {
    "apache_notice": "Licensed under the Apache License, Version 2.0",
    "apache_notice_the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache_compliance": "you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_as_is": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License",
    "mit_notice": "Released under the MIT License",
    "mit_notice_licensed": "Licensed under the MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
                 "to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_notice_kept": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                       "portions of the Software",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl_free": "This program is free software",
    "gpl3_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                  "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                  "Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                  "following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                 "products derived from this software without specific prior written permission",
    "cc_by": "Licensed under CC BY 4.0",
    "cc_by_sa": "Licensed under CC BY-SA 4.0",
    "cc_by_nc": "Licensed under CC BY-NC 4.0",
    "cc0": "Released under CC0 1.0",
    "all_rights": "All rights reserved",
}
RULES = {
    "Apache-2.0": [["apache_notice"], ["apache_notice_the", "apache_compliance"], ["apache_as_is", "apache_see"]],
    "MIT": [["mit_notice"], ["mit_notice_licensed"], ["mit_grant", "mit_notice_kept"]],
    "GPL-3.0": [["gpl3_notice"], ["gpl_free", "gpl3_terms"]],
    "GPL-2.0": [["gpl_free", "gpl2_terms"]],
    "BSD-2-Clause": [["bsd_grant", "bsd_source", "bsd_binary"]],
    "BSD-3-Clause": [["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]],
    "CC-BY-4.0": [["cc_by"]],
    "CC-BY-SA-4.0": [["cc_by_sa"]],
    "CC-BY-NC-4.0": [["cc_by_nc"]],
    "CC0-1.0": [["cc0"]],
    "all-rights-reserved": [["all_rights"]],
}
#: A rule whose match makes another one's needless: the longer of two that begin alike.
STRONGER = {"BSD-2-Clause": "BSD-3-Clause"}
#: A sentence ends at a line's end, or at one of these marks before a blank or the text's end.
SENTENCE_END = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|[\x0A-\x0D]+"
#: Foreign sentences that may stand between two of a rule's.
GAP = 2


def plain(sentence: str) -> str:
    """A known sentence as a text's sentences are normalised (ASCII, as all known ones are)."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def rule_pattern(rule: list[str], names: list[str], gap: int = GAP) -> str:
    """The rule as a pattern over sentence numbers written ``,3,,0,,4,``."""
    return f"(?:,0,){{0,{gap}}}".join(f",{names.index(s) + 1}," for s in rule)


def sentence_numbers(text: Column, sentences: dict[str, str]) -> Column:
    """Array of the numbers of a text's sentences in order; zero for one that is not known."""
    parts = F.split(F.coalesce(text, F.lit("")), SENTENCE_END)
    known = F.array(*[F.lit(plain(s)) for s in sentences.values()])

    def number(part: Column) -> Column:
        return F.array_position(known, F.trim(F.regexp_replace(F.lower(part), "[^a-z0-9]+", " "))).cast("int")

    return F.transform(F.filter(parts, lambda p: F.length(F.trim(p)) > 0), number)


def scan(docs: DataFrame, text_col: str = "text", sentences: dict[str, str] | None = None,
         rules: dict[str, list[list[str]]] | None = None, gap: int = GAP) -> DataFrame:
    """Adds ``licenses`` (sorted array of the licences whose rules match) and ``sentence_ids`` (those known, in order).

    A null, empty or blank text has neither; matches of one licence count once; repeated rows are scanned each; null
    ids matter nothing; an empty table gives no rows; existing columns of these names are replaced.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    names = list(sentences)
    found = docs.drop("licenses", "sentence_ids", "_numbers").withColumn("_numbers", sentence_numbers(F.col(text_col), sentences))
    sequence = F.concat(F.lit(","), F.array_join(F.col("_numbers").cast("array<string>"), ",,"), F.lit(","))
    found = found.withColumn("_sequence", F.when(F.exists("_numbers", lambda n: n > 0), sequence))
    hits = []
    for licence, ways in sorted(rules.items()):
        pattern = "|".join(rule_pattern(w, names, gap) for w in ways)
        match = F.col("_sequence").rlike(pattern)
        if licence in STRONGER and STRONGER[licence] in rules:
            match = match & ~F.col("_sequence").rlike("|".join(rule_pattern(w, names, gap) for w in rules[STRONGER[licence]]))
        hits.append(F.when(F.coalesce(match, F.lit(False)), licence))
    known = F.array(*map(F.lit, names))
    ids = F.transform(F.filter("_numbers", lambda n: n > 0), lambda n: F.element_at(known, n))
    return found.withColumn("licenses", F.array_compact(F.array(*hits))).withColumn("sentence_ids", ids).drop("_numbers", "_sequence")


def twin_sql(gap: int = GAP) -> str:
    """The scan of ``documents`` in SQL, from the same fixed tables: doc_id, licenses, sentence_ids (joined by commas)."""
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    names = list(SENTENCES)
    known = "[" + ", ".join(text(plain(s)) for s in SENTENCES.values()) + "]"
    match = {k: "regexp_matches(q, " + text("|".join(rule_pattern(w, names, gap) for w in ways)) + ")" for k, ways in RULES.items()}
    cases = ", ".join(f"CASE WHEN {match[k]}" + (f" AND NOT {match[STRONGER[k]]}" if k in STRONGER else "") + f" THEN {text(k)} END" for k in sorted(RULES))
    return f"""
WITH parts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {text(SENTENCE_END)}), lambda p: length(trim(p)) > 0) AS l FROM documents),
numbers AS (SELECT doc_id, list_transform(l, lambda p: coalesce(list_position({known}, trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))), 0)) AS n FROM parts),
sequences AS (SELECT doc_id, n, ',' || array_to_string(n, ',,') || ',' AS q FROM numbers)
SELECT doc_id, coalesce(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ','), '') AS licenses,
  coalesce(array_to_string(list_transform(list_filter(n, lambda x: x > 0), lambda x: [{", ".join(map(text, names))}][x]), ','), '') AS sentence_ids
FROM sequences"""

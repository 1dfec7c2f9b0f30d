"""Licence scan by sentence rules, in Spark's own functions throughout.

The lines of a text are stripped of comment signs and joined, cut into sentences and
lower-cased. Sentences that speak of licensing are mapped to identifiers of known
licence sentences; the sequence of identifiers is matched against ordered rules. A
speaking sentence that is not known is reported as unknown; one that holds several
identifiers gives all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and phrases one of which any known licence sentence holds. Fixed values.
SPEAKS = (
    r"licen[cs]e|copyright|warrant(y|ies)|permission|redistribut|\bliab(le|ility)\b|spdx|public domain|provided [^a-z]?as is|\bgpl\b|endorse or promote|creative commons"
    r"|\bcc[ -]by|\bcc0\b|all rights reserved|\bor (\(?at your option\)?,? )?any later version"
    r"|unless required by applicable law|in no event (shall|will) the"
)
#: Single words one of which any text with such a sentence holds: phrases may run over lines.
MAY_SPEAK = r"licen[cs]e|copyright|warrant|permission|redistribut|\bliab|spdx|public|provided|\bgpl\b|endorse|commons|\bcc\b|\bcc0|reserved|later|applicable|event"

#: What may stand before the licence that is looked for, in a tag's expression or a list of two.
TAG = r"(?:spdx-license-identifier|\blicen[cs]e): ?\(*(?:[a-z0-9.+()-]+ (?:and|or|with) \(*)*"
#: Where a tag's name ends: "mit" is not "mit-0", "gpl-2.0" not "gpl-2.0+".
ENDS = r"(?![a-z0-9+-]|\.[a-z0-9])"
LISTED = r"(?:either (?:of )?)?(?:the )?(?:(?:mit|expat|apache) licen[cs]e,? ?(?:\(?(?:version |v)?2\.0\)?)?,?(?: \([^()]*\))? ?(?:and/or|and|or) (?:the )?)?"
#: A grant that is denied is none.
GRANTED = r"(?<!\bnot )(?<!n't )(?<!\bnever )(?<!\bno longer )"
UNDER = r"(?<!\bnot (?:released|licensed|distributed|available) )(?<!n't (?:released|licensed|distributed|available) )under the (terms of the )?"
PUBLISHED = r",? (as published by the free software foundation[,;] (either )?)?"
#: Known licence sentences: identifier and pattern of the normalised sentence. Fixed values.
SENTENCES = (
    ("spdx_mit", TAG + "mit" + ENDS),
    ("spdx_mit0", TAG + "mit-0" + ENDS),
    ("spdx_apache2", TAG + r"apache-2\.0" + ENDS),
    ("spdx_gpl2", TAG + r"gpl-2\.0(-only)?" + ENDS),
    ("spdx_gpl2_later", TAG + r"gpl-2\.0(-or-later|\+)" + ENDS),
    ("spdx_gpl3", TAG + r"gpl-3\.0(-only)?" + ENDS),
    ("spdx_gpl3_later", TAG + r"gpl-3\.0(-or-later|\+)" + ENDS),
    ("spdx_agpl3", TAG + r"agpl-3\.0(-only|-or-later|\+)?" + ENDS),
    ("spdx_lgpl", TAG + r"lgpl-(2\.0|2\.1|3\.0)(-only|-or-later|\+)?" + ENDS),
    ("spdx_bsd3", TAG + "bsd-3-clause" + ENDS),
    ("spdx_bsd2", TAG + "bsd-2-clause" + ENDS),
    ("spdx_mpl2", TAG + r"mpl-2\.0" + ENDS),
    ("spdx_isc", TAG + "isc" + ENDS),
    ("spdx_unlicense", TAG + "unlicense" + ENDS),
    ("spdx_cc0", TAG + r"cc0-1\.0" + ENDS),
    ("spdx_bsl1", TAG + r"bsl-1\.0" + ENDS),
    ("spdx_epl2", TAG + r"epl-2\.0" + ENDS),
    ("title_apache2", r"apache licen[cs]e,? version 2\.0, january 2004"),
    ("title_gpl2", r"gnu general public licen[cs]e,? version 2, june 1991"),
    ("title_gpl3", r"gnu general public licen[cs]e,? version 3, 29 june 2007"),
    ("title_agpl3", r"gnu affero general public licen[cs]e,? version 3, 19 november 2007"),
    ("title_lgpl", r"gnu lesser general public licen[cs]e,? version (2\.1, february 1999|3, 29 june 2007)"),
    ("title_mpl2", r"mozilla public licen[cs]e,? version 2\.0"),
    ("title_bsl1", r"boost software licen[cs]e - version 1\.0"),
    ("title_epl2", r"eclipse public licen[cs]e - v ?2\.0"),
    ("by_mit", GRANTED + r"(released|licensed|distributed|available) under (the )?(terms of )?" + LISTED + r"(mit|expat) licen[cs]e"),
    ("by_apache2", GRANTED + r"licensed under (the terms of )?" + LISTED + r"apache licen[cs]e,? (version )?2\.0"),
    ("apache_not", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache_copy", r"you may obtain a copy of the licen[cs]e at"),
    ("apache_unless", r"unless required by applicable law or agreed to in writing"),
    ("apache_see", r"see the licen[cs]e for the specific language governing permissions"),
    ("by_gpl3", UNDER + r"gnu general public licen[cs]e" + PUBLISHED + "version 3"),
    ("by_gpl2", UNDER + r"gnu general public licen[cs]e" + PUBLISHED + "version 2"),
    ("by_agpl3", UNDER + r"gnu affero general public licen[cs]e"),
    ("by_lgpl", UNDER + r"gnu (lesser|library) general public licen[cs]e"),
    ("gpl_later", r"\bor (\(?at your option\)?,? )?any later version"),
    ("gpl_hope", r"in the hope that it will be useful, but without any warranty"),
    ("gpl_received", r"you should have received a copy of the gnu (affero |lesser |library )?general public licen[cs]e"),
    ("by_mpl2", r"subject to the terms of the mozilla public licen[cs]e,? v\. ?2\.0"),
    ("by_cc_by_nc_sa", r"\bcc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike"),
    ("by_cc_by_nc_nd", r"\bcc[ -]by-nc-nd|creative commons attribution-noncommercial-noderiv"),
    ("by_cc_by_nc", r"\bcc[ -]by-nc(?!-[sn])|creative commons attribution-noncommercial(?!-[sn])"),
    ("by_cc_by_sa", r"\bcc[ -]by-sa|creative commons attribution-sharealike"),
    ("by_cc_by_nd", r"\bcc[ -]by-nd|creative commons attribution-noderiv"),
    ("by_cc_by", r"\bcc[ -]by\b(?!-[sn])|creative commons attribution(?!-[sn])"),
    ("by_cc0", r"\bcc0\b|public domain dedication"),
    ("mit_grant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included"),
    ("isc_grant", r"permission to use, copy, modify, (and/or|and) distribute this software"),
    ("as_is", r"(software|program|work) is provided [^a-z]?as is[^a-z]?"),
    ("no_liability", r"in no event (shall|will) the (authors|copyright|regents|author)"),
    ("bsd_grant", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"(neither the name|the names? of).*(may|used).*endorse or promote products"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("all_rights", r"all rights reserved"),
    ("copyright", r"copyright (\(c\)|©|[0-9]{4})"),
)

#: Identifiers that begin a notice of their own, by the start of their names.
BEGINS = ("spdx_", "title_", "by_", "mit_grant", "isc_grant", "bsd_grant", "unlicense")
#: Rules in order: licence, the identifiers it takes in their order, and one that must not
#: follow. All stand in one notice: others may lie between, but none that begins another.
#: Fixed values.
RULES = (
    ("MIT", ("spdx_mit",), None),
    ("MIT", ("by_mit",), None),
    ("MIT", ("mit_grant", "mit_notice"), None),
    ("MIT-0", ("spdx_mit0",), None),
    ("ISC", ("spdx_isc",), None),
    ("ISC", ("isc_grant", "as_is"), None),
    ("Apache-2.0", ("spdx_apache2",), None),
    ("Apache-2.0", ("title_apache2",), None),
    ("Apache-2.0", ("by_apache2",), None),
    ("Apache-2.0", ("apache_not", "apache_copy", "apache_unless"), None),
    ("GPL-3.0-or-later", ("spdx_gpl3_later",), None),
    ("GPL-3.0-or-later", ("by_gpl3", "gpl_later"), None),
    ("GPL-3.0", ("spdx_gpl3",), None),
    ("GPL-3.0", ("title_gpl3",), None),
    ("GPL-3.0", ("by_gpl3",), "gpl_later"),
    ("GPL-2.0-or-later", ("spdx_gpl2_later",), None),
    ("GPL-2.0-or-later", ("by_gpl2", "gpl_later"), None),
    ("GPL-2.0", ("spdx_gpl2",), None),
    ("GPL-2.0", ("title_gpl2",), None),
    ("GPL-2.0", ("by_gpl2",), "gpl_later"),
    ("AGPL-3.0", ("spdx_agpl3",), None),
    ("AGPL-3.0", ("title_agpl3",), None),
    ("AGPL-3.0", ("by_agpl3",), None),
    ("LGPL", ("spdx_lgpl",), None),
    ("LGPL", ("title_lgpl",), None),
    ("LGPL", ("by_lgpl",), None),
    ("MPL-2.0", ("spdx_mpl2",), None),
    ("MPL-2.0", ("title_mpl2",), None),
    ("MPL-2.0", ("by_mpl2",), None),
    ("BSD-3-Clause", ("spdx_bsd3",), None),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"), None),
    ("BSD-2-Clause", ("spdx_bsd2",), None),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary"), "bsd_endorse"),
    ("Unlicense", ("spdx_unlicense",), None),
    ("Unlicense", ("unlicense",), None),
    ("BSL-1.0", ("spdx_bsl1",), None),
    ("BSL-1.0", ("title_bsl1",), None),
    ("EPL-2.0", ("spdx_epl2",), None),
    ("EPL-2.0", ("title_epl2",), None),
    ("CC-BY-NC-SA", ("by_cc_by_nc_sa",), None),
    ("CC-BY-NC-ND", ("by_cc_by_nc_nd",), None),
    ("CC-BY-NC", ("by_cc_by_nc",), None),
    ("CC-BY-SA", ("by_cc_by_sa",), None),
    ("CC-BY-ND", ("by_cc_by_nd",), None),
    ("CC-BY", ("by_cc_by",), None),
    ("CC0-1.0", ("spdx_cc0",), None),
    ("CC0-1.0", ("by_cc0",), None),
)

COMMENT = r"(?m)^[ \t]*(//+|/\*+|\*+/?|#+|;+|--+|<!--|%+)[ \t]*"
#: A sentence ends at a stop before white space, or at an empty line; not after the colon
#: of a tag, after "v." before a number, nor at the ";" before the version of a GPL.
STOP = (
    r"((?<!spdx-license-identifier)(?<!\blicense)(?<!\blicence):|(?!(?<=\bv)\.\s+[0-9])\.|[!?]|;(?!\s+(?:either\s+)?version\s+[0-9]))\s+"
    r"|\n\s*\n"
)
BREAK = "\u0001"
UNKNOWN = "unknown"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text that speak of licensing."""
    bare = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), COMMENT, "")
    lower = F.lower(bare)
    ended = F.regexp_replace(lower, STOP, "$1" + BREAK)
    flat = F.regexp_replace(ended, r"\s+", " ")
    return F.filter(F.split(flat, BREAK), lambda s: s.rlike(SPEAKS))


def identifiers(spoken: Column) -> Column:
    """The identifiers that every sentence holds, where they first stand in it.

    Of the patterns of one family the special ones exclude the general one by themselves.
    """

    def known(s: Column) -> Column:
        places = [
            F.struct(F.regexp_instr(s, F.lit(pattern)).alias("at"), F.lit(i).alias("nth"), F.lit(name).alias("name"))
            for i, (name, pattern) in enumerate(SENTENCES)
        ]
        held = F.filter(F.array(*places), lambda p: p["at"] > 0)
        names = F.transform(F.array_sort(held), lambda p: p["name"])
        return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(UNKNOWN)))

    return F.transform(spoken, known)


def rule_pattern(ids: tuple[str, ...], without: str | None = None) -> str:
    """The rule over a joined sequence ' id  id  id '.

    It may match at any place. Between its identifiers stand others of the same notice
    only, so that a search from one place ends where the next notice begins, and the
    time is linear in the length of the sequence.
    """
    others = rf"(?: (?!{'|'.join(BEGINS)})\w+ )"
    pattern = f" {ids[0]} " + "".join(rf"{others}*? {i} " for i in ids[1:])
    return pattern + (rf"(?!{others}*? {without} )" if without else "")


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, sequence, licences, n_sentences and n_unknown of every row.

    ``sequence`` lists the identifiers of the sentences that speak of licensing, in
    order; ``licences`` those whose rule some notice of it holds, in the order of the
    rules. A licence that a sentence denies is not one of them. Missing
    and empty texts, and texts that do not speak of licensing, have none of either.
    Rows are looked at one by one: repeated or missing ids need no care.
    """
    text = docs["text"]
    spoken = F.when(F.lower(text).rlike(MAY_SPEAK), sentences(text)).otherwise(F.array().cast("array<string>"))
    out = docs.select(docs["doc_id"].alias("doc_id"), identifiers(spoken).alias("_found"))
    out = out.withColumn("sequence", F.flatten("_found"))
    joined = F.concat(F.lit(" "), F.array_join("sequence", "  "), F.lit(" "))
    held: dict[str, Column] = {}
    for name, ids, without in RULES:
        match = F.col("_joined").rlike(rule_pattern(ids, without))
        held[name] = held[name] | match if name in held else match
    found = [F.when(match, F.lit(name)) for name, match in held.items()]
    return out.withColumn("_joined", joined).select(
        "doc_id",
        "sequence",
        F.array_compact(F.array(*found)).alias("licences"),
        F.size("_found").cast("long").alias("n_sentences"),
        F.size(F.filter("sequence", lambda s: s == UNKNOWN)).cast("long").alias("n_unknown"),
    )


def op10_licences(spark, sf_dir: str) -> DataFrame:
    """Every document with its licence sentences and licences, joined by commas."""
    found = licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        F.array_join("sequence", ",").alias("sequence"),
        "n_sentences",
        "n_unknown",
    )

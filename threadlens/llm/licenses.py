"""License scans by sentence rules.

A text is cut into lines, and each line is normalised: A-Z lower-cased, every run of other
characters than a-z and 0-9 one blank. Sentences, on one line or wrapped over several, that
belong to a known license text become identifiers. Ordered rules then match runs of
identifiers, more specific ones first, and use up what they match; what no rule uses is
reported as unmatched. Everything happens within a row: no shuffle, whatever a document's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import ascii_lower

# Identifiers of license sentences and patterns of the whole normalised
# sentence. The first pattern that fits names the sentence.
SENTENCES = [
    ("SPDX_TAG", r"spdx license identifier( .+)?"),
    ("COPYRIGHT", r"(portions )?copyright( c)?( (19|20)[0-9]{2}.*| by .+| the .+)"),
    ("ALL_RIGHTS", r"(.* )?all rights reserved"),
    ("APACHE2_REF", r"(.* )?(licensed|released|distributed|available) under the( terms of the)? apache (software )?license( version)? 2( 0)?( the license)?"),
    ("APACHE2_COMPLY", r"you may not use this (file|work|software) except in compliance with the license"),
    ("APACHE2_COPY", r"you may obtain a copy of the license at( http.*)?"),
    ("APACHE2_AS_IS", r"(unless required by applicable law or agreed to in writing )?software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("APACHE2_SEE", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MIT_REF", r"(.* )?(licensed|released|distributed|available) under the( terms of the)? mit licen[sc]e"),
    ("MIT_GRANT", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*"),
    ("MIT_NOTICE", r"the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("MIT_AS_IS", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("MIT_LIABILITY", r"in no event shall the( authors or)? copyright holders?.* be liable for any claim damages or other liability.*"),
    ("ISC_GRANT", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ISC_AS_IS", r"the software is provided as is and the author disclaims all warranties.*"),
    ("BSD_REF", r"(.* )?(licensed|released|distributed|available) under the( terms of the)? (2 clause |3 clause |new |simplified )?bsd licen[sc]e"),
    ("BSD_GRANT", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", r"([0-9a-z] )?redistributions of source code must retain the above copyright notice.*"),
    ("BSD_BINARY", r"([0-9a-z] )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSD_NAMES", r"([0-9a-z] )?neither the names? of .* may be used to endorse or promote products derived from this software.*"),
    ("BSD_AS_IS", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("BSD_LIABILITY", r"in no event shall .* be liable for any direct indirect incidental.*"),
    ("AGPL3_REF", r"(.* )?(licensed|released|distributed|available) under the( terms of the)? gnu affero general public licen[sc]e( version)?( v)? ?3( 0)?.*"),
    ("LGPL_REF", r"(.* )?(licensed|released|distributed|available) under the( terms of the)? gnu lesser general public licen[sc]e.*"),
    ("GPL3_REF", r"(.* )?(licensed|released|distributed|available) under the( terms of the)? gnu general public licen[sc]e( version)?( v)? ?3( 0)?( or.*)?"),
    ("GPL2_REF", r"(.* )?(licensed|released|distributed|available) under the( terms of the)? gnu general public licen[sc]e( version)?( v)? ?2( 0)?( or.*)?"),
    ("GPL_FREE", r"this (program|library|file|software) is free software"),
    ("AGPL3_GRANT", r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3.*"),
    ("LGPL_GRANT", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation.*"),
    ("GPL3_GRANT", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3.*"),
    ("GPL2_GRANT", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2.*"),
    ("GPL_HOPE", r"this (program|library|file|software) is distributed in the hope that it will be useful.*"),
    ("GPL_MORE", r"see the gnu (affero |lesser )?general public license for more details"),
    ("GPL_COPY", r"you should have received a copy of the gnu (affero |lesser )?general public license along with this (program|library|file|software).*"),
    ("MPL2_FORM", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL2_COPY", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("CC0_REF", r"(.* )?(licensed|released|dedicated|available) (under|to the public domain under) (the )?(creative commons zero|cc0)( 1 0)?.*"),
    ("CC_BY_NC_SA_REF", r"(.* )?(licensed|released|available) under (a |the )?(cc by nc sa|creative commons attribution noncommercial sharealike)( [0-9] 0)?.*"),
    ("CC_BY_NC_ND_REF", r"(.* )?(licensed|released|available) under (a |the )?(cc by nc nd|creative commons attribution noncommercial noderivatives)( [0-9] 0)?.*"),
    ("CC_BY_NC_REF", r"(.* )?(licensed|released|available) under (a |the )?(cc by nc|creative commons attribution noncommercial)( [0-9] 0)?.*"),
    ("CC_BY_SA_REF", r"(.* )?(licensed|released|available) under (a |the )?(cc by sa|creative commons attribution sharealike)( [0-9] 0)?.*"),
    ("CC_BY_ND_REF", r"(.* )?(licensed|released|available) under (a |the )?(cc by nd|creative commons attribution noderivatives)( [0-9] 0)?.*"),
    ("CC_BY_REF", r"(.* )?(licensed|released|available) under (a |the )?(cc by|creative commons attribution)( [0-9] 0)?.*"),
    ("UNLICENSE", r"this is free and unencumbered software released into the public domain"),
    ("PUBLIC_DOMAIN", r"(.* )?(is|placed|released) (in|into) the public domain"),
]

# Other forms of the sentences above.
_UNDER = r"(.* )?(licensed|released|distributed|available) under( the| an?)?( terms of( the)?)? "
MORE_FORMS = [
    ("APACHE2_REF", _UNDER + r"apache (software )?(license )?(version )?(v ?)?2( 0)?"),
    ("MIT_REF", _UNDER + r"mit( x11| expat)? licen[sc]e"),
    ("ISC_GRANT", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted.*"),
    ("BSD_REF", _UNDER + r"((2|two|3|three) clause |new |simplified |modified )?bsd( (2|two|3|three) clause)? licen[sc]e"),
    ("MPL2_FORM", r"this source code form is subject to the terms of the mozilla public license version 2 0"),
]

# Ordered rules, license and the run of identifiers that tells it.
RULES = [
    ("Apache-2.0", "APACHE2_REF APACHE2_COMPLY APACHE2_COPY APACHE2_AS_IS APACHE2_SEE"),
    ("Apache-2.0", "APACHE2_REF APACHE2_COMPLY APACHE2_COPY"),
    ("Apache-2.0", "APACHE2_REF"),
    ("MIT", "MIT_GRANT MIT_NOTICE MIT_AS_IS MIT_LIABILITY"),
    ("MIT", "MIT_GRANT MIT_NOTICE MIT_AS_IS"),
    ("MIT", "MIT_GRANT MIT_NOTICE"),
    ("MIT", "MIT_REF"),
    ("ISC", "ISC_GRANT ISC_AS_IS"),
    ("ISC", "ISC_GRANT"),
    ("BSD-3-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_NAMES BSD_AS_IS BSD_LIABILITY"),
    ("BSD-3-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_NAMES"),
    ("BSD-2-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_AS_IS BSD_LIABILITY"),
    ("BSD-2-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY"),
    ("BSD", "BSD_REF"),
    ("AGPL-3.0", "GPL_FREE AGPL3_GRANT GPL_HOPE GPL_MORE GPL_COPY"),
    ("AGPL-3.0", "GPL_FREE AGPL3_GRANT"),
    ("AGPL-3.0", "AGPL3_REF"),
    ("LGPL", "GPL_FREE LGPL_GRANT GPL_HOPE GPL_MORE GPL_COPY"),
    ("LGPL", "GPL_FREE LGPL_GRANT"),
    ("LGPL", "LGPL_REF"),
    ("GPL-3.0", "GPL_FREE GPL3_GRANT GPL_HOPE GPL_MORE GPL_COPY"),
    ("GPL-3.0", "GPL_FREE GPL3_GRANT"),
    ("GPL-3.0", "GPL3_REF"),
    ("GPL-2.0", "GPL_FREE GPL2_GRANT GPL_HOPE GPL_MORE GPL_COPY"),
    ("GPL-2.0", "GPL_FREE GPL2_GRANT"),
    ("GPL-2.0", "GPL2_REF"),
    ("MPL-2.0", "MPL2_FORM MPL2_COPY"),
    ("MPL-2.0", "MPL2_FORM"),
    ("CC0-1.0", "CC0_REF"),
    ("CC-BY-NC-SA", "CC_BY_NC_SA_REF"),
    ("CC-BY-NC-ND", "CC_BY_NC_ND_REF"),
    ("CC-BY-NC", "CC_BY_NC_REF"),
    ("CC-BY-SA", "CC_BY_SA_REF"),
    ("CC-BY-ND", "CC_BY_ND_REF"),
    ("CC-BY", "CC_BY_REF"),
    ("Unlicense", "UNLICENSE"),
    ("Public-domain", "PUBLIC_DOMAIN"),
    ("Proprietary", "COPYRIGHT ALL_RIGHTS"),
    ("Proprietary", "ALL_RIGHTS"),
    ("Copyright-notice", "COPYRIGHT"),
]

# Every pattern above needs one of these in the normalised sentence, wrapped or not.
CUES = (
    r"licen[sc]|copyright|rights reserved|permission|redistribut|free software|warrant"
    r"|neither the name|be liable|as is|public domain|dedicated|released|available|distributed"
)
BREAK = r"([.;:!?])[\x20\x09-\x0D]+"
OTHER = r"[^a-z0-9]+"
# The points of these words end no sentence.
GOES_ON = r"(?<![^a-z0-9](?:v|inc|ltd|corp|co))"
# An SPDX tag and its expression.
_ID = r"(?:\([ \t]*)*[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?(?:[ \t]*\))*"
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
# SPDX identifiers, lower-cased, and the name that RULES has for them.
SPDX_NAMES = [
    (r"apache-2\.0", "Apache-2.0"),
    (r"mit", "MIT"),
    (r"isc", "ISC"),
    (r"bsd-2-clause", "BSD-2-Clause"),
    (r"bsd-3-clause", "BSD-3-Clause"),
    (r"agpl-3\.0(-only|-or-later|\+)?", "AGPL-3.0"),
    (r"lgpl-(2\.0|2\.1|3\.0)(-only|-or-later|\+)?", "LGPL"),
    (r"gpl-3\.0(-only|-or-later|\+)?", "GPL-3.0"),
    (r"gpl-2\.0(-only|-or-later|\+)?", "GPL-2.0"),
    (r"mpl-2\.0", "MPL-2.0"),
    (r"cc0-1\.0", "CC0-1.0"),
    (r"cc-by-nc-sa-[0-9.]+", "CC-BY-NC-SA"),
    (r"cc-by-nc-nd-[0-9.]+", "CC-BY-NC-ND"),
    (r"cc-by-nc-[0-9.]+", "CC-BY-NC"),
    (r"cc-by-sa-[0-9.]+", "CC-BY-SA"),
    (r"cc-by-nd-[0-9.]+", "CC-BY-ND"),
    (r"cc-by-[0-9.]+", "CC-BY"),
    (r"unlicense", "Unlicense"),
]
KNOWN = "array<struct<place:int,id:string>>"


def _within(pattern: str) -> str:
    """A pattern over the lines of ``marked_lines``: its blanks may be line breaks."""
    head, rest = ("(.* )?", pattern[6:]) if pattern.startswith("(.* )?") else ("", pattern)
    rest = rest.replace(".* ", "<more> ").replace(".", r"[^.\n]").replace("<more>", "[^.]*")
    return head.replace(".", r"[^.\n]") + rest.replace(" ", r"[ \n]")


def known_patterns() -> list[tuple[str, str]]:
    """Names and patterns of sentences that may go over several lines. A sentence that
    refers to a license may go on after the license's name; the first one named counts."""
    out = []
    for name, pattern in SENTENCES:
        forms = [pattern, *(p for n, p in MORE_FORMS if n == name)]
        whole = "|".join(f"(?:{_within(p)})" for p in forms)
        out.append((name, rf"(?:{whole})(?: [^.\n]*)?" if name.endswith("_REF") else whole))
    return out


def marked_lines(text: Column) -> Column:
    """A text as normalised lines that are cut at BREAK too. A point ends the last line of
    a sentence; a semicolon, a colon and the point of an abbreviation do not end it. Lines
    without any letter or digit, as between paragraphs, are left out."""
    text = ascii_lower(text)  # capitals are marks from here on
    blank = r"[\x20\x09-\x0D]"
    for pattern, new in (
        (rf"(?:{GOES_ON}\.|[!?]){blank}+", "H"),
        (rf"[.;:](?:[\x20\t\x0B-\x0D]*\n|{blank})", "S"),
        (r"\n", "S"),
        (r"[^a-z0-9HS]+", " "),
        (r" ?(?:S ?[SH]|H)[ HS]*", ".\n"),
        (r" ?S ?", "\n"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return F.btrim(text)


def known_sentences(text: Column) -> Column:
    """Place and identifier of the known sentences, in order. At the start of a line the
    first pattern that fits takes its lines; the next sentence starts after them."""
    whole = "|".join(f"(?:{pattern})" for _, pattern in known_patterns())
    found = F.regexp_replace(marked_lines(text), rf"(?dm)^(?:{whole})(?=\.?$)", "M$0E")
    joined = F.regexp_replace(found, r"(\G(?!^)|M)([^\nE]*)\n", "$1$2L")
    places = F.transform(
        F.split(joined, "\n", -1),
        lambda s, i: F.when(
            F.startswith(s, F.lit("M")),
            F.struct(i.alias("place"), sentence_id(F.translate(s, "LME.", "\n")).alias("id")),
        ),
    )
    return F.filter(places, lambda p: p.isNotNull())


def sentence_id(sentence: Column) -> Column:
    """The identifier of a known sentence."""
    out = F.when(sentence.isNull(), F.lit(None).cast("string"))
    for name, pattern in known_patterns():
        out = out.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out


def spdx_name(spdx: Column) -> Column:
    """The name in RULES of an SPDX identifier, or the identifier as written."""
    out = F.when(spdx.isNull(), spdx)
    for pattern, name in SPDX_NAMES:
        out = out.when(ascii_lower(spdx).rlike(f"^(?:{pattern})$"), F.lit(name))
    return out.otherwise(spdx)


def tagged_licenses(text: Column) -> Column:
    """The licenses that SPDX tags name, sorted, distinct: those joined by AND or OR each,
    an exception after WITH not."""
    expressions = F.array_join(F.regexp_extract_all(text, F.lit(SPDX)), " OR ")
    bare = F.regexp_replace(expressions, r"(?i)[ \t]+WITH[ \t]+[^ \t()]+", "")
    parts = F.split(F.regexp_replace(bare, r"[()]", " "), r"(?i)[ \t]+(?:AND|OR)[ \t]+")
    ids = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t"))), lambda p: p != "")
    return F.sort_array(F.array_distinct(F.transform(ids, spdx_name)))


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``sentences`` (place and identifier of the
    known ones, in order), ``licenses`` (sorted, distinct), ``unmatched`` (the identifiers
    that no rule used, in order) and ``tagged`` (the licenses that SPDX tags name, sorted,
    distinct).

    The same sentence twice counts twice in ``sentences``. A null, empty or blank text
    has no sentence. No rule uses an SPDX tag: it stands in ``unmatched``, and what it
    names in ``tagged``."""
    # Most texts have no cue at all; they are not cut into sentences.
    some = F.coalesce(ascii_lower(F.col("__text")).rlike(CUES.replace(" ", "[^a-z0-9]+")), F.lit(False))
    none = F.array().cast("array<string>")
    known = known_sentences(F.col("__text"))
    ids = F.transform("sentences", lambda p: F.concat(F.lit(","), p["id"], F.lit(",")))
    found = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
        .withColumn("sentences", F.when(some, known).otherwise(F.array().cast(KNOWN)))
        .withColumn("tagged", F.when(some, tagged_licenses(F.col("__text"))).otherwise(none))
        .withColumn("__run", F.array_join(ids, ""))
        .withColumn("__end", F.when(F.col("__run") != "", _matched(F.col("__run"))))
    )
    left = F.filter(F.split(F.coalesce("__end.run", F.lit("")), ","), lambda x: x != "")
    names = F.coalesce("__end.licenses", none)
    return found.select(
        "doc_id", "sentences", F.sort_array(F.array_distinct(names)).alias("licenses"),
        left.alias("unmatched"), "tagged",
    )


def _matched(run: Column) -> Column:
    """What the rules find in a run of identifiers and what they leave, rule after rule.
    A comma stays where a match was, so that its neighbours do not become one run."""
    rules = F.array(
        *(F.struct(F.lit(n).alias("name"), F.lit(rule_pattern(i)).alias("ids")) for n, i in RULES)
    )
    none = F.array().cast("array<string>")

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["run"], rule["ids"])
        new = F.when(hit, F.array(rule["name"])).otherwise(none)
        return F.struct(
            F.replace(state["run"], rule["ids"], F.lit(",")).alias("run"),
            F.concat(state["licenses"], new).alias("licenses"),
        )

    return F.aggregate(rules, F.struct(run.alias("run"), none.alias("licenses")), step)


def rule_pattern(ids: str) -> str:
    """A rule's identifiers as they stand in a document's run: ``,A,,B,``."""
    return "".join(f",{i}," for i in ids.split())

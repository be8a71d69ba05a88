"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences: at . ! ? ; before white space, at blank lines, and at line ends, which a
known sentence may run across. Sentences are normalised (lower case, punctuation to spaces, white space
collapsed, comment marks beside line ends dropped) and slots are put in for what varies: the subject and
verb before "under", copyright years and holders, a name inside a sentence. A normalised sentence that is
equal to a known one gets its identifier; another one that holds a licensing word is "unknown". The
identifiers of a text, in order, are then matched against ordered license rules; a rule consumes the
identifiers it matches, and no others, so that a later, weaker rule does not count them again.
Between two sentences of a rule there may be others, but not the rule's first sentence again (of
two notices, each is matched by itself), nor another license that "or later" may belong to. What
stands between stays for later rules.

No shuffle: all is done in the scan, row by row, on whole texts.

A text may be long, and hold any number of sentences and marks: no pattern needs stack or time beyond its length.

Defined cases: null, empty and blank texts have no sentences and no licenses; every row of repeated
rows gets its own result, and of repeated notices in one text each is matched; a text of any length is
scanned whole; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised and with slots, then ordered rules over their identifiers.
# "under" stands for a subject, a verb and "under the terms of the".
SENTENCES = {
    "ApacheRef": ("under apache license version 2 0", "under apache license version 2 0 the license", "under apache 2 0 license", "under apache license 2 0"),
    "ApacheNoUse": ("you may not use this file except in compliance with the license",),
    "ApacheCopyAt": ("you may obtain a copy of the license at",),
    "ApacheUrl": ("http www apache org licenses license 2 0", "https www apache org licenses license 2 0"),
    "ApacheAsIs": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "ApacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "MitRef": ("under mit license", "mit license", "the mit license", "the mit license mit"),
    "MitGrant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "MitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MitAsIs": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "MitLiable": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "IscGrant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "IscAsIs": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "BsdGrant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BsdBinary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "BsdNoEndorse": ("neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "Gpl3OrLater": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "Gpl2OrLater": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "LgplOrLater": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "AgplOrLater": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "GplNoWarranty": ("this program is distributed in the hope that it will be useful but without any warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    "AgplRef": ("under gnu affero general public license", "under gnu affero general public license version 3", "under gnu agpl version 3"),
    "LgplRef": ("under gnu lesser general public license", "under gnu lesser general public license version 3", "under gnu lesser general public license version 2 1", "under gnu lgpl"),
    "Gpl3Ref": ("under gnu general public license version 3", "under gnu general public license v3", "under gnu gpl version 3", "under gplv3"),
    "Gpl2Ref": ("under gnu general public license version 2", "under gnu general public license v2", "under gnu gpl version 2", "under gplv2"),
    "GplRef": ("under gnu general public license", "under gnu gpl", "under gpl"),
    "OrLater": ("or at your option any later version", "at your option any later version", "or any later version", "you may use this or any later version", "you may use that or any later version"),
    "CcByNcSa4": ("under cc by nc sa 4 0", "under creative commons attribution noncommercial sharealike 4 0 international license"),
    "CcByNcNd4": ("under cc by nc nd 4 0", "under creative commons attribution noncommercial noderivatives 4 0 international license"),
    "CcByNc4": ("under cc by nc 4 0", "under creative commons attribution noncommercial 4 0 international license"),
    "CcBySa4": ("under cc by sa 4 0", "under creative commons attribution sharealike 4 0 international license"),
    "CcBy4": ("under cc by 4 0", "under creative commons attribution 4 0 international license"),
    "Cc0": ("under cc0", "under cc0 1 0", "dedicated to the public domain under cc0 1 0"),
    "Mpl2Ref": ("this source code form is subject to the terms of the mozilla public license v 2 0", "under mozilla public license version 2 0", "under mozilla public license v 2 0"),
    "MplCopyAt": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "Epl2Ref": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "under eclipse public license version 2 0", "under eclipse public license v 2 0"),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "PublicDomain": ("placed in the public domain", "released into the public domain", "this work is placed in the public domain", "this work is released into the public domain", "this work is in the public domain"),
    "GplCopy": ("you should have received a copy of the gnu general public license along with this program",),
    "LgplCopy": ("you should have received a copy of the gnu lesser general public license along with this library",),
    "Lgpl3OrLater": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "BoostGrant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "BoostRef": ("under boost software license version 1 0", "boost software license version 1 0"),
    "ZlibAsIs": ("this software is provided as is without any express or implied warranty", "this software is provided as is without express or implied warranty"),
    "ZlibLiable": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "ZlibGrant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "BsdAsIs": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "UnlicenseGrant": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "Artistic2Ref": ("under artistic license 2 0", "under artistic license version 2 0"),
    "Eupl12Ref": ("under eupl version 1 2", "under european union public licence version 1 2", "under european union public license version 1 2"),
    "Cddl1Ref": ("under cddl 1 0", "under common development and distribution license version 1 0", "under common development and distribution license"),
    "MsPlRef": ("under microsoft public license", "under ms pl"),
    "OflRef": ("this font software is licensed under the sil open font license version 1 1", "under sil open font license version 1 1"),
    "OdblRef": ("under open database license", "under open data commons open database license", "under odbl 1 0"),
    "GfdlGrant": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation",),
    "GfdlRef": ("under gnu free documentation license", "under gfdl"),
    "PsfRef": ("under python software foundation license version 2", "under psf license"),
    "Mpl11Ref": ("under mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    "Wtfpl": ("do what the fuck you want to public license", "under wtfpl"),
    "CcBySa3": ("under cc by sa 3 0", "under creative commons attribution sharealike 3 0 unported license"),
    "CcBy3": ("under cc by 3 0", "under creative commons attribution 3 0 unported license"),
    "CcByNd4": ("under cc by nd 4 0", "under creative commons attribution noderivatives 4 0 international license"),
    "AsIs": ("provided as is", "this software is provided as is"),
    "RightsReserved": ("all rights reserved",),
    "CopyrightLine": ("copyright {years}",),
    "SpdxTag": ("spdx license identifier {name}",),
}
RULES = (
    ("Apache-2.0", ("ApacheRef", "ApacheNoUse", "ApacheCopyAt", "ApacheUrl", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheRef", "ApacheNoUse", "ApacheCopyAt", "ApacheUrl", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheRef", "ApacheNoUse", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheRef",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSL-1.0", ("BoostRef",)),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiable")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitRef",)),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("Zlib", ("ZlibAsIs", "ZlibLiable", "ZlibGrant")),
    ("Zlib", ("ZlibGrant",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("AGPL", ("AgplOrLater",)),
    ("AGPL", ("AgplRef",)),
    ("LGPL-3.0-or-later", ("Lgpl3OrLater", "LgplCopy")),
    ("LGPL-3.0-or-later", ("Lgpl3OrLater",)),
    ("LGPL", ("LgplOrLater", "LgplCopy")),
    ("LGPL", ("LgplOrLater",)),
    ("LGPL", ("LgplRef",)),
    ("GPL-3.0-or-later", ("Gpl3OrLater", "GplNoWarranty", "GplNoWarranty", "GplCopy")),
    ("GPL-3.0-or-later", ("Gpl3OrLater", "GplNoWarranty", "GplNoWarranty")),
    ("GPL-3.0-or-later", ("Gpl3OrLater",)),
    ("GPL-3.0-or-later", ("Gpl3Ref", "OrLater")),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("GPL-2.0-or-later", ("Gpl2OrLater", "GplNoWarranty", "GplNoWarranty", "GplCopy")),
    ("GPL-2.0-or-later", ("Gpl2OrLater", "GplNoWarranty", "GplNoWarranty")),
    ("GPL-2.0-or-later", ("Gpl2OrLater",)),
    ("GPL-2.0-or-later", ("Gpl2Ref", "OrLater")),
    ("GPL-2.0", ("Gpl2Ref",)),
    ("GPL", ("GplRef",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-ND-4.0", ("CcByNd4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-SA-3.0", ("CcBySa3",)),
    ("CC-BY-3.0", ("CcBy3",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("Cc0",)),
    ("MPL-2.0", ("Mpl2Ref", "MplCopyAt")),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("EPL-2.0", ("Epl2Ref",)),
    ("MPL-1.1", ("Mpl11Ref",)),
    ("Artistic-2.0", ("Artistic2Ref",)),
    ("EUPL-1.2", ("Eupl12Ref",)),
    ("CDDL-1.0", ("Cddl1Ref",)),
    ("MS-PL", ("MsPlRef",)),
    ("OFL-1.1", ("OflRef",)),
    ("ODbL-1.0", ("OdblRef",)),
    ("GFDL", ("GfdlGrant",)),
    ("GFDL", ("GfdlRef",)),
    ("PSF-2.0", ("PsfRef",)),
    ("WTFPL", ("Wtfpl",)),
    ("Unlicense", ("Unlicense", "UnlicenseGrant")),
    ("Unlicense", ("Unlicense",)),
    ("SPDX-tag", ("SpdxTag",)),
    ("public-domain", ("PublicDomain",)),
    ("proprietary", ("RightsReserved",)),
)
#: Sentences that a following OrLater may belong to; it belongs to the nearest.
VERSIONED = ("AgplRef", "LgplRef", "Gpl3Ref", "Gpl2Ref", "GplRef")
#: A sentence with one of these is a licensing one, known or not.
STEMS = r"licen[sc]|copyright|warrant|redistribut|rights reserved|public domain|gplv?[23]?\b|creative commons|mozilla public"
# What varies, and what stands for it in the normalised sentence.
UNDER = r"(?:(?:this|the) (?:work|program|software|file|project|code|library|package|document|dataset|text|page|article|book) is )?(?:made available|released|licensed|available|distributed|published) under (?:(?:the )?terms of )?(?:the |a )?"
SLOTS = (
    ("^" + UNDER, "under "),
    (r"^copyright(?: c)? [12][0-9]{3}(?: .*)?$", "copyright {years}"),
    (r"^neither the name of .* nor the names of", "neither the name of {name} nor the names of"),
    (r"^spdx license identifier .*$", "spdx license identifier {name}"),
)
KNOWN = {sentence: name for name, sentences in SENTENCES.items() for sentence in sentences}
#: What every licensing word has in it; with these a text may hold a sentence that counts.
_PARTS = ("licen[sc]", "copyright", "warrant", "redistribut", "reserved", "domain", "gpl", "commons", "mozilla")


def _gate() -> str:
    """A pattern that every text with a known sentence or a licensing word has a match of, in lower case: one of the parts, or the
    longest word of a known sentence that has none of them. Words are runs of letters and digits, which normalising leaves whole."""
    parts = [*_PARTS]
    for sentence in sorted(KNOWN):
        words = sentence.replace("{years}", "").replace("{name}", "").split()
        if not any(re.search("|".join(parts), w) for w in words):
            parts.append(max(words, key=len))
    return "|".join(parts)


GATE = _gate()
#: Ends of sentences: | is one, / a line end that a known sentence may run across. Every run of marks is looked at once, from its
#: begin: no pattern here repeats a group or tries a run again from inside, so that any text takes linear time and no stack.
HARD = r"""(?i)(?<![.!?;])(?!(?<=\bv)\.(?:\s|$))[.!?;]++["')\]]*+(?=\s|$)|\n[^\p{L}\p{N}\n]*+\n"""
SOFT = r"(?<![^\p{L}\p{N}|])[^\p{L}\p{N}|\n]*+\n[^\p{L}\p{N}|]*+"


def _pattern(sentence: str) -> str:
    """A known sentence in a marked text; its words may have a line end between them, but those of a line that is
    open at its end."""
    if sentence.endswith("}"):
        return sentence.replace("{years}", "(?:c )?[12][0-9]{3}[^|/]*").replace("{name}", "[^|/]+")
    if sentence.startswith("under "):
        pattern = UNDER + sentence[6:]
    else:
        pattern = sentence.replace("{name}", "[^|]{1,200}?")
    return pattern.replace(" ", "[ /]")


RECOGNISED = r"(?<=[|/])(?:" + "|".join(_pattern(s) for s in sorted(KNOWN, key=lambda s: (-len(s), s))) + r")(?=[|/])|(?<=[|/])[^|/]*(?:" + STEMS + r")[^|/]*"


def marked(text: Column) -> Column:
    """``text`` in lower case, with single spaces for all else but the marks of sentence ends."""
    text = F.regexp_replace(F.regexp_replace(F.translate(text, "|/", "  "), HARD, "|"), SOFT, "/")
    text = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}|/]+", " "), " *([|/]) *", "$1")
    return F.concat(F.lit("|"), F.trim(text), F.lit("|"))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the licensing sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def name(sentence: Column) -> Column:
        sentence = F.translate(sentence, "/", " ")
        for pattern, slot in SLOTS:
            sentence = F.regexp_replace(sentence, pattern, slot)
        return F.coalesce(F.try_element_at(known, sentence), F.lit("unknown"))

    return F.transform(F.regexp_extract_all(marked(text), F.lit(RECOGNISED), F.lit(0)), name)


#: A character for each identifier, so that a sequence of them is a string and what stands between two is a run of characters.
LETTERS = {name: chr(0xE000 + i) for i, name in enumerate(("unknown", *SENTENCES))}


def _rule(name: str, needs: tuple[str, ...]) -> tuple[str, str, str, str]:
    """A rule's license, the letter of its first sentence, its pattern and what goes back. From the first sentence the nearest of each next
    one is taken, unless a sentence that stops it comes first; what lies between goes back in place. Runs are possessive: nothing is tried twice."""
    stops = "".join(LETTERS[x] for x in (VERSIONED if "OrLater" in needs else needs[:1]))
    pattern = LETTERS[needs[0]] + "".join(f"([^{stops}{LETTERS[x]}]*+){LETTERS[x]}" for x in needs[1:])
    return name, LETTERS[needs[0]], pattern, "".join(f"${i}" for i in range(1, len(needs)))


def matched(ids: Column) -> Column:
    """struct(rest, names) after all rules, in order: ``ids`` is the array of identifiers, ``rest`` the array of those no rule took."""
    to = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    back = F.create_map(*[F.lit(x) for name, letter in LETTERS.items() for x in (letter, name)])
    letters = F.array_join(F.transform(F.filter(ids, lambda x: x != ""), lambda x: F.element_at(to, x)), "")
    rules = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("name", "first", "pattern", "gaps"), _rule(*r), strict=True)]) for r in RULES])

    def step(s: Column, r: Column) -> Column:
        hit = F.contains(s["rest"], r["first"]) & F.rlike(s["rest"], r["pattern"])
        rest = F.when(hit, F.regexp_replace(s["rest"], r["pattern"], r["gaps"])).otherwise(s["rest"])
        return F.struct(rest.alias("rest"), F.when(hit, F.concat(s["names"], F.array(r["name"]))).otherwise(s["names"]).alias("names"))

    def names(s: Column) -> Column:
        return F.struct(F.transform(F.filter(F.split(s["rest"], ""), lambda c: c != ""), lambda c: F.element_at(back, c)).alias("rest"), s["names"].alias("names"))

    return F.aggregate(rules, F.struct(letters.alias("rest"), F.expr("cast(array() as array<string>)").alias("names")), step, names)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (in rule order, each once), unmatched (identifiers no rule took)."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    ids = F.when(F.lower(text).rlike(GATE), sentence_ids(text)).otherwise(none)
    out = docs.select("doc_id", ids.alias("sentence_ids"))
    out = out.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, matched(F.col("sentence_ids"))).alias("m"))
    return out.select("doc_id", "sentence_ids", F.coalesce(F.array_distinct("m.names"), none).alias("licenses"), F.coalesce("m.rest", none).alias("unmatched"))


def oracle() -> str:
    """The scan as SQL for DuckDB, for the columns of the query, by other means: sentences are joined with the table
    of known ones by equality, over runs of lines, and rules are followed one by one over positions in lists."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(sentence)}, {quote(name)})" for sentence, name in KNOWN.items())
    rules = ", ".join(f"({k}, {quote(name)}, [{', '.join(map(quote, needs))}], [{', '.join(map(quote, VERSIONED if 'OrLater' in needs else needs[:1]))}])" for k, (name, needs) in enumerate(RULES, 1))
    slot = "joined"
    for pattern, to in SLOTS:
        slot = f"regexp_replace({slot}, {quote(pattern)}, {quote(to)})"
    most = max(len(needs) for _, needs in RULES)
    source = "(SELECT s.*, license, needs, stops, list_filter(range(place, len(ids) + 1), lambda i: ids[i] = needs[1])[1] AS p1 FROM steps s JOIN rules USING (k))"
    for m in range(2, most + 1):
        source = f"(SELECT *, CASE WHEN len(needs) < {m} THEN NULL ELSE list_filter(range(p{m - 1} + 1, len(ids) + 1), lambda i: ids[i] = needs[{m}])[1] END AS p{m} FROM {source})"
    longest = max(len(x.split()) for x in KNOWN)
    return f"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
rules(k, license, needs, stops) AS (VALUES {rules}),
-- Blocks end at sentence ends and blank lines, lines inside a block at line ends. A version's "v." is no end.
ends AS (SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '\\b([vV])[.](\\s)', '\\1\\2', 'g'), '[.!?;]+["'')\\]]*(\\s|$)', chr(1) || '\\1', 'g') AS t FROM documents),
blocks AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '\\n[^\\p{{L}}\\p{{N}}\\n]*\\n', chr(1), 'g'), chr(1))) AS block, generate_subscripts(string_split(regexp_replace(t, '\\n[^\\p{{L}}\\p{{N}}\\n]*\\n', chr(1), 'g'), chr(1)), 1) AS b FROM ends),
lines AS (SELECT doc_id, b, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS l FROM blocks),
words AS (SELECT doc_id, b, l, trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM lines),
pieces AS (SELECT doc_id, w, b, row_number() OVER (PARTITION BY doc_id ORDER BY b, l) AS p, row_number() OVER (PARTITION BY doc_id, b ORDER BY l) AS q FROM words WHERE w <> ''),
-- A run of lines of one block is a sentence where it is equal to a known one; the longest at each place counts.
runs AS (SELECT x.doc_id, x.p AS first, y.p AS last, string_agg(z.w, ' ' ORDER BY z.p) AS joined
  FROM pieces x JOIN pieces y ON x.doc_id = y.doc_id AND x.b = y.b AND y.p BETWEEN x.p AND x.p + {longest} JOIN pieces z ON x.doc_id = z.doc_id AND z.p BETWEEN x.p AND y.p
  WHERE x.doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), {quote(GATE)})) GROUP BY ALL),
hits AS (SELECT doc_id, first, max(last) AS last, arg_max(id, last) AS id FROM runs JOIN known ON {slot} = sentence AND (first = last OR NOT ends_with(sentence, '}}')) GROUP BY ALL),
taken AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND o.first < h.first AND h.first <= o.last)),
found AS (SELECT doc_id, first AS p, id FROM taken
  UNION ALL SELECT doc_id, p, 'unknown' FROM pieces x WHERE regexp_matches(w, {quote(STEMS)}) AND NOT EXISTS (SELECT 1 FROM taken h WHERE h.doc_id = x.doc_id AND x.p BETWEEN h.first AND h.last)),
lists AS (SELECT doc_id, list(id ORDER BY p) AS ids FROM found GROUP BY doc_id),
steps(doc_id, k, place, ids, names) AS (
  SELECT doc_id, 1, 1, ids, CAST([] AS VARCHAR[]) FROM lists
  UNION ALL
  SELECT doc_id, CASE WHEN p1 IS NULL THEN k + 1 ELSE k END, CASE WHEN p1 IS NULL THEN 1 WHEN taken THEN p1 ELSE p1 + 1 END,
    CASE WHEN taken THEN list_select(ids, list_filter(range(1, len(ids) + 1), lambda i: NOT list_contains(places, i))) ELSE ids END,
    CASE WHEN taken THEN list_append(names, license) ELSE names END
  FROM (SELECT *, p1 IS NOT NULL AND p[len(needs)] IS NOT NULL AND len(list_filter(range(p1 + 1, p[len(needs)]), lambda i: NOT list_contains(p, i) AND list_contains(stops, ids[i]))) = 0 AS taken, p AS places
    FROM (SELECT *, [{", ".join(f"p{m}" for m in range(1, most + 1))}] AS p FROM {source})))
SELECT d.doc_id, coalesce(len(l.ids), 0) AS n_sentences, coalesce(array_to_string(l.ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter(s.names, lambda x, i: list_position(s.names, x) = i), ','), '') AS licenses, coalesce(array_to_string(s.ids, ','), '') AS unmatched
FROM documents d LEFT JOIN lists l ON d.doc_id = l.doc_id LEFT JOIN steps s ON d.doc_id = s.doc_id AND s.k = {len(RULES) + 1}
"""

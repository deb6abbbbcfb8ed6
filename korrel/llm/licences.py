"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences after ``.``, ``!`` or ``?`` before white space and at
blank lines; a line end, with the comment marks behind it, is a space. A sentence
may start at any line of what is so cut, as titles and copyright lines have no full
stop, and may begin and end at ``;`` or ``:`` too; a long one may begin anywhere. What is no known sentence so is
read line by line, as ``sql`` does, which knows sentences of one line only. A URL
may stand on its own line below the words before it. A sentence is normalised to lower-case ASCII letters, digits, dots,
pluses and hyphens with single spaces. Known sentences map to identifiers. The
identifiers of a text, in order, are matched against ordered rules: a rule holds
if its identifiers stand next to each other in that sequence, sentences that are
not known being passed over; where a longer rule that starts with it holds, it gives
way to that one at that place only.

One pass over each row: no join and no shuffle. Null and empty texts have no
sentence and no licence. Repeated rows get a row each; extra columns are not read.
An empty table gives no rows; a text of any length is one array of sentences.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence notices, normalised, and their identifiers.
SENTENCES = {
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-title": ["mit license", "the mit license mit"],
    "grant-mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "notice-mit": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "asis-mit": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "grant-isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "redistribution-bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "source-bsd": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "binary-bsd": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "endorse-bsd": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-ref": ["licensed under the apache license version 2.0", "released under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "comply-apache": ["you may not use this file except in compliance with the license"],
    "copy-apache": ["you may obtain a copy of the license at http www.apache.org licenses license-2.0"],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2-ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "free-gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "hope-gpl": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "see-gpl": ["see the gnu general public license for more details"],
    "free-gpl2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "free-lgpl21": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"],
    "free-lgpl3": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "hope-lgpl": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "see-lgpl": ["see the gnu lesser general public license for more details"],
    "free-agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "see-agpl": ["see the gnu affero general public license for more details"],
    "epl-ref": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0"],
    "free-unlicense": ["this is free and unencumbered software released into the public domain"],
    "anyone-unlicense": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means"],
    "asis-zlib": ["this software is provided as-is without any express or implied warranty"],
    "grant-zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "cc0-ref": ["licensed under cc0 1.0", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "mpl-ref": ["this source code form is subject to the terms of the mozilla public license v"],
    "cc-by-ref": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-ref": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc-ref": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "reserved": ["all rights reserved"],
}
#: Rules: a licence and the identifiers that name it, in order.
RULES = [
    ("AGPL-3.0-or-later", ["free-agpl", "hope-gpl", "see-agpl"]),
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0-notice", ["apache-ref", "comply-apache", "copy-apache"]),
    ("BSD-2-Clause", ["redistribution-bsd", "source-bsd", "binary-bsd"]),
    ("BSD-3-Clause", ["redistribution-bsd", "source-bsd", "binary-bsd", "endorse-bsd"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("EPL-2.0", ["epl-ref"]),
    ("GPL-2.0", ["gpl2-ref"]),
    ("GPL-2.0-or-later", ["free-gpl2", "hope-gpl", "see-gpl"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-3.0-or-later", ["free-gpl", "hope-gpl", "see-gpl"]),
    ("ISC", ["grant-isc"]),
    ("LGPL-2.1-or-later", ["free-lgpl21", "hope-lgpl", "see-lgpl"]),
    ("LGPL-3.0-or-later", ["free-lgpl3", "hope-lgpl", "see-lgpl"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["grant-mit", "notice-mit", "asis-mit"]),
    ("MPL-2.0", ["mpl-ref"]),
    ("Proprietary", ["reserved"]),
    ("Unlicense", ["free-unlicense", "anyone-unlicense"]),
    ("Zlib", ["asis-zlib", "grant-zlib"]),
]
#: Words from which a known sentence counts wherever in a line it begins, if it ends with the line's sentence.
LONG = 12
#: Parts of words of which every known sentence holds one; a text without any has no known sentence.
CUES = ("licen", "software", "reserved", "redistribut", "merchantability")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[.!?]+([ \t\n\r\f]|$)"
_OTHER = r"[^a-z0-9.+\n-]+"


_MARKS = r"(^|\n)[ \t\r\f]*[#*/;%!|<>-]+(?=[ \t\r\f\n]|$)"
_URL = r"(of the license at):?[ \t\r\f]*\n\s*(?=https?://)"
_STOP, _PART = "\x01", "\x02"
_LONGEST = max(len(s) for sentences in SENTENCES.values() for s in sentences)


def _plain(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, rf"[ \n{_PART}]+", " "))


def _known(sentence: Column) -> Column:
    known = F.create_map(*(F.lit(x) for i, sentences in SENTENCES.items() for s in sentences for x in (s, i)))
    return F.try_element_at(known, _plain(sentence))


def _ending(sentence: Column) -> Column:
    """The identifier of a long known sentence that others without a full stop precede."""
    plain, out = _plain(sentence), F.lit(None).cast("string")
    for i, sentences in SENTENCES.items():
        for s in sentences:
            if len(s.split()) >= LONG:
                out = F.when(F.endswith(plain, F.lit(" " + s)), F.lit(i)).otherwise(out)
    return F.when(F.length(sentence) > min(len(s) for x in SENTENCES.values() for s in x if len(s.split()) >= LONG), out)


def _found(ids: Column) -> Column:
    return F.filter(ids, lambda i: i.isNotNull())


def _of_lines(piece: Column) -> Column:
    """The identifiers of lines, the last of which may be the end of a wrapped sentence."""
    lines = F.split(piece, "\n")
    # A line end is up to three characters; a sentence that starts before is too long to be known.
    last = F.split(F.when(F.length(piece) > 3 * _LONGEST, F.substring(piece, -3 * _LONGEST, 3 * _LONGEST)).otherwise(piece), "\n")
    ends = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.struct((F.size(lines) - F.size(last) + i - 1).alias("before"), _known(F.array_join(F.slice(last, i, F.size(last)), " ")).alias("id")))
    whole = F.try_element_at(F.filter(ends, lambda e: e["id"].isNotNull()), F.lit(1))
    before = F.coalesce(whole["before"], F.size(lines))
    return _found(F.concat(F.transform(F.slice(lines, F.lit(1), before), _known), F.array(F.coalesce(whole["id"], _ending(piece)))))


def _of_piece(piece: Column) -> Column:
    whole, parts = _of_lines(piece), F.flatten(F.transform(F.split(piece, _PART), _of_lines))
    parted = F.when(F.size(parts) > F.size(whole), parts).otherwise(whole)
    return F.when(F.contains(piece, F.lit(_PART)), parted).when(F.contains(piece, F.lit("\n")), whole).otherwise(_found(F.array(F.coalesce(_known(piece), _ending(piece)))))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER + _STOP + _PART, _LOWER + "  ")
    low = F.regexp_replace(F.regexp_replace(low, _MARKS, "$1"), _URL, "$1 ")
    low = F.regexp_replace(F.regexp_replace(low, _BREAK, _STOP), r"\n[ \t\r\f]*\n\s*", _STOP)
    plain = F.regexp_replace(F.regexp_replace(low, r"[;:]+(?=[ \t\n\r\f]|$)", _PART), rf"[^a-z0-9.+\n{_STOP}{_PART}-]+", " ")
    return F.flatten(F.transform(F.split(plain, _STOP), _of_piece))


def _longer(rule: list[str]) -> list[list[str]]:
    """Rules that start with a rule and go on."""
    return [r for _, r in RULES if len(r) > len(rule) and r[: len(rule)] == rule]


def _line(rule: list[str]) -> str:
    return "".join(f"({i})" for i in rule)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) of each row, lists joined by commas."""
    low = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("low", F.lower("text"))
    cue = functools.reduce(lambda a, b: a | b, (F.contains("low", F.lit(x)) for x in CUES))
    found = low.select("doc_id", F.when(cue, F.array_join(sentence_ids(F.col("text")), ",")).otherwise("").alias("ids"))
    line = F.concat(F.lit("("), F.replace("ids", F.lit(","), F.lit(")(")), F.lit(")"))
    holds: dict[str, Column] = {}
    for name, rule in RULES:
        rest = line
        for longer in _longer(rule):  # there the longer rule holds instead
            rest = F.replace(rest, F.lit(_line(longer)), F.lit("()"))
        one = F.contains(rest, F.lit(_line(rule)))
        holds[name] = holds[name] | one if name in holds else one
    named = [F.when(c, F.lit(n)) for n, c in sorted(holds.items())]
    count = F.when(F.col("ids") == "", 0).otherwise(F.size(F.split("ids", ",")))
    return found.select("doc_id", count.cast("long").alias("n_sentences"), F.col("ids").alias("sentence_ids"), F.concat_ws(",", *named).alias("licences"))


def sql() -> str:
    """The same scan of sentences of one line in DuckDB's SQL."""
    known = ", ".join(f"'{s}': '{i}'" for i, sentences in SENTENCES.items() for s in sentences)
    holds: dict[str, str] = {}
    for name, rule in RULES:
        rest = "line"
        for longer in _longer(rule):
            rest = f"replace({rest}, '{_line(longer)}', '()')"
        one = f"contains({rest}, '{_line(rule)}')"
        holds[name] = f"{holds[name]} or {one}" if name in holds else one
    named = ", ".join(f"case when {c} then '{n}' end" for n, c in sorted(holds.items()))
    brk, other = _BREAK.replace("'", "''"), _OTHER
    return f"""
with plain as (
  select doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{brk}', chr(10), 'g'), '{other}', ' ', 'g') as t from documents
), found as (
  select doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda s: map {{{known}}}[trim(s)]), lambda i: i is not null) as l from plain
), joined as (
  select doc_id, len(l) as n_sentences, coalesce(array_to_string(l, ','), '') as ids, '(' || replace(ids, ',', ')(') || ')' as line from found
)
select doc_id, n_sentences::bigint as n_sentences, ids as sentence_ids, concat_ws(',', {named}) as licences from joined
"""

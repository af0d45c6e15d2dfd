"""License scans by sentence rules.

Texts are cut into parts at line breaks and sentence ends, parts are normalised (letters and digits in lower case, single
spaces) and each run of neighbouring parts that joins to a known licence sentence becomes its identifier. A match rests on all words of a sentence. So a sentence is
found on one line or wrapped over several, with or without comment marks, blank comment lines and an item number ("1.")
before it; a part that is a sentence by itself, such as a line without a full stop, is one still. A document is then a sequence of identifiers, with a gap where
other sentences stand in between; ordered rules are sequences of identifiers, tried from the first to the last, and
each match uses its identifiers up. What no rule explains is reported as ``UNMATCHED``.

All of it is one projection over whole texts: no shuffle, and no sentence is ever looked at twice.

Defined results: null, empty and blank texts hold no sentences; repeated rows are reported one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filter_here, fresh

#: Identifier of each known sentence and the sentence (fixed values).
SENTENCES = {
    "ApacheGrant": "Licensed under the Apache License, Version 2.0.",
    "ApacheGrantYou": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "ApacheCopy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ApacheAsIs": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                  "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License.",
    "MitReleased": "Released under the MIT License.",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Gpl3Work": "This work is licensed under the GNU General Public License, version 3.",
    "GplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
               "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GplUseful": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
                 "or FITNESS FOR A PARTICULAR PURPOSE.",
    "GplSee": "See the GNU General Public License for more details.",
    "CcByNc4": "Licensed under CC BY-NC 4.0.",
    "CcBy4": "Licensed under CC BY 4.0.",
    "CcBySa4": "Licensed under CC BY-SA 4.0.",
    "BsdRetain": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                 "and/or other materials provided with the distribution.",
    "BsdEndorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                  "without specific prior written permission.",
    "Reserved": "All rights reserved.",
}
#: Licence and its sequence of sentences; "?" behind an identifier makes it optional (fixed values). The first match wins.
RULES = (
    ("Apache-2.0", "ApacheGrantYou ApacheCopy ApacheAsIs? ApacheSee?"),
    ("Apache-2.0", "ApacheGrantYou"),
    ("Apache-2.0", "ApacheGrant"),
    ("BSD-3-Clause", "BsdRetain BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "BsdRetain BsdBinary"),
    ("MIT", "MitGrant MitNotice?"),
    ("MIT", "MitReleased"),
    ("GPL-3.0-or-later", "GplFree GplUseful? GplSee?"),
    ("GPL-3.0", "Gpl3Work"),
    ("CC-BY-NC-4.0", "CcByNc4"),
    ("CC-BY-SA-4.0", "CcBySa4"),
    ("CC-BY-4.0", "CcBy4"),
    ("All-Rights-Reserved", "Reserved"),
)
#: Grants of the other GNU licences: identifier, licence, and the words that differ (fixed values).
_GNU = [
    ("Gpl2Later", "GPL-2.0-or-later", "program", "General", "; either version 2 of the License, or (at your option) any later version."),
    ("Gpl2Only", "GPL-2.0-only", "program", "General", "; version 2 of the License."),
    ("Gpl3Only", "GPL-3.0-only", "program", "General", ", version 3 of the License."),
    ("Lgpl20Later", "LGPL-2.0-or-later", "library", "Library General", "; either version 2 of the License, or (at your option) any later version."),
    ("Lgpl21Later", "LGPL-2.1-or-later", "library", "Lesser General", "; either version 2.1 of the License, or (at your option) any later version."),
    ("Lgpl21LaterProgram", "LGPL-2.1-or-later", "program", "Lesser General", "; either version 2.1 of the License, or (at your option) any later version."),
    ("Lgpl3Later", "LGPL-3.0-or-later", "library", "Lesser General", ", either version 3 of the License, or (at your option) any later version."),
    ("Lgpl3LaterProgram", "LGPL-3.0-or-later", "program", "Lesser General", ", either version 3 of the License, or (at your option) any later version."),
    ("Agpl3Later", "AGPL-3.0-or-later", "program", "Affero General", ", either version 3 of the License, or (at your option) any later version."),
    ("Agpl3Only", "AGPL-3.0-only", "program", "Affero General", ", version 3 of the License."),
]
#: Known sentences and rules of a scan; ``SENTENCES`` and ``RULES`` are the part that the SQL has.
ALL_SENTENCES = SENTENCES | {
    name: f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by "
          f"the Free Software Foundation{version}" for name, _, thing, kind, version in _GNU
} | {
    "LibraryUseful": SENTENCES["GplUseful"].replace("This program", "This library"),
    "LgplSee": "See the GNU Lesser General Public License for more details.",
    "Lgpl20See": "See the GNU Library General Public License for more details.",
    "AgplSee": "See the GNU Affero General Public License for more details.",
}
_SEE = {"General": "GplSee", "Library General": "Lgpl20See", "Lesser General": "LgplSee", "Affero General": "AgplSee"}
ALL_RULES = RULES + tuple((spdx, f"{name} {'LibraryUseful' if thing == 'library' else 'GplUseful'}? {_SEE[kind]}?") for name, spdx, thing, kind, _ in _GNU)
#: A sentence ends at a line break, or behind . ! ? : ; that white space follows.
BREAK = r"[\n\r]+|(?<=[.!?:;])[ \t]+"


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normal form -> identifier, as the SQL has them: a licence sentence that the break rule cuts is known by its first
    part. A scan wants the whole sentence."""
    out = {}
    for name, text in sentences.items():
        parts = [normal(p) for p in re.split(BREAK, text) if normal(p)]
        out.setdefault(parts[0], name)
        for p in parts[1:]:
            out.setdefault(p, "")  # part of the sentence before: neither a gap nor a sign of its own
    return out


def run_pattern(words: str) -> str:
    """A run of neighbouring parts (``|part|part|``) that joins to just these words, with an item number or none before them."""
    return r"(?<=\|)(?:[0-9]{1,2} )?" + words.replace(" ", "[ |]") + r"(?=\|)"


def _sequence(text: Column, known: dict[str, str]) -> Column:
    """Identifiers in text order as ``;A;B;;-;C;``: every identifier between semicolons of its own, gaps as ``-``."""
    flat = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    parts = F.filter(F.transform(F.split(text, BREAK), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))), lambda s: s != "")
    marked = F.concat(F.lit("|"), F.array_join(parts, "|"), F.lit("|"))
    for words in sorted(known, key=len, reverse=True):  # a sentence before those that it begins or ends with
        marked = F.regexp_replace(marked, run_pattern(words), f";{known[words]};")
    ids = F.filter(F.split(marked, r"\|"), lambda s: ~s.rlike("^([0-9]{1,2})?$"))  # an item number is no gap
    any_known = reduce_or([F.contains(flat, F.lit(k)) for k in known])
    return F.when(any_known, F.array_join(F.transform(ids, lambda s: F.when(F.startswith(s, F.lit(";")), s).otherwise(";-;")), "")).otherwise("")


def reduce_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def rule_pattern(sequence: str) -> str:
    return "".join(f"(;{s[:-1]};)?" if s.endswith("?") else f";{s};" for s in sequence.split())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = ALL_SENTENCES,
         rules: tuple[tuple[str, str], ...] = ALL_RULES) -> DataFrame:
    """``doc_id, license, n_matches, n_sentences`` of every document with a known licence sentence, a row per licence.

    ``n_sentences``: known sentences of the document; ``UNMATCHED`` counts those that no rule uses.
    """
    seq, left = fresh("seq"), [fresh("left") for _ in range(len(rules) + 1)]
    out = df.select(F.col(id_col).alias("doc_id"), _sequence(F.coalesce(F.col(text_col), F.lit("")), {normal(text): name for name, text in sentences.items()}).alias(seq))
    out = filter_here(out, F.col(seq).rlike("[A-Za-z]")).withColumn(left[0], F.col(seq))
    counts = []
    for j, (_, sequence) in enumerate(rules):
        counts.append(fresh("n"))
        out = out.withColumn(counts[-1], F.regexp_count(left[j], F.lit(rule_pattern(sequence)))).withColumn(left[j + 1], F.regexp_replace(left[j], rule_pattern(sequence), ";-;"))
    unmatched = F.regexp_count(left[-1], F.lit(";[A-Za-z0-9]+;"))
    per = {}
    for (name, _), c in zip(rules, counts):
        per[name] = per[name] + F.col(c) if name in per else F.col(c)
    per["UNMATCHED"] = unmatched
    rows = F.filter(F.array(*[F.struct(F.lit(name).alias("license"), n.cast("long").alias("n_matches")) for name, n in per.items()]), lambda r: r["n_matches"] > 0)
    return out.select("doc_id", F.regexp_count(seq, F.lit(";[A-Za-z0-9]+;")).cast("long").alias("n_sentences"), F.explode(rows).alias("r")).select(
        "doc_id", "r.license", "r.n_matches", "n_sentences")

"""License scans by diagonal voting, in DataFrame functions only.

Every text's rolling three-word hashes are joined to the places of the same
hashes in a fixed table of license wordings (a few thousand rows, so it is
broadcast).  A match of text place p with wording place q votes for the diagonal
p - q of that text and wording; votes are summed by diagonal, and diagonals a few
words apart are merged (words were inserted or dropped).  Merged diagonals with
enough of the wording's places are verified in the order of the text: a span ends
where the wording's place does not rise (the wording starts again) or the
diagonal leaves its neighbourhood, so repeated notices are as many spans, and a
span drifts by ``NEAR`` words at most for each place found; it counts if it holds
enough places itself.  Wordings that differ by a few words (a license with and
without a restriction) both reach that; :func:`licenses` leaves out a span that
lies in another one at least as well covered, of all that overlap.

Defined results: a null text is empty: no words, null places, empty labels and a
score of 0; repeated rows give repeated rows (a text is known by its id and its
hash, so copies do not add up votes); an empty table gives an empty result; extra
columns are ignored.  A very long text is one array of words in its task; its
matches and spans are rows, sorted by windows that spill.  Spans that overlap in
one chain are compared with one another in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals this far apart are merged.
NEAR = 6
#: The share of a wording's places that must be found.
COVERED = 0.6
#: The score of a text that only names a license.
NAMED = 0.5

# Phrases and labels of the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license wordings (statements, notices, headers).
WORDINGS = (
    ("mit", "Released under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("reserved", "All rights reserved."),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-only"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("cc-by", "SPDX-License-Identifier: CC-BY-4.0"),
    ("cc-by-nc", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("cc-by-sa", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BREAK), lambda w: w != "")


def grams(words: Column) -> Column:
    """The hash of the three words from each place on."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(GRAM))))
    return F.when(F.size(words) >= GRAM, each).otherwise(F.expr("cast(array() as array<bigint>)"))


def phrase_starts(words: Column, phrase: str) -> Column:
    """The places where a phrase's words stand; only texts with its last word are searched."""
    parts = phrase.split()
    here = lambda x, i: F.when((x == parts[0]) & _all(F.get(words, i + j) == p for j, p in enumerate(parts) if j), i.cast("long"))
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(F.array_contains(words, parts[-1]), F.array_compact(F.transform(words, here))).otherwise(none)


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def wording_places(spark: SparkSession, wordings=WORDINGS) -> DataFrame:
    """(g, wording, label, q, places): a row for each place of each wording."""
    quote = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({n}, {quote(label)}, {quote(text)})" for n, (label, text) in enumerate(wordings))
    table = spark.sql(f"select * from values {rows} as t(wording, label, t)").select("wording", "label", words_of(F.col("t")).alias("w"))
    return table.select("wording", "label", (F.size("w") - GRAM + 1).alias("places"), F.posexplode(grams(F.col("w"))).alias("q", "g"))


def license_spans(docs: DataFrame, wordings=WORDINGS) -> DataFrame:
    """(doc_id, h, label, first, last, coverage, found) for each verified span, words from 0, ends included."""
    text = text_of(docs)
    words = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("h"), words_of(text).alias("w"))
    # outer: for the inner form the optimizer adds a filter on the array's size and evaluates all of it there once more
    hashes = words.select("doc_id", "h", grams(F.col("w")).alias("gs")).select("doc_id", "h", F.posexplode_outer("gs").alias("p", "g"))
    hits = hashes.join(F.broadcast(wording_places(docs.sparkSession, wordings)), "g")
    key = ("doc_id", "h", "wording", "label", "places")
    votes = hits.groupBy(*key, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set(F.struct("p", "q")).alias("hits"))
    by = Window.partitionBy("doc_id", "h", "wording").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEAR).cast("int"), F.lit(1))
    merged = votes.withColumn("run", F.sum(new).over(by)).groupBy(*key, "run").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    likely = merged.where(F.size(F.array_distinct("hits.q")) >= COVERED * F.col("places")).select(*key, "run", F.inline("hits"))
    along = Window.partitionBy("doc_id", "h", "wording", "run").orderBy("p", "q")
    before = F.lag(F.struct("p", "q")).over(along)
    turns = (F.col("q") <= before["q"]) | (F.abs(F.col("p") - F.col("q") - before["p"] + before["q"]) > NEAR)
    traced = likely.withColumn("turn", F.coalesce(turns.cast("int"), F.lit(0))).withColumn("part", F.sum("turn").over(along))
    spans = traced.groupBy(*key, "run", "part").agg(F.min("p").alias("first"), (F.max("p") + GRAM - 1).alias("last"), F.count("*").cast("int").alias("found"))
    return spans.select("doc_id", "h", "label", "first", "last", F.round(F.col("found") / F.col("places"), 6).alias("coverage"), "found").where(F.col("coverage") >= COVERED)


def best_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, h, covered, spans): each text's spans in order, without those inside others at least as well covered.

    Only spans that overlap are compared: a group ends where one starts behind all before it.
    """
    ranked = spans.select("doc_id", "h", "first", (-F.col("coverage")).alias("lack"), (-F.col("found")).alias("fewer"), "label", "last")
    by = Window.partitionBy("doc_id", "h").orderBy("first", "lack", "fewer", "label", "last")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranked.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1))).withColumn("chain", F.sum("new").over(by))
    each = apart.groupBy("doc_id", "h", "chain").agg(F.min("lack").alias("lack"), F.sort_array(F.collect_set(F.struct("first", "lack", "fewer", "label", "last"))).alias("ranked"))
    best = F.filter("ranked", lambda s, i: ~F.exists(F.slice("ranked", 1, i), lambda b: (b["last"] >= s["last"]) & (b["lack"] <= s["lack"])))
    chains = each.select("doc_id", "h", "lack", best.alias("spans"))
    return chains.groupBy("doc_id", "h").agg((-F.min("lack")).alias("covered"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def licenses(docs: DataFrame, wordings=WORDINGS, phrases=PHRASES) -> DataFrame:
    """One row for each document: base phrases, labels of both, and a score."""
    text = text_of(docs)
    df = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("h"), words_of(text).alias("w"))
    df = df.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), *(phrase_starts(F.col("w"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)))
    starts = [F.col(f"p{i}") for i in range(len(phrases))]
    named = F.array_compact(F.array(*(F.when(F.size(s) > 0, label) for s, (_, label) in zip(starts, phrases, strict=True))))
    df = df.select("doc_id", "h", "n_words", F.concat(*starts).alias("all"), F.array_sort(F.array_distinct(named)).alias("named"))
    found = best_spans(license_spans(docs, wordings)).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("spans.label").alias("more"), "covered", "spans")
    out = df.join(found, (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    labels = F.array_sort(F.array_union("named", F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    return out.select(
        "doc_id", "n_words", F.size("all").cast("long").alias("n_base"),
        F.array_min("all").alias("first_word"), F.array_max("all").alias("last_word"),
        F.array_join("named", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("covered", F.lit(0.0)), F.when(F.size("all") > 0, NAMED).otherwise(0.0)).alias("score"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"].cast("string"), s["last"].cast("string"))), ","), F.lit("")).alias("spans"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ahead(k: int) -> str:
    return f"lead(w, {k}) over (partition by rid order by p)" if k else "w"


def _stands(phrase: str) -> str:
    """Whether a phrase starts at the word."""
    return "coalesce(" + " and ".join(f"{_ahead(k)} = {_quoted(w)}" for k, w in enumerate(phrase.split())) + ", false)"


#: Equal SQL: grams are compared as words, not as hashes, and rows are told apart by number.
ORACLE = rf"""
with wording as (select * from (values {", ".join(f"({n}, {_quoted(label)}, {_quoted(text)})" for n, (label, text) in enumerate(WORDINGS))}) as t(wording, label, text)),
texts as (select row_number() over () as rid, doc_id, null::int as wording, null as label, coalesce(text, '') as text from documents
          union all select -1 - wording, null, wording, label, text from wording),
split as (select rid, doc_id, wording, label, list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from texts),
word as (select rid, wording, label, len(ws) - 2 as places, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as p from split),
place as (select rid, wording, label, places, p, w || ' ' || {_ahead(1)} || ' ' || {_ahead(2)} as gram, {", ".join(f"{_stands(p)} as s{i}" for i, (p, _) in enumerate(PHRASES))} from word),
vote as (select t.rid, q.wording, q.label, q.places, t.p, q.p as q, t.p - q.p as diagonal
         from place t join place q on t.gram = q.gram and t.rid > 0 and q.rid < 0),
diagonals as (select distinct rid, wording, diagonal from vote),
steps as (select *, case when diagonal - lag(diagonal) over o <= {NEAR} then 0 else 1 end as new from diagonals window o as (partition by rid, wording order by diagonal)),
runs as (select rid, wording, diagonal, sum(new) over (partition by rid, wording order by diagonal) as run from steps),
hits as (select rid, wording, run, label, places, p, q from vote join runs using (rid, wording, diagonal)),
turns as (select *, case when q <= lag(q) over o or abs(p - q - lag(p - q) over o) > {NEAR} then 1 else 0 end as turn from hits window o as (partition by rid, wording, run order by p, q)),
parts as (select *, sum(turn) over (partition by rid, wording, run order by p, q) as part from turns),
likely as (select rid, label, min(p) as first, max(p) + 2 as last, count(*) as found, round(count(*) / any_value(places), 6) as coverage
           from parts group by rid, wording, label, run, part having coverage >= {COVERED}),
ranked as (select *, row_number() over (partition by rid order by first, coverage desc, found desc, label, last) as i from (select distinct * from likely)),
spans as (select * from ranked s where not exists (
            select 1 from ranked b where b.rid = s.rid and b.i < s.i and b.last >= s.last and b.coverage >= s.coverage)),
found as (select rid, max(coverage) as covered, list(distinct label) as more, list_sort(list(distinct {{'first': first, 'last': last, 'label': label}})) as spans from spans group by rid),
base as (select rid, sum({" + ".join(f"s{i}::int" for i in range(len(PHRASES)))})::bigint as n_base,
                min(p) filter ({" or ".join(f"s{i}" for i in range(len(PHRASES)))}) as first_word, max(p) filter ({" or ".join(f"s{i}" for i in range(len(PHRASES)))}) as last_word,
                list_filter([{", ".join(f"case when bool_or(s{i}) then {_quoted(label)} end" for i, (_, label) in enumerate(PHRASES))}], lambda x: x is not null) as named
         from place group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       array_to_string(list_sort(list_distinct(coalesce(named, []))), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(named, []), coalesce(more, [])))), ',') as labels,
       greatest(coalesce(covered, 0.0), case when n_base > 0 then {NAMED} else 0.0 end)::double as score,
       coalesce(array_to_string(list_transform(f.spans, lambda s: s.label || ':' || s.first || ':' || s.last), ','), '') as spans
from split left join base using (rid) left join found f using (rid)
where rid > 0
"""

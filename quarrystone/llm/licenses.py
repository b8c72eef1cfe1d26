"""License scans with a positional rare-token index. DataFrame functions only.

Words are runs of lower-case letters and digits (and anything beyond ASCII). The licence words of the templates get inverse document
frequencies over all documents. Of a file, the licence words it holds say which templates it can be at all: those whose mandatory words it
has every one of. For each of these the file's highest-IDF words among the template's mandatory ones are looked up: every place of such a word in the file less its
place in the template is where the template would begin. These postings are intersected by relative position, in buckets of BUCKET words
with some slack, so that files with words put in or left out still agree. What remains is verified: every mandatory phrase must stand near
where the bucket has it, by TOLERANCE words and an eighth of its distance from the rarest phrase. A place that can be verified holds all of the
looked-up words there, so none is missed, in any mix of notices. Verified labels join those of the base phrases, which always stay.
The score is the largest share of a verified template's words that stand in its stretch of the file.

Cases: a null or empty text has no words and no labels; repeated rows get equal results; an empty table gives an
empty result; extra columns are ignored; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import let, read_table, starts_of, text_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and labels of the base search.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words looked up for a template, width of a bucket of starts, and words by which a phrase may stand elsewhere.
LOOKUPS, BUCKET, TOLERANCE = 3, 8, 8
#: Distance between a looked-up word's phrase and the rarest one's, in words, and buckets by which its starts may then differ.
NEAR, SLACK = 64, 2
#: Fixed values: (label, text, mandatory phrases) of notices that stand in files, and of whole licences; lower case, words only.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "free software foundation", "version 3 of the license"]),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "free software foundation", "version 2 of the license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "this software and associated documentation files"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "the following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("lgpl-3.0", "gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("lgpl-2.1", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["gnu lesser general public license", "version 2 1 of the license"]),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license", "version 3 of the license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ["permission is hereby granted free of charge", "this permission notice shall be included in all copies", "the software is provided as is without warranty of any kind"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ["distribute this software for any purpose with or without fee", "this permission notice appear in all copies", "the author disclaims all warranties with regard to this software"],
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice", "endorse or promote products derived from this software without specific prior written permission"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ["without any express or implied warranty", "permission is granted to anyone to use this software for any purpose", "the origin of this software must not be misrepresented"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ["free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
]


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def idf(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, tuple[int, int]]:
    """word -> (documents that hold it, all documents), over all rows; the words are the templates', so the result is bounded."""
    words = _words(text_of(text_col))
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words, _strings(vocabulary(templates))))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    return {w: (counts.get(w, 0), total) for w in vocabulary(templates)}


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _words(text: Column) -> Column:
    """Words of the lower-cased (A-Z only) text, in order."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def _places(joined: Column, phrase: str) -> Column:
    """Word positions at which the phrase stands in ' w0 w1 ... '. Words that the phrase shares between places count for both."""
    body = phrase.split(" ")
    # a look-ahead for all but the first word and the blank after it, so that overlapping places are found
    pattern = f"(?<= ){body[0]}(?= {' '.join(body[1:])} )" if len(body) > 1 else f"(?<= ){body[0]}(?= )"
    parts = F.split(joined, pattern)
    blanks = lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))
    # the blanks before a place, but for the first one, are the words before it: the sum over the parts up to there
    found = lambda p: F.transform(F.slice(starts_of(F.transform(p, blanks)), 2, F.size(p)), lambda at: at - 1)
    return let(parts, lambda p: F.when(F.size(p) > 1, found(p)).otherwise(F.array().cast("array<int>")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    frequency = idf(docs, text_col, templates)
    index = _index_of(frequency, templates)
    rows = docs.select(F.col(id_col).alias("doc_id"), _words(text_of(text_col)).alias("words"))
    rows = rows.select("doc_id", "words", F.arrays_overlap("words", _strings(sorted({t["lookups"][0]["word"] for t in index}))).alias("present"))
    joined = F.when(F.exists("words", lambda w: w.isin(*sorted({p.split(" ")[0] for p in PHRASES}))), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise(F.lit(" "))
    rows = rows.select("doc_id", "words", "present", joined.alias("joined"))
    rows = rows.select("doc_id", "words", "present", *[_places(F.col("joined"), p).alias(f"p{k}") for k, p in enumerate(PHRASES)])
    places = F.concat(*[f"p{k}" for k in range(len(PHRASES))])
    labels = F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    found = F.when(F.col("present"), _matches(F.col("words"), index)).otherwise(F.array().cast("array<struct<label:string,share:double>>"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"), labels.alias("base"), found.alias("found"))
    joined_labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    own = F.transform("found", lambda x: x["label"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined_labels(F.col("base")).alias("base_labels"),
        joined_labels(F.concat("base", own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.when(F.size("places") > 0, F.lit(1.0)), F.lit(0.0)).alias("score"),
    )


def _index_of(frequency: dict[str, tuple[int, int]], templates, lookups: int = LOOKUPS) -> list[dict]:
    """For each template that some document can be: its words, mandatory words, looked-up words with their places (rarest first, ties by word),
    and phrases with places and tolerances. Templates with a mandatory word that no document holds are left out."""
    out = []
    for label, text, phrases in templates:
        body = text.split()
        starts = {phrase: _index(body, phrase) for phrase in phrases}
        must = sorted({w for phrase in phrases for w in phrase.split()})
        if any(frequency[w][0] == 0 for w in must):
            continue
        rarest = sorted((frequency[w][0], w, at, at + k) for phrase, at in starts.items() for k, w in enumerate(phrase.split()))
        centre = rarest[0][2]
        chosen: dict[str, int] = {}
        for _, w, start, place in rarest:
            if abs(start - centre) <= NEAR and len(chosen) < lookups:
                chosen.setdefault(w, place)
        parts = [{"at": at, "words": phrase.split(), "slack": TOLERANCE + abs(at - centre) // 8} for phrase, at in starts.items()]
        # the phrase with the rarest word comes first: its place names the bucket
        parts.sort(key=lambda x: (x["at"] != centre, x["at"]))
        out.append({"label": label, "body": body, "must": must, "lookups": [{"word": w, "place": p} for w, p in chosen.items()], "parts": parts})
    return out


def _matches(words: Column, index: list[dict]) -> Column:
    """Verified (label, share of the template's words that stand in its stretch)."""
    if not index:
        return F.array().cast("array<struct<label:string,share:double>>")
    vocabulary = _strings(sorted({w for t in index for w in t["must"]}))

    def buckets(hits: Column, word: str, place: int) -> Column:
        """Buckets of the starts that the places of a word give."""
        own = F.filter(hits, lambda x: x["w"] == word)
        return F.array_distinct(F.transform(own, lambda x: F.floor((x["i"] - place) / BUCKET).cast("int")))

    def wider(starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda b: F.sequence(b - SLACK, b + SLACK)))

    def stands(phrase: list[str]):
        return lambda i: F.slice(words, i + 1, F.lit(len(phrase))) == _strings(phrase)

    def verified(t: dict, b: Column) -> Column:
        """Whether all phrases stand near where the bucket has them."""
        first, ok = b * BUCKET, F.lit(True)
        for part in t["parts"]:
            size, slack = len(part["words"]), part["slack"] if part is not t["parts"][0] else 0
            low = F.greatest(first + part["at"] - slack, F.lit(0))
            high = F.least(first + BUCKET - 1 + part["at"] + slack, F.size(words) - size)
            places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            ok = ok & F.exists(places, stands(part["words"]))
        return ok

    def share(t: dict, b: Column) -> Column:
        low = F.greatest(b * BUCKET - TOLERANCE, F.lit(0))
        reach = len(t["body"]) + 2 * TOLERANCE + BUCKET + len(t["body"]) // 8
        own = sorted(set(t["body"]))
        return F.size(F.array_intersect(F.slice(words, low + 1, F.lit(reach)), _strings(own))) / len(own)

    def of_template(t: dict, hits: Column) -> Column:
        word, place = t["lookups"][0]["word"], t["lookups"][0]["place"]
        agreed = buckets(hits, word, place)
        for other in t["lookups"][1:]:
            agreed = F.array_intersect(agreed, wider(buckets(hits, other["word"], other["place"])))
        found = let(agreed, lambda bs: F.filter(bs, lambda b: verified(t, b)))
        return F.transform(found, lambda b: F.struct(F.lit(t["label"]).alias("label"), share(t, b).alias("share")))

    looked = sorted({x["word"] for t in index for x in t["lookups"]})
    numbered = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*looked))
    none = F.array().cast("array<struct<label:string,share:double>>")

    def of_all(held: Column, hits: Column) -> Column:
        # a template whose mandatory words the file doesn't all hold is passed over
        each = [F.when(F.size(F.array_except(_strings(t["must"]), held)) == 0, of_template(t, hits)).otherwise(none) for t in index]
        return F.flatten(F.array(*each))

    return let(F.array_intersect(words, vocabulary), lambda held: let(numbered, lambda hits: of_all(held, hits)))


def _index(text: list[str], phrase: str) -> int:
    part = phrase.split()
    return next(k for k in range(len(text)) if text[k : k + len(part)] == part)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))

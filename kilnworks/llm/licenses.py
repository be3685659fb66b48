"""License scans by ordered signature rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word is a run of digits, letters and characters beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The phrases whose places make the base columns, and their labels: fixed values of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Families of licenses: label, the words that name it, as a pattern over words joined by one blank, and the word of the name that gates its rules.
FAMILIES = [
    ("mit", "mit", "mit"), ("mit-0", "mit (?:no attribution|0)", "mit"), ("apache-1.1", "apache(?: software)?(?: license)?(?: version| v)? 1 1", "apache"), ("apache-2.0", "apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?", "apache"), ("gpl-1", "(?:gnu )?(?:gpl|general public license)(?: version| v)? 1(?: 0)?", "public gpl"),
    ("gpl-2", "(?:gnu )?(?:gpl|general public license)(?: version| v)? 2(?: 0)?", "public gpl"), ("gpl-3", "(?:gnu )?(?:gpl|general public license)(?: version| v)? 3(?: 0)?", "public gpl"), ("gpl-2", "gplv2", "gplv2"), ("gpl-3", "gplv3", "gplv3"), ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? 2 1", "lesser lgpl"),
    ("lgpl-3", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? 3(?: 0)?", "lesser lgpl"), ("agpl-3", "(?:gnu )?(?:agpl|affero general public license)(?: version| v)? 3(?: 0)?", "affero agpl"), ("gfdl", "(?:gnu )?free documentation license", "documentation"), ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause)", "bsd"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|bsd 3 clause)", "bsd"), ("bsd-4-clause", "(?:original bsd|bsd 4 clause)", "bsd"), ("bsd-0-clause", "(?:zero clause bsd|bsd 0 clause|0bsd)", "bsd 0bsd"), ("bsd", "bsd", "bsd"), ("mpl-1.1", "(?:mozilla public license|mpl)(?: version| v)? 1 1", "mozilla mpl"),
    ("mpl-2.0", "(?:mozilla public license|mpl)(?: version| v)? 2(?: 0)?", "mozilla mpl"), ("epl-1.0", "(?:eclipse public license|epl)(?: version| v)? 1 0", "eclipse epl"), ("epl-2.0", "(?:eclipse public license|epl)(?: version| v)? 2 0", "eclipse epl"), ("edl-1.0", "eclipse distribution license", "eclipse"),
    ("cddl-1.0", "(?:common development and distribution license|cddl)", "distribution cddl"), ("cpl-1.0", "common public license", "common"), ("ibm-pl", "ibm public license", "ibm"), ("isc", "isc", "isc"), ("zlib", "zlib(?: libpng)?", "zlib"), ("libpng", "libpng", "libpng"), ("boost-1.0", "boost software(?: license)?", "boost"), ("bsl-1.1", "business source", "business"),
    ("artistic-1.0", "artistic(?: license)? 1(?: 0)?", "artistic"), ("artistic-2.0", "artistic(?: license)? 2(?: 0)?", "artistic"), ("perl", "same terms as perl(?: itself)?", "perl"), ("python-2.0", "(?:python software foundation|psf)", "python psf"), ("ruby", "ruby", "ruby"), ("php-3.01", "php(?: license)? 3(?: 0?1)?", "php"), ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"), ("ssleay", "ssleay", "ssleay"), ("curl", "curl", "curl"), ("x11", "x11", "x11"), ("xfree86", "xfree86", "xfree86"), ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"), ("w3c", "w3c(?: software notice and)?", "w3c"), ("unicode", "unicode(?: inc)?", "unicode"), ("icu", "icu", "icu"),
    ("ofl-1.1", "(?:sil )?open font", "font"), ("unlicense", "(?:the )?unlicense", "unlicense"), ("wtfpl", "(?:wtfpl|do what the fuck you want to)", "wtfpl fuck"), ("beerware", "beer ?ware", "beerware beer"), ("json", "json", "json"), ("ms-pl", "microsoft public", "microsoft"), ("ms-rl", "microsoft reciprocal", "microsoft"), ("apsl-2.0", "apple public source", "apple"),
    ("eupl-1.2", "(?:european union public|eupl)", "european eupl"), ("cecill", "cecill", "cecill"), ("osl-3.0", "open software(?: license)?(?: version| v)? 3(?: 0)?", "open"), ("afl-3.0", "academic free", "academic"), ("ecl-2.0", "educational community", "educational"), ("upl-1.0", "universal permissive", "universal"), ("odbl", "open (?:data commons open )?database", "database"),
    ("odc-by", "open data commons attribution", "commons"), ("pddl", "(?:public domain dedication and|pddl)", "domain pddl"), ("cdla-permissive", "community data(?: license)?(?: agreement)? permissive", "community"), ("sspl-1", "(?:server side public|sspl)", "server sspl"), ("elastic-2.0", "elastic(?: license)?(?: version| v)? 2(?: 0)?", "elastic"), ("polyform", "polyform", "polyform"),
    ("commons-clause", "commons clause", "clause"), ("rail", "(?:responsible ai|openrail|creativeml open ?rail)", "responsible openrail creativeml"), ("llvm-exception", "apache(?: license)? 2 0 with llvm exceptions?", "llvm"), ("classpath-exception", "classpath exception", "classpath"), ("gcc-exception", "gcc runtime library exception", "gcc"), ("naist", "naist", "naist"), ("mulan-2.0", "mulan(?: psl)?", "mulan"),
    ("blueoak-1.0", "blue oak model", "oak"), ("fair", "fair", "fair"), ("vim", "vim", "vim"), ("tcl", "tcl(?: tk)?", "tcl"), ("sleepycat", "sleepycat", "sleepycat"), ("qpl", "(?:q public|qpl)", "qpl"), ("sun", "sun(?: industry standards source| public)", "sun"), ("intel", "intel(?: open source| simplified software)", "intel"), ("nvidia", "nvidia(?: source code| software)", "nvidia"),
]
#: Ways to name a license around a family's name: suffix of the rule's name, pattern, priority, confidence. Higher priorities win.
NOTICES = [
    ("grant", "(?:licensed|released|distributed|published|provided|available) (?:under|with|by) (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?{name}(?: license| licence)?", 60, 0.95),
    ("tag", "spdx license identifier {name}", 70, 1.0),
    ("name", "{name} (?:license|licence)", 40, 0.8),
]
#: Rules for single wordings: label, pattern, gating word, priority, confidence.
WORDINGS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 80, 0.98), ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial", 80, 0.9), ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", 80, 0.98),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 80, 0.95), ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote", "endorse", 85, 0.97), ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising", 85, 0.97),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable", 80, 0.95), ("apache-2.0", "you may not use this file except in compliance with the license", "compliance", 75, 0.9), ("apache-2.0", "www apache org licenses license 2 0", "apache", 75, 0.97),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute", 80, 0.97), ("gpl-3", "either version 3 of the license or (?:at your option )?any later version", "later", 65, 0.8), ("gpl-2", "either version 2 of the license or (?:at your option )?any later version", "later", 65, 0.8), ("gpl", "www gnu org licenses", "gnu", 50, 0.7),
    ("lgpl", "gnu lesser general public license", "lesser", 65, 0.85), ("agpl", "gnu affero general public license", "affero", 65, 0.85), ("lgpl", "gnu library general public license", "library", 65, 0.85), ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla", 80, 0.97), ("mpl", "mozilla public license", "mozilla", 40, 0.8), ("epl", "eclipse public license", "eclipse", 40, 0.8),
    ("boost-1.0", "boost software license", "boost", 60, 0.9), ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 80, 0.98), ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "authors", 75, 0.9), ("wtfpl", "do what the fuck you want to public license", "fuck", 80, 0.98),
    ("public-domain", "(?:released |placed |dedicated )?(?:in |into |to )?the public domain", "domain", 40, 0.7), ("public-domain", "(?:no copyright|no rights reserved)", "copyright reserved", 40, 0.6), ("proprietary", "all rights reserved", "reserved", 30, 0.5), ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary", 60, 0.9), ("proprietary", "(?:unauthorized|unauthorised) (?:copying|use|reproduction)(?: or distribution)?", "unauthorized unauthorised", 45, 0.7),
    ("proprietary", "commercial (?:license|licence) agreement", "commercial", 40, 0.6), ("proprietary", "end user (?:license|licence) agreement", "agreement", 60, 0.85), ("non-commercial", "(?:for )?non ?commercial (?:use|purposes) only", "commercial noncommercial", 50, 0.8), ("no-derivatives", "no derivative works(?: are)? (?:allowed|permitted)", "derivative", 50, 0.8), ("copyleft", "copyleft", "copyleft", 20, 0.4),
    ("copyright-notice", "copyright (?:c )?(?:[0-9]{4} )+", "copyright", 10, 0.3), ("dual", "dual(?:ly)? licensed under", "licensed", 35, 0.6), ("multi", "tri licensed under", "licensed", 35, 0.6),
]
#: Parts of the Creative Commons names; each combination and version is a rule.
CC_PARTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(rule, label, pattern over words joined by one blank, gating word, priority, confidence), several hundred of them.

    A family's base phrases are rules of priority 100, which nothing suppresses.
    """
    made = [(f"base:{label}", label, phrase, phrase.split(" ")[-1], 100, 1.0) for phrase, label in BASE.items()]
    for label, name, gates in FAMILIES:
        made += [(f"{label}:{kind}", label, shape.format(name=f"(?:{name})"), gate, priority, sure) for kind, shape, priority, sure in NOTICES for gate in gates.split(" ")]
    made += [(f"{label}:wording{i}", label, pattern, gate, priority, sure) for i, (label, pattern, gates, priority, sure) in enumerate(WORDINGS) for gate in gates.split(" ")]
    for short, long in CC_PARTS.items():
        for version in CC_VERSIONS:
            label = f"cc-{short}-{version}".replace(" 0", ".0").replace(" 5", ".5").replace(" ", "-")
            made += [(f"{label}:short", label, f"cc {short} {version}", "cc", 60 + len(short), 0.95), (f"{label}:name", label, f"creative commons {long}(?: [a-z]+)?(?: license)? {version}", "creative", 60 + len(short), 0.95)]
        made.append((f"cc-{short.replace(' ', '-')}:short", f"cc-{short.replace(' ', '-')}", f"cc {short}", "cc", 50 + len(short), 0.85))
    made += [("cc0:short", "cc0-1.0", "cc0(?: 1 0)?(?: universal)?", "cc0", 60, 0.95), ("cc:name", "cc", "creative commons", "creative", 30, 0.6)]
    return made


def normalise(text: Column) -> Column:
    """The words in lower case, each with a blank before it, and one blank more at the end; no words give one blank.

    lower() also changes letters beyond ASCII, in place and within their words: counts stay, and the only one that
    becomes a letter a-z is the Kelvin sign, whose k no base phrase has.
    """
    return F.lower(F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), NOT_WORD, " "))


def _blanks(array: str) -> str:
    return f"transform({array}, x -> length(x) - length(replace(x, ' ', '')))"


def detections(texts: DataFrame) -> DataFrame:
    """key, rule, label, priority, confidence, start and stop (in words, stop excluded) of all matches of the rules.

    texts: key and words, as normalise() gives them, one row for each key. Only pairs of a text and a rule whose gating
    word the text holds meet the rule's regular expression, once for the first such word of the rule.
    """
    earlier: dict[tuple[str, str, str], list[str]] = {}
    made = []
    for r in rules():
        before = earlier.setdefault(r[:3], [])
        made.append((list(earlier).index(r[:3]), *r, list(before)))
        before.append(r[3])
    table = texts.sparkSession.createDataFrame(made, "number int, rule string, label string, pattern string, gate string, priority int, confidence double, earlier array<string>")
    gates = sorted({r[3] for r in rules()})
    held = texts.withColumn("gates", F.array_intersect(F.split("words", " "), F.array(*map(F.lit, gates)))).withColumn("gate", F.explode("gates"))
    # the rules are a constant of this module
    tried = held.join(F.broadcast(table), "gate").filter(~F.arrays_overlap("earlier", "gates")).withColumn("regex", F.expr("concat(' (?:', pattern, ')(?= )')")).filter("words rlike regex")
    # the blanks before a match are the words before it: those of all gaps up to it and of all matches before it
    matches = tried.select("key", "number", "rule", "label", "priority", "confidence", F.expr(f"posexplode(arrays_zip({_blanks('split(words, regex, -1)')}, {_blanks('regexp_extract_all(words, regex, 0)')}))").alias("at", "both"))
    matches = matches.select("key", "number", "rule", "label", "priority", "confidence", "at", F.col("both").getField("0").alias("gap"), F.col("both").getField("1").alias("size")).filter("size is not null")
    upto = Window.partitionBy("key", "number").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    return matches.withColumn("stop", stop).select("key", "rule", "label", "priority", "confidence", (F.col("stop") - F.col("size")).cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def surviving(found: DataFrame) -> DataFrame:
    """key, start, stop, priority, labels and confidence of detections that no better one covers.

    A better one has a higher priority, or the same and more words. Sorted by start, and longer ones first, whatever
    covers a detection stands before it, so running maxima of the stops for each priority find it: no pairs are made.
    """
    places = found.groupBy("key", "start", "stop", "priority").agg(F.collect_set("label").alias("labels"), F.max("confidence").alias("confidence"))
    order = [F.col("start"), F.col("stop").desc()]
    same = Window.partitionBy("key", "priority").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    levels = sorted({r[4] for r in rules()})
    stops = places.withColumn("equal", F.max("stop").over(same)).withColumns({f"p{p}": F.max(F.when(F.col("priority") == p, F.col("stop"))).over(upto) for p in levels})
    better = F.greatest(F.lit(-1), F.lit(-1), *[F.when(F.col("priority") < p, F.col(f"p{p}")) for p in levels])
    covered = (F.coalesce("equal", F.lit(-1)) >= F.col("stop")) | (F.coalesce(better, F.lit(-1)) >= F.col("stop"))
    return stops.filter((F.col("priority") == 100) | ~covered).select("key", "start", "stop", "priority", "labels", "confidence")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Every whole text is reduced to its words once. Texts without any rule's gating word are done with that; the others
    are scanned once for each distinct text, found by its hash, so a hot group of copies is scanned once. A detection
    is suppressed where one of higher priority, or of the same priority and longer, covers it; base phrases never are.
    score is the largest confidence left, 0 without any. Places are counted in words from 0, and all of them count.
    spans holds (start, stop, labels) of what is left.

    A null text counts as empty. Repeated rows give repeated results; a null id stays null. No other column is read,
    so none can clash. Empty tables give no rows.
    """
    words = docs.select(docs[id_col].alias("doc_id"), normalise(docs[text_col].cast("string")).alias("words"))
    gate = f" (?:{'|'.join(sorted({r[3] for r in rules()}))}) "
    # rows without a gating word, empty ones among them, meet nothing: their key is made of the id, so that they are dealt out evenly
    gated, by_text = F.col("words").rlike(gate), F.xxhash64("words")
    words = words.withColumn("key", F.when(gated, F.struct(by_text.alias("hash"), F.length("words").alias("length"))).otherwise(F.struct(F.xxhash64("doc_id", by_text).alias("hash"), F.lit(-1).alias("length"))))
    left = surviving(detections(words.filter(gated).dropDuplicates(["key"]).select("key", "words")))
    base = F.col("priority") == 100
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.flatten(labels))), ",")
    per_text = left.groupBy("key").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"), join(F.collect_set(F.when(base, F.col("labels")))).alias("base_labels"),
        join(F.collect_set("labels")).alias("labels"), F.max("confidence").alias("score"), F.sort_array(F.collect_list(F.struct("start", "stop", "labels"))).alias("spans"),
    )
    rows = words.select("doc_id", "key", (F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"))
    return rows.join(per_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, stop: bigint, labels: array<string>>>)")).alias("spans"),
    )

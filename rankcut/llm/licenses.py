"""License scans: TF-IDF cosine of text passages to templates, then inheritance from the nearest ancestor directory. DataFrame functions only."""

from __future__ import annotations

import json
import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.llm.frames import number_of, numbered
from rankcut.operators.ordering import BROADCAST_GROUPS, join_groups
from rankcut.session import stage

SIMILARITY = 0.75
DIRECTORIES = 100_000  # licensed directories that are broadcast once counted

# Names of licenses in identifier lines, and the license they stand for here.
IDENTIFIERS = {
    **{name: name for name in (
        "0BSD", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
        "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "ISC", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
    )},
    **{f"{name}{suffix}": name for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for suffix in ("", "-only", "-or-later")},
}
# Statements by which texts declare a license, several per license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("Proprietary", "All rights reserved"),
]
# Words that tell one license from another. A passage must hold those of its template, and all its numbers.
TELLING = set("apache mit fee gnu lesser affero endorse redistribution mozilla eclipse unencumbered cc0 cc by by-sa by-nc by-nd by-nc-sa by-nc-nd attribution noncommercial rights reserved".split())
TELLING |= {f"attribution-{x}" for x in ("sharealike", "noncommercial", "noderivatives", "noncommercial-sharealike", "noncommercial-noderivatives")}
# Words that turn one license into another; a passage with one of these is not near a template without it.
QUALIFIERS = ["lesser", "library", "affero", "noncommercial", "sharealike", "noderivatives"]
# Statements that also stand in texts of other licenses only count where no other one does, in this order.
RANKS = {"BSD-2-Clause": 1, "Proprietary": 2}
# Names of files that license their directory.
LICENSE_FILES = ["license", "licence", "copying", "notice", "unlicense"]
ADDED = ["own_license", "own_similarity", "inherited_license", "inherited_from", "license"]
_DIRECTORY = r"^(.*)/[^/]*$"


_IDENTIFIER = r"spdx-license-identifier[^\S\n]*:[^\S\n]*\(*[^\S\n]*"
_UNIT = "spdx-license-identifier."  # an identifier line is one term, together with the name it gives


def terms(text: Column) -> Column:
    """Lower-cased terms: letters and digits, with single dots and dashes inside, so that versions stay whole."""
    lower = F.lower(text)
    joined = F.when(lower.contains("spdx-license-identifier"), F.regexp_replace(lower, _IDENTIFIER, _UNIT)).otherwise(lower)
    return F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def template_terms(statement: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", re.sub(_IDENTIFIER, _UNIT, statement.lower()))


IDENTIFIED = {template_terms(f"SPDX-License-Identifier: {name}")[0]: license for name, license in IDENTIFIERS.items()}


def rules(statement: str) -> tuple[list[str], list[str]]:
    """Terms that a passage near this template must hold, and terms that it must not."""
    own = sorted(set(template_terms(statement)))
    return [t for t in own if t in TELLING or any(c.isdigit() for c in t)], [t for t in QUALIFIERS if t not in own]


RUN = max(len(template_terms(s)) for _, s in TEMPLATES)  # terms of the longest template, and of the longest run that is compared


def weigh_templates(idf: dict[str, float], similarity: float) -> tuple[list[tuple], list[str]]:
    """Unit vectors of the templates, and signal terms: a passage without any of these is too far from every template.

    Without its signal terms, a template's vector is shorter than ``similarity``, and so is every cosine with it.
    """
    rows, signals = [], set()
    for number, (license, statement) in enumerate(TEMPLATES):
        tf = Counter(template_terms(statement))
        weights = {t: n * idf[t] for t, n in tf.items()}
        norm = sqrt(sum(w * w for w in weights.values()))
        rows += [(number, license, t, w / norm) for t, w in weights.items()]
        rest = 1.0
        for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
            if sqrt(max(rest, 0.0)) < similarity - 1e-9:
                break
            signals.add(t)
            rest -= (w / norm) ** 2
    return rows, sorted(signals)


def by_template(rows: list[tuple]) -> dict[int, dict[str, float]]:
    """Squared weight of every term of every template."""
    squares: dict[int, dict[str, float]] = {}
    for number, _, term, weight in rows:
        squares.setdefault(number, {})[term] = weight * weight
    return squares


def constant(values: list[str]) -> Column:
    """Strings without blanks as one constant array."""
    return F.split(F.lit(" ".join(values)), " ")


def template_list(rows: list[tuple], idf: dict[str, float]) -> Column:
    """The templates as one constant: terms that a passage must hold, all terms, their squared weights and their weights times ``idf``."""
    entries = []
    for number, squares in by_template(rows).items():
        factors = [sqrt(square) * idf[t] for t, square in squares.items()]
        entries.append({"required": rules(TEMPLATES[number][1])[0], "known": list(squares), "squares": list(squares.values()), "factors": factors})
    return F.from_json(F.lit(json.dumps(entries)), "array<struct<required:array<string>, known:array<string>, squares:array<double>, factors:array<double>>>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def may_reach(words: Column, known: Column, templates: Column, idf: dict[str, float], similarity: float) -> Column:
    """Whether these terms can be near any template: their product with it is known, and every other distinct term has a weight of at least 1.

    ``known``: those of the terms that stand in a template, a column of its own since every template looks through it.
    """
    weights = F.map_from_arrays(constant(list(idf)), F.from_json(F.lit(json.dumps(list(idf.values()))), "array<double>"))
    shortest = total(F.transform(known, lambda t: F.pow(F.try_element_at(weights, t), 2))) + F.size(F.array_distinct(words)) - F.size(F.array_distinct(known))

    def product(template: Column) -> Column:
        return total(F.zip_with(template["known"], template["factors"], lambda term, factor: factor * F.size(F.filter(known, lambda t: t == term))))

    return F.array_max(F.transform(templates, product)) >= (similarity - 1e-9) * F.sqrt(shortest)


def shared(words: Column, template: Column, squares: Column) -> Column:
    return total(F.zip_with(template, squares, lambda t, s: F.when(F.array_contains(words, t), s).otherwise(0.0)))


def may_hold(present: Column, templates: Column, similarity: float) -> Column:
    """Whether a text with these template terms can hold an identifier, or a passage near a template."""

    def near(template: Column) -> Column:
        complete = F.forall(template["required"], lambda t: F.array_contains(present, t))
        return complete & (shared(present, template["known"], template["squares"]) >= similarity**2 - 1e-9)

    return F.arrays_overlap(present, constant(list(IDENTIFIED))) | F.exists(templates, near)


def runs_near(windows: DataFrame, rows: list[tuple], signals: list[str], similarity: float) -> DataFrame:
    """Runs of at most ``RUN`` terms that can be near a template, cut from distinct ``windows`` around signal terms: ``w, i, size, terms``.

    The best run begins and ends with terms of the template: others at its ends only lengthen its vector.
    """
    table = [(t, list(s), list(s.values()), rules(TEMPLATES[n][1])[0]) for n, s in by_template(rows).items() for t in s if t in signals]
    templates = windows.sparkSession.createDataFrame(table, "term string, known array<string>, squares array<double>, required array<string>")
    enough = similarity**2 - 1e-9
    complete = lambda words: F.size(F.array_except("required", words)) == 0
    around = windows.join(F.broadcast(templates), "term").where(complete(F.col("around")) & (shared(F.col("around"), F.col("known"), F.col("squares")) >= enough))
    around = around.withColumn("ends", F.array_compact(F.transform("around", lambda t, i: F.when(F.array_contains("known", t), i))))
    runs = F.flatten(F.transform("ends", lambda i: F.transform(F.filter("ends", lambda j: (j >= i) & (j - i < RUN)), lambda j: F.struct(i.alias("i"), (j - i + 1).alias("size")))))
    cut = around.select("*", F.inline(runs)).withColumn("terms", F.slice("around", F.col("i") + 1, F.col("size")))
    near = cut.where(complete(F.col("terms")) & (shared(F.col("terms"), F.col("known"), F.col("squares")) >= enough))
    return near.select("w", "i", "size", "terms").distinct()


def nearest_templates(contents: DataFrame, weights: DataFrame, factors: DataFrame, similarity: float) -> DataFrame:
    """``h, best``: the template that a passage's terms are nearest to, if any: (rank, similarity negated, license)."""
    counts = contents.select("h", F.explode("terms").alias("term")).groupBy("h", "term").agg(F.count("*").alias("tf"))
    weighed = join_groups(counts, factors, ["term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("h").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("vector"))
    held = F.filter(F.transform("vector", lambda x: x["term"]), lambda t: t.isin(QUALIFIERS))
    met = norms.withColumn("held", F.array_sort(held)).select("h", "norm", "held", F.inline("vector")).join(F.broadcast(weights), "term")
    dots = met.groupBy("h", "norm", "held", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.sum("must").alias("must"))
    known = []
    for number, (license, statement) in enumerate(TEMPLATES):
        required, forbidden = rules(statement)
        known.append((number, license, RANKS.get(license, 0), len(required), forbidden))
    templates = contents.sparkSession.createDataFrame(known, "template int, license string, rank int, required long, forbidden array<string>")
    close = dots.join(F.broadcast(templates), "template").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9))
    close = close.where((F.col("similarity") >= similarity) & (F.col("must") == F.col("required")) & ~F.arrays_overlap("held", "forbidden"))
    return close.groupBy("h").agg(F.min(F.struct("rank", (-F.col("similarity")).alias("far"), "license")).alias("best"))


def scan_licenses(files: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """License of every file: columns of ``files`` other than ``text``, then ``own_license, own_similarity, inherited_license, inherited_from, license``.

    ``files`` has ``path`` (slashes separate directories) and ``text``. Compared with the templates are: every run of at most as many
    terms as the longest template has, across line ends; every line; the header block (up to the first blank line); and the whole text of files with a license
    file's name. Terms are weighted by their document frequency over all files. A passage counts for a template if it also holds the words and
    numbers that tell its license from others, and no word that makes another license of it. An identifier line and the name in it are one term, so it is
    near only if the name is equal; unknown names are no license. The best passage decides (ties: the license first
    in the alphabet); "all rights reserved" decides only where nothing else does. A file licenses its directory if its name says so, or if the license passages cover at least half of its terms. A file
    without a license of its own takes that of the nearest directory above it that has one; of several license files
    in a directory, the most similar one counts, then the first path.

    Null and empty texts have no license of their own. Rows with one path share what any of them declares; rows with a null path are taken
    together and inherit nothing. Repeated rows stay. Empty tables give no rows.
    """
    spark = files.sparkSession
    vocabulary = sorted({t for _, s in TEMPLATES for t in template_terms(s)})
    body = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    known = constant(vocabulary)
    counted = body.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(terms(F.col("text")), known))).alias("term"))
    frequency = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most one row per template term
    files_in_all = frequency.pop("", 0)
    idf = {t: log((files_in_all + 1) / (frequency.get(t, 0) + 1)) + 1 for t in vocabulary}
    rows, signals = weigh_templates(idf, similarity)
    must = {(n, t) for n, (_, statement) in enumerate(TEMPLATES) for t in rules(statement)[0]}
    weights = spark.createDataFrame([(n, t, w, int((n, t) in must)) for n, _, t, w in rows], "template int, term string, weight double, must int")

    # Passages are only cut from texts that hold enough terms of some template, and all those it must have.
    named = F.lower(F.regexp_extract(F.col("path"), r"([^/]*)$", 1))
    named = F.coalesce(F.regexp_replace(named, r"\.(txt|md|rst|html)$", "").isin(LICENSE_FILES), F.lit(False))
    per_line = F.transform(F.split("text", "\n"), terms)
    header = F.size(terms(F.get(F.split(F.regexp_replace("text", r"^\s+", ""), r"\n[^\S\n]*\n", 2), F.lit(0))))
    templates = template_list(rows, idf)
    # The template terms of a text are rows of their own before they are looked at, so that they are formed once.
    present = F.array_intersect(terms(F.col("text")), constant([*vocabulary, *IDENTIFIED]))
    looked = body.select("path", "text", F.inline(F.array(F.struct(present.alias("present")))))
    hinted = looked.where(may_hold(F.col("present"), templates, similarity)).select("path", "text", F.inline(F.array(F.struct(per_line.alias("lines")))))
    hinted = hinted.select("path", F.xxhash64("text").alias("copy"), "lines", F.flatten("lines").alias("all"), header.alias("header"), named.alias("named"))
    hinted = stage(hinted.withColumn("words", F.size("all")), "hinted")
    # Each term with its place in its line and the size of that line.
    placed = F.flatten(F.transform("lines", lambda line: F.transform(line, lambda t, k: F.struct(t.alias("t"), k.alias("k"), F.size(line).alias("n")))))
    marks = F.transform(placed, lambda x, i: F.struct(x["t"].alias("term"), i.alias("at"), (i - x["k"]).alias("first"), x["n"].alias("n")))
    marks = F.filter(marks, lambda x: x["term"].isin([*signals, *IDENTIFIED]))
    marked = hinted.select("path", "copy", "words", "all", marks.alias("marks"), F.array("header", F.when(F.col("named"), F.col("words"))).alias("whole"))
    key = ["path", "copy", "words"]

    def span(start: Column, size: Column) -> Column:
        terms = F.slice("all", start + 1, size)
        return F.struct(start.alias("start"), size.alias("size"), terms.alias("terms"), F.filter(terms, lambda t: t.isin(vocabulary)).alias("known"))

    own_line = F.transform("marks", lambda m, i: F.when((i == 0) | (F.get("marks", F.greatest(i - 1, F.lit(0)))["first"] != m["first"]), span(m["first"], m["n"])))
    blocks = F.transform("whole", lambda n: F.when(n > 0, span(F.lit(0), n)))
    spans = marked.select(*key, F.inline(F.array_compact(F.concat(own_line, blocks)))).where(may_reach(F.col("terms"), F.col("known"), templates, idf, similarity))
    spans = stage(spans.drop("known").distinct().withColumn("h", F.xxhash64("terms")), "spans")

    def surrounded(m: Column) -> Column:
        low = F.greatest(m["at"] - (RUN - 1), F.lit(0))
        return F.struct(m["term"].alias("term"), low.alias("low"), F.slice("all", low + 1, m["at"] - low + RUN).alias("around"))

    # Windows with the same terms are looked into once, however often a statement is repeated.
    windows = marked.select(*key, F.inline(F.transform(F.filter("marks", lambda m: m["term"].isin(signals)), surrounded))).withColumn("w", F.xxhash64("term", "around"))
    runs = runs_near(windows.select("w", "term", "around").dropDuplicates(["w"]), rows, signals, similarity)
    runs = stage(runs.withColumn("h", F.xxhash64("terms")), "runs")
    contents = stage(spans.select("h", "terms").unionByName(runs.select("h", "terms")).dropDuplicates(["h"]), "contents")
    # Every term of these passages has its own weight: all files that hold it count, not only those with such a passage.
    wanted = stage(contents.select(F.explode("terms").alias("term")).distinct(), "wanted")
    held = body.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    if wanted.count() <= BROADCAST_GROUPS:
        held = held.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    else:  # one row per term meets one row per term
        held = held.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term", "left_semi")
    factors = held.select("term", (F.log(F.lit(files_in_all + 1) / (F.col("n") + 1)) + 1).alias("idf"))
    nearest_of = stage(nearest_templates(contents, weights, factors, similarity), "nearest")

    places = F.sequence("start", F.col("start") + F.col("size") - 1).alias("places")
    by_span = join_groups(spans.drop("terms"), nearest_of, ["h"], staged=True).select(*key, "best", places)
    inside = F.sequence("i", F.col("i") + F.col("size") - 1)
    by_window = join_groups(runs.drop("terms"), nearest_of, ["h"], staged=True).groupBy("w").agg(F.min("best").alias("best"), F.array_distinct(F.flatten(F.collect_list(inside))).alias("covers"))
    found = join_groups(windows.select(*key, "w", "low"), by_window, ["w"])
    found = found.select(*key, "best", F.transform("covers", lambda c: c + F.col("low")).alias("places"))
    names = F.map_from_arrays(constant(list(IDENTIFIED)), constant(list(IDENTIFIED.values())))
    given = marked.select(*key, F.inline(F.filter("marks", lambda m: F.array_contains(constant(list(IDENTIFIED)), m["term"]))))
    exact = F.struct(F.lit(0).alias("rank"), F.lit(-1.0).alias("far"), F.try_element_at(names, F.col("term")).alias("license"))
    given = given.select(*key, exact.alias("best"), F.array("at").alias("places"))
    matched = stage(by_span.unionByName(found).unionByName(given), "matched")
    per_file = matched.groupBy(*key).agg(F.min("best").alias("best"))
    # Passages overlap: what they cover together counts once.
    covered = matched.select("path", "copy", F.explode("places").alias("at")).distinct().groupBy(F.col("path").alias("_p"), F.col("copy").alias("_c")).agg(F.count("*").alias("said"))
    declared = stage(per_file.join(covered, F.col("path").eqNullSafe(F.col("_p")) & (F.col("copy") == F.col("_c"))).drop("_p", "_c"), "licenses")
    best = F.min("best").alias("best")
    own = declared.groupBy("path").agg(best).select(F.col("path").alias("_path"), F.col("best.license").alias("own_license"), (-F.col("best.far")).alias("own_similarity"))

    sized = declared.where(F.col("path").isNotNull())
    license_files = sized.where(named | (2 * F.col("said") >= F.col("words")))
    directory = F.regexp_extract("path", _DIRECTORY, 1)
    licensed = license_files.where(F.col("path").contains("/")).groupBy(directory.alias("_dir")).agg(F.min(F.struct(F.col("best.rank").alias("rank"), F.col("best.far").alias("s"), "path", F.col("best.license").alias("license"))).alias("l"))
    licensed = stage(licensed.select("_dir", F.col("l.license").alias("inherited_license"), F.col("l.path").alias("inherited_from")), "licensed")
    small = licensed.count() <= DIRECTORIES

    # Ancestors of the distinct directories, not of every file.
    folders = files.where(F.col("path").contains("/")).select(directory.alias("folder")).distinct()
    parts = F.split("folder", "/")
    ancestors = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("_dir")))).alias("a")).select("folder", "a.depth", "a._dir")
    nearest = ancestors.join(F.broadcast(licensed) if small else licensed, "_dir").groupBy("folder").agg(F.max(F.struct("depth", "inherited_license", "inherited_from")).alias("n"))
    nearest = nearest.select(F.col("folder").alias("_in"), "n.inherited_license", "n.inherited_from")

    others = files.drop("text")
    path = F.col(number_of(others, "path"))
    plain = numbered(others).withColumn("_in", F.when(path.contains("/"), F.regexp_extract(path, _DIRECTORY, 1)))
    # A folder may hold most of the files.
    joined = join_groups(plain.join(own, path.eqNullSafe(F.col("_path")), "left"), nearest, ["_in"], "left")
    heir = F.col("own_license").isNull()
    result = joined.select(
        *[c for c in plain.columns if c != "_in"], "own_license", "own_similarity", F.when(heir, F.col("inherited_license")).alias("inherited_license"),
        F.when(heir, F.col("inherited_from")).alias("inherited_from"), F.coalesce("own_license", "inherited_license").alias("license"),
    )
    return result.toDF(*others.columns, *ADDED)

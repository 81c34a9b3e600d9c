import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankcut.llm.decontaminate import decontaminate, find_overlaps
from rankcut.llm.licenses import TEMPLATES, scan_licenses, weigh_templates
from rankcut.llm.packing import balance, pack_documents
from rankcut.llm.pii import BASE, base_spans, estimate, find_personal_data, fit_classifier, luhn, redact
from rankcut.llm.sharding import jump_hash, shard_documents
from rankcut.llm.token_counts import Emitter, count_tokens, pre_token_starts
from rankcut.operators.vocab import byte_alphabet

from .conftest import prose

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "  two", "it's 're'll don't 'veel 'r 'l' ''s !'s x's", "a\n\n  b\t\t c \n", " x　 y", "<|endoftext|>x <|endoftext|>", "<|ENDOFTEXT|>", "é 12½ ١٢ 日本語 'tis", "x" * 3000,
       "\x85\x1c\x1f a b", "👍🏽 'm", "Å H̱ İx ŒuVre,. Straße&& 12,3", "x,y ª º. ŉ"]


# Sharding


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_one_key_at_a_time():
    keys = np.array([0, 1, -1, 2**62, -(2**63), *range(100, 400)], np.int64)
    for shards in (1, 2, 8, 9, 1000):
        assert jump_hash(keys, shards).tolist() == [plain_jump(int(k) & (2**64 - 1), shards) for k in keys]
    with pytest.raises(ValueError):
        jump_hash(keys, 0)


def test_shards_have_gapless_slots_and_grow_into_the_new_one(spark, awkward, nothing):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text")).union(awkward.select("doc_id", "text"))
    rows = shard_documents(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert len(rows) == 3012 and set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows}
    assert (5, 3, zlib.crc32("é".encode())) in sizes and (3, 1, 0) in sizes
    assert shard_documents(nothing).count() == 0


# Packing


def test_balanced_packing_fills_every_sequence_but_the_last_tokens():
    lengths = [4096, 3000, 2000, 100, 100, 5, 0, 3000]
    pieces = balance(lengths)
    assert {(i, s + k) for i, s, n, _, _ in pieces for k in range(n)} == {(i, k) for i, n in enumerate(lengths) for k in range(n)}
    filled = defaultdict(int)
    for _, _, n, seq, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == filled[seq]
        filled[seq] += n
    assert len(filled) == -(-sum(lengths) // 4096) and max(filled.values()) <= 4096


@pytest.mark.parametrize("partitions", [2, 30])
def test_packed_ids_are_those_of_the_library(spark, awkward, nothing, partitions):
    path = public.path("word_bpe_49k.json")
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").union(odd)
    expected = Counter()
    library = tokenizers.Tokenizer.from_file(path)
    for r in docs.collect():
        expected[r["doc_id"], tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])] += 1
    docs = docs.coalesce(2) if partitions == 2 else docs.repartition(partitions)
    rows = sorted(pack_documents(docs, path, block=50_000).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    filled, found = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r["offset"] == filled[r["sequence_id"]] and r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        filled[r["sequence_id"]] += r["length"]
        found[r["doc_id"]].append((r["start"], tuple(r["ids"]), r["doc_tokens"]))
    # Less than one sequence is padding, however small partitions are.
    assert max(filled.values()) <= 4096 and sum(4096 - n for n in filled.values()) < 4096
    bare = pack_documents(docs, path, block=50_000, with_ids=False)
    assert bare.columns == [c for c in rows[0].asDict() if c != "ids"] and bare.count() == len(rows)
    for (doc, ids), n in expected.items():
        if sum(1 for d, _ in expected if d == doc) == 1 and n == 1:
            pieces = sorted(found[doc])
            assert sum((p[1] for p in pieces), ()) == ids and all(p[2] == len(ids) for p in pieces)
    assert sum(filled.values()) == sum(len(i) * n for (_, i), n in expected.items())
    assert pack_documents(nothing, path).count() == 0


# Token counts


def test_counts_are_those_of_the_library(spark, awkward, nothing):
    path = public.path("byte_bpe_50k.json")
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").union(odd)
    library = tokenizers.Tokenizer.from_file(path)
    expected = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        expected[r["doc_id"], len(t.encode()), n, n > 1024] += 1
    assert Counter(map(tuple, count_tokens(docs, path).collect())) == expected
    assert count_tokens(nothing, path).count() == 0


def test_compiled_transducer_counts_as_the_library_encodes():
    """On texts of few letters, where merges compete most, on any bytes of characters, and with states dropped and compiled anew."""
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(12)
    pools = ["aeinrst", "abcdefghijklmnopqrstuvwxyz", "äöüßéèàçñ", "0123456789", ".,;:!?-_*#", "日本語のテキスト", "👍🏽🙂é", "ABCabc"]
    words = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 24))) for pool in pools for _ in range(1500)]
    words = sorted({p for w in words for p, _ in library.pre_tokenizer.pre_tokenize_str(w)})
    alphabet = {c: b for b, c in enumerate(byte_alphabet())}
    expected = [len(library.model.tokenize(w)) for w in words]
    data = [bytes(alphabet[c] for c in w) for w in words]
    whole, small = Emitter(path), Emitter(path, states=500, pairs=300)
    assert [whole.count(d) for d in data] == expected == [small.count(d) for d in data]
    assert len(whole.transitions) < sum(map(len, data)) and len(small.states) < 600


def test_chunked_scan_equals_one_state_at_a_time():
    from rankcut.llm.token_counts import _TABLE, BEFORE, HERE, START

    classes = np.random.default_rng(3).integers(0, 12, 5000).astype(np.uint8)
    state, starts = START, np.zeros(len(classes), bool)
    for i, c in enumerate(classes):
        state, out = _TABLE[state][c]
        starts[i] |= bool(out & HERE)
        if out & BEFORE:
            starts[i - 1] = True
    for steps in (1, 7, 256, 10_000):
        assert (pre_token_starts(classes, steps) == starts).all()


# Personal data

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[ -]", "", s)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}
PRIVATE = ["a@b.c_d@e.f x@y @z a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111-1111 1111  4111111111111112", "+1 (743) 555-3824+44 20 7946 0958 +1", "é x@y.zz", "1" * 50, "+1((((2"]


@pytest.mark.parametrize("text", PRIVATE)
def test_plain_spans_equal_the_patterns(text):
    found = base_spans(text)
    for kind, (pattern, valid) in PLAIN.items():
        assert found[kind] == [m.span() for m in re.finditer(pattern, text) if valid(m.group())]


def test_personal_data_of_awkward_rows(spark, awkward, nothing):
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(50 + i, t) for i, t in enumerate(PRIVATE)] + [(80 + i, f'x token = "{i:02d}be64439e3e49cf46b2d7c90f3602a3d0b907ff"') for i in range(9)], "doc_id long, text string"))
    rows = find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        plain = [s for s in r["spans"].split(",") if s.split(":")[0] in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(plain).encode()).hexdigest()
    assert all("secret:11:51" in r["spans"] for r in rows if r["doc_id"] and r["doc_id"] >= 80)
    assert not any(r["n_added"] for r in rows if not r["doc_id"] or r["doc_id"] < 50)
    assert find_personal_data(nothing).count() == 0


def test_likelihoods_follow_agreement():
    patterns = [((1, 1, 0), 50), ((-1, -1, 0), 80), ((1, -1, 0), 3), ((-1, 0, 0), 20)]
    q, theta = estimate(patterns)
    assert q[0] > 0.95 and q[1] < 0.05 and q[3] < 0.3 and np.allclose(theta.sum(axis=2), 1)
    assert len(fit_classifier(patterns, q)) == 7


def test_redaction_keeps_other_columns(spark, awkward):
    out = redact(awkward)
    assert out.schema == awkward.schema and out.count() == awkward.count()
    text = redact(spark.createDataFrame([(1, "mail a@b.co now 1.2.3.4")], "doc_id long, text string")).collect()[0]["text"]
    assert text == "mail [EMAIL] now [IP]"


# Decontamination


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(40, 501)), (2, prose(30, 502)), (3, "too short"), (4, None), (None, prose(25, 503)), (5, prose(9, 504))], "item_id long, text string")


def test_overlaps_tolerate_substitutions(spark, benchmark, nothing):
    item = prose(40, 501).split(" ")
    swapped = [w if i % 9 else "other" for i, w in enumerate(item)]
    half = item[:8] + [f"q{i}" for i in range(40)]
    texts = [(1, f"{prose(300, 9)} {prose(40, 501).upper()}. {prose(10, 8)}"), (2, " ".join(swapped)), (3, " ".join(half)), (4, prose(500, 10)), (5, prose(9, 504)), (6, None), (None, f"x {prose(25, 503)}"), (7, ""), (1, prose(40, 501)), (8, "this is, of all things, TOO SHORT indeed")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["matched"], r["compared"]) for r in find_overlaps(docs, benchmark).collect()}
    assert set(found) == {(1, 1), (2, 1), (5, 5), (None, None), (8, 3)}
    assert found[1, 1] == (16, 16) and found[2, 1][0] < 16 and found[5, 5] == (9, 9)
    kept = decontaminate(docs, benchmark).collect()
    assert sorted((str(r["doc_id"]) for r in kept)) == ["3", "4", "6", "7"]
    assert find_overlaps(nothing, benchmark).count() == 0 and find_overlaps(docs, benchmark.limit(0)).count() == 0


def test_large_benchmarks_are_joined_by_a_shuffle(spark, benchmark, monkeypatch):
    import rankcut.llm.decontaminate as module

    docs = spark.createDataFrame([(1, f"{prose(300, 9)} {prose(40, 501)} {prose(60, 8)}"), (2, prose(30, 502))], "doc_id long, text string")
    few = {tuple(r) for r in find_overlaps(docs, benchmark).collect()}
    monkeypatch.setattr(module, "SEED_ROWS", 0)
    assert {tuple(r) for r in find_overlaps(docs, benchmark).collect()} == few != set()


def test_hits_of_a_benchmark_with_copies_and_long_items_stay_in_place(spark):
    """Seeds carry no tokens, and equal items are sought once: no position of a document is shuffled."""
    long = prose(1200, 505)
    benchmark = spark.createDataFrame([(i, long) for i in range(6)] + [(6, "one two three"), (7, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{prose(80, 9)} {' '.join(long.split()[600:640])}"), (2, "one two three"), (3, prose(30, 10))], "doc_id long, text string")
    found = find_overlaps(docs, benchmark)
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in found.collect()} == {(1, i): 16 for i in range(6)} | {(2, 6): 3, (2, 7): 3}


def test_decontamination_keeps_every_column(spark, awkward, benchmark):
    out = decontaminate(awkward, benchmark)
    assert out.schema.names == awkward.schema.names and out.count() == awkward.count()
    leak = awkward.withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.col("text"), F.lit(f" {prose(40, 501)}"))).otherwise(F.col("text")))
    assert decontaminate(leak, benchmark).count() == awkward.count() - 1  # at the end of 60,000 words
    assert {r["doc_id"] for r in find_overlaps(leak, benchmark).collect()} == {7}


def windows_with(item, text, window=16, least=12):
    """Whether some window of the item agrees with the text in enough places, laid on in any way."""
    n = min(window, len(item))
    for shift in range(-len(item), len(text) + 1):
        same = [0 <= i + shift < len(text) and text[i + shift] == w for i, w in enumerate(item)]
        if any(sum(same[k : k + n]) >= least for k in range(len(item) - n + 1)):
            return True
    return False


def test_every_overlap_by_the_rule_is_found(spark):
    """Fragments of 16 tokens of which four are others, wherever these stand; brute force says what the rule finds."""
    rnd = random.Random(8)
    item = prose(40, 601).split()
    texts = []
    for i in range(400):
        start, bad = rnd.randrange(0, 25), set(rnd.sample(range(16), 4 if i % 4 else 5))
        part = [f"z{i}x{k}" if k in bad else w for k, w in enumerate(item[start : start + 16])]
        texts.append([f"a{k}" for k in range(5)] + part + [f"b{k}" for k in range(5)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"] for r in find_overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    expected = {i for i, t in enumerate(texts) if windows_with(item, t)}
    assert found == expected and len(expected) == 300


def test_masks_fit_between_any_four_substitutions():
    from itertools import combinations

    from rankcut.llm.decontaminate import MASKS, WINDOW

    laid = [{s + i for i, bit in enumerate(m) if bit == "1"} for m in MASKS for s in range(WINDOW - len(m) + 1)]
    assert all(any(not places & set(bad) for places in laid) for bad in combinations(range(WINDOW), 4))


# Licenses


def test_licenses_are_found_and_inherited(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", f"{apache}\nand much more text of other things that is not of the license at all " + prose(50, 1)), ("a/b/x.py", prose(40, 2)), ("a/b/c/y.py", f"code\n{mit}\nmore"), ("a/b/c/z.py", prose(30, 3)),
        ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("d/x", prose(20, 4)), ("top", mit), (None, mit), (None, None), ("e/x", ""), ("a/b/x.py", prose(40, 2)),
    ]
    rows = scan_licenses(spark.createDataFrame([(*f, 1) for f in files], "path string, text string, _in int")).collect()
    assert len(rows) == len(files)
    found = {r["path"]: (r["own_license"], r["inherited_license"], r["inherited_from"], r["license"]) for r in rows}
    assert found["a/b/x.py"] == (None, "Apache-2.0", "a/LICENSE", "Apache-2.0")
    assert found["a/b/c/y.py"] == ("MIT", None, None, "MIT")
    assert found["a/b/c/z.py"] == (None, "GPL-3.0", "a/b/c/COPYING.txt", "GPL-3.0")
    assert found["d/x"] == found["e/x"] == (None, None, None, None) and found["top"][0] == found[None][0] == "MIT"
    assert scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_lines_without_signal_terms_are_too_far_from_every_template():
    from rankcut.llm.licenses import template_terms

    idf = {t: 1.0 + len(t) / 5 for _, s in TEMPLATES for t in template_terms(s)}
    rows, signals = weigh_templates(idf, 0.75)
    rest = defaultdict(float)
    for number, _, term, weight in rows:
        rest[number] += 0.0 if term in signals else weight * weight
    assert max(rest.values()) < 0.75**2


def test_common_words_beside_a_statement_weigh_little(spark):
    common = "for all of you"
    files = [(f"d{i}/x.txt", f"{prose(20, i)}\n{common}") for i in range(60)]
    rows = scan_licenses(spark.createDataFrame([*files, ("y/x.txt", "Released for under all the of MIT you License")], "path string, text string")).collect()
    # The four terms between those of the statement are in every file, its own five in this one alone.
    weights = {True: np.log(62 / 62) + 1, False: np.log(62 / 2) + 1}
    statement = "released under the mit license".split()
    dot = sum(weights[False] ** 2 for _ in statement)
    expected = np.sqrt(dot / (dot + sum(weights[True] ** 2 for _ in common.split())))
    found = {r["path"]: (r["own_license"], r["own_similarity"]) for r in rows if r["own_license"]}
    assert set(found) == {"y/x.txt"} and found["y/x.txt"][0] == "MIT" and found["y/x.txt"][1] == pytest.approx(expected, abs=1e-6)


def best_passage(text, name, idf):
    """Every run, line, header block and license file against every template, one at a time: (rank, similarity negated, license)."""
    from rankcut.llm.licenses import IDENTIFIED, LICENSE_FILES, RANKS, RUN, rules, template_terms

    lines = [template_terms(line) for line in text.split("\n")]
    every = sum(lines, [])
    header = template_terms(re.split(r"\n[^\S\n]*\n", re.sub(r"^\s+", "", text))[0])
    runs = [every[i : i + n] for i in range(len(every)) for n in range(1, RUN + 1) if i + n <= len(every)]
    passages = {tuple(p) for p in [*runs, *lines, header, *([every] if name in LICENSE_FILES else [])] if p}
    templates = [(license, Counter(template_terms(s)), *rules(s)) for license, s in TEMPLATES]

    def length(tf):
        return np.sqrt(sum((n * idf(t)) ** 2 for t, n in tf.items()))

    scores = [(0, -1.0, IDENTIFIED[t]) for t in every if t in IDENTIFIED]
    for tf in map(Counter, passages):
        for license, of, required, forbidden in templates:
            dot = sum(n * of[t] * idf(t) ** 2 for t, n in tf.items())
            similarity = round(dot / (length(tf) * length(of)), 9)
            if similarity >= 0.75 and set(required) <= set(tf) and not set(forbidden) & set(tf):
                scores.append((RANKS.get(license, 0), -similarity, license))
    return min(scores, default=None)


def test_passages_equal_brute_force(spark):
    rnd = random.Random(5)
    pool = "the of this work is software all and here acme see for details license lesser version 2 3 mit gnu".split()
    texts = []
    for i in range(len(TEMPLATES)):
        _, statement = TEMPLATES[i % len(TEMPLATES)]
        part = [w if rnd.random() > 0.15 else rnd.choice(pool) for w in statement.split()][rnd.randrange(2) :]
        words = [*rnd.choices(pool, k=rnd.randrange(30)), *part, *rnd.choices(pool, k=rnd.randrange(30))]
        texts.append("".join(w + rnd.choice([" ", " ", " ", "\n", "\n \n"]) for w in words))
    texts += ["x y z " * 200, "This project is licensed under the MIT License - see the LICENSE file for details", "Copyright. All\nrights reserved.", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nmore"]
    files = [(f"f{i}/{'LICENSE' if i % 5 == 0 else 'x.py'}", t) for i, t in enumerate(texts)]
    from rankcut.llm.licenses import template_terms

    frequency = Counter(t for x in texts for t in set(template_terms(x)))

    def idf(term):
        return np.log((len(texts) + 1) / (frequency[term] + 1)) + 1

    rows = scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()
    expected = {}
    for path, text in files:
        best = best_passage(text, path.split("/")[1].lower(), idf)
        expected[path] = (best[2], pytest.approx(-best[1], abs=1e-6)) if best else (None, None)
    assert {r["path"]: (r["own_license"], r["own_similarity"]) for r in rows} == expected
    assert sum(v[0] is not None for v in expected.values()) > 20


def test_near_licenses_are_told_apart(spark):
    gpl = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    bsd = "Copyright (c) 2024, Acme. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without any modification, are all permitted provided that"
    third = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    isc = "Copyright 2024 Acme\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    cases = [
        ("SPDX-License-Identifier: ISC", "ISC"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("# SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
        ("SPDX-License-Identifier: Custom-1.0 and mit", None), ("Wir gehen mit dem Hund, mit License", None),
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"), ("Licensed under CC BY 3.0", None),
        (gpl.format("", 2), "GPL-2.0"), (gpl.format("", 3), "GPL-3.0"), (gpl.format("Lesser ", "2.1"), "LGPL-2.1"), (gpl.format("Affero ", 3), "AGPL-3.0"), (gpl.format("Library ", 2), None),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), (bsd, "BSD-2-Clause"), (bsd + third, "BSD-3-Clause"), (isc, "ISC"),
        ("Copyright 2024 Foo. All rights reserved.", "Proprietary"), ("All rights reserved. Released under the MIT License.", "MIT"),
    ]
    files = [(f"d{i}/x.txt", text) for i, (text, _) in enumerate(cases)] + [(f"p{i}/x.txt", prose(60, i)) for i in range(200)]
    found = {r["path"]: r["own_license"] for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [found[f"d{i}/x.txt"] for i in range(len(cases))] == [license for _, license in cases]
    assert all(found[f"p{i}/x.txt"] is None for i in range(200))


def test_a_long_text_of_repeated_statements(spark):
    """Work follows the distinct passages, not the number of repeats times their length."""
    statements = ["Released under the MIT License.", "Licensed under CC BY 4.0", "This work is licensed under the GNU General Public License, version 3"]
    files = [("a/x.txt", " ".join(statements[:1] * 6500)), ("b/x.txt", "\n".join(statements * 1500)), ("b/y.txt", prose(20, 1))]
    assert len(files[0][1]) > 200_000
    found = {r["path"]: (r["own_license"], r["license"]) for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found["a/x.txt"] == ("MIT", "MIT") and found["b/x.txt"][0] == "CC-BY-4.0" and found["b/y.txt"] == (None, "CC-BY-4.0")


def test_statements_across_lines_and_inside_paragraphs(spark):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"
    files = [("a/LICENSE", f"MIT License\n\nCopyright (c) 2024 Acme\n\n{mit} and {prose(40, 1)}"), ("a/x.py", prose(30, 2)), ("b/x.py", f"{prose(60, 3)} Released under the MIT License. {prose(60, 4)}"), ("b/y.py", prose(40, 5)),
             ("c/x.py", "# Licensed under the Apache\n# License, Version 2.0\n"), ("c/y.py", prose(40, 6))]
    found = {r["path"]: (r["own_license"], r["license"]) for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {"a/LICENSE": ("MIT", "MIT"), "a/x.py": (None, "MIT"), "b/x.py": ("MIT", "MIT"), "b/y.py": (None, None), "c/x.py": ("Apache-2.0", "Apache-2.0"), "c/y.py": (None, "Apache-2.0")}


def test_awkward_files(awkward, nothing):
    assert scan_licenses(awkward.withColumnRenamed("path2", "path")).count() == awkward.count()
    assert scan_licenses(nothing.withColumnRenamed("path2", "path")).count() == 0


# Pipeline and queries


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_pipeline_stages_hand_on_documents(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage_of in corpus_pipeline.STAGES[:-1]:
        out = stage_of(spark, docs, sf_dir).cache()
        after = {r["doc_id"] for r in out.collect()}
        assert out.columns == docs.columns and after <= before and len(after) > 0.6 * len(before), name
        docs, before = out, after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == before


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_overlap_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from rankcut.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    result = con.execute(ORACLE_SQL["op8_decontamination"])
    order = [d[0] for d in result.description]
    ours = QUERIES["op8_decontamination"](spark, "/root/testdata/sf0.001").select(*order).collect()
    assert sorted(map(tuple, ours)) == sorted(result.fetchall()) and ours


def test_license_spans_look_for_template_terms_once(spark):
    """The terms known to templates are a column; the condition per template no longer filters all terms of a text."""
    from rankcut.llm.licenses import may_reach, template_list, template_terms

    idf = {t: 2.0 for _, s in TEMPLATES for t in template_terms(s)}
    rows, _ = weigh_templates(idf, 0.75)
    texts = [(s.lower().split(), [t for t in s.lower().split() if t in idf]) for s in ("Released under the MIT License", "nothing of the sort is said here by anyone")]
    spans = spark.createDataFrame(texts, "terms array<string>, known array<string>")
    near = may_reach(spans["terms"], spans["known"], template_list(rows, idf), idf, 0.75)
    plan = spans.where(near)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert " in (" not in plan and "inset" not in plan
    assert [r["near"] for r in spans.select(near.alias("near")).collect()] == [True, False]

import re
from itertools import permutations

import pytest

from rankcut.llm.filter_audit import audit_documents, audit_orders, judge, later_copies, store_failing, survivors, text_conditions, with_words
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, good, toxic):
    """The report by its definition: every order is run over every document."""
    fails = {}
    for doc_id, text, lang in rows:
        text = text or ""
        w = WORD.findall(text)
        f = set()
        if len(w) < 100:
            f.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            f.add("C")
        if re.search("[#$%&*|]", text):
            f.add("D")
        if any(o < doc_id and (t or "") == text for o, t, _ in rows):
            f.add("E")
        fails[doc_id] = f
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        ids = [i for i, _, lang in rows if (lang or "") == part]
        removed_by = {}
        for order in permutations("ABCDE"):
            left = set(ids)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in fails[i]}
                left -= gone
                removed_by[f] = removed_by.get(f, 0) + len(gone)
                failing = {i for i in ids if f in fails[i]}
                out[part, "".join(order), step] = [len(left), len(gone), len(failing - gone), sum(fails[i] == {f} for i in ids), len(gone & good), len(gone & toxic)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def test_report_equals_brute_force(spark):
    rows = []
    for i in range(120):
        text = prose(110 if i % 3 else 40, i % 50)
        text = " ".join(text.split()[:30] * 4) if i % 4 == 0 else text
        text = text.upper() if i % 5 == 0 else text
        text = text + " #" if i % 7 == 0 else text
        rows.append((i, None if i % 41 == 40 else text, [None, "en", "de"][i % 3]))
    good, toxic = {i for i in range(120) if i % 2}, {i for i in range(120) if i % 9 == 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in good), int(i in toxic)) for i in range(120)] * 2 + [(None, 1, 1), (3, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    report = audit_documents(docs, labels)
    assert report.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {tuple(r[:3]): list(r[3:]) for r in report.collect()}
    assert got == brute(rows, good, toxic)


def test_survivors_are_what_the_report_keeps(spark):
    docs = spark.createDataFrame([(i, prose(120, i // 2) + (" |" if i % 5 == 0 else ""), "en", i) for i in range(60)], "doc_id long, text string, lang string, failed int")
    judged = judge(with_words(docs), text_conditions(), docs["lang"])
    failing = store_failing(judged, {"E": later_copies(judged)})
    left = survivors(docs, failing, "DE")
    assert left.columns == docs.columns
    report = audit_orders(judged, failing, "DE", {})
    kept = {(r["filter_order"], r["step"]): r["kept"] for r in report.collect()}
    assert left.count() == kept["DE", 2] == kept["ED", 2] < kept["DE", 1] < 60


def test_awkward_rows(spark, awkward, labels, nothing):
    rows = {tuple(r[:3]): r for r in audit_documents(awkward, labels).collect()}
    assert {k[0] for k in rows} == {"", "en", "de"} and len(rows) == 3 * 120 * 5
    # Two rows of id 1 and one of id 2 have one text; rows without id stay.
    assert rows["en", "EABCD", 1]["removed"] == 1
    assert rows["", "ABCDE", 5]["kept"] == 1
    assert audit_documents(nothing, labels).collect() == []
    none = audit_documents(awkward, labels.limit(0)).collect()
    assert len(none) == 1800 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in none)


def test_filters_must_differ(spark):
    judged = spark.createDataFrame([], "id long, part string, fails array<string>, digest binary")
    with pytest.raises(ValueError):
        audit_orders(judged, store_failing(judged), "AA", {})

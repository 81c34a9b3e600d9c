import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankcut.llm.components import components
from rankcut.llm.neardup import drop_near_duplicates, near_duplicates, shingle_sets

from .conftest import prose

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Component of every row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(i)] = min(ids.get(root(i), doc), doc)
    return Counter((d, len(s), ids.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(text, share, rnd):
    w = text.split(" ")
    for _ in range(int(len(w) * share)):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def corpus():
    """Chains of edits, one large group of near copies, exact copies, and a passage most texts share."""
    rnd, rows = random.Random(5), []
    passage = prose(60, 99)
    for i in range(120):
        body = prose(rnd.randrange(3, 200), 1000 + i)
        rows.append(body if i % 3 else f"{body} {passage}")
    base = prose(150, 7)
    rows += [edited(base, rnd.choice([0.005, 0.02, 0.03]), rnd) for _ in range(80)]
    chain = prose(120, 8)
    for _ in range(25):
        rows.append(chain)
        chain = edited(chain, 0.02, rnd)
    rows += [base.upper()] * 5 + ["Short one", "short ONE", "short one two", "", "  ", None]
    rows += [f"{passage} {prose(rnd.randrange(5, 25), 2000 + i)}" for i in range(40)]
    rnd.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_components_equal_those_of_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, near_duplicates(df).collect())) == brute(rows)


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert Counter(map(tuple, near_duplicates(awkward).collect())) == brute(rows)
    assert near_duplicates(nothing).count() == 0


def test_one_document_of_each_group_stays(awkward, nothing):
    kept = drop_near_duplicates(awkward)
    assert kept.schema.names == awkward.schema.names
    ids = sorted((str(r["doc_id"]), r["text"] is None) for r in kept.collect())
    assert ids == sorted([("1", False), ("3", True), ("4", False), ("None", False), ("None", True), ("7", False), ("9", False), ("10", False), ("11", False)])
    assert drop_near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], [(5, 1), (4, 2), (2, 5)], []])
def test_labels_are_smallest_nodes(spark, links):
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups: list[set] = []
    for a, b in links:
        joined = [g for g in groups if g & {a, b}]
        groups = [g for g in groups if g not in joined] + [set().union({a, b}, *joined)]
    assert found == {n: min(g) for g in groups for n in g}


def test_sets_are_distinct_and_whole():
    h, r = shingle_sets(pa.array(["a b c d e f a b c d e", "A B C D E", "a b", None]))
    assert [int((r == i).sum()) for i in range(4)] == [6, 1, 1, 0]
    assert h[r == 1][0] in h[r == 0]


def test_segments_of_a_fragment_are_rows_of_buckets():
    """However many texts share n-grams in a fragment, it hands on one row per bucket; texts are whole again afterwards."""
    from rankcut.llm.neardup import _assemble, _segments

    rnd = np.random.default_rng(3)
    node = rnd.integers(-(1 << 62), 1 << 62, 500).repeat(8)
    token = rnd.integers(0, 1 << 48, 8 * 500)
    token[1::8] = token[0::8]  # repeated
    size = np.full(len(node), 9)
    parts = [_segments(node[half], size[half], token[half], 7) for half in (slice(0, 2100), slice(2000, 4000))]
    assert all(p.num_rows == 7 and p["g"].to_pylist() == list(range(7)) for p in parts)
    both = pa.concat_tables(parts)
    rows = [r for g in range(7) for r in _assemble(75)(both.filter(pa.array(both["g"].to_numpy() == g))).to_pylist()]
    assert {r["node"]: r["tokens"] for r in rows} == {x: np.unique(token[node == x]).tolist() for x in np.unique(node).tolist()} and len(rows) == 500
    assert not _assemble(80)(both).num_rows  # seven of nine n-grams are too few

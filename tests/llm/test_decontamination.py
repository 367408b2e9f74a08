"""Leaks against full edit distances."""

import random
import re

from loomgraph.llm import decontamination as D


def distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, t in enumerate(text):
            row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (c != t)))
        before = row
    return min(before)


def test_matches(words):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 20)))) for k in range(8)] + [(8, "tiny")]
    index = D.ItemIndex(items)
    for _ in range(60):
        k = rng.randrange(9)
        t = list(items[k][1])
        for _ in range(rng.randint(0, int(len(t) * 0.16))):
            p, kind = rng.randrange(len(t)), rng.random()
            if kind < 0.34:
                t[p] = rng.choice("abcé ")
            elif kind < 0.67 and len(t) > 1:
                del t[p]
            else:
                t.insert(p, rng.choice("abc "))
        host = " ".join(rng.choice(words) for _ in range(20))
        p = rng.randrange(len(host) + 1)
        text = host[:p] + "".join(t) + host[p:]
        want = {i: distance(s, text) for i, s in items}
        assert {m[0]: m[1] for m in index.matches(text)} == {i: c for j, (i, c) in enumerate(want.items()) if c <= index.edits[j] and (i != 8 or re.search(r"\btiny\b", text))}


def test_whole_budget_at_every_length(words):
    """Any item with as many edits as the budget allows is found, however short it is."""
    rng = random.Random(5)
    for size in range(1, 130):
        item = " ".join(rng.choice(words) for _ in range(40))[:size].strip() or "x"
        index = D.ItemIndex([("k", item)])
        assert index.edits[0] == len(item) // 10
        for _ in range(6):
            t = list(item)
            for _ in range(int(index.edits[0])):
                p, kind = rng.randrange(len(t)), rng.random()
                if kind < 0.34:
                    t[p] = rng.choice("abcé")
                elif kind < 0.67 and len(t) > 1:
                    del t[p]
                else:
                    t.insert(p, rng.choice("abc"))
            found = index.matches(D.normalised("qq rr " + "".join(t) + " ss tt"))
            assert found and found[0][1] <= index.edits[0], (item, "".join(t))
    assert D.ItemIndex([(1, "tiny")]).matches("what destiny is") == [] and D.ItemIndex([(1, "tiny")]).matches("a tiny, one")


def test_tables(spark):
    item = "Which of these rivers is the longest one in the world today"
    docs = spark.createDataFrame([(1, f"so {item.upper()}   and on", 1), (2, None, 1), (3, "", 1), (4, "nothing of that kind", 1), (5, item.replace("rivers", "river") + " yes " * 20000, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.find_leaks(spark, docs, items).collect()}
    assert got == {(1, 7, 0), (1, 8, 0), (5, 7, 1), (5, 8, 1)}
    named = spark.createDataFrame([("x", item), ("y", item)], "item_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(spark, docs, named).collect()} == {(1, "x"), (1, "y"), (5, "x"), (5, "y")}
    assert {r["doc_id"] for r in D.drop_leaks(spark, docs, items, broadcast_chars=40).collect()} == {2, 3, 4}
    small = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(spark, docs, items, broadcast_chars=40).collect()}
    assert small == {(1, 7), (1, 8), (5, 7), (5, 8)}
    assert {r["doc_id"] for r in D.drop_leaks(spark, docs, items).collect()} == {2, 3, 4}
    assert D.find_leaks(spark, docs, items.limit(0)).count() == 0
    assert D.find_leaks(spark, docs.limit(0), items).count() == 0

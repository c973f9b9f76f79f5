import hashlib
import random
import re

import sightline.llm.decontaminate as module
from sightline.llm.decontaminate import clean, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, own = set(), set()
        for win, names in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    own |= names
        out.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data():
    rng = random.Random(4)
    words = ["alpha", "Beta", "γάμμα", "d4", "e", "the", "É"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 10, 11, 30])))) for i in range(40)] + [(99, None), (7, "rare words here are seldom seen by any other text at all")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 12, 60])))) for i in range(60)]
    docs += [(200 + i, "before " + (items[i][1] or "").upper().replace(" ", ", ") + " after") for i in range(41)]
    return docs + [(300, None), (301, ""), (302, "rare words here are seldom seen by any other text at"), (302, "again"), (None, "rare words here are seldom seen by any other text")], items


def check(spark, docs, items):
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    got = sorted([tuple(r) for r in contamination(d, b).collect()], key=str)
    assert got == brute(docs, items)
    return d, b


def test_against_brute_force(spark):
    docs, items = data()
    d, b = check(spark, docs, items)
    kept = sorted(str(r.doc_id) for r in clean(d, b).collect())
    hit = {r[0] for r in brute(docs, items) if r[5] and r[0] is not None}
    assert kept == sorted(str(i) for i, _ in docs if i not in hit)


def test_a_full_bloom_filter_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(module, "BITS", 1 << 10)
    monkeypatch.setattr(module, "ENTRY_BITS", 1)
    check(spark, *data())


def test_empty_tables(spark):
    docs, items = data()
    check(spark, docs[:3], [])
    check(spark, [], items[:3])

"""Conversation tries, group joins and ranked search against plain versions; words whose quick hashes collide."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from framewake.llm import groupjoin, minhash, search, trie
from test_cases import components, shingles

TURNS = "conv_id long, turn long, role string, text string, key string, c long, part int"


def plain_trie(rows):
    """Every node as a tuple of its columns, from all rebuilt conversations and all their prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def rank(x):
        return (*x[:3], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest())

    own = {c: [x[2:] for x in sorted(t, key=rank)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        yield p
        for k in kids.get(p, []):
            yield from below(k)

    out = []
    for p, m in nodes.items():
        sub = list(below(p))
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in sub if x)
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids.get(p, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def same_trie(spark, rows):
    df = spark.createDataFrame([(*r, "k", 7, 1) for r in rows], TURNS)
    got = trie.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_hand_made_cases(spark):
    same_trie(spark, [])
    same_trie(spark, [(3, 0, "user", "a")])  # h of 3 is beyond its turns, and its base is absent
    rows = [(c, t, "user" if t % 2 == 0 else None, f"t{t}" if c % 7 else None) for c in range(25) for t in range(c % 6)]
    rows += [(5, None, "user", "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "b", "é" * 9), (None, 0, "user", "x"), (40, 0, "", ""), (41, 0, None, None)]
    same_trie(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_blocks_levels_and_ranges(spark, monkeypatch, seed):
    """Blocks of two turns over several levels, ranges of a few rows, chains of prefixes and groups of copies."""
    monkeypatch.setattr(trie, "WIDTH", 2)
    monkeypatch.setattr(trie, "STEP", 3)
    rng = random.Random(seed)
    rows = []
    for c in range(70):
        kind = rng.random()
        n = 40 if c == 10 else rng.randint(1, 14)
        texts = [f"x{rng.randint(0, 1)}" for _ in range(n)] if kind < 0.5 else ["same"] * n
        rows += [(c, t, "user", x) for t, x in enumerate(texts)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same_trie(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def words(rng, n, kinds):
    return " ".join(f"w{rng.randint(0, kinds)}" for _ in range(n))


def test_group_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(groupjoin, "MEMBERS", 3)  # many groups
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 90), 400) for _ in range(30)]
    rows = list(enumerate(base))
    for i in range(30, 140):
        parts = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            parts[rng.randrange(len(parts))] = f"new{rng.randint(0, 5)}"
        cut = rng.randint(0, max(0, len(parts) // 9))
        rows.append((i, " ".join(parts[cut:]) + rng.choice(["", " ", "\n"])))
    rows += [(140, None), (141, ""), (142, " \n\t"), (143, "a b"), (144, "A  B"), (145, "a" * 50_000 + " b"), (3, base[3]), (None, base[4])]
    # the same set in another order
    loop = [f"v{k}" for k in range(30)]
    rows += [(150, " ".join(loop * 2)), (151, " ".join(loop[5:] + loop * 2 + loop[:5]))]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, id string, n int, c int")
    got = groupjoin.jaccard_groups(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == len(rows)
    label = components_of([r for r in rows if r[0] is not None], 4)
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(shingles(dict(rows)[r["doc_id"]], 4)), label[r["doc_id"]])
    assert label[151] == 150
    assert groupjoin.jaccard_groups(df.where("false")).count() == 0


def components_of(texts, size, percent=85):
    named = [(i, shingles(t, size)) for i, t in texts]
    label = {i: i for i, _ in named}
    links = [(a, b) for k, (a, x) in enumerate(named) for b, y in named[k + 1 :] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_group_join_of_a_hot_group(spark):
    """Near copies of one text, and texts that share a passage of less than what a link asks for."""
    rng = random.Random(4)
    base = words(rng, 200, 10_000).split()
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(w)))
    shared = words(rng, 120, 10_000)
    rows += [(200 + i, shared + " " + words(rng, 80, 100_000)) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in groupjoin.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows, 4) and {got[i] for i in range(120)} == {0}


def test_texts_with_colliding_quick_hashes_stay_apart(spark):
    x, y = "abcdefghijklmnop", "nrsqbdyo%4(>),wu"
    rows = [(1, x), (2, y), (3, f"one two {x} three four"), (4, f"one two {y} three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for got in (minhash.near_duplicates(df), groupjoin.jaccard_groups(df)):
        assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got.collect()} == {i: (i, 1 if got.columns[-1] == "kept" or i < 3 else 2) for i, _ in rows}
    items = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert [(r["doc_id"], r["rank"]) for r in search.ranked_search(df.where("doc_id in (1, 3)"), items).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert search.Vocabulary([x, y]).find(*spans(f"{y} zz {x}")).tolist() == [1, -1, 0]


def spans(text):
    import numpy as np

    buf = np.frombuffer(text.encode(), np.uint8)
    at = [(m.start(), m.end()) for m in re.finditer(rb"\S+", text.encode())]
    return buf, np.array([a for a, _ in at]), np.array([b for _, b in at])


def plain_search(docs, items, top):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in held) + 1))) for t in want}
        scored = []
        for i, d in held:
            m = 50 + 50 * len(d) * n_docs // max(n_terms, 1)
            s = sum(w * (1_000_000_000 * d.count(t) // (1000 * d.count(t) + 20 * m)) for t, w in weight.items())
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "block", "triples"), [(5, 8 << 20, 1 << 20), (3, 200, 40)])
def test_search_against_plain_scores(spark, monkeypatch, top, block, triples):
    monkeypatch.setattr(search, "TRIPLES", triples)
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randint(1, 60), 30) + rng.choice(["", " É", " W1.w2-W3", " naïve🙂x"])) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "-- !!"), (3, docs[3][1]), (None, docs[4][1]), (153, "w1 " * 20_000), (154, docs[5][1]), (155, docs[5][1])]
    items = [(k, words(rng, rng.randint(1, 8), 40)) for k in range(12)] + [(20, None), (21, "?"), (22, "naïve🙂x É"), (2, "w9 unheard"), (None, "w4 W5")]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, item string, score int")
    q = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    got = search.ranked_search(df, q, top=top, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, top)
    if top == 5:
        for a, b in ((df.where("false"), q), (df, q.where("false"))):
            assert search.ranked_search(a, b).count() == 0


def test_radix_order_is_stable():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 1 << 40, 5000) // 7 % (1 << 34)
    assert (search.radix_order(keys, 1 << 34) == np.argsort(keys, kind="stable")).all()

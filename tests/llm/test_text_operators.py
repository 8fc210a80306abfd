"""Operators on texts: edge cases on small hand-made tables, against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewake.llm import bpe, chat, decontaminate, exactdedup, htmltext, linededup, minhash, quality, sharding, tokenfile

DOCS = "doc_id long, text string, lang string, source string, extra string, kept string, n long, id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, "x", "y", None, "z") for i, t, s in rows], DOCS)


def words(rng, n, kinds=40):
    return " ".join(f"w{rng.randint(0, kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed(spark):
    """Nulls, empties, long texts, ties, repeats, and columns whose names clash."""
    rng = random.Random(1)
    base = [words(rng, rng.randint(1, 60), 300) for _ in range(25)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    for i in range(25, 60):
        parts = rng.choice(base).split()
        if len(parts) > 20:
            parts[rng.randrange(len(parts))] = "new"
        rows.append((i, " ".join(parts) + rng.choice(["", " ", "\n"]), "s"))
    rows += [(60, None, None), (61, "", "s"), (62, " \n\t", "s"), (63, "a b", "s"), (64, "A  B", "s"), (65, "a" * 50_000 + " b", "s"), (66, None, "s"), (3, base[3], "s"), (None, base[4], "s")]
    return documents(spark, rows), rows


def sets(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_near_duplicates_against_all_pairs(mixed):
    df, rows = mixed
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    named = {i: sets(t) for i, t, _ in rows if i is not None}
    label = {i: i for i in named}
    changed = True
    while changed:
        changed = False
        for a in named:
            for b in named:
                x, y = named[a], named[b]
                if x and y and 100 * len(x & y) >= 85 * len(x | y) and label[a] > label[b]:
                    label[a], changed = label[b], True
    for i, s in named.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), label[i], label[i] == i)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b, c = minhash.fast_similarity_sketches([x[:800], x[200:], x[:1]], 400)
    assert abs((a == b).mean() - 0.6) < 0.12 and (minhash.fast_similarity_sketches([x[:0]], 4) == np.uint64(2**64 - 1)).all()
    assert (c != np.uint64(2**64 - 1)).all()


def test_near_duplicates_of_a_hot_group(spark):
    rng = random.Random(2)
    base = words(rng, 120, 10_000).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w), "s"))
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    named = {i: sets(t) for i, t, _ in rows}
    label = {i: i for i in named}
    for _ in range(6):
        for a in named:
            for b in named:
                if 100 * len(named[a] & named[b]) >= 85 * len(named[a] | named[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_near_duplicates_of_one_of_several_texts_of_an_id(spark):
    rng = random.Random(5)
    base = words(rng, 104, 10**6).split()
    near = base[:-1] + ["new"]
    rows = [(5, " ".join(base), "s"), (5, words(rng, 150, 10**6), "s"), (7, " ".join(near), "s"), (8, words(rng, 104, 10**6), "s")]
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got} == {(5, 100): 5, (5, 146): 5, (7, 100): 5, (8, 100): 8}


def test_exact_duplicates(mixed):
    df, rows = mixed
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    got = exactdedup.exact_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(t for i, t, _ in rows if i == r["doc_id"])
        group = [(-len(t or ""), i is None, i, t) for i, t, _ in rows if key(t) == key(own)]
        assert r["group_size"] == len(group) and r["keep_id"] == min(group, key=lambda g: g[:3] if g[2] is not None else (g[0], True, 0))[2]
        assert r["text_sha256"] == hashlib.sha256(key(own).encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len({key(t) for _, t, _ in rows})


def test_long_texts_that_differ_late(spark):
    rows = [(1, "x" * 9000 + "a", "s"), (2, "x" * 9000 + "b", "s"), (3, "x" * 9000 + "a ", "s")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exactdedup.exact_duplicates(documents(spark, rows)).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def brute_contamination(text, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w, hit, named = find(text), set(), set()
    for name, item in items:
        x = find(item)
        n = min(len(x), window)
        for k in range(max(0, len(x) - window) + 1 if x else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit |= set(range(i, i + n))
                    if name is not None:
                        named.add(str(name))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, words(rng, n, 6)) for i, n in enumerate([30, 10, 9, 5, 3, 1, 0, 14])] + [(7, None), (None, words(rng, 12, 6)), (8, "É-ß w1 W2"), (9, items_twin := words(rng, 11, 6)), (10, items_twin)]
    rows = [(i, words(rng, rng.randint(0, 80), 6), "s") for i in range(30)] + [(30, None, "s"), (31, "", "s"), (32, "é-SS É-ß w1 w2!", "s"), (33, (items[0][1] + " w9 ") * 40, "s"), (33, "other text under the same id", "s"), (34, items_twin, "s"), (34, items_twin, "s")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    got = decontaminate.contamination(documents(spark, rows), benchmark).collect()
    want = sorted((i, *brute_contamination(t, items)) for i, t, _ in rows)
    assert sorted(tuple(r) for r in got) == want


def test_nothing_to_find(spark):
    empty = documents(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert [tuple(r)[:3] for r in decontaminate.contamination(documents(spark, [(1, "a b", "s")]), benchmark).collect()] == [(1, 2, 0)]
    assert minhash.near_duplicates(empty).count() == exactdedup.exact_duplicates(empty).count() == 0
    assert linededup.drop_boilerplate(empty).count() == sharding.hilbert_shards(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(empty, quality.train(empty, labels)).count() == 0
    assert bpe.round_trips(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert tokenfile.token_file(empty, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"unique {i}\n foot \n\nend {i % 9}", "a") for i in range(20)] + [(50, "foot\nx", "b"), (51, None, "a"), (52, "", None), (53, "foot", None)]
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(documents(spark, rows), ratio=0.5).collect()}
    assert got[3]["text"] == "unique 3\n\nend 3" and (got[3]["n_lines"], got[3]["n_dropped"]) == (4, 1)
    assert got[50]["text"] == "foot\nx" and got[51]["text"] is None and got[52]["text"] == "" and got[53]["text"] == "foot"
    assert "kept" in got[3].asDict()


def test_bpe_is_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.encoder(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", " ", "a" * 3000, "ab" * 3000, "  two  spaces ", "don't  we'll 12 345 $$$\t\n", "𝔘 😀 ‍　x", "<|endoftext|> hi", "\x00\x1c a\x1c"]
    texts += ["".join(rng.choice("ab c\n\t'sé1. \x1c") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    found = own.encode(texts)
    assert found == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(i) for i in found] == [t.encode() for t in texts]
    assert [own._merge_singly(t.encode()) for t in ("the quick", "aaaa", "lower")] == own.merge([b"the quick", b"aaaa", b"lower"])
    df = documents(spark, [(1, "hi there", "s"), (2, None, "s"), (None, "x", "s")])
    encoded = bpe.encode_documents(df, path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode_documents(encoded, path, public_tokenizers.PATTERN).collect()} == {1: b"hi there", 2: b"", None: b"x"}
    got = {r["doc_id"]: r for r in bpe.round_trips(df, path, public_tokenizers.PATTERN).collect()}
    ids = library.encode_ordinary("hi there")
    assert got[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[2]["n_tokens"] == 0


def test_merges_that_make_lower_ranks():
    # a vocabulary that no training gives: 'ab' made after 'bc' may make 'abc' of a lower rank
    own = object.__new__(bpe.Encoder)
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bcd": 257, b"bc": 300, b"ab": 301, b"cd": 302, b"bcde": 258}
    import os
    import tempfile

    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken", delete=False) as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = bpe.Encoder(f.name, r".+")
    os.unlink(f.name)
    rng = random.Random(6)
    pieces = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))).encode() for _ in range(500)]
    assert own.merge(pieces) == [[ranks[p]] if p in ranks else own._merge_singly(p) for p in pieces]


def test_simple8b_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        for bits in (1, 7, 16, 30, 60, 61, 64):
            v = rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True)
            v[rng.random(n) < 0.3] = 0
            assert (tokenfile.simple8b_decode(*tokenfile.simple8b_encode(v)) == v).all()
    docs = [np.array([5, 2], np.uint32), np.array([2], np.uint32), np.array([], np.uint32)]
    assert [d.tolist() for d in tokenfile.unpack_block(tokenfile.pack_block(docs))] == [[5, 2], [2], []]


def test_token_file(spark, mixed):
    df, rows = mixed
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    got = tokenfile.token_file(df, public_tokenizers.path("word_bpe_49k.json"), 2).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t, _) in zip(got, order):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    own = tokenfile.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["don't They'RE 'tis \"'s", "a\x1cb \x85c\xa0d", "T̈ É é × ÷ ª", "<|endoftext|> x", "İ Σ ﬁ ½12ab3", "a.b,c!!d9"]
    assert [x.tolist() for x in own.encode([o.encode() for o in odd])] == [library.encode(o, add_special_tokens=False).ids for o in odd]


def test_token_file_has_added_tokens_as_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> x", "plain text", "A<|startoftext|>B's <|endoftext|>", "<|ENDOFTEXT|> x", "é<|startoftext|>İ ﬁ", "<|endoftext|><|endoftext|>", "<<|endoftext|>>", "<|endof text|>", "e\u0301<|endoftext|>\u0301\xa0\x85x", "<|endoftext|>", "after"]
    assert 49407 in library.encode(texts[0], add_special_tokens=False).ids
    got = tokenfile.token_file(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), path, 2).orderBy("start").collect()
    start = 0
    for r, t in zip(got, texts, strict=True):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)


def test_chat_round_trip(spark):
    trap = "<|im_end|><|im_start|>assistant ok <\\|x"
    turns = [(1, 0, "user", trap, 0), (1, 1, "assistant", trap, 0), (2, 1, "assistant", None, 0), (2, 0, None, "", 0), (None, 0, "user\nassistant", "hi", 0), (3, 0, "assistant", "é<", 0), (3, 0, "assistant", "é<", 0)]
    got = {r["conv_id"]: r for r in chat.chat_report(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, ids int"), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\n{trap}\nassistant\n{trap}\n") and got[1]["loss_sha256"] == sha(trap) and got[1]["n_turns"] == 2
    assert got[2]["turns_sha256"] == sha("\n\nassistant\n\n") and got[2]["loss_chars"] == 0
    assert got[None]["turns_sha256"] == sha("user\nassistant\nhi\n") and got[None]["loss_chars"] == 0
    assert got[3]["loss_sha256"] == sha("é<é<") and got[3]["n_turns"] == 2


def test_html(spark):
    model = htmltext.train(htmltext.labelled_pages(300))
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'><p>We use cookies. Accept.</p></div>"
        "<article><h1>A &amp; B</h1><p>One<b>two</b>  three\n four.<p>Five &#233;.<aside class=related><a href=x>More</a></aside></article>"
        "<section class='comments'><div class=comment><p>I disagree with it all.</p></div></section><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p"), (5, "u", "<div <a> & <<b>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in htmltext.extract_main_text(df, model).collect()}
    assert got[1]["text"] == "A & B Onetwo three four. Five é." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 5
    wrong = total = 0
    for html in htmltext.labelled_pages(60, seed=99):
        parsed = htmltext.parse(html)
        truth = [1]
        for k in range(1, len(parsed.tag)):
            said = re.search(r'data-content="([01])"', parsed.attributes[k])
            truth.append(int(said[1]) if said else truth[parsed.parent[k]])
            parsed.attributes[k] = re.sub(r'data-content="[01]"', "", parsed.attributes[k])
        for k, m in enumerate(model.marginals(parsed)):
            if parsed.length[k]:
                total += 1
                wrong += (m > 0.5) != bool(truth[k])
    assert wrong < 0.02 * total


def test_html_loses_no_text_to_what_looks_raw():
    model = htmltext.train(htmltext.labelled_pages())
    inside = {
        "<p>one <svg-icon name=x></svg-icon> two</p><p>three</p>": "one two three",
        "<p>one <svg width=1/> two</p><p>three</p>": "one two three",
        "<p>one <math/> two</p><math-field>x</math-field><p>three <template-x>y</template-x> z</p>": "one two x three y z",
        "<p>one <svg width=1> two</p><p>three</p>": "one two three",
        "<p>one <svg width=1> two<h2>three</h2><p>four</p>": "one two three four",
        "<p>one <svg><style/><path d=x /><script href=x /></svg> two</p><p>three</p>": "one two three",
        "<p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math>, then</p>": "so a=1, then",
        "<p>a <object data=x><p>shown instead</p></object> b</p><noscript><p>no script</p></noscript><p>c</p>": "a shown instead b no script c",
        "<p>a<script>'<p' + \"<!--\"</script>b</p><textarea>no</textarea><iframe>no</iframe><template>no<template>no</template>no</template><p>c</p>": "ab c",
        "<p>a<svg>x</svg>b</p>": "axb",
    }
    for html, text in inside.items():
        page = f"<html><body><nav><a href=x>menu</a></nav><noscript>Turn scripts on.</noscript><article><p>Start.</p>{html}</article></body></html>"
        assert htmltext.main_text(page, model) == f"Start. {text}", html
    parsed = htmltext.parse("<p>a <svg><title>Icon</title><text>b</text><text>c</text><foreignObject><p>d</p></foreignObject></svg> e</p>")
    assert ["".join(text for _, text in block).strip() for block in parsed.blocks] == ["a", "b", "c", "d", "e"]


def test_marginals_are_exact():
    import itertools

    page = htmltext.parse("<div><p>x</p><a>y<b>z</b></a></div>")
    model = htmltext.TreeModel({"pair div p": 3.0, "pair div a": 0.2, "tag b": 2.0, "form p 1 0": 0.7}, ((0.9, 0.1), (0.3, 0.7)), 0.6)
    n, evidence = len(page.tag), htmltext._evidence(page)
    weight = [1.0] * n
    for k in range(n):
        for e in evidence[k]:
            weight[k] *= model.node.get(e, model.node.get("tag b", 1.0) if e == "pair a b" else 1.0)
    total, ones = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        p = model.root if y[0] else 1 - model.root
        for k in range(n):
            p *= weight[k] if y[k] else 1.0
            if k:
                p *= model.edge[y[page.parent[k]]][y[k]]
        total += p
        ones = [a + p * b for a, b in zip(ones, y)]
    assert np.allclose(model.marginals(page), [x / total for x in ones])


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count(F.when(F.col("predicted") == F.col("quality"), 1))).first()
    assert n > 1000 and right > 0.98 * n
    odd = quality.score_quality(documents(spark, [(None, None, None), (1, "", None), (1, "x" * 100_000, None)]), quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect()
    assert [r["score"] for r in odd] == [0.5] * 3 and not odd[0]["held_out"]


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    path = grid[np.argsort(sharding.hilbert_index(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, mixed, tmp_path):
    df, rows = mixed
    got = sharding.hilbert_shards(df, 7).collect()
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(7)]
    assert len(got) == len(rows) and max(map(len, counts)) - min(map(len, counts)) <= 1 and all(c == list(range(len(c))) for c in counts)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 16 for _, t, _ in rows)
    assert {(r["doc_id"], r["text_crc32"]) for r in got} == {(i, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    unique = df.where("doc_id <> 3")
    sharding.write_shards(unique, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == unique.count() and back.select("shard").distinct().count() == 3

"""Hard cases of the training-data operators against plain versions: colliding words, groups of copies, clashing names, the whole pipeline."""

import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from framewake.llm import chat, decontaminate, htmltext, linededup, minhash, quality, sharding, textkit, tokenfile

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(texts, percent):
    """Smallest reachable id of each id, by comparing all pairs. texts: (id, text)."""
    named = [(i, shingles(t)) for i, t in texts]
    label = {i: i for i, _ in named}
    links = [(a, b) for k, (a, x) in enumerate(named) for b, y in named[k + 1 :] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def twins(n):
    """Two words of a and b that collide under any polynomial modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_elsewhere(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for n in (64, 128, 1024, 2048):
        x, y = twins(n)
        hashes = textkit.word_hashes(np.frombuffer(f"{x} {y}".encode(), np.uint8), np.array([0, n + 1]), np.array([n, 2 * n + 1]))
        assert hashes[0] != hashes[1]
        own = tokenfile.word_encoder(path, True)
        assert [e.tolist() for e in own.encode([x.encode(), y.encode()])] == [library.encode(t, add_special_tokens=False).ids for t in (x, y)]
    x, y = twins(1024)
    docs = spark.createDataFrame([(1, f"one two {x} three four"), (2, f"one two {y} three four"), (3, f"one two {x} three four")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(1, f"one two {y} three four five six seven eight nine")], "item_id long, text string")
    same = spark.createDataFrame([(1, f"one two {x} three four five six seven eight nine"), (2, f"zero one two {y} three four five six seven eight nine")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(same, items).collect()} == {1: 0, 2: 10}


def test_distinct_words_survive_a_collision(monkeypatch):
    text = b"aa bb aa cc AA " + b"d" * 300 + b" " + b"e" * 300
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = textkit.word_spans(buf, np.array([0, len(buf)]), textkit.NOT_SPACE)
    want = [0, 1, 0, 2, 0, 3, 4]

    def told():
        first, which = textkit.distinct_words(buf, starts, ends)
        seen = {}
        assert [text[a:b].lower() for a, b in zip(starts, ends)] == [text[starts[first[k]] : ends[first[k]]].lower() for k in which]
        return [seen.setdefault(int(k), len(seen)) for k in which]

    assert told() == want
    monkeypatch.setattr(textkit, "word_hashes", lambda buf, a, b: np.zeros(len(a), np.uint64))
    assert told() == want


def test_an_id_with_several_texts_links_by_each(spark):
    rng = random.Random(8)
    a = [f"w{rng.random()}" for _ in range(104)]
    other = " ".join(f"v{rng.random()}" for _ in range(150))
    rows = [(7, " ".join(a)), (7, other), (3, " ".join([*a[:-1], "x"])), (9, " ".join(["y", *a[1:]])), (11, other + " z"), (12, "alone text of five words")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {3: 3, 7: 3, 9: 3, 11: 3, 12: 12}


@pytest.mark.parametrize("percent", [80, 85])
def test_variants_of_templates_at_all_distances(spark, percent):
    """Groups in which some are linked, directly or by others, and most are near the threshold or below it."""
    rng = random.Random(percent)
    few = [f"c{k}" for k in range(25)]
    rows = []
    for length in (60, 146, 150, 9):
        base = [f"t{length}x{k}" for k in range(length)]
        for _ in range(60):
            w = list(base[: length - rng.randint(0, 6)])
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(few)
            rows.append((len(rows), " ".join(w)))
    bands = {80: 40, 85: 28}[percent]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, bands=bands).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(rows, percent)


def test_a_hot_class(spark):
    rows = [(i, "the same text again and again") for i in range(3000)] + [(5000 + i, f"text number {i} of its own kind {i * i}") for i in range(50)] + [(9000, None), (None, "the same text again and again")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("doc_id < 3000 and component_id <> 0").count() == 0 and got.where("kept").count() == 1 + 50 + 2


def test_line_dedup_with_clashing_names(spark):
    rows = [(i, f"own {i}\nfoot", "a", [1], 5, "of", "row", i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __lines array<int>, n_lines int, of string, row string, `dotted.name` int")
    out = linededup.drop_boilerplate(docs, ratio=0.5, lines_col=None, dropped_col=None)
    assert out.columns == docs.columns
    r = out.where("doc_id = 3").first()
    assert (r["text"], r["__lines"], r["n_lines"], r["of"], r["row"], r["dotted.name"]) == ("own 3", [1], 5, "of", "row", 3)
    repeated = linededup.drop_boilerplate(docs.select("doc_id", "text", "source").union(docs.where("doc_id = 3").select("doc_id", "text", "source")), ratio=0.5)
    assert repeated.count() == 21 and repeated.where("n_dropped <> 1").count() == 0
    long = spark.createDataFrame([(i, "\n".join(f"l{i}x{k}" for k in range(20_000)) + "\nfoot", "a") for i in range(6)], "doc_id long, text string, source string")
    assert [(r["n_lines"], r["n_dropped"]) for r in linededup.drop_boilerplate(long, ratio=0.5).collect()] == [(20_001, 1)] * 6


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] + x[:, 3] * x[:, 4] > 0).astype(float), rounds=15, pair_rounds=5)
    for row, got in zip(x[:50], model.score(x[:50])):
        total = model.base
        for f, (cuts, table) in enumerate(zip(model.cuts, model.tables)):
            total += table[sum(c <= row[f] for c in cuts)]
        for f, g, cf, cg, table in model.pairs:
            total += table[sum(c <= row[f] for c in cf)][sum(c <= row[g] for c in cg)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((model.score(x) > 0.5) == (x[:, 0] + x[:, 3] * x[:, 4] > 0)).mean() > 0.8


def test_shards_are_runs_of_a_sort_by_the_curve(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300), rng.choice("abcdef"), rng.choice(["en", "de", None])) for i in range(500)]
    got = sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 7).collect()
    order = sorted(got, key=lambda r: (r["curve"], r["text_crc32"], r["size"], r["doc_id"]))
    first = [-(-s * len(rows) // 7) for s in range(8)]
    for place, r in enumerate(order):
        shard = place * 7 // len(rows)
        assert (r["shard"], r["slot"]) == (shard, place - first[shard])


def test_empty_and_long_pages_and_conversations(spark):
    model = htmltext.train(htmltext.labelled_pages(100))
    assert htmltext.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
    body = "".join(f"<p>Sentence {k} of a very long article about one thing.</p>" for k in range(20_000))
    pages = spark.createDataFrame([(1, "u", f"<html><body><nav><a href=x>m</a></nav><article>{body}</article></body></html>", 7)] * 2, "page_id long, url string, html string, text int")
    got = htmltext.extract_main_text(pages, model).collect()
    assert len(got) == 2 and got[0]["text"].startswith("Sentence 0 of") and got[0]["text"].endswith("Sentence 19999 of a very long article about one thing.")
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = "conv_id long, turn long, role string, text string, conv long, mask int"
    assert chat.chat_report(spark.createDataFrame([], turns), path).count() == 0
    long = chat.chat_report(spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", "word " * 5000, 3, 4) for k in range(6)], turns), path).first()
    assert long["loss_chars"] == 3 * 25_000 and long["n_turns"] == 6


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables with planted copies, boilerplate, benchmark passages and junk, and rows of every odd kind."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(900)]

    def prose(n):
        words = [rng.choice(vocabulary) for _ in range(n)]
        return ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, n, 9)) + "."

    rows, labels = [], []
    for i in range(160):
        junk = i % 4 == 3
        text = " ".join(rng.choice(["###", "$$$ win", "|||", "!!!", "click", "*** 99"]) for _ in range(120)) if junk else prose(rng.randint(60, 160)) + "\nAll rights of the site reserved"
        rows.append((i, text, "en", f"s{i % 3}", len(text), i))
        labels.append((i, 0 if junk else 1, 0))
    items = [(k, prose(30)) for k in range(5)]
    good = [r for r in rows if r[0] % 4 != 3]
    for k in range(20):
        near = good[k][1].split(" ")
        near[len(near) // 2] = "changed"
        rows.append((200 + k, " ".join(near), "en", f"s{k % 3}", 0, k))
    rows += [(300 + k, prose(40) + " " + items[k][1] + " " + prose(40), "en", "s1", 0, k) for k in range(5)]
    rows += [(400, None, None, None, None, 1), (401, "", "en", "s1", 0, 2), (None, prose(50), "en", "s2", 0, 3), rows[0], rows[1], (402, prose(3000), "en", "s0", 0, 4)]
    path = tmp_path_factory.mktemp("corpus")
    kind = "doc_id long, text string, lang string, source string, n_chars long, site int"
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_pipeline_against_plain_python(spark, corpus):
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = model.score(quality.features(pa.array([r[1] for r in rows], pa.string())))
    left = [r for r, s in zip(rows, scores) if s >= 0.5]
    assert sum(r[0] is not None and r[0] < 160 and r[0] % 4 == 3 for r in left) == 0 and sum(r[0] is not None and r[0] < 160 for r in left) >= 118
    stages = dict(corpus_pipeline.STAGES)

    def same(df, want):
        key = lambda r: tuple(str(x) for x in r)
        got = sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=key)
        assert got == sorted(want, key=key)

    out = stages["quality"](spark, docs, path)
    same(out, [r[:2] for r in left])
    # lines on more than 2 % of a source's pages, and on five at least
    bare = lambda line: line.strip(" \t\r")
    pages, seen = {}, {}
    for r in left:
        pages[r[3]] = pages.get(r[3], 0) + 1
        for line in {bare(x) for x in (r[1] or "").split("\n")} - {""}:
            seen[r[3], line] = seen.get((r[3], line), 0) + 1
    common = {k for k, n in seen.items() if n >= 5 and n > 0.02 * pages[k[0]]}
    left = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], bare(x)) not in common)) for r in left]
    out = stages["line_dedup"](spark, spark.createDataFrame(out.collect(), docs.schema), path)
    same(out, left)
    assert out.where("n_chars <> char_length(text)").count() == 0 and any("All rights" in (r[1] or "") for r in rows) and not any("All rights" in (t or "") for _, t in left)
    label = components([r for r in left if r[0] is not None], 80)
    left = [r for r in left if r[0] is None or label[r[0]] == r[0]]
    out = stages["near_dedup"](spark, spark.createDataFrame(out.collect(), docs.schema), path)
    same(out, left)
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(find(t)[k : k + 10]) for _, t in items for k in range(len(find(t)) - 9)}
    hit = lambda t: any(tuple(find(t)[k : k + 10]) in windows for k in range(len(find(t)) - 9))
    dropped = {i for i, t in left if i is not None and hit(t)}
    assert dropped >= {300, 301, 302, 303, 304}
    left = [r for r in left if r[0] not in dropped]
    out = stages["decontaminate"](spark, spark.createDataFrame(out.collect(), docs.schema), path)
    same(out, left)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = stages["encode"](spark, spark.createDataFrame(out.collect(), docs.schema), path).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=key) == sorted(((i, library.encode_ordinary(t or "")) for i, t in left), key=key)
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in whole) == sorted((str(r["doc_id"]), r["n_tokens"]) for r in got)


def test_stages_of_an_empty_table(spark, corpus):
    path = corpus[0]
    empty = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, path)
        assert out.count() == 0 and (name == "encode" or out.columns == empty.columns)


def test_crc_of_rows(spark):
    got = sharding.hilbert_shards(spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "é", "s", "l")], "doc_id long, text string, source string, lang string"), 2).collect()
    assert sorted(r["text_crc32"] for r in got) == sorted([0, 0, zlib.crc32("é".encode())])

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelmill.llm import chat, decontamination, sharding, toxicity, voronoi
from tests.llm.conftest import rows_of


# ---- toxicity


def labelled(documents, spark, count=400):
    chance = random.Random(2)
    texts, labels = [], []
    for k in range(count):
        words = [f"w{chance.randint(0, 300)}" for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            words[chance.randint(0, 39)] = "nastyword" + chance.choice(["s", "er", "", "ing"])
            words[chance.randint(0, 39)] = "horrid"
        texts.append(" ".join(words))
        labels.append((k, int(toxic)))
    return documents(texts, extra=["score"]), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(spark, documents):
    docs, labels = labelled(documents, spark)
    model = toxicity.fit(docs, toxicity.learnable(labels))
    assert 0 < len(model.features) < 5000
    found = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert len(found) > 60 and {zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in found} == {2}
    assert np.mean([(r["score"] >= 0.3) == (r["toxic"] == 1) for r in found]) > 0.97
    again = toxicity.fit(docs.repartition(5), toxicity.learnable(labels).repartition(3))
    assert np.array_equal(again.features, model.features) and np.array_equal(again.weights, model.weights)


def test_only_the_text_scores(spark, documents):
    docs, labels = labelled(documents, spark, 100)
    model = toxicity.fit(docs, labels.where("doc_id < 50"))
    one = toxicity.score(documents(["horrid w1", None, "", "horrid w1"], ids=[1, None, 3, 4], sources=["a", None, "c", "d"]), model)
    scores = {r["doc_id"]: r["score"] for r in one.collect()}
    assert scores[1] == scores[4] and scores[None] == scores[3] and 0 < scores[3] < scores[1] < 1


def test_no_labels_no_toxicity(spark, documents):
    none = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents(["a", "b"]), none)
    assert [r["score"] for r in toxicity.score(documents(["a", "b"]), model).collect()] == [0.0, 0.0]
    assert toxicity.score(documents(["a"]).limit(0), model).count() == 0


def test_the_sample_is_bounded(spark, documents):
    docs, labels = labelled(documents, spark, 100)
    small = toxicity.fit(docs, labels, max_rows=1)
    assert small.intercept is not None and len(small.features) == 0


# ---- decontamination


def brute_passages(docs, items, window=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    lower = lambda text: re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    patterns = {}
    for item, text in items:
        words = find(lower(text))
        for k in range(max(len(words) - window, 0) + 1 if words else 0):
            patterns.setdefault(tuple(words[k : k + window]), set()).update([] if item is None else [str(item)])
    out = []
    for key, text in docs:
        words, hit, found = find(lower(text)), set(), set()
        for pattern, owners in patterns.items():
            for k in range(len(words) - len(pattern) + 1):
                if tuple(words[k : k + len(pattern)]) == pattern:
                    hit.update(range(k, k + len(pattern)))
                    found |= owners
        out.append((key, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_passages_equal_brute_force(spark, documents, block_bytes):
    chance = random.Random(6)
    word = lambda: chance.choice(["alpha", "Beta", "g", "É", "1", "x2"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 9, 10, 11, 25, 0])]
    items += [(4, "a different text of the same item"), (None, "no id but five words"), (50, None), (51, "--- !!")]
    texts = [" ".join(word() for _ in range(chance.randint(0, 80))) for _ in range(60)]
    texts += [None, "", "x" * 50_000, items[6][1], "say: " + items[5][1].upper().replace(" ", "--"), "no id but five words", "pi 3"]
    docs = [(None if k == 5 else min(k, 64), text) for k, text in enumerate(texts)]
    frame = documents([text for _, text in docs], ids=[key for key, _ in docs], extra=["spans", "items"])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_passages(frame, bench, block_bytes=block_bytes).collect()
    got = [(r[0], r["n_words"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), r["items"]) for r in found]
    assert sorted(got, key=repr) == brute_passages(docs, items)
    nothing = decontamination.find_passages(frame, bench.limit(0))
    assert nothing.where("size(spans) > 0").count() == 0 and nothing.count() == len(texts)
    assert decontamination.find_passages(frame.limit(0), bench).count() == 0


# ---- search


def brute_top(vectors, queries, k):
    out = []
    for query, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), key) for key, v in vectors if key != query)[:k]
        out += [(query, rank, key, -score) for rank, (score, key) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [1, 7])
def test_top_k_equals_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(voronoi, "DATA_PER_PIVOT", 300 // pivots)
    monkeypatch.setattr(voronoi, "QUERIES_PER_PIVOT", 40 // pivots)
    draw = np.random.default_rng(1)
    centres = draw.integers(-200, 200, (4, 8))
    points = [(centres[k % 4] + draw.integers(-20, 20, 8)).tolist() for k in range(150)]
    points += [points[0]] * 120 + [[0] * 8] * 5 + [[900, *[0] * 7]] * 3
    vectors = [(k * 3, v) for k, v in enumerate(points)]
    queries = vectors[::10] + vectors[150:160] + vectors[-2:]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, v array<long>")
    found = voronoi.top_k(frame(vectors), frame(queries), 5)
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(brute_top(vectors, dict(queries).items(), 5), key=repr)


def test_search_of_few_none_and_broken_rows(spark):
    rows = [(1, [0.5, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (4, None), (None, [1.0, 1.0]), (50, [0.5, -0.001]), (51, [1.0, 1.0])]
    vectors = voronoi.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert rows_of(vectors, "vec_id", "v") == [(50, [128, -1]), (51, [256, 256])]
    found = voronoi.top_k(vectors, vectors.where("vec_id = 50"))
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == [(50, 1, 51, 128 * 256 - 256)]
    assert voronoi.top_k(vectors.limit(0), vectors).count() == 0 and voronoi.top_k(vectors, vectors.limit(0)).count() == 0


# ---- shards


def test_shards_are_level_and_gapless(documents):
    chance = random.Random(9)
    texts = ["copy of a text"] * 700 + [None, ""] + ["x y " * int(chance.lognormvariate(3, 1)) for _ in range(1300)]
    sizes = sharding.document_sizes(documents(texts, ids=[None, *range(1, len(texts) - 1), 1]))
    dims = {"size": 1024, "tokens": 1, "rows": 1}
    found = sharding.shard_rows(sizes, "doc_id", ["text_hash", "text_crc32", "size"], dims, slice_rows=1000).collect()
    assert len(found) == len(texts) and sum(r["size"] for r in found) == sum(len(t or "") + 1 for t in texts)
    for shard in range(16):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    for name, most in (("size", 1.05), ("tokens", 1.1)):
        totals = [sum(r[name] for r in found if r["shard"] == shard) for shard in range(16)]
        assert max(totals) < most * sum(totals) / 16
    assert sharding.shard_rows(sizes.limit(0), "doc_id", ["text_hash"], dims).count() == 0


def test_small_groups_stay_together(documents):
    texts = [f"text {k // 3} with some words" for k in range(300)]
    sizes = sharding.document_sizes(documents(texts))
    found = sharding.shard_rows(sizes, "doc_id", ["text_hash"], {"size": 1, "rows": 1}).collect()
    assert len({(r["text_hash"], r["shard"]) for r in found}) == 100


# ---- chat


def conversation(template, turns, context=16):
    renderer = chat.Renderer(template, context)
    return [renderer.add(role, text) for role, text in turns]


def test_spans_join_to_the_rendering():
    template = chat.InstructionTemplate()
    hard = "</s>[INST] ok [/INST]"
    turns = [("system", hard), ("user", hard), ("assistant", hard), ("user", ""), ("assistant", "[\\<\\\\"), ("to]ol[", "x" * 9)] * 12
    found = conversation(template, turns, context=4)
    rendered = "".join(span for span, *_ in found)
    assert rendered == template(turns) and template.read(rendered) == turns and not any(x[3] for x in found)
    for (span, begin, end, _), (_, text) in zip(found, turns):
        assert template.unescape(span[begin:end]) == text
    assert rendered.count("</s>") == 24 and rendered.count("[/INST]") == 24


def test_rewritten_history_is_seen():
    hides = lambda turns: "|".join(("..." if k < len(turns) - 1 and role == "assistant" else text) for k, (role, text) in enumerate(turns))
    found = conversation(hides, [("user", "a"), ("assistant", "thoughts"), ("user", "b"), ("assistant", "c")])
    assert [x[3] for x in found] == [False, False, True, False]


def test_a_template_that_looks_far_back_keeps_its_context():
    numbered = lambda turns: "".join(f"<{k}>{text}" for k, (_, text) in enumerate(turns))
    turns = [("user", f"t{k}") for k in range(50)]
    assert "".join(span for span, *_ in conversation(numbered, turns, context=3)) == numbered(turns)


def test_conversations_read_back(spark):
    long = [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(90)]
    rows = [(1, 0, "user", None), (1, 1, "assistant", "é<s>"), (1, 1, "assistant", "é<s>"), (2, None, None, "x"), (None, 3, "assistant", "y"), *long]
    frame = spark.createDataFrame([(*row, 7) for row in rows], "conv_id long, turn long, role string, text string, position int")
    template = chat.InstructionTemplate()
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame, template), template).collect()}
    assert set(found) == {1, 2, 9, None}
    for conv, row in found.items():
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert row["formatted_chars"] == len(template(turns))
    assert chat.read_back(chat.format_conversations(frame.limit(0), template), template).count() == 0


def test_passages_with_clashing_columns(spark, documents):
    """A kept column may have any name; those named like a result give way to it."""
    bench = spark.createDataFrame([("i", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id string, text string")
    frame = documents(["x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", None]).selectExpr(
        "doc_id", "text", "'kept' AS _text", "'c' AS c0", "1 AS spans", "2 AS n_words"
    )
    found = decontamination.find_passages(frame, bench, keep=["_text", "c0", "spans", "n_words"])
    assert found.columns == ["doc_id", "_text", "c0", "n_words", "spans", "items"]
    assert sorted((r["_text"], r["c0"], r["n_words"], r["items"]) for r in found.collect()) == [("kept", "c", 0, []), ("kept", "c", 11, ["i"])]
    with pytest.raises(ValueError):
        decontamination.find_passages(frame, bench, key="spans")


"""Quality, language, mixing, sharding and the pipeline on small inputs."""

import os
import random
import zlib

import numpy as np
import pytest
from plain import plain_naive_bayes
from pyspark.sql import functions as F

from kelpline.llm import language, mixing, quality, sharding
from kelpline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@needs_data
def test_quality_held_out(spark):
    rows = QUERIES["op1_quality"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64) if k != "embed" else net.p[k]
    docs = [quality.blocks_of(bytes(rng.integers(97, 123, n).astype(np.uint8))) for n in (20, 300, 600)]
    data, counts, label = np.concatenate(docs), np.array([len(d) // quality.BLOCK for d in docs]), np.array([0.0, 1.0, 1.0])

    def loss():
        z = net.features(data, counts) @ np.r_[net.p["mean"], net.p["top"]] + net.p["bias"][0]
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    grads = net.gradients(data, counts, label)
    for name, at in (("filters", (3, 2)), ("offsets", (1,)), ("mean", (4,)), ("top", (0,)), ("bias", (0,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-4
        up = loss()
        net.p[name][at] = old - 1e-4
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-3


def test_quality_long_texts_in_parts(monkeypatch):
    net = quality.Network()
    text = "".join(random.Random(1).choice("abc é\n") for _ in range(9000))
    whole = net.score([text, None, ""])
    monkeypatch.setattr(quality, "PIECE", 1024)
    assert np.allclose(net.score([text, None, ""]), whole)


def test_language(spark, monkeypatch):
    rng = random.Random(2)
    words = {"aa": ["kilo", "muna", "tabi"], "bb": ["strøm", "fjord", "ålen"], "cc": ["дом", "мир", "река"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(l, 20), l) for i, l in enumerate(["aa", "bb", "cc"] * 10)] + [(90, None, "aa"), (91, "12 %", "bb"), (92, "kilo", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert all(got[i][0] == l for i, t, l in rows[:30]) and got[92][0] == "aa"
    assert got[90] == ("und", 0.0) and got[91] == ("und", 0.0)
    long = text("cc", 4000) + text("aa", 100)
    whole = model.predict([long, "kilo", long])
    monkeypatch.setattr(language, "PIECE", 1000)
    parts = model.predict([long, "kilo", long])
    assert whole[0] == parts[0] == ["cc", "aa", "cc"] and np.allclose(whole[1], parts[1])
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_language_counts_all_rows():
    model_input = ["ab c", "a"]
    bins = np.concatenate([language._grams(c, r)[0].ravel() for c, r in language._pieces(model_input)])
    assert len(bins) == 3 * 4  # three grams end in each letter


@needs_data
def test_language_held_out(spark):
    rows = QUERIES["op2_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.98


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 1, 1], 450) == [150.0, 150.0, 150.0]
    got = mixing.water_fill([10, 100, 0, 100], [5, 2, 1, 1], 300)
    assert got[0] == 20.0 and got[2] == 0.0 and abs(sum(got) - 300) < 1e-9 and got[1] / got[3] == pytest.approx(2.0)
    assert mixing.water_fill([10], [1], 99) == [20.0] and mixing.water_fill([], [], 0) == []


def test_mixture_keeps_rows_without_an_id(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    rows = [(None if i % 3 else i, f"row {i} " + "w " * rng.randrange(1, 40), "en", "ab"[i % 2], i) for i in range(900)]
    rows += [(5, "one", "en", "a", 1), (5, "another text", "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.mix_sources(spark, docs, "").collect()
    plan = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for source, target in plan.items():
        taken = sum(len(r["text"].split()) for r in got if r["source"] == source)
        assert abs(taken - target) <= 21
    assert {tuple(r) for r in got} <= set(rows)
    without = sum(r["doc_id"] is None for r in got) / len(got)
    assert 0.6 < without < 0.73
    again = p.mix_sources(spark, docs.repartition(5), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))), rng.choice(["b", "a", "ü", None, "b", "b"])) for i in range(600)]
    rows += [(600, None, "a"), (601, "", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    names = ["a", "b", "ü", None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = mixing.water_fill(sizes, [5, 2, 1, 5], 1.5 * sum(sizes))
    for name, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in got if r["source"] == name]
        assert {(r["source_size"], r["target"]) for r in own} == {(size, target)}
        assert abs(sum(r["taken"] for r in own) - target) <= 2 * 40
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_shards(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(0, 3000)) for i in range(3000)] + [(7, "twice"), (7, "twice"), (9000, None)]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, shard string")
    out, shard_of, sizes = sharding.shard_records(docs, 40)
    got = out.collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert len(total) == 40 and max(total.values()) - min(total.values()) <= 3016
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9000]["size"] == 16 and by_id[9000]["text_crc32"] is None
    assert by_id[3]["text_crc32"] == zlib.crc32(rows[3][1].encode()) and {r["law"] for r in got} == {"bytes"}
    grown = sharding.rebalance(shard_of, sizes, 41)
    moved = [(a, b) for a, b in zip(shard_of, grown, strict=True) if a != b]
    filled = [0] * 41
    for slot, s in enumerate(grown):
        filled[s] += sizes.get(slot, 0)
    assert moved and {b for _, b in moved} == {40} and filled[40] > 0.8 * sum(filled) / 41
    path = str(tmp_path / "maps")
    sharding.save_map(sharding.map_frame(spark, shard_of, 1), path)
    sharding.save_map(sharding.map_frame(spark, grown, 2), path)
    assert sharding.as_list(sharding.load_map(spark, path)) == grown and sharding.as_list(sharding.load_map(spark, path, 1)) == shard_of
    assert sharding.shard_records(docs.limit(0), 40)[0].count() == 0


@needs_data
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    for name, stage in p.STAGES[:-1]:
        docs = p.checkpointed(stage(spark, docs, DATA))
        assert tuple(docs.columns) == p.COLUMNS
        if name == "benchmark_decontamination":
            assert docs.count() == docs.select("doc_id").distinct().count() > 700
    last = p.assign_shards(spark, docs, DATA)
    assert last.count() == docs.count()
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "some plain words here for you", None, None, 3), (3, "some plain words here for you", None, None, 3)], docs.schema)
    for _, stage in p.STAGES:
        assert stage(spark, odd, DATA).count() >= 0
        assert stage(spark, odd.limit(0), DATA).count() == 0
    assert sum(r["taken"] for r in mixing.mix(docs.filter(F.col("doc_id") < 0)).collect()) == 0


def test_rows_without_an_id(spark):
    from kelpline.llm import decontaminate, embeddings, lines, minhash, suffix

    big = 2**60 + 1
    text = "one two three four five six seven eight nine ten eleven " * 30
    docs = spark.createDataFrame([(None, text, "en", "s", 1), (big, text, "en", "s", 1), (3, text, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    model = language.train(docs)
    assert {r["doc_id"] for r in language.predict(docs, model).collect()} == {None, big, 3}
    assert {r["doc_id"] for r in quality.score(docs, quality.Network()).collect()} == {None, big, 3}
    assert {r["doc_id"]: r["kept"] for r in minhash.near_duplicates(docs).collect()} == {None: True, big: False, 3: True}
    assert {r["doc_id"]: r["n_dropped"] for r in lines.line_digests(docs).collect()} == {None: 0, big: 1, 3: 0}
    assert {r["doc_id"]: r["n_removed"] > 0 for r in suffix.removed(docs).collect()} == {None: False, big: True, 3: True}
    assert decontaminate.decontaminate(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).count() <= 3
    assert len(key(mixing.mix(docs), "doc_id")) == 3 and len(key(sharding.shard_records(docs, 2)[0], "doc_id")) == 3
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (big, [1.0, 2.0]), (3, [2.0, 4.0])], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(vectors).collect()} == {None: (0, None, True), big: (1, 3, False), 3: (1, 3, True)}


def test_shards_of_repeated_and_missing_ids(spark):
    """A third of the rows without an id, a third of one id, equal rows among them: no slot is filled by them, and reruns agree."""
    rng = random.Random(15)
    rows = [(i, "x" * rng.randrange(50, 900)) for i in range(1500)] + [(None, "y" * rng.randrange(50, 900)) for _ in range(1500)] + [(7777, "z" * 500)] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("vslot", F.lit("a"))
    got = sharding.shard_records(docs, 10)[0].collect()
    again = sharding.shard_records(docs.repartition(3), 10)[0].collect()
    key = lambda out: sorted(str((r["doc_id"], r["size"], r["text_crc32"], r["shard"])) for r in out)
    assert key(got) == key(again) and len(got) == len(rows)
    filled, places, slots = {}, {}, {}
    for r in got:
        filled[r["shard"]] = filled.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        slots[r["vslot"]] = slots.get(r["vslot"], 0) + 1
    assert max(filled.values()) - min(filled.values()) <= 916 and max(slots.values()) < 12
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_later_call_leaves_earlier_shards_alone(spark):
    rng = random.Random(18)
    docs = [spark.createDataFrame([(i, "x" * rng.randrange(0, 2000)) for i in range(500)], "doc_id long, text string") for _ in range(2)]
    first = sharding.shard_records(docs[0], 7)[0]
    sharding.shard_records(docs[1], 3)
    assert {r["shard"] for r in first.collect()} == set(range(7))


def test_shards_against_plain_greedy(spark):
    """Bytes of each shard, and the shard of each slot, by a plain loop over the slots."""
    rng = random.Random(16)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(0, 2000)) for i in range(4000)], "doc_id long, text string")
    got = sharding.shard_records(docs, 40)[0].collect()
    slots, filled, want = {}, [0] * 40, {}
    for r in got:
        slots[r["vslot"]] = slots.get(r["vslot"], 0) + r["size"]
    assert {r["doc_id"]: r["vslot"] for r in got} == {r["doc_id"]: r["v"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(8192)).alias("v")).collect()}
    for slot in sorted(slots, key=lambda s: (-slots[s], s)):
        shard = min(range(40), key=lambda s: (filled[s], s))
        want[slot] = shard
        filled[shard] += slots[slot]
    assert {r["vslot"]: r["shard"] for r in got} == want


def test_stored_maps_are_replaced_not_doubled(spark, tmp_path):
    path = str(tmp_path / "m")
    for version in (1, 2, 2):
        sharding.save_map(sharding.map_frame(spark, [version] * 8, version), path)
    assert sharding.load_map(spark, path).count() == 8 and sharding.as_list(sharding.load_map(spark, path, 1)) == [1] * 8


def test_language_against_plain_naive_bayes(spark):
    rng = random.Random(17)
    words = {"aa": ["kilo", "muna", "tabi", "x1y"], "bb": ["strøm", "Fjord", "ålen", "kilo"], "cc": ["дом", "мир", "река", "kilo"]}
    rows = [(" ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 9))), lang) for lang in words for _ in range(15)]
    texts = [" ".join(rng.choice(words[rng.choice("abc") * 2]) for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["kilo " * 3000 + "мир"]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    for i, (lang, score) in enumerate(plain_naive_bayes(rows, texts)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-3


def test_letters_of_all_planes(spark):
    model = language.Model(["aa"], np.zeros((1, language.N_BINS), np.float32))
    assert model.predict(["😀😀 🎉", "𝐚", "𠀀"])[0] == ["und", "aa", "aa"]
    from kelpline.llm.shingles import words

    assert [len(words([t])[0]) for t in ("😀 😀", "𝐚 𠀀", "a😀b")] == [0, 2, 2]


def test_quality_against_plain_convolution():
    """Scores by loops over places, filters and chunks."""
    rng = np.random.default_rng(8)
    net = quality.Network()
    net.p["mean"], net.p["top"] = rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32)
    net.p["bias"], net.p["offsets"] = np.float32([0.2]), rng.normal(size=quality.FILTERS).astype(np.float32)
    for text in ("", "short", "a longer text é " * 40, None):
        data = (text or "").encode()
        n = (len(data) + quality.WIDTH) // quality.BLOCK + 1
        padded = data.ljust(n * quality.BLOCK + quality.WIDTH, b"\0")
        blocks = []
        for b in range(n):
            answers = []
            for place in range(b * quality.BLOCK, (b + 1) * quality.BLOCK, quality.STRIDE):
                x = np.concatenate([net.p["embed"][c] for c in padded[place : place + quality.WIDTH]])
                answers.append(x @ net.p["filters"] + net.p["offsets"])
            blocks.append(np.max(answers, 0))
        chunks = [np.maximum(np.maximum(blocks[i], blocks[min(i + 1, n - 1)]), 0) for i in range(max(n - 1, 1))]
        z = np.mean(chunks, 0) @ net.p["mean"] + np.max(chunks, 0) @ net.p["top"] + net.p["bias"][0]
        assert abs(net.score([text])[0] - 1 / (1 + np.exp(-z))) < 1e-5


def test_quality_gradient_of_the_embedding():
    rng = np.random.default_rng(1)
    net = quality.Network()
    docs = [quality.blocks_of(bytes(rng.integers(97, 103, n).astype(np.uint8))) for n in (40, 300)]
    data, counts, label = np.concatenate(docs), np.array([len(d) // quality.BLOCK for d in docs]), np.array([0.0, 1.0])

    def loss():
        z = net.features(data, counts).astype(np.float64) @ np.r_[net.p["mean"], net.p["top"]].astype(np.float64) + net.p["bias"][0]
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    g = net.gradients(data, counts, label)["embed"]
    for at in ((97, 0), (99, 2), (101, 3)):
        old = net.p["embed"][at]
        net.p["embed"][at] = old + 1e-2
        up = loss()
        net.p["embed"][at] = old - 1e-2
        down = loss()
        net.p["embed"][at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_quality_sample(spark, monkeypatch):
    """Conflicting labels go, repeated rows count once, the bytes bound holds, and the fit is the same whatever the order of the rows."""
    seen = []
    monkeypatch.setattr(quality.Network, "fit", lambda self, docs, labels: seen.append((docs, labels)) or self)
    rng = random.Random(4)
    docs = [(i, "t" * (50 + i)) for i in range(60)] + [(3, "t" * 53), (4, "other"), (None, "x"), (70, "long " * 400_000), (71, None)]
    labels = [(i, i % 2) for i in range(60)] + [(3, 1), (5, 0), (8, None), (70, 1), (71, 1), (None, 1)]
    for order in (1, 2):
        rng.shuffle(docs)
        quality.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(order), spark.createDataFrame(labels, "doc_id long, quality int"))
    (a, la), (b, lb) = seen
    assert [x.tobytes() for x in a] == [x.tobytes() for x in b] and la.tolist() == lb.tolist() and len(a) == 60 + 1 - 1 + 1
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 500)
    quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 0 < len(seen[2][0]) < 10
    quality.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert len(seen) == 3

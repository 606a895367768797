"""The whole pipeline against a plain version of each stage, on a small corpus."""

import random
import re
import zlib
from collections import Counter

from plain import bag, classes, plain_mixture, plain_naive_bayes, similarity

from kelpline.llm import mixing, sharding

SYLLABLES = {"aa": ("ko", "mu", "ta", "bi", "lo", "ne"), "bb": ("strø", "fjo", "ål", "gru", "vek", "ski"), "cc": ("до", "ми", "ре", "ка", "лу", "ша")}


def corpus(rng):
    """Documents in three languages with copies, edited copies, benchmark items, and rows that have to go."""
    pools = {lang: [a + b for a in parts for b in parts] for lang, parts in SYLLABLES.items()}

    def prose(lang, n):
        return " ".join(rng.choice(pools[lang]) for _ in range(n))

    items = [prose("aa", 30), prose("bb", 12), prose("cc", 50)]
    rows = []

    def add(text, lang, source):
        rows.append((len(rows), text, lang, source, len(text or "")))

    for k in range(150):
        lang = "abc"[k % 3] * 2
        text = prose(lang, rng.randrange(3, 90))
        add(text, None if k % 7 == 0 else lang, (None, "s1", "s2", "s2", "s2")[k % 5])
        words = text.split()
        if k % 10 == 0:
            add(text.upper() + "!", lang, "s3")
        if k % 6 == 0 and len(words) > 60:
            add(" ".join([*words[:-1], "edge"]), lang, "s1")
            add(" ".join([*words[: len(words) // 2], *prose(lang, len(words)).split()]), lang, "s1")
        if k % 25 == 0:
            add(prose("aa", 20) + " " + items[k // 25 % 3] + " " + prose("cc", 9), "aa", "s2")
    for text in (None, "", "12 34 56", "😀 😀"):
        add(text, "aa", "s1")
    return rows, items


def plain_pipeline(rows, items, sharded_slots):
    """(the rows that the stages leave, one for each time taken; the shard of each slot)."""
    learned = [(t, lang) for _, t, lang, _, _ in rows if t is not None and lang is not None]
    found = plain_naive_bayes(learned, [t or "" for _, t, _, _, _ in rows])
    kept = [r for r, (_, p) in zip(rows, found, strict=True) if any(c.isalpha() for c in r[1] or "") and p >= 0.5]

    bags = [bag(r[1]) for r in kept]
    links = [(i, j) for i in range(len(kept)) for j in range(i) if similarity(bags[i], bags[j]) >= 0.8]
    root = classes(links, len(kept))
    kept = [r for i, r in enumerate(kept) if root[i] == i]

    def leaks(text):
        words = re.findall(r"[^\W_]+", text.lower())
        run = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        for item in map(bag, items):
            n = sum(item.values())
            if any(similarity(Counter(run[k : k + n]), item) >= 0.8 for k in range(len(run))):
                return True
        return False

    kept = [r for r in kept if not leaks(r[1])]
    taken = [r for r, n in plain_mixture(kept) for _ in range(n)]

    filled, shard_of = [0] * 40, {}
    sizes = Counter()
    for slot, size in sharded_slots:
        sizes[slot] += size
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        shard_of[slot] = min(range(40), key=lambda s: (filled[s], s))
        filled[shard_of[slot]] += sizes[slot]
    return taken, shard_of


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rows, items = corpus(random.Random(31))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    taken, shard_of = plain_pipeline(rows, items, [(r["vslot"], r["size"]) for r in got])
    assert 60 < len({r[0] for r in taken}) < len(rows) - 20
    want = Counter((i, len(t.encode()) + sharding.OVERHEAD, zlib.crc32(t.encode())) for i, t, *_ in taken)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert all(shard_of[r["vslot"]] == r["shard"] for r in got)
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_plain_mixture_meets_its_targets():
    rng = random.Random(32)
    rows = [(i, "w " * rng.randrange(1, 30), None, rng.choice(["a", "b", None]), 0) for i in range(500)]
    taken = Counter()
    sizes = Counter()
    for r, n in plain_mixture(rows):
        taken[r[3]] += n * len(r[1].split())
        sizes[r[3]] += len(r[1].split())
    names = ["a", "b", None]
    for name, target in zip(names, mixing.water_fill([sizes[s] for s in names], [5, 2, 1], 1.5 * sum(sizes.values())), strict=True):
        assert abs(taken[name] - target) <= 30

"""Plain versions, in loops, of what the training-data operators compute."""

import hashlib
import math
import re
from collections import Counter

from kelpline.llm import language, mixing


def bag(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / ((sum(a.values()) + sum(b.values()) - both) or 1)


def classes(links, n):
    """The least member that each of n reaches by links."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def plain_naive_bayes(rows, texts):
    """Multinomial naive Bayes by loops over characters, with the same hash of one- to three-grams."""
    mask, counts = 2**64 - 1, {}

    def bins(text):
        lowered = "  " + text.lower()
        chars = [ord(c) if c.isalpha() else 32 for c in lowered]
        for i in range(2, len(chars)):
            if lowered[i].isalpha():
                x = chars[i] * int(language._MUL[0])
                grams = [x + 1, x + chars[i - 1] * int(language._MUL[1]) + 2, x + chars[i - 1] * int(language._MUL[1]) + chars[i - 2] * int(language._MUL[2]) + 3]
                for g in (v & mask for v in grams):
                    yield ((g ^ (g >> 29)) * int(language._MUL[0]) & mask) >> (64 - language.BITS)

    for text, lang in rows:
        own = counts.setdefault(lang, {})
        for b in bins(text):
            own[b] = own.get(b, 0) + 1
    totals = {lang: sum(own.values()) + language.ALPHA * language.N_BINS for lang, own in counts.items()}
    out = []
    for text in texts:
        held = list(bins(text))
        score = {lang: sum(math.log((own.get(b, 0) + language.ALPHA) / totals[lang]) for b in held) for lang, own in counts.items()}
        best = min(score, key=lambda k: (-score[k], k))
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


def plain_mixture(rows):
    """(row, how often it is taken) of (doc_id, text, lang, source, n_chars) rows, by a loop over each source's rows in the order of their draws."""
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    words = {id(r): len(re.findall(mixing.WORD, r[1] or "")) for r in rows}
    sizes = [sum(words[id(r)] for r in rows if r[3] == name) for name in names]
    weights = [mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i in range(len(names))]
    targets = mixing.water_fill(sizes, weights, mixing.TOTAL * sum(sizes))

    def draw(row):
        return int(hashlib.md5(f"{mixing.SEED}:{row[0]}".encode()).hexdigest()[:15], 16)

    out = []
    for name, size, target in zip(names, sizes, targets, strict=True):
        whole = int(target // size) if size else 0
        part, upto = target - whole * size, 0
        for row in sorted((r for r in rows if r[3] == name), key=lambda r: (draw(r) % mixing.CELLS, draw(r), r[0])):
            upto += words[id(row)]
            out.append((row, whole + (upto - words[id(row)] / 2 <= part)))
    return out

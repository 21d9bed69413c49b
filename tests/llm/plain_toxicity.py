"""The toxicity model written out with dictionaries."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOLDS = {"0": (0,), "2": (2,), "both": (0, 2)}


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def error(toxic, ordinary, share):
    held = toxic + ordinary
    return abs(toxic - held * share) / math.sqrt(held * share * (1 - share)) if held else 0.0


def table(labelled, folds, z=4.0, ratio=4.0, held_ratio=2.0, discount=0.75):
    """expression -> value, from (text, toxic, fold) of the folds; None where a class is missing."""
    labelled = [(words_of(text), toxic) for text, toxic, number in labelled if number in folds]
    documents = [sum(t for _, t in labelled), sum(not t for _, t in labelled)]
    if not all(documents):
        return None
    held, pairs, before = defaultdict(lambda: [0, 0]), (set(), set()), defaultdict(lambda: (set(), set()))
    for words, toxic in labelled:
        side = 0 if toxic else 1
        own_pairs = set(zip([b"", *words], words))
        for each in set(words) | own_pairs:
            held[each][side] += 1
        pairs[side].update(own_pairs)
        for place, word in enumerate(words):
            before[word][side].add(words[place - 1] if place else b"")
            if place:
                before[words[place - 1], word][side].add(words[place - 2] if place > 1 else b"")
    n = [len(side) for side in pairs]
    v = [len({word for _, word in side}) for side in pairs]
    values = {}
    for each, (toxic, ordinary) in held.items():
        if each not in before:
            continue  # the first word of a document, after nothing
        shares = abs(math.log((toxic + 0.5) / (documents[0] + 1)) - math.log((ordinary + 0.5) / (documents[1] + 1)))
        if error(toxic, ordinary, documents[0] / sum(documents)) <= z or shares < math.log(held_ratio):
            continue
        own = [len(side) for side in before[each]]
        p = [max(own[i] - discount, 0) / n[i] + discount * v[i] / n[i] * sum(own) / sum(n) for i in (0, 1)]
        value = math.log(p[0] / p[1])
        if error(*own, n[0] / sum(n)) > z and abs(value) >= math.log(ratio):
            values[each] = value
    return {each: value for each, value in values.items() if isinstance(each, bytes) or each[1] not in values}


def difference(text, values):
    words = words_of(text)
    total = sum(values.get(word, 0.0) for word in words) + sum(values.get(pair, 0.0) for pair in zip(words, words[1:]))
    return total / math.sqrt(max(1, len(words)))


def logistic(x, y):
    """Newton's steps on slope and offset; both classes weigh the same, a small ridge holds the slope."""
    if len(set(y)) < 2:
        rate = (sum(y) + 0.5) / (len(y) + 1)
        return 1.0, math.log(rate / (1 - rate))
    x, y = np.array(x), np.array(y, float)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    slope = offset = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -500, 500)))
        curve = weight * p * (1 - p)
        a, b, c = (curve * x * x).sum() + 1e-3 * len(x) / 100 + 1e-9, (curve * x).sum(), curve.sum() + 2e-9
        g, h = (weight * (y - p) * x).sum() - 1e-3 * len(x) / 100 * slope, (weight * (y - p)).sum() - 1e-9 * offset
        step = (c * g - b * h) / (a * c - b * b), (a * h - b * g) / (a * c - b * b)
        slope, offset = slope + step[0], offset + step[1]
        if max(map(abs, step)) < 1e-9:
            break
    return slope, offset


def scores(documents, labels, wanted):
    """The score of each wanted text, from (id, text) documents and (id, toxic) labels."""
    known = {}
    for doc, toxic in labels:
        if doc is not None and toxic is not None:
            known[doc] = max(known.get(doc, 0), toxic)
    labelled = [(text, known[doc] > 0, zlib.crc32(str(doc).encode()) % 3) for doc, text in documents if doc in known and zlib.crc32(str(doc).encode()) % 3 != 1]
    tables = {name: table(labelled, folds) for name, folds in FOLDS.items()}
    full = tables["both"] or {}
    x = []
    for text, _, number in labelled:
        other = tables["2" if number == 0 else "0"] or {}
        common = [each for each in other if each in full]
        scale = sum(abs(full[each]) for each in common) / sum(abs(other[each]) for each in common) if common else 1.0
        x.append(difference(text, other) * scale)
    slope, offset = logistic(x, [int(toxic) for _, toxic, _ in labelled]) if labelled else (1.0, 0.0)
    return [1 / (1 + math.exp(-max(-500, min(500, slope * difference(text, full) + offset)))) for text in wanted]

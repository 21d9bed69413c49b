"""Plain restatements the Spark results are compared with. Written by scanning, not by pattern."""

from __future__ import annotations

import math
import string
import unicodedata
from collections import Counter


def squeeze(text):
    return " ".join(text.split())


def cut_spans(text, opening, closing, keep, one_line=True):
    """Each span from an opening to the next closing mark is cut, or only its marks are."""
    out, at = "", 0
    while True:
        start = text.find(opening, at)
        if start < 0:
            return out + text[at:]
        inner = start + len(opening)
        end = text.find(closing, inner)
        line_end = text.find("\n", inner) if one_line else -1
        if end < 0 or 0 <= line_end < end:
            out += text[at:start + 1]
            at = start + 1
            continue
        out += text[at:start] + (text[inner:end] if keep else "")
        at = end + len(closing)


def mark_gaps(text, is_gap, mark):
    """Bracketed spans whose content qualifies become a mark; an opening bracket inside starts anew."""
    out, at = "", 0
    while at < len(text):
        if text[at] == "[":
            end = text.find("]", at)
            if end > 0 and is_gap(text[at + 1:end]):
                out += mark
                at = end + 1
                continue
        out += text[at]
        at += 1
    return out


def is_long_gap(content):
    if not (content.startswith("...") and content.endswith("..")):
        return False
    tail = content[3:].lstrip()
    return tail in ("..", "...")


def is_short_gap(content):
    return content[:1] == "x" and content[-1:] == "x" and set(content.split()) == {"x"}


def space_divider(text, divider):
    parts = text.split(divider)
    if len(parts) == 1:
        return text
    middle = [part.strip() for part in parts[1:-1]]
    return " ".join([parts[0].rstrip(), *middle, parts[-1].lstrip()])


LABELS = {"o", "r", "rev", "obv"} | {
    head + dot + "e" + end for head in ("lo", "u") for dot in ("", ".") for end in ("", ".")
}


def strip_number(text):
    at = 0
    while at < len(text) and unicodedata.category(text[at]) == "Nd":
        at += 1
    if not at:
        return None
    if text[at:at + 1] in ("'", "′"):
        at += 1
    return text[at + 1:].lstrip() if text[at:at + 1] == "." else None


def drop_line_number(text):
    head = text.split(None, 1)
    if len(head) == 2 and not text[:1].isspace():
        label = head[0]
        if label in LABELS or (label.endswith(".") and label[:-1] in LABELS):
            rest = strip_number(text[len(label):].lstrip())
            if rest is not None:
                return rest
    rest = strip_number(text)
    return text if rest is None else rest


def clean_source(text):
    if text is None or not text.strip():
        return ""
    text = unicodedata.normalize("NFC", text)
    text = text.replace("Ḫ", "H").replace("ḫ", "h").replace("˹", "").replace("˺", "")
    text = cut_spans(text, "<<", ">>", keep=False)
    text = cut_spans(text, "<", ">", keep=True)
    text = mark_gaps(text, is_long_gap, "<big_gap>")
    text = mark_gaps(text, is_short_gap, "<gap>")
    text = cut_spans(text, "[", "]", keep=True)
    text = text.replace("!", "").replace("?", "")
    for divider in "/:":
        text = space_divider(text, divider)
    digits = {**{0x2080 + d: str(d) for d in range(10)}, 0x2070: "0", 0xB9: "1", 0xB2: "2", 0xB3: "3"}
    digits.update({0x2070 + d: str(d) for d in range(4, 10)})
    return squeeze(drop_line_number(text.translate(digits)))


def collapse_repeats(words):
    out = []
    while words:
        size = next((n for n in range(10, 2, -1) if len(words) >= 2 * n and words[:n] == words[n:2 * n]), 0)
        out += words[:size or 1]
        words = words[2 * size or 1:]
    return out


def postprocess(text):
    if text is None:
        return "..."
    text = cut_spans(text, "<|", "|>", keep=False)
    text = cut_spans(text, "<think>", "</think>", keep=False, one_line=False)
    return " ".join(collapse_repeats(text.split())) or "..."


# --- scores -------------------------------------------------------------------------------------


def tokens_13a(text):
    """mteval-13a tokens by walking over the characters of each rule in turn."""
    text = text.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, char)
    alone = set(string.punctuation) - set("',-.")
    text = " " + "".join(f" {c} " if c in alone else c for c in text) + " "

    def pairs(text, first, second, form):
        out, at = "", 0
        while at < len(text):
            if at + 1 < len(text) and first(text[at]) and second(text[at + 1]):
                out += form(text[at], text[at + 1])
                at += 2
            else:
                out += text[at]
                at += 1
        return out

    def digit(c):
        return c in "0123456789"

    def point(c):
        return c in ".,"

    text = pairs(text, lambda c: not digit(c), point, lambda a, b: f"{a} {b} ")
    text = pairs(text, point, lambda c: not digit(c), lambda a, b: f" {a} {b}")
    text = pairs(text, digit, lambda c: c == "-", lambda a, b: f"{a} {b} ")
    return text.split()


def chrf_words(text):
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in string.punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in string.punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def ngram_counts(hyp, ref, order):
    """(hyp, ref, match) n-gram counts of two sequences."""
    left = Counter(tuple(hyp[i:i + order]) for i in range(len(hyp) - order + 1))
    right = Counter(tuple(ref[i:i + order]) for i in range(len(ref) - order + 1))
    return sum(left.values()), sum(right.values()), sum((left & right).values())


def bleu(pairs):
    sums = [[0, 0] for _ in range(4)]
    sys_len = ref_len = 0
    for hyp, ref in pairs:
        hyp, ref = tokens_13a(hyp), tokens_13a(ref)
        sys_len += len(hyp)
        ref_len += len(ref)
        for order in range(1, 5):
            n_hyp, _, match = ngram_counts(hyp, ref, order)
            sums[order - 1][0] += n_hyp
            sums[order - 1][1] += match
    if not any(match for _, match in sums) or not all(total for total, _ in sums):
        return 0.0
    smooth, logs = 1, 0.0
    for total, match in sums:
        if match:
            precision = 100 * match / total
        else:
            smooth *= 2
            precision = 100 / (smooth * total)
        logs += math.log(precision)
    brevity = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return brevity * math.exp(logs / 4)


def chrf(pairs):
    sums = [[0, 0, 0] for _ in range(8)]
    for hyp, ref in pairs:
        chars = "".join(hyp.split()), "".join(ref.split())
        words = chrf_words(hyp), chrf_words(ref)
        for place in range(8):
            n_hyp, n_ref, match = (
                ngram_counts(*chars, place + 1) if place < 6 else ngram_counts(*words, place - 5)
            )
            for field, value in enumerate((n_hyp if n_ref else 0, n_ref, match)):
                sums[place][field] += value
    used = [(match / n_hyp, match / n_ref) for n_hyp, n_ref, match in sums if n_hyp and n_ref]
    if not used:
        return 0.0
    precision = sum(p for p, _ in used) / len(used)
    recall = sum(r for _, r in used) / len(used)
    return 100 * 5 * precision * recall / (4 * precision + recall) if precision + recall else 0.0

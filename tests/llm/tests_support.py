"""Plain versions of two stages, for the pipeline's test."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_cut(text, items, window=10):
    """A text without hit words and what lies between them; None if no word is left of one that had hits."""
    low = text.translate(LOWER)
    at = [m.span() for m in WORD.finditer(low)]
    ws = [low[a:b] for a, b in at]
    hit = [False] * len(ws)
    for _, t in items:
        q = WORD.findall(t.translate(LOWER))
        n = min(window, len(q))
        grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i : i + n]) in grams:
                hit[i : i + n] = [True] * n
    if not any(hit):
        return text
    out, last, i = [], 0, 0
    while i < len(ws):
        if hit[i]:
            j = i
            while j + 1 < len(ws) and hit[j + 1]:
                j += 1
            out.append(text[last : at[i][0]])
            last = at[j][1]
            i = j
        i += 1
    left = "".join(out) + text[last:]
    return left if WORD.search(left.translate(LOWER)) else None


def entities(text):
    """(kind, name) of a text's personal data."""
    from test_secrets_pii import private_base

    return {(k, re.sub("[^0-9]", "", text[a:b]) if k in ("card", "phone") else text[a:b].lower()) for k, a, b in private_base(text)}


def terms(text):
    return {w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) >= 4 and re.search(r"[^\W\d_]", w)}


def brute_private_spans(texts, disclosure=0.8, least=3):
    """For each text its spans with those of disclosing terms, from loops over all distinct lines and documents."""
    from test_secrets_pii import private_base

    telling = set()
    for contexts in ({x for t in texts for x in (t or "").split("\n") if x.strip(" ")}, {t for t in texts if (t or "").strip(" ")}):
        n, n_c, n_t, n_ct = len(contexts), Counter(), Counter(), Counter()
        for x in contexts:
            es, ts = entities(x), terms(x)
            n_c.update(es)
            n_t.update(ts)
            n_ct.update((e, t) for e in es for t in ts)
        telling |= {(e, t) for (e, t), k in n_ct.items() if k >= least and n_c[e] < n and math.log(k * n / (n_c[e] * n_t[t])) / math.log(n / n_c[e]) >= disclosure}
    out = []
    for text in texts:
        text = text or ""
        base, found = private_base(text), {t for e in entities(text) for f, t in telling if f == e}
        extra = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in found]
        extra = [x for x in extra if not any(x[1] < b and a < x[2] for _, a, b in base)]
        kinds = ["email", "ip", "card", "phone", "term"]
        out.append(sorted(base + extra, key=lambda s: (s[1], kinds.index(s[0]), s[2])))
    return out


def brute_mask(text, spans):
    """Spans replaced by marks; overlapping spans are one mark, of the first's kind."""
    out, last, end = [], 0, 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
        last = end
    return "".join(out) + text[last:]

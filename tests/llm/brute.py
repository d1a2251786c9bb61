"""Plain versions of what the queries return, row by row and without Spark."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def token_ids(docs, path, end_id):
    """{doc_id: (start, n, crc)} for distinct ids."""
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, {}
    for doc_id, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    return out


def shingles(text, width):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard(docs, width, num, den):
    """{doc_id: (n_shingles, component_id)} by counting all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, own in sets.items():
        met = Counter(j for s in own for j in held[s])
        for j, n in met.items():
            if den * n >= num * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            held[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    return tuple(sum(x[1] == k for x in found) for k in range(3)) + (hashlib.sha256(joined.encode()).hexdigest(),)


def quality_stats(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def warc(pages, least=0):
    """{(page_id, html): (bytes, digest, type, refers_to)} as a multiset of rows."""
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[(html or "").encode()].append(page_id)
    rows = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        known = [p for p in groups[payload] if p is not None]
        first = min(known) if known and len(payload) >= least else None
        revisit = first is not None and page_id != first
        rows.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(rows)


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """{source: target} by handing the excess round until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > most * sizes[s]]
        if not above:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: most * sizes[s] for s in above}


def toxicity(docs, labels, k=12, least_z=4.0, epsilon=0.05):
    """{doc_id: (held_out, score)} by dense vectors over all words and all pairs."""
    import math

    import numpy as np

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts = {i: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in docs}
    known = {i: y for i, y in labels if not held(i) and i in counts}
    terms = sorted({w for i in known for w in counts[i]})
    at, toxic = {w: n for n, w in enumerate(terms)}, np.array([known[i] for i in sorted(known)], float)
    df = np.array([sum(w in c for c in counts.values()) for w in terms], float)
    a, b = (np.array([sum(w in counts[i] for i in known if known[i] == y) for w in terms], float) for y in (1, 0))
    p, n = toxic.sum(), len(toxic) - toxic.sum()
    share = (a + b + 1) / (p + n + 2)
    z = np.abs(a / p - b / n) / np.sqrt(share * (1 - share) * (1 / p + 1 / n))
    idf = np.where((a + b >= 3) & (z >= least_z), z * z, 1.0) * (np.log((1 + len(docs)) / (1 + df)) + 1)
    rare = math.log((1 + len(docs)) / 2) + 1

    def vector(c):
        v, far = np.zeros(len(terms)), 0.0
        for w, m in c.items():
            if w in at:
                v[at[w]] = (1 + math.log(m)) * idf[at[w]]
            else:
                far += ((1 + math.log(m)) * rare) ** 2
        return v / math.sqrt(v @ v + far) if v.any() else v

    vectors = {i: vector(c) for i, c in counts.items()}
    ids = sorted(known)
    examples = np.array([vectors[i] for i in ids])
    prior = min(0.99, max(0.001, np.mean([y for i, y in labels if not held(i)])))

    def vote(i, without=None):
        cosines = np.array([0.0 if j == without else c for j, c in zip(ids, examples @ vectors[i], strict=True)])
        near = np.argsort(-cosines, kind="stable")[:k]
        c = np.minimum(cosines[near], 1.0)
        weight = c / (1 - c + epsilon)
        s = (weight @ toxic[near] + prior) / (weight.sum() + 1)
        return math.log(s / (1 - s))

    x = np.array([vote(i, i) for i in ids])  # the curve's votes leave each example out
    weight = np.where(toxic == 1, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    slope, level = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(slope * x + level)))
        g = np.array([np.sum(weight * (toxic - q) * x) - 1e-3 * (slope - 1), np.sum(weight * (toxic - q)) - 1e-3 * level])
        h = weight * q * (1 - q)
        step = np.linalg.solve(np.array([[np.sum(h * x * x), np.sum(h * x)], [np.sum(h * x), np.sum(h)]]) + 1e-3 * np.eye(2), g)
        slope, level = slope + np.clip(step[0], -2, 2), level + np.clip(step[1], -2, 2)
    slope = max(0.1, slope)
    return {i: (held(i), 1 / (1 + math.exp(-(slope * vote(i) + level)))) for i in counts}


_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
_PARTS = {
    "assign": r"(?:(?i:password|passwd|secret|token|api_?key))" + _NAMED + r"([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "temporary": r"\bASIA[A-Z0-9]{12,}",
    "name": r"\b(?i:client_?id|access_?key_?id|user_?name|user|login)" + _NAMED + r"[A-Za-z0-9@._-]{3,}",
    "key": r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "endpoint": r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+",
}
_KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


def linked_secrets(text, scope):
    """(spans, groups) of secret_report, every part compared with every other."""
    parts = set()
    for family, pattern in _PARTS.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            size = len(m[1]) if family == "assign" else len(m[0])
            kind = {
                "assign": "assign" if size >= 12 else "weak_secret" if size >= 6 else None,
                "access": "access" if size >= 18 else "weak_id" if size >= 12 else None,
                "hex": "hex",
                "key": "weak_secret" if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]")) else None,
                "endpoint": "endpoint",
            }.get(family, "weak_id")
            if kind:
                parts.add((m.start(), _KINDS.index(kind), m.end()))
    role = ["secret", "id", "secret", "id", "secret", "endpoint"]
    needs = {"id": {"secret"}, "secret": {"id"}, "endpoint": {"id", "secret"}}
    name = lambda p: f"{_KINDS[p[1]]}:{p[0]}:{p[2]}"
    spans, groups = [], []
    for p in sorted(parts):
        with_ = sorted(o for o in parts if role[o[1]] != role[p[1]] and max(o[0] - p[2], p[0] - o[2]) <= scope)
        covered = any(o[1] < 3 and o[0] < p[2] and p[0] < o[2] for o in parts)
        if p[1] < 3 or (needs[role[p[1]]] <= {role[o[1]] for o in with_} and not covered):
            spans.append(name(p))
            if with_:
                groups.append(name(p) + ">" + ",".join(map(name, with_)))
    return ",".join(spans), ";".join(groups)


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """[(vec_id, code, error, label_error, codebooks_sha256)] of rows (vec_id, vector, label), all in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for c in cut:
            for p in range(parts):
                held[p, near(c[p], p)[1]].append(c[p])
        for (p, k), xs in held.items():
            books[p][k] = [sum(y) // len(xs) for y in zip(*xs)]
    coded = [[near(c[p], p) for p in range(parts)] for c in cut]
    by_label = Counter()
    for (_, _, label), c in zip(kept, coded):
        by_label[label] += sum(d for d, _ in c)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), by_label[label], digest) for (i, _, label), c in zip(kept, coded)]


def passages(rows, window=20):
    """[(doc_id, n_words, n_removed, kept_sha256)] of rows (doc_id, text); null ids last."""
    order = lambda i: (i is None, i or 0)
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - window + 1):
            key, at = tuple(w[s : s + window]), (order(i), s)
            first[key] = min(first.get(key, at), at)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {s + k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (order(i), s) for k in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def phrases(rows, least=30, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] of rows (text, lang)."""
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[p[i : i + m]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out

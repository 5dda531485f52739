"""Slow, plain restatements of the problems over lists of rows, to compare the operators with."""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime, timezone
from urllib.parse import parse_qsl, urlsplit

from tidewright.llm.look import bare, category_key, look, name_key

MISSING = float("inf")


def score_key(s):
    return (1, 0.0) if s is None or math.isnan(s) else (0, -s)


def capped(rows, limit):
    """rows: (batch, name, score, index); what lies beyond the first ``limit``."""
    groups = defaultdict(list)
    for b, name, s, i in rows:
        if (k := name_key(name)) is not None:
            groups[b, k].append((score_key(s), i))
    return sorted(i for g in groups.values() for _, i in sorted(g)[limit:])


def instant(text):
    if text is None:
        return None
    try:
        t = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()


def leaders(rows, n):
    """rows: (index, batch, id, category, score, published)."""
    seen, groups = set(), defaultdict(list)
    for i, b, key, cat, s, at in sorted(rows, key=lambda r: r[0]):
        if key is not None and (b, key) in seen:
            continue
        seen.add((b, key))
        t = instant(at)
        groups[b, category_key(cat)].append((score_key(s), (1, 0) if t is None else (0, -t), i))
    return sorted(i for g in groups.values() for *_, i in sorted(g)[:n])


def grams(s, k):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def joined(tokens, share):
    """Exact links (i, j) of token sets by prefix filtering."""
    df = Counter(t for g in tokens for t in g)
    index, out = defaultdict(list), []
    for x, g in enumerate(tokens):
        n, seen = len(g), set()
        if not n:
            continue
        for t in sorted(g, key=lambda t: (df[t], t))[: n - math.ceil(share * n - 1e-9) + 1]:
            for y in index[t]:
                if y not in seen:
                    seen.add(y)
                    both = len(g & tokens[y])
                    if both >= share * (n + len(tokens[y]) - both) - 1e-9:
                        out.append((y, x))
            index[t].append(x)
    return out


def groups_of(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(parent):
        out[find(x)].add(x)
    return list(out.values())


def similar_ids(rows, k=3, share=0.6):
    """rows: (id, title, summary, original); pairs of ids in one group."""
    ids = defaultdict(set)
    for key, *fields in rows:
        if key is not None:
            ids["".join(bare(f) for f in fields)].add(key)
    texts = [t for t in ids if len(t) >= k]
    links = [(sorted(ids[t])[0], x) for t in texts for x in ids[t]]
    links += [(min(ids[texts[a]]), min(ids[texts[b]])) for a, b in joined([grams(t, k) for t in texts], share)]
    return sorted((a, b) for g in groups_of(links) for a in g for b in g if a < b)


def same_looks(rows):
    """rows: (index, title, summary)."""
    out = []
    for j, field in enumerate(("title", "summary")):
        by = defaultdict(list)
        for r in rows:
            if r[1 + j] is not None and look(r[1 + j]).strip():
                by[look(r[1 + j])].append((r[0], r[1 + j]))
        out += [(field, min(a, b), max(a, b)) for g in by.values() for a, x in g for b, y in g if a < b and x != y]
    return sorted(out)


def page(address):
    """Host, path and the parameters that count, or None."""
    if not address or not address.strip():
        return None
    try:
        u = urlsplit(address.strip())
    except ValueError:
        return None
    host = u.netloc.lower()
    host = host[4:] if host.startswith("www.") else host
    if not host:
        return None
    path = u.path[:-1] if u.path.endswith("/") else u.path
    q = dict()
    for k, v in parse_qsl(u.query, keep_blank_values=True):
        if k in ("id", "aid", "cat"):
            q.setdefault(k, []).append(v)
    return host, path, tuple(sorted((k, tuple(sorted(v))) for k, v in q.items()))


def repeats(rows, share=0.6):
    """rows: (index, id, title, original address); (first, duplicate)."""
    accepted_id, accepted_page, by_digits, out = {}, {}, defaultdict(list), []
    for i, key, title, address in sorted(rows):
        hits = []
        p = page(address)
        if key is not None and key in accepted_id:
            hits.append(accepted_id[key])
        if p is not None and p in accepted_page:
            hits.append(accepted_page[p])
        b = bare(title)
        g = grams(b, 2)
        digits = tuple(sorted(re.findall("[0-9]+", look(title)))) if title else ()
        if g:
            for j, h in by_digits[digits]:
                both = len(g & h)
                if both >= share * (len(g) + len(h) - both) - 1e-9:
                    hits.append(j)
                    break
        if hits:
            out.append((min(hits), i))
        else:
            if key is not None:
                accepted_id.setdefault(key, i)
            if p is not None:
                accepted_page.setdefault(p, i)
            if g:
                by_digits[digits].append((i, g))
    return sorted(out)


def leaked(docs, items, run=30, share=0.5):
    """docs, items: (id, text); (doc, item)."""
    out = []
    texts = [(d, bare(t)) for d, t in docs]
    for item, t in items:
        b = bare(t)
        if len(b) < run:
            continue
        for d, doc in texts:
            found = bytearray(len(b))
            for i in range(len(b) - run + 1):
                if b[i : i + run] in doc:
                    found[i : i + run] = b"\1" * run
            if sum(found) >= share * len(b):
                out.append((d, item))
    return sorted(out)


def sharing(docs, length=200):
    """docs: (id, text); pairs with a common span of ``length``."""
    where, out = defaultdict(set), set()
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where[hash(t[i : i + length])].add(d)
    for s in {frozenset(s) for s in where.values() if len(s) > 1}:
        out |= {(a, b) for a in s for b in s if a < b}
    return sorted(out)


def is_form(s):
    return unicodedata.normalize("NFC", s) == s

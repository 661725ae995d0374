"""Plain single-process statements of the operators' results."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

_tokenizer = None


def ids_of(text, end):
    global _tokenizer
    if _tokenizer is None:
        _tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        _tokenizer.encode_special_tokens = True
    return [*_tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substrings(docs, window=35):
    """{doc_id: (n_words, n_removed, sha256)} for (doc_id, text) rows."""
    words = [words_of(t) for _, t in docs]
    seen = Counter()
    for w in words:
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def simhash_components(docs, radius=2):
    """(doc_id, fingerprint, component_id) for (doc_id, text) rows."""
    prints = [fingerprint(t) for _, t in docs]
    nodes = np.array(sorted(set(prints)), "<u8")
    root = {int(p): int(p) for p in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in nodes:
        for q in nodes[np.bitwise_count(nodes ^ p) <= radius]:
            root[find(int(q))] = find(int(p))
    least = defaultdict(list)
    for (doc_id, _), p in zip(docs, prints, strict=True):
        if doc_id is not None:
            least[find(p)].append(doc_id)
    return [(doc_id, f"{p:016x}", min(least[find(p)], default=None))
            for (doc_id, _), p in zip(docs, prints, strict=True)]


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache",
           ("general", "public", "license"): "gpl"}


def license_base(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words))
              if tuple(words[i:i + len(phrase)]) == phrase]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def exact(docs):
    """(doc_id, keep_id, group_size, sha256) for (doc_id, text) rows."""
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[text or ""].append(doc_id)
    return [(doc_id, max((d for d in groups[text or ""] if d is not None), default=None),
             len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest())
            for doc_id, text in docs]


def one_edit(a, b):
    """Whether two different words differ by one inserted, deleted or replaced character."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    return a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def spelling(rows, min_length=7, min_count=2, ratio=10):
    """(word, form, root, n, n_near, form_n); every word against words of about its length."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    by_half = defaultdict(set)  # one half of a word stays as it is
    for w in n:
        k = len(w) // 2
        for size in (k - 1, k):
            by_half["<", w[:size]].add(w)
            by_half[">", w[len(w) - size:]].add(w)
    forms, out = {}, []
    for w in n:
        k = len(w) // 2
        met = set().union(*(by_half["<", w[:s]] | by_half[">", w[len(w) - s:]]
                            for s in (k - 1, k)))
        near = [x for x in met if one_edit(w, x)]
        top = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = top if top is not None and n[top] >= ratio * n[w] else None
        out.append((w, len(near)))
    rows = []
    for w, n_near in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n[w], n_near, n.get(forms[w])))
    return rows


def secrets_base(text):
    """n_assign, n_access, n_hex and the hash of the strong findings."""
    text = text or ""
    found = []
    for rank, (kind, pattern, flags, good) in enumerate((
            ("assign", "(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
             "([A-Za-z0-9+/_.=-]+)", re.I | re.A, lambda m: len(m[2]) >= 12),
            ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
            ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 16))):
        found += [(m.start(), rank, kind, m.end())
                  for m in re.finditer(pattern, text, flags) if good(m)]
    kinds = [f[2] for f in found]
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
    return (kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
            hashlib.sha256(listed.encode()).hexdigest())


def ranked(rows, items, top=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    from math import floor, log

    def terms(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)

    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in docs:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda x: x[:3])
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(scored[:top])]
    return out

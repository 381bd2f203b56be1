"""Plain forms of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_removal(docs, window=100):
    """doc_id -> (bytes, removed, runs, sha-256 of the rest); docs: (doc_id, text) in order."""
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                covered[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out[i] = (len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


def window_removal(docs, window=35):
    words = {i: WORDS.findall(t or "") for i, t in docs}
    counts = Counter(tuple(w[s : s + window]) for w in words.values() for s in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        covered = bytearray(len(w))
        for s in range(len(w) - window + 1):
            if counts[tuple(w[s : s + window])] > 1:
                covered[s : s + window] = b"\1" * window
        kept = " ".join(x for x, c in zip(w, covered) if not c)
        out[i] = (len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest())
    return out


LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def near_components(docs, percent=85, size=5):
    """doc_id -> (shingles, smallest id reachable)."""
    sets = {}
    for i, t in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent, where = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sorted(sets.items()):
        shared = Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def _base(text):
    patterns = (
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    return sorted((m.start(), n, m.end(), k) for n, (k, p, ok) in enumerate(patterns) for m in p.finditer(text or "") if ok(m))


def base_secrets(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in _base(text)).encode()).hexdigest()


def linked_secrets(text, scope=200):
    """All spans (kind, start, end), those of linked weak parts too, by looking at every pair of parts."""
    base = _base(text)
    patterns = {
        "link_id": r"""(?i:access_?key_?id|client_?id|account_?id|key_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
        "link_secret": r"[A-Za-z0-9+/_-]{20,}",
        "link_endpoint": r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+""",
    }
    weak = [(m.start(), k, m.end()) for k, p in patterns.items() for m in re.finditer(p, text, re.A)]
    weak = [x for x in weak if x[1] != "link_secret" or re.search("[0-9]", text[x[0] : x[2]]) and re.search("[A-Za-z]", text[x[0] : x[2]])]
    weak = [x for x in weak if not any(a <= x[0] < b for a, _, b, _ in base)]
    ids = [a for a, _, _, k in base if k == "access"] + [x[0] for x in weak if x[1] == "link_id"]
    keys = [a for a, _, _, k in base if k != "access"] + [x[0] for x in weak if x[1] == "link_secret"]
    near = lambda a, others: any(abs(a - b) <= scope for b in others)
    needs = {"link_id": [keys], "link_secret": [ids], "link_endpoint": [ids, keys]}
    return {(k, a, b) for a, _, b, k in base} | {(k, a, b) for a, k, b in weak if all(near(a, o) for o in needs[k])}


def fingerprint(text, gram, window, hashes):
    """Places that winnowing chooses, given the hash of each gram."""
    window = min(window, len(hashes))
    chosen = []
    for s in range(len(hashes) - window + 1):
        run = hashes[s : s + window]
        at = s + max(i for i, h in enumerate(run) if h == min(run))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return chosen

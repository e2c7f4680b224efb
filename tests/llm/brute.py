"""Plain statements of what the operators compute, for small inputs."""

import hashlib


def repeated_strings(rows, length=100):
    """rows: (doc_id, text), ids unique; (n_bytes, n_removed, n_spans, kept_sha256) by id."""
    seen, out = set(), {}
    for ident, text in sorted(rows):
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[i:i + length] = [True] * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[ident] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def near_groups(rows, percent=75):
    """rows: (doc_id, text), ids unique; component by id."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def contained(docs, items, percent=75):
    sets, out = [(i, shingles(t)) for i, t in docs], set()
    for item, text in items:
        own = shingles(text)
        for i, s in sets:
            if own and 100 * len(own & s) >= percent * len(own):
                out.add((i, item, len(own), len(own & s)))
    return out


def base_secrets(text):
    """(n_assign, n_access, n_hex, base_sha256) with plain regular expressions on the text."""
    import re
    text = text or ""
    kinds = {
        "assign": [(m.start(), m.end()) for m in re.finditer(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
            if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32],
    }
    spans = sorted((a, k, b, kind) for k, (kind, found) in enumerate(kinds.items()) for a, b in found)
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    return tuple(len(v) for v in kinds.values()), hashlib.sha256(joined.encode()).hexdigest(), joined


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]

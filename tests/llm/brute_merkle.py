"""A plain Merkle manifest of rows (doc_id, text, lang, source, n_chars)."""

import hashlib
import zlib


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """(root, siblings of each leaf on the way up)."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(places):
            run = nodes[i - i % 3:i - i % 3 + 3]
            proofs[j].append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
            places[j] = i // 3
        nodes = [digest(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(b"" if r[3] is None else b"=" + r[3].encode(), []).append(r)
    built = []
    for key in sorted(trees):
        part = sorted(trees[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        built.append((part, *climb([leaf(*r) for r in part])))
    root, last = climb([b[1] for b in built])
    out = []
    for (part, subroot, proofs), top in zip(built, last):
        for r, low in zip(part, proofs):
            h = leaf(*r)
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                h = leaf(r[0], r[1].replace("\n", ""), *r[2:])
            for a, b in low + top:
                h = digest(a, h, b)
            out.append((r[0], leaf(*r), subroot, root, digest(*[a + b for a, b in low + top]), h, h == root))
    return out

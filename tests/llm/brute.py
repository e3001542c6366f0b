"""Plain Python versions of the operators, over whole inputs."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE.findall(text or "")


def shingles(text, n=2):
    found = words((text or "").translate(LOWER))
    return {tuple(found[k : k + n]) for k in range(max(len(found) - n + 1, 1))} if found else set()


def components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_duplicates(rows, percent=80, words=2):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) with distinct ids."""
    sets = {d: shingles(t, words) for d, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    links.append((a, b))
    label = components(ids, links)
    return sorted((d, len(sets[d]), label[d], label[d] == d) for d in ids)


def remove_repeats(rows, threshold):
    """(doc_id, n_bytes, n_removed, spans, kept) of (doc_id, text)."""
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - threshold + 1):
            s = b[i : i + threshold]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - threshold + 1):
            if first[b[i : i + threshold]] < d:
                gone[i : i + threshold] = b"\x01" * threshold
        spans, i = [], 0
        while i < len(b):
            if gone[i]:
                j = i
                while j < len(b) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)

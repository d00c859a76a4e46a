"""Plain single-machine versions of the operators, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, width=5):
    words = WORD.findall((text or "").translate(LOWERED))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_classes(docs, percent=85):
    """{doc_id: (n_shingles, smallest id reachable)} by comparing all pairs that share a shingle."""
    sets = {k: shingle_set(t) for k, t in docs}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k in sorted(sets):
        seen = {}
        for s in sets[k]:
            for other in holders.setdefault(s, []):
                seen[other] = seen.get(other, 0) + 1
            holders[s].append(k)
        for other, shared in seen.items():
            if 100 * shared >= percent * (len(sets[k]) + len(sets[other]) - shared):
                a, b = sorted((root(k), root(other)))
                parent[b] = a
    return {k: (len(s), root(k)) for k, s in sets.items()}


def site_lines(rows, ratio, min_pages):
    """[(n_lines, n_dropped, text)] of rows (host, text)."""
    blanks = " \t\n\x0b\x0c\r"
    pages, counts = {}, {}
    for host, text in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(blanks) for x in (text or "").split("\n")} - {""}:
            counts[host, line] = counts.get((host, line), 0) + 1
    out = []
    for host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [
            x for x in lines
            if not (n := counts.get((host, x.strip(blanks)), 0)) or n < min_pages or n <= ratio * pages[host]
        ]
        out.append((len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


def measures(text, window=8):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(window)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def earliest_deadline(counts, weights):
    """Slots of all blocks, found by going through every period block by block."""
    order, period = [], 0
    while any(counts[k] > period * weights[k] for k in counts):
        mix = {k: min(weights[k], n - period * weights[k]) for k, n in counts.items() if n > period * weights[k]}
        total, waiting = sum(mix.values()), []
        jobs = sorted((j * total // n, -(-(j + 1) * total // n), k, j) for k, n in mix.items() for j in range(n))
        for slot in range(total):
            waiting += [(due, k, j) for free, due, k, j in jobs if free == slot]
            best = min(waiting)
            waiting.remove(best)
            order.append((best[1], period * weights[best[1]] + best[2]))
        period += 1
    return order

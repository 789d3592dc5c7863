"""Small corpora with every odd case, and brute-force versions."""

import random
from collections import Counter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n, extra=200):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(extra)) for _ in range(n))


def corpus(seed=3):
    """(doc_id, text, lang, source, n_chars, n_words): copies, near copies, shared passages, nulls, long texts."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 120)
    texts = [None, "", "   \n\t ", "one", "one two", "Héllo wörld\r\nand more", passage]
    texts += [prose(rng, rng.randrange(5, 90)) for _ in range(40)]
    texts += [prose(rng, 30) + "\n" + passage + " " + prose(rng, 20) for _ in range(6)]
    for edits in (0, 0, 1, 2, 3, 4, 6, 8, 9, 10, 12, 14, 20):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = prose(rng, 1, 10**6)
        texts.append(" ".join(words))
    texts += ["loop the loop " * 400, prose(rng, 9000), "x" * 5000, "repeat me now\n" * 30]
    rows = [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), None, 7) for i, t in enumerate(texts)]
    rows.append(rows[50])  # a repeated row
    return rows


DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def shingle_set(text, k):
    w = words_of(ascii_lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def components(rows, k, percent):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def removed_words(rows, size):
    """(doc_id, place) of words under a window that starts earlier; rows sorted by id, then as they come."""
    seen, gone, order = set(), Counter(), sorted(range(len(rows)), key=lambda r: (rows[r][0], rows[r][1] or ""))
    for r in order:
        w = words_of(rows[r][1])
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                for k in range(i, i + size):
                    gone[r, k] = 1
            seen.add(key)
    return gone

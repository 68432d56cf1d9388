"""Small documents with every odd case, and plain restatements of the contracts to compare with."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, lines=12):
    syllables = ["the", "of", "and", "er", "on", "ti", "sh", "tion", "éa", "ñi", "ble", "wh", "A", "Re"]
    out = []
    for i in range(n):
        out.append("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))))
    return "".join(w + ("\n" if i % lines == lines - 1 else " ") for i, w in enumerate(out)).strip()


def odd_documents(seed=1):
    """Null and empty fields, ties, repeated rows, copies, near copies, shared passages, one long text."""
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(12)]
    passage = prose(rng, 60)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100, None, None, None), (101, "", "en", ""), (102, " \t\n ", "xx", "s0"), (103, "one", None, "s1"),
             (104, "Two words", "en", None), (None, base[0], "en", "s0"), (None, None, None, None)]
    rows += [(200 + i, base[3], "fr", "s0") for i in range(5)]  # copies
    near = base[4].split(" ")
    for i in range(6):  # near copies
        k = rng.randrange(len(near))
        rows.append((300 + i, " ".join(near[:k] + ["changed"] + near[k + 1:]), "en", "s1"))
    rows += [(400 + i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30), "de", "s2") for i in range(5)]
    rows += [(500, prose(rng, 9000), "en", "s1"), (501, "ab " * 400, "en", "s2"), (502, "x" * 3000, "en", "s2")]
    rows += [(600, base[7].upper(), "en", "s0"), (601, "### *** " * 60, "en", "s0")]
    rows += [(7, base[7], "en", "s1"), (7, base[7], "en", "s1")]  # repeated rows
    return rows


def grams(text, n):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(ids, links):
    par = {i: i for i in ids}

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        par[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def unigram(rows, is_train):
    count = collections.Counter()
    for i, t, *_ in rows:
        if is_train(i):
            count.update(words((t or "").translate(LOWER)))
            count[None] += 1
    return count


def by_id(df, *cols):
    """Rows as a dict by the first column; repeated ids give the list of their rows."""
    out = {}
    for r in df.select(*cols).collect():
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out

"""Plain, slow versions of what the operators compute, and awkward rows to run them on."""

import re
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

BASE = " ".join(f"word{i} of{i % 7}" for i in range(40))
NEAR = BASE.replace("word39", "other")
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def rows():
    """Nulls in every column, empty and blank texts, one very long text, copies, near copies and repeated rows."""
    long = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(30_000))
    made = [
        (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, NEAR, None, None, None), (4, None, "en", "b", 0), (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "b", 4), (7, long, "en", "c", len(long)), (8, "one two", "de", "c", 7), (9, "One TWO", "de", "c", 7),
        (None, "a text without an id but with quite enough words to be counted as one", "en", "a", 3),
        (11, f"Before it. Alpha, BETA gamma-delta epsilon zeta eta theta iota kappa! lambda mu {ITEM}", "en", "d", 9),
        (12, "Same line here now\nSame line here now\nÜber ß 漢字 😀 #tag 100% | x", "fr", "e", 60),
        (12, "Same line here now\nSame line here now\nÜber ß 漢字 😀 #tag 100% | x", "fr", "e", 60),
        (13, " ".join(["der"] * 200), "de", "e", 800), (14, "x" * 5000, None, "e", 5000), (15, "é́ zero\u0000byte end", "fr", "e", 9),
    ]
    return made


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def clashing(df):
    """Columns named like those that operators make."""
    for name in ("ledger", "ids", "decoded", "found", "judged", "licenses", "score", "_row", "_text", "_words", "KEPT", "row", "class", "slot"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("mine"))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def strict(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def measures(text):
    w, t = words(text), text or ""
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat))


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_groups(texts):
    """Smallest index reachable over links of similarity 0.75, for each text."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


def window_hits(text, items, width=10):
    """Hit word positions and the names of the items that hit, window by window."""
    w, hit, names = strict(text), set(), set()
    for name, item in items:
        v = strict(item)
        n = min(width, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(name)
    return hit, {str(n) for n in names if n is not None}

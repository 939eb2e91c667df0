import random
from functools import lru_cache

from plain import DOCS, clashing, frame

from quotemill.llm import licenses as L
from quotemill.llm import queries as Q
from quotemill.llm.common import prepare


def lcs(a, b):
    @lru_cache(None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_alignment_is_a_common_subsequence_and_near_the_longest():
    rnd, total, best = random.Random(4), 0, 0
    for _ in range(150):
        a = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(0, 25))]
        b = [x for x in a if rnd.random() < 0.85]
        b[rnd.randint(0, len(b)) : 0] = [rnd.choice("abcxyz") for _ in range(rnd.randint(0, 4))]
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        total, best = total + len(pairs), best + lcs(tuple(a), tuple(b))
    assert total > 0.9 * best


def test_rising_is_a_longest_increasing_subsequence():
    rnd = random.Random(1)
    for _ in range(100):
        x = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 12))]
        got = [x[i] for i in L.rising(x)]
        length = [1] * len(x)
        for i in range(len(x)):
            length[i] = 1 + max((length[j] for j in range(i) if x[j] < x[i]), default=0)
        assert got == sorted(set(got)) and len(got) == max(length, default=0)


def scan(text, coverage=L.COVERAGE):
    return L.Scanner(L.TEMPLATES, coverage).scan(text)[1]


def test_every_template_is_found_whole_edited_and_twice():
    rnd = random.Random(2)
    prose = " ".join(rnd.choice("the of and to in is this for with words that are here".split()) for _ in range(400))
    for name, text in L.TEMPLATES.items():
        inside = f"{prose}\n{text}\n{prose}"
        best = scan(inside)[0]
        assert best["coverage"] == 1.0 and (best["license"] == name or best["matched"] > len(L.words_of(text)[0]) * 0.7)
        whole = next(m for m in scan(inside) if m["license"] == name)
        assert inside[whole["char_from"] : whole["char_to"]].strip('."') in text
        assert sum(m["license"] == name for m in scan(f"{inside}\n{prose}\n{text}\n{text}")) >= 3
        words = text.split()
        if len(words) > 20:
            for _ in range(len(words) // 12):
                words[rnd.randrange(len(words))] = "changed"
            edited = next(m for m in scan(" ".join(words)) if m["license"] == name)
            assert 0.75 <= edited["coverage"] < 1
    assert scan(prose) == [] and scan("") == []


def test_frames(spark):
    text = "Some words.\nReleased under the MIT License."
    docs = clashing(frame(prepare(spark), [*[(100, text, "en", "s", 1)] * 2, (101, None, None, None, None), (102, "", "en", "s", 0)]))
    out, name = L.scan(docs)
    assert out.columns == [*docs.columns, name]
    got = {r.doc_id: r[name] for r in out.collect()}
    assert [m.license for m in got[100].matches] == ["mit-notice"] and text[got[100].matches[0].char_from :] == "Released under the MIT License."
    assert got[101].matches == got[102].matches == [] and got[101].n_words == 0
    assert L.scan(spark.createDataFrame([], DOCS))[0].count() == 0


def test_the_query_returns_every_match(spark, tmp_path):
    text = "Released under the MIT License.\nSome words between.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."
    frame(spark, [(100, text, "en", "s", 1), (101, "no licence", "en", "s", 1)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()}
    spans = {(m.license, text[m.char_from : m.char_to]) for m in got[100].matches}
    assert spans == {("mit-notice", "Released under the MIT License"), ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0")}
    assert len({(m.license, m.char_from) for m in got[100].matches}) == got[100].n_matches == 3
    assert got[101].matches == [] and got[101].n_matches == 0 and got[101].license is None

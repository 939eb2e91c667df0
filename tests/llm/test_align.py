import base64
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from plain import clashing, frame, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import align as A
from quotemill.llm.common import prepare

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> is plain text", "mark ▁ inside", " leading", "  two  ", "\n\n\ttabs\r\n", "日本語 text 😀", "é vs é", "a" * 3000, " " * 2500 + "x", "zero \0 byte", "½⅓ №5"]


@pytest.fixture(scope="module")
def models():
    return A.Aligner(BYTES, PIECES)


def plain(texts):
    """Figures of every text, from the libraries and all pairs of tokens inside every group."""
    byte, piece = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    out, links = [], []
    for text in texts:
        if not text:
            out.append((0, 0, 0, 0, "")), links.append([])
            continue
        a, b = byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
        spell = [piece.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, spell)]
        raw_a = [ranks[i] for i in a]
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            out.append((0, 0, 0, 0, "")), links.append([])
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, mine = 0, []
            for r in raw:
                mine.append((at, at + len(r)))
                at += len(r)
            spans.append(mine)
        ends, groups, found, i, j = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), [], [], 0, 0
        for e in ends:
            p, q = [], []
            while i < len(a) and spans[0][i][1] <= e:
                p.append(i)
                i += 1
            while j < len(b) and spans[1][j][1] <= e:
                q.append(j)
                j += 1
            groups.append(",".join(str(a[x]) for x in p) + "|" + ",".join(str(b[x]) for x in q))
            found += [(a[x], b[y]) for x in p for y in q if spans[0][x][0] < spans[1][y][1] and spans[1][y][0] < spans[0][x][1]]
        out.append((len(a), len(b), len(groups), len(found), ";".join(groups)))
        links.append(found)
    counts = Counter(pair for found in links for pair in set(found))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(*o, sum(counts[p] == top[p[0]] for p in found), sum(counts[p] for p in found)) for o, found in zip(out, links)]


def got(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def awkward(spark):
    data = rows() + [(100 + i, t, "en", "x", 1) for i, t in enumerate(ODD)]
    want = sorted(((r[0], *p) for r, p in zip(data, plain([r[1] for r in data]))), key=repr)
    return clashing(frame(prepare(spark), data)).withColumn("pairs", F.lit("mine")).withColumn("id", F.lit("mine")), want


def test_equals_all_pairs(awkward):
    assert got(A.align(awkward[0], BYTES, PIECES)) == awkward[1]


def test_shuffle_gives_the_same(awkward):
    assert got(A.align(awkward[0], BYTES, PIECES, broadcast_pairs=0)) == awkward[1]


def test_given_documents(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *p) for r, p in zip(data, plain([r.text for r in data]))), key=repr)
    assert got(A.align(docs, BYTES, PIECES)) == want


def test_byte_model_equals_its_library(models):
    random.seed(3)
    letters = [*range(32, 127), 9, 10, 13, 0, 0xA0, 0x85, 0x2028, 0x3000, 0x301, 0x1F600, 0x200D, 0x4E00, 0x661, 0xBD]
    assert models.a.ranked is not None
    for _ in range(2000):
        s = " " + "".join(chr(random.choice(letters)) for _ in range(random.randint(0, 40)))
        assert models.a.encode(s).tolist() == models.a.whole.encode(s, add_special_tokens=False).ids
    assert len(models.tokens(" " * 1_000_000)[0])  # a run of blanks of any length


def test_empty_table(spark):
    assert A.align(frame(prepare(spark), []), BYTES, PIECES).count() == 0

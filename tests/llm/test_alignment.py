"""Token alignment against one byte after the other."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SF
from xtalframe.llm import token_alignment as ta
from xtalframe.llm.common import ship, table
from xtalframe.llm.queries import queries
from xtalframe.llm.vocabulary import default_model

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(ta.byte_model())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_model())


def plain(libraries, rows):
    """(doc_id, text) -> (doc_id, *COLUMNS), whole texts through the libraries."""
    tok, sp = libraries
    letters = ta.byte_letters()
    out, links = [], []
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a, b, bytes_a, bytes_b = [], [], [], []
        of_a = [k for k, x in enumerate(bytes_a) for _ in x]
        of_b = [k for k, x in enumerate(bytes_b) for _ in x]
        pairs = list(dict.fromkeys(zip(of_a, of_b)))
        links.append(Counter((a[i], b[j]) for i, j in pairs))
        groups, x, y, ends_a, ends_b = [], [], [], 0, 0
        i = j = 0
        while i < len(a) or j < len(b):
            if ends_a <= ends_b:
                x.append(a[i]), (ends_a := ends_a + len(bytes_a[i])), (i := i + 1)
            else:
                y.append(b[j]), (ends_b := ends_b + len(bytes_b[j])), (j := j + 1)
            if ends_a == ends_b:
                groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                x, y = [], []
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append([doc_id, len(a), len(b), len(groups), len(pairs), digest])
    held = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (*row[:5], sum(n for p, n in c.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in c.items()), row[5])
        for row, c in zip(out, links)
    ]


def result(df):
    return sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect()), key=str)


def test_whole_query(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert result(queries()["op13_token_alignment"](spark, SF)) == sorted(plain(libraries, rows), key=str)


ODD = [
    (1, "plain words here"),
    (1, "plain words here"),
    (1, "other text"),
    (2, None),
    (3, ""),
    (4, "a marker ▁ in the text"),
    (5, "  leading, double  and trailing  "),
    (6, " \n \t lines\n\n  end \n"),
    (7, "naïve Straße 日本語 😀😀 don't we'll I'M"),
    (8, "<|endoftext|> </s> <0x41> <s>"),
    (9, "x" * 9_000),
    (10, "word " * 20_000),
    (None, "no id at all"),
    (11, " no break  space   　wide \x1c sep \x00 nul"),
    (12, " "),
]


@pytest.mark.parametrize("heavy, step", [(ta.HEAVY, ta.PIECE), (12, 7), (0, 1)])
def test_odd_texts(spark, libraries, heavy, step):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as pairs", "2 as TEXT2")
    assert result(ta.align(docs, heavy=heavy, step=step)) == sorted(plain(libraries, ODD), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align(docs).collect() == []


def test_pieces_do_equal_work_and_join():
    rng = np.random.default_rng(3)
    for _ in range(60):
        cuts = [np.unique(np.append(rng.integers(1, 200, rng.integers(0, 80)), 200)) for _ in range(2)]
        a, b = cuts
        i = ta.diagonals(a, b, 9)
        j = np.append(np.arange(0, len(a) + len(b), 9), len(a) + len(b)) - i
        assert set((np.diff(i) + np.diff(j))[:-1].tolist()) <= {9} and (i[-1], j[-1]) == (len(a), len(b))
        whole = [(np.searchsorted(a, x, "right"), np.searchsorted(b, x, "right")) for x in range(200)]
        for step in (1, 2, 9, 1000):
            found = ta.overlaps(a, b, step)
            assert list(zip(found.a, found.b)) == list(dict.fromkeys(whole))
            assert a[found.cut_a - 1].tolist() == sorted(set(a) & set(b)) == b[found.cut_b - 1].tolist()


def test_words_together_equal_whole_texts(libraries, monkeypatch):
    """Random texts through word tables that are full all the time: ids as by
    the libraries over whole texts, of any letters and spaces."""
    monkeypatch.setattr(ta, "CACHE", 40)
    tok, sp = libraries
    both = ta.Pair(ta.byte_model(), default_model())
    rng = np.random.default_rng(7)
    parts = ["a", "the", "Str", "ß", "é", "ÿ", "ƀ", "ɏ", "ɐ", "ж", "中", "😀", "'s", "'", "1", "²", "½", "ª", "_", "-", "§", "\u00ad", " ", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u0085", "\u2003", "\x1c", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(3000)]
    for k in range(0, len(texts), 100):
        some = texts[k : k + 100]
        a, b = both.encode(some)
        for t, x, y in zip(some, a, b):
            want_a, want_b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            whole = (" " + t).encode()
            if b"".join(both.bytes_a[i] for i in want_a) != whole or b"".join(both.bytes_b[i] for i in want_b) != whole:
                want_a = want_b = []
            assert (np.frombuffer(x, "<i4").tolist(), np.frombuffer(y, "<i4").tolist()) == (want_a, want_b), repr(t)
    assert len(both.words) <= 40 + 100 * 40


def test_merges_follow_the_ids(libraries):
    """What lets tokens be merged by rank: ids number the merges in order."""
    import json

    model = json.load(open(ta.byte_model()))["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    assert ids == sorted(ids) and len(set(ids)) == len(ids)

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces as p


def check(text, limit, overlap):
    got = p.pieces(text, limit, overlap)
    if not text:
        assert got == []
        return got
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for lo, hi in got:
        assert 0 < hi - lo <= limit
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d
        assert b - c <= overlap + overlap // 4
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.,é́\r。-", max_size=900))
def test_pieces_cover_and_fit(text):
    check(text, 101, 20)


def brute_cut(text, start, limit, overlap):
    s = p.strengths(text)
    window = range(start + max(limit // 2, overlap + overlap // 4 + 1), start + limit + 1)
    best = max((int(s[i]), i) for i in window)
    return start + limit if best[0] < 0 else best[1]


def test_cut_is_the_strongest_and_rightmost():
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice("abcdef  \n.,") for _ in range(700))
        for lo, hi in check(text, 101, 20)[:-1]:
            assert hi == brute_cut(text, lo, 101, 20)


def test_blocks_agree(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abc \n.") for _ in range(3000))
    whole = p.pieces(text, 101, 20)
    monkeypatch.setattr(p, "BLOCK", 128)
    assert p.pieces(text, 101, 20) == whole


def test_natural_boundaries_preferred():
    text = "word " * 150 + "end.\n\n" + "more " * 200
    first = p.pieces(text, 1281, 160)[0]
    assert text[first[1] - 2 : first[1]] == "\n\n"


def test_never_inside_crlf_or_before_combining():
    for cut in (x for _, x in p.pieces("a\r\n" * 300 + "é" * 400, 101, 20)[:-1]):
        text = "a\r\n" * 300 + "é" * 400
        assert text[cut] not in "\ń"


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 9), (2, "", "y", 9), (3, "short", "z", 9), (4, "x" * 3000, "w", 9)], "id int, body string, content string, token_count int")
    rows = p.split(df, "body", ["id"]).orderBy("id", "piece").collect()
    assert [r.id for r in rows] == [3, 4, 4, 4]
    assert rows[0].content == "short" and rows[0].token_count == 1
    assert all(r.token_count <= 320 for r in rows) and rows[1].char_end - rows[2].char_start == 160
    assert p.split(df.limit(0), "body", ["id", "content"]).count() == 0

import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import contamination, repetition, tokens, words

SF = "/root/testdata/sf0.001"


def plain_words(text):
    text = "".join(c for c in text or "" if unicodedata.category(c) != "Cf")
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


def grams(text):
    w = plain_words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


# encoding

FILE = tokens.FOLDER + "/byte_bpe_50k.tiktoken"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_any_text_encodes_as_a_whole(text):
    enc = tokens.encoder(FILE, 3)
    assert enc.ids(text) == (enc.encode(text) if text else [])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sre !?.\n\t　 漢字テ。éß0１9😀#<|endoftext|>", max_size=300))
def test_awkward_text_encodes_as_a_whole(text):
    enc = tokens.encoder(FILE, 3)
    assert enc.ids(text) == (enc.encode(text) if text else [])


def test_encoding_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 50_000)], "id long, text string")
    got = sorted((r.id, r.ids) for r in tokens.encoded(df).collect())
    enc = tokens.encoder(FILE)
    assert got == [(1, []), (2, []), (3, enc.encode("a b")), (3, enc.encode("a b")), (4, enc.encode("x" * 50_000))]
    assert tokens.encoded(df.limit(0)).count() == 0


def test_encoding_of_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id id", "text")
    enc = tokens.encoder(FILE)
    texts = {r.id: r.text for r in df.collect()}
    got = {r.id: r.ids for r in tokens.encoded(df).collect()}
    assert got == {i: enc.encode(t or "") for i, t in texts.items()}
    assert any(len(enc.fragments(t.encode())) > 2 for t in texts.values() if t)


# containment


def brute_contained(items, docs, least=8):
    out = {}
    for i, a in items:
        x = set(grams(a))
        for d, b in docs:
            n = len(x & set(grams(b)))
            if n >= least:
                out[i, d] = n
    return out


def test_contained_against_brute_force(spark):
    items = spark.read.parquet(f"{SF}/eval_items.parquet").selectExpr("item_id id", "text", "answer seq")
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id id", "text", "source pos")
    want = brute_contained([(r.id, r.text) for r in items.collect()], [(r.id, r.text) for r in docs.collect()])
    for kept in (2_000_000, 0):
        got = {(r.item_id, r.doc_id): r.joint for r in contamination.contained(items, docs, kept=kept).collect()}
        assert got == want and want


def test_contained_edge_cases(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    item = [(1, passage), (1, passage), (2, None), (3, ""), (4, "too few words"), (5, passage.upper() + " x y z")]
    doc = [(10, "Intro " + passage.replace("w3", "­w​3") + " end"), (11, None), (12, " ".join(f"w{i}" for i in range(11))), (13, passage + " q " + passage), (13, passage + " q " + passage)]
    items, docs = (spark.createDataFrame(x, "id long, text string") for x in (item, doc))
    got = {(r.item_id, r.doc_id): (r.joint, r.window_joint) for r in contamination.contained(items, docs).collect()}
    assert got == {(1, 10): (8, 8), (5, 10): (8, 8), (1, 13): (8, 8), (5, 13): (8, 8)}
    assert contamination.contained(items.limit(0), docs).count() == 0
    assert contamination.contained(items, docs.limit(0)).count() == 0


# repetition


def brute_share(text):
    g = grams(text)
    return None if not g else (len(g) - len(set(g))) / len(g)


def test_repetition_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id id", "text", "n_chars sequences")
    texts = {r.id: r.text for r in docs.collect()}
    got = {r.id: r.repeated_share for r in repetition.repetition(docs).collect()}
    assert got == {i: brute_share(t) for i, t in texts.items()}


def test_repetition_edge_cases(spark):
    loop = "all of this is said again. " * 20
    rows = [(1, None), (2, ""), (3, "four words are few"), (4, loop), (5, "\n".join(["Home | About | Contact", "A real sentence that stands here.", "Home | About | Contact"])), (None, loop), (6, " \n \n")]
    got = {r.id: r for r in repetition.repetition(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert all(got[i].repeated_share is None and not got[i].rejected for i in (1, 2, 3, 6))
    assert got[4].repeated_share > 0.9
    assert got[5].rejected and got[5].repeated_line_share == 1 / 3
    assert [r.id for r in repetition.repetitive(spark.createDataFrame(rows, "id long, text string")).collect()] == [4]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ßＡé́​_1-\nİ", max_size=80))
def test_words_fold_as_stated(text):
    assert words.WORD.findall(words.folded(text)) == plain_words(text)
    assert len(words.sequence_hashes(words.word_hashes(text))) == len(grams(text))
    assert len(set(words.sequence_hashes(words.word_hashes(text)).tolist())) == len(set(grams(text)))


def test_lines_hash_like_the_whole():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("ab é\n\ŕ ") for _ in range(60))
        assert repetition._measure(text)[0] == len(plain_words(text))


def test_lines_add_up_to_the_whole():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["all of it ", "one two three four five ", "six. ", "seven! ", "\n", " \n\n", "。", "eight | nine "]) for _ in range(rng.randrange(60)))
        m = dict(zip([x.split()[0] for x in repetition.SCHEMA.split(", ")][1:], repetition._measure(text)))
        g = grams(text)
        assert (m["sequences"], m["different_sequences"]) == (len(g), len(set(g)))
        assert m["kept_line_sequences"] + m["lost_line_sequences"] == len(g)
        assert m["kept_line_repeats"] + m["lost_line_repeats"] == len(g) - len(set(g))


def test_boilerplate_comes_from_the_corpus(spark):
    rows = [(i, f"Document {i} tells of matter {i * 7} here.\nAlle Rechte vorbehalten\nImpressum und mehr") for i in range(40)] + [(99, "Alle Rechte vorbehalten"), (100, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    common = repetition.common_lines(df)
    assert common == {repetition.line_hash("alle rechte vorbehalten"), repetition.line_hash("impressum und mehr")}
    got = {r.id: r for r in repetition.repetition(df).collect()}
    assert got[99].rejected and not got[100].rejected and got[0].boilerplate_share == 2 / 3
    assert repetition.common_lines(df.limit(0)) == frozenset()


def test_planted_repetition_is_removed(spark):
    rng = random.Random(12)
    words_ = [f"w{i}" for i in range(400)]
    said = lambda n: " ".join(rng.choice(words_) for _ in range(n)) + "."
    rows = []
    for i in range(60):
        again = said(12)
        own = [said(12) for _ in range(6)]
        rows.append((i, " ".join([*own, *[again] * 14]) if i % 3 == 0 else "\n".join([*own, *[again] * 14]) if i % 3 == 1 else "\n".join(own)))
    got = {r.id: r for r in repetition.repetition(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert all(got[i].rejected == (i % 3 != 2) == (got[i].repeated_share >= 0.3) for i in range(60))
    assert all(got[i].kept_repeated_share < 0.3 for i in range(60))


def test_filter_holds_every_sequence(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    own, other = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    bits = contamination.bloom(spark.createDataFrame([(int(x),) for x in own], "seq long").repartition(3))
    assert contamination._passes(bits, own).all() and contamination._passes(bits, other).mean() < 0.01


def test_windows_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, d, p, rng.randrange(12), 4 + i) for i in range(3) for d in range(5) for p in sorted(rng.sample(range(60), 20))]
    want = {}
    for i in range(3):
        for d in range(5):
            own = [(p, s) for a, b, p, s, _ in rows if (a, b) == (i, d)]
            want[i, d] = max(len({s for p, s in own if q - (4 + i) < p <= q}) for q, _ in own)
    df = spark.createDataFrame(rows, "item_id long, doc_id long, pos int, seq long, span int")
    assert {(r.item_id, r.doc_id): r.window_joint for r in contamination._windows(df).collect()} == want

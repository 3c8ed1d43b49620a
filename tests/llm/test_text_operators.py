"""Line deduplication, decontamination and encoding against brute force and the library."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm.decontaminate import decontaminate, phrase_matches, proximity_matches
from tidewright.llm.line_dedup import drop_repeated_lines
from tidewright.llm.queries import piece_model
from tidewright.llm.sentencepiece import Encoder, decode, encode_decode, load, merge_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, id long, pos int, row string, h1 long, tkey string, kept string, ids string, item string, n_hit int"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def frame(spark, rows):
    """Rows (doc_id, text) with further columns that carry the names of inner ones."""
    return spark.createDataFrame([(i, t, 7, 1, "r", 5, "k", "x", "y", "z", 3) for i, t in rows], CLASHING)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "x1", "delta,", "eps;", "zeta", "eta", "iota", "kappa"]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(60)]
    rows = [(k, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(200)]
    return rows + [(500, None), (501, ""), (502, "\n\n"), (503, "common line\nown 1"), (503, "common line\nown 1"), (503, "other text"), (None, "Common Line \nrest"),
                   (504, "long " * 50_000)] + [(600 + k, f" common LINE\x0b\n{k}\ncommon line") for k in range(8)]


def dropped_by_hand(rows, least):
    strip = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen.setdefault(strip(line), set()).add(i)
    bad = {k for k, v in seen.items() if k and len(v) >= least}
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if strip(x) not in bad]
        out.append((i, len(all_lines), len(all_lines) - len(keep), "\n".join(keep)))
    return out


def test_lines_like_brute_force(spark, texts):
    got = drop_repeated_lines(frame(spark, texts), min_docs=10)
    mine = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(mine, key=key) == sorted(dropped_by_hand(texts, 10), key=key)
    assert got.select("row.*").columns == frame(spark, []).columns


def test_lines_of_an_empty_table(spark):
    assert drop_repeated_lines(frame(spark, [])).count() == 0


def contaminated_by_hand(rows, items, window):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            n = min(window, len(iw))
            if item is None or not n:
                continue
            wins = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ITEMS = [(1, "alpha Beta gamma x1 delta"), (2, "alpha beta"), (10, "zeta zeta zeta zeta"), (3, ""), (4, None), (None, "alpha beta gamma"), (5, "ÉTÉ été x1 eta iota kappa zeta"),
         (5, "ÉTÉ été x1 eta iota kappa zeta"), (5, "kappa"), (6, "words that no text has")]


@pytest.mark.parametrize("window", [1, 3, 13])
def test_contamination_like_brute_force(spark, texts, window):
    items = spark.createDataFrame([(i, t, "row", 9) for i, t in ITEMS], "item_id long, text string, doc_id string, term int")
    rows = texts + [(700, "start " + "alpha beta gamma x1 delta " * 3), (701, "beta gamma x1 delta tail"), (702, "zeta " * 40)]
    got = decontaminate(frame(spark, rows), items, window=window, share=20)
    mine = [(r["row"]["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(mine, key=key) == sorted(contaminated_by_hand(rows, ITEMS, window), key=key)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in decontaminate(docs, none).collect()] == [(3, 0, 0, [], False)]
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_spans_and_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one x two three four five"), (3, "five one")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "two three four")], "item_id long, text string")
    spans = phrase_matches(docs, items, window=3)[1]
    assert sorted((r["id"], r["start"], r["stop"]) for r in spans.collect()) == [(1, 1, 3), (2, 2, 4)]
    far = spark.createDataFrame([(9, "one two")], "item_id long, text string")
    assert {r["id"] for r in proximity_matches(docs, far, window=2, slack=1).collect()} == {1, 2}
    assert {r["id"] for r in proximity_matches(docs, far, window=2, slack=0).collect()} == {1}


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def odd_texts():
    rng = random.Random(1)
    fixed = ["", None, " ", "  a  b ", "▁a ▁", "日本語😀\x00z", "a" * 5000, " " * 777, "ab" * 900 + " " * 40 + "x", "é é", "</s><0x0A>", "\n\n", "x" + "▁" * 9 + "y", "=-" * 700]
    letters = "abAB e▁\n \t=-_0１é日😀theing"
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(600)]


def test_encoding_like_the_library(spark, library):
    rows = list(enumerate(odd_texts()))
    got = encode_decode(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, body string"), piece_model()).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["row"]["text"] or "", add_eos=True)
        assert r["ids"] == want and r["decoded"] == library.decode(want)
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), piece_model()).count() == 0


def test_a_full_cache_starts_anew(library, monkeypatch):
    from tidewright.llm import sentencepiece as module

    monkeypatch.setattr(module, "CACHED_WORDS", 5)
    coder = Encoder(load(piece_model()))
    for part in (["some words here and there", "again some"], ["other words now"], ["some words here"]):
        flat, at = coder.encode(part)
        assert [flat[at[k] : at[k + 1]].tolist() for k in range(len(part))] == [library.encode(t, add_eos=True) for t in part]


def test_decoding_any_ids(library):
    import numpy as np

    rng, v = random.Random(2), load(piece_model())
    for _ in range(300):
        ids = rng.choices(range(3, 400), k=12)
        assert decode(v, np.array(ids), np.array([0, 12])) == [library.decode(ids)]


def test_simultaneous_merges_equal_single_ones(library):
    rng, v = random.Random(5), load(piece_model())
    texts = ["".join(rng.choice("ab-= ") for _ in range(rng.randint(1, 700))).replace(" ", "▁") for _ in range(80)]
    flat, at = merge_words(v, texts)
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == library.encode(t.replace("▁", " "))


def test_digests(spark, library):
    from tidewright.llm.queries import op4_sentencepiece

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op4_sentencepiece(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy(F.length("text").desc()).collect()[::9]:
        ids = library.encode(r["text"] or "", add_eos=True)
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids) and mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_long_items_and_many_short_ones(spark):
    """An item of 60,000 words and thousands of one-word items, in documents that hold parts of them."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    items = [(0, " ".join(long))] + [(k, f"z{k}") for k in range(1, 5001)]
    docs = [(1, " ".join(long[20_000:20_040])), (2, " ".join(["own", *long[:12], "words"])), (3, " ".join(f"z{k}" for k in range(1, 41)) + " and others " * 300), (4, " ".join(long[-13:]) + " tail"),
            (5, " ".join(long))]
    got = {r.doc_id: r for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("row.doc_id", "n_hit", "n_items").collect()}
    assert {k: (r.n_hit, r.n_items) for k, r in got.items()} == {1: (40, 1), 2: (0, 0), 3: (40, 40), 4: (13, 1), 5: (60_000, 1)}

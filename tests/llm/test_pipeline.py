"""Every stage against brute force on its own input, and the registered queries against their SQL."""
import os
import tempfile

import pytest
import twin
from test_near_duplicates import by_hand
from test_text_operators import contaminated_by_hand, dropped_by_hand, frame

import corpus_pipeline
from tidewright.llm import queries as q
from tidewright.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    """The small tables with odd documents among them."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = " ".join(f"unique{k}" for k in range(120))
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, ""), (10**6 + 3, None), (10**6 + 4, f"before {item.upper()} after"), (10**6 + 5, base), (10**6 + 6, base.replace("unique60", "other")),
           (10**6 + 7, base), (10**6 + 7, base), (10**6 + 8, "tab\there " * 40_000), (None, "a row without id")]
    odd += [(2 * 10**6 + k, f"Subscribe NOW \nown line {k} {k * 7} {k * 11} {k * 13} {k * 17}") for k in range(12)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    docs.unionByName(rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark", "embeddings", "pages"):
        os.symlink(f"{FOLDER}/{name}.parquet", f"{path}/{name}.parquet")
    return path


def key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")


def test_stages(spark, folder):
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], folder)
        path = f"{folder}/after-{name}"
        out.write.parquet(path)
        tables.append(spark.read.parquet(path))
    rows = [[(r["doc_id"], r["text"]) for r in t.collect()] for t in tables]
    assert all(t.columns == tables[0].columns for t in tables[:5])

    model = toxicity.train(tables[0], spark.read.parquet(f"{folder}/labels.parquet"), per_class=3000)
    marks = toxicity.linear_scores(model, [t for _, t in rows[0]]) >= model.thresholds[0]
    assert sorted(rows[1], key=key) == sorted((r for r, bad in zip(rows[0], marks) if not bad), key=key)

    lines = [(i, t if n == 0 and t is None else kept) for (i, t), (_, _, n, kept) in zip(rows[1], dropped_by_hand(rows[1], 10))]
    assert sorted(rows[2], key=key) == sorted(lines, key=key)
    assert all(r["n_chars"] == len(r["text"]) for r in tables[2].filter("doc_id between 2000000 and 3000000").collect())

    ordered = sorted(rows[2], key=lambda r: (r[0] is None, r[0] or 0))
    texts = [t for _, t in ordered]
    first = by_hand(texts)
    want = {ordered[n] for n, root in first.items() if ordered[root] == ordered[n]}
    assert {r for r in rows[3] if r[0] is not None} == {r for r in want if r[0] is not None} and len(rows[3]) == len(want)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [r for r, c in zip(rows[3], contaminated_by_hand(rows[3], items, 13)) if not c[-1]]
    assert sorted(rows[4], key=key) == sorted(clean, key=key) and len(clean) < len(rows[3])

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=q.piece_model())
    last = tables[5].collect()
    assert sorted(((r["doc_id"], r["text"]) for r in last), key=key) == sorted(rows[4], key=key)
    for r in last[::7]:
        ids = lib.encode(r["text"] or "", add_eos=True)
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_text"] == lib.decode(ids)


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    kept = spark.read.parquet(f"{folder}/after-sentencepiece")
    assert got.columns == kept.columns and sorted(map(key, got.select("doc_id", "text").collect())) == sorted(map(key, kept.select("doc_id", "text").collect()))


def test_empty_table_passes(spark):
    docs = frame(spark, []).drop("row").withColumnRenamed("kept", "n_chars_2")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    assert twin.compare(q.queries()[name](spark, FOLDER), twin.duck(FOLDER).execute(q.SQL[name])) == ""


@pytest.mark.parametrize("name, table", [("op1_toxicity", "documents"), ("op3_sharding", "documents"), ("op6_order_minhash", "documents"), ("op7_url_filter", "pages"), ("op8_warc", "pages"),
                                         ("op10_quality", "documents")])
def test_a_row_for_each_row(spark, folder, name, table):
    df = q.queries()[name](spark, folder)
    id_col = df.columns[0]
    ids = lambda d: sorted((r[0] is None, r[0] or 0) for r in d.select(id_col).collect())
    assert ids(df) == ids(spark.read.parquet(f"{folder}/{table}.parquet"))


def test_every_number_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 11))

"""Trained operators on held-out rows, search against brute force, placement, URLs and archives."""
import base64
import gzip
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import ann, quality, sharding, tokens, toxicity, url_filter, warc
from tidewright.llm.queries import SHARDS, URL_RULES

FOLDER = "/root/testdata/sf0.01"
ODD = [(10_000_001, None), (10_000_002, ""), (10_000_003, "\n \n"), (10_000_004, "word " * 60_000), (10_000_005, "twice"), (10_000_005, "twice"), (None, "no id")]


def read(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_odd(spark, docs):
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    return docs.unionByName(odd).withColumns({"row": F.lit("r"), "body": F.lit(1), "keep": F.lit(2), "toxic": F.lit(3)})


def test_word_hashes_match_words():
    texts = ["Ab ab AB, été x_y", None, "", "9 9a"]
    w = tokens.Words(texts)
    assert w.doc.tolist() == [0, 0, 0, 0, 0, 0, 3, 3] and w.offsets.tolist() == [0, 6, 6, 6, 8]
    h = w.hashes().tolist()
    assert h[0] == h[1] == h[2] and len(set(h)) == 6
    assert tokens.Words(["zz ab"]).hashes()[1] == h[0]


def test_toxicity_on_held_out_labels(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    seen = labels.filter("doc_id % 3 <> 0")
    got = toxicity.score(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), toxicity.train(docs, seen, per_class=3000)).select("row.toxic", "toxic", "expected_severity", "grade").collect()
    bad, good = [r for r in got if r[0] == 1], [r for r in got if r[0] == 0]
    assert sum(r[1] for r in bad) >= 0.8 * len(bad) and sum(r[1] for r in good) <= 0.01 * len(good)
    assert np.mean([r[2] for r in bad]) > 0.7 > 0.05 > np.mean([r[2] for r in good])


def test_toxicity_of_odd_rows(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    odd = with_odd(spark, docs)
    model = toxicity.train(odd, labels.withColumn("text", F.lit("clash")), per_class=200)
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and got.filter("row.doc_id > 10000000").select("p_toxic").distinct().count() == 1
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.score(odd, toxicity.train(odd, few, per_class=50)).filter("toxic").count() == 0
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_ordinal_fit_finds_ordered_grades():
    rng = np.random.default_rng(0)
    names = np.arange(3, dtype=np.uint32)
    sets = [np.flatnonzero(rng.random(3) < [0.5, 0.4, 0.3]).astype(np.uint32) for _ in range(3000)]
    z = np.array([2.0 * (0 in s) + 3.0 * (1 in s) + 0.0 * (2 in s) for s in sets]) + rng.logistic(size=3000)
    grades = (z[:, None] > [1.5, 4.0]).sum(1)
    m = toxicity.fit(grades, sets, names, toxic_share=float((grades > 0).mean()))
    assert np.all(np.diff(m.thresholds) > 0) and np.allclose(m.weights, [2, 3, 0], atol=0.4) and np.allclose(m.thresholds, [1.5, 4.0], atol=0.4)


def test_quality_on_held_out_labels(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"), per_class=400, named=40)
    got = quality.score(docs.join(labels.filter("doc_id % 3 = 0").withColumnRenamed("quality", "truth"), "doc_id"), model).select("row.truth", "keep").collect()
    assert np.mean([r["truth"] == r["keep"] for r in got]) >= 0.97


def test_quality_of_odd_rows(spark):
    docs, labels = with_odd(spark, read(spark, "documents")), read(spark, "labels")
    model = quality.train(docs, labels, per_class=100, named=20)
    got = quality.score(docs, model)
    assert got.count() == docs.count() and got.filter("quality is null or isnan(quality)").count() == 0
    none = quality.train(docs, labels.filter("quality = 1"), per_class=50, named=10)
    assert quality.score(docs, none).filter("quality <> 0.5 or not keep").count() == 0
    assert quality.score(docs.limit(0), model).count() == 0


def test_pseudo_labels_help_the_weaker_view():
    rng = np.random.default_rng(1)
    y = rng.random(2400) < 0.5
    a, b = (np.c_[y * s + rng.normal(size=2400), rng.normal(size=(2400, 6))] for s in (4.0, 2.0))
    few, pool, test = slice(0, 24), slice(24, 1200), slice(1200, 2400)

    def surest_of(free):
        def surest(views, good, bad):
            out = []
            for v, x in zip(views, (a[pool], b[pool])):
                z = np.where(free, v.logit(x), np.nan)
                order = np.argsort(z)[: int(free.sum())]
                at = np.r_[order[:bad], order[len(order) - good :]]
                at = at[np.abs(z[at]) > 1]
                out.append((a[pool][at], b[pool][at], z[at] > 0))
                free[at] = False
            return out
        return surest

    alone, together = (quality.co_train(a[few], b[few], y[few], surest_of(np.ones(1176, bool)), rounds=r, named=58) for r in (0, 6))
    right = lambda m: np.mean((m.metadata.logit(b[test]) > 0) == y[test])
    assert right(together) >= right(alone)


def test_surest_documents_of_the_whole_corpus(spark):
    """The distributed top-k of a round against sorting all scores; nothing is named twice."""
    docs = read(spark, "documents").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.col("text"))).repartition(7)
    rest = quality.feature_table(docs, "text", "doc_id", ["lang"], ["n_chars"]).withColumn("h", F.xxhash64("lid", "key")).cache()
    rows = rest.toPandas()
    xa, xb = np.stack(rows["f"].to_list()).astype(float), quality.metadata_features(rows["places"].tolist(), rows["sizes"].tolist(), 1)
    rng = np.random.default_rng(3)
    views = [quality.View(x.mean(0), np.maximum(x.std(0), 1e-3), rng.normal(size=x.shape[1] + 1)) for x in (xa, xb)]
    surest, gone = quality.named_by(rest, 1), set()
    for _ in range(2):
        found, now = surest(views, 5, 9), set()
        for v, x, (a, b, label) in zip(views, (xa, xb), found):
            z, h = v.logit(x), rows["h"].to_numpy()
            want = []
            for sign, k in ((1, 5), (-1, 9)):
                free = [i for i in np.lexsort((h, -sign * z)) if h[i] not in gone and sign * z[i] > 1][:k]
                want += free
            assert sorted(map(tuple, np.round(a, 5))) == sorted(map(tuple, np.round(xa[want], 5))) and np.allclose(np.sort(b.sum(1)), np.sort(xb[want].sum(1)))
            assert label.sum() == sum(z[i] > 0 for i in want)
            now |= {h[i] for i in want}
        gone |= now


def search_by_hand(rows, query_ids, k):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and i is not None and None not in v and np.all(np.isfinite(v)) and np.any(np.array(v) != 0)]
    out = {}
    for q, x in usable:
        if q in query_ids:
            s = sorted((-round(float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)), 12), i) for i, v in usable if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_nearest_of_few_rows_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [1.0, None] + [0.5] * 6), (2004, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, [0]) for i, v in rows], "vec_id long, embedding array<float>, part int, ids array<int>")
    ids = [0, 5, 1000, 1019, 2000, 2002, 2003]
    got = ann.nearest(df, spark.createDataFrame([(i,) for i in ids], "id long"), k=5).collect()
    mine = {q: [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert mine == search_by_hand(rows, set(ids), 5)
    assert ann.nearest(df.limit(0), spark.createDataFrame([(1,)], "id long")).count() == 0
    assert ann.nearest(df, spark.createDataFrame([], "id long")).count() == 0


def test_recall_over_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK", 50)
    df = read(spark, "embeddings")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    ids = {i for i, _ in rows if i % 10 == 0}
    got = ann.nearest(df, df.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("id")), k=5).collect()
    truth = search_by_hand(rows, ids, 5)
    assert len(got) == 5 * len(ids) and sum(r["id"] in truth[r["query_id"]] for r in got) >= 0.9 * 5 * len(ids)


def test_lookup_table_turns():
    names = ["c", "a", "b", "a"]
    table = sharding.lookup_table(names, 101)
    order = {}
    for n in "abc":
        start, stride = sharding._number(f"start {n}") % 101, sharding._number(f"stride {n}") % 100 + 1
        order[n] = [(start + j * stride) % 101 for j in range(101)]
    want = {}
    while len(want) < 101:
        for n in "abc":
            free = next((s for s in order[n] if s not in want), None)
            if free is not None:
                want[free] = n
    assert ["abc"[i] for i in table] == [want[s] for s in range(101)]
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_placement_is_even_and_stable(spark, tmp_path):
    df = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("slot"))
    got = {r["row"]["doc_id"]: r["shard"] for r in sharding.place(df, "doc_id", SHARDS[:10]).collect()}
    sizes = [list(got.values()).count(s) for s in SHARDS[:10]]
    assert len(got) == 20_000 and max(sizes) < 1.2 * min(sizes)
    fewer = {r["row"]["doc_id"]: r["shard"] for r in sharding.place(df, "doc_id", SHARDS[:9]).collect()}
    assert sum(got[i] != fewer[i] for i in got if got[i] != SHARDS[9]) < 0.05 * len(got)
    assert sharding.place(df.limit(0), "doc_id", SHARDS).count() == 0
    sharding.write_shards(sharding.place(df.select("doc_id"), "doc_id", SHARDS[:3]), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20_000


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?x#y", "http://example.com/en/", "http://sub.example.com/en/b", "http://example.com", "http://xexample.com/en/",
        "a://b.net/es/x", "a://net/fr/", "a://b.net/ES/", "a://c.net?q=/es/", "a://d.org/p://e.com/", "http://é.org/en/\nz", "http://www.example.com/en", "x://" + "l" * 100_000 + ".com/" + "p" * 100_000]


def rule_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fit = [(len(r), r, v) for r, v in URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, path string").unionByName(
        read(spark, "pages").select("page_id", "url", F.lit("h").alias("host"), F.lit("p").alias("path")))
    judged = url_filter.judged_by_rules(pages, URL_RULES)
    model = url_filter.train(url_filter.rule_labels(judged), 500)
    seen = {}
    for r in url_filter.filter_urls(judged, model).collect():
        host, path, rule, says = rule_by_hand(r["row"]["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (says or ("block" if r["p_block"] >= 0.5 else "allow"))
        assert seen.setdefault(r["row"]["url"], r["verdict"]) == r["verdict"]
    none = url_filter.train(url_filter.rule_labels(judged).limit(0))
    assert url_filter.filter_urls(judged, none).filter("rule is null and verdict = 'block'").count() == 0
    assert url_filter.filter_urls(judged.limit(0), model).count() == 0


def test_url_classifier_on_held_out_rows():
    rng = random.Random(3)
    hosts = [f"{rng.choice(['ads', 'track', 'news', 'docs'])}{rng.randrange(900)}.site{rng.randrange(50)}.org" for _ in range(1200)]
    y = np.array([int(h.startswith(("ads", "track"))) for h in hosts])
    paths = [f"/p{rng.randrange(1000)}" for _ in hosts]
    m = url_filter.fit(hosts[:800], paths[:800], y[:800])
    assert np.mean((url_filter.predict(m, hosts[800:], paths[800:]) >= 0.5) == y[800:]) > 0.97


PAGES = [(1, "http://a/ b", "same"), (2, "http://b/\r\né", "same"), (7, None, "same"), (3, "u", ""), (4, "u", None), (5, "u", "own é " + "x" * 200_000), (6, "u", "a\r\n\r\nb WARC/1.1"), (None, "u", "same"),
         (None, "u", "alone"), (8, "u", "two"), (8, "u", "two")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    for least, size in ((0, 10**9), (0, 1000), (5, 1000)):
        whole = warc.write_archives(pages, least_bytes=least, archive_bytes=size)
        index = warc.normalise(whole)
        got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(index).collect()), key=str)
        want = []
        for i, _, h in PAGES:
            body = (h or "").encode()
            top = max([j for j, _, g in PAGES if (g or "") == (h or "") and j is not None], default=None)
            of = top if top is not None and top != i and len(body) >= least else None
            want.append((i or -1, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if of is None else "revisit", of))
        assert got == sorted(want, key=str)
        assert sum(r["records"] for r in whole.collect()) == len(PAGES)
        for name in {r["archive"] for r in index.collect()}:
            path = warc._local(name)
            raw = open(path, "rb").read()
            side = [json.loads(line) for line in open(path.removesuffix(".warc.gz") + ".idx")]
            assert sum(e["length"] for e in side) == len(raw)
            assert all(gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n") for e in side)
    assert warc.read_records(warc.normalise(warc.write_archives(pages.limit(0)))).count() == 0


def test_records_split_at_any_piece():
    raw = [warc.record(k, f"u{k}", b"p" * k, "d") for k in range(40)]
    for step in (1, 7, 1000):
        whole = gzip.compress(b"".join(raw[:20])) + gzip.compress(b"".join(raw[20:]))
        assert list(warc.split_records(warc.inflated(whole[s : s + step] for s in range(0, len(whole), step)))) == raw
    with pytest.raises(ValueError):
        list(warc.split_records([b"".join(raw)[:-3]]))

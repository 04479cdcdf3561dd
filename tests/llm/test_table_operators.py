import itertools
"""SimHash, URL templates, WARC, toxicity and the pipeline against plain Python."""

import hashlib
import base64
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tastemark.llm import bpe, decontam, language, pii, queries, simhash, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# simhash -------------------------------------------------------------------------------------------------------------


def brute_print(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(prints, bits=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in ps}


def brute_components(ids, prints):
    roots = brute_roots(set(prints))
    low = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            low[roots[p]] = min(low.get(roots[p], i), i)
    return [low.get(roots[p]) for p in prints]


def test_simhash_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [brute_print(r["text"], 3) for r in rows]
    want = {r["doc_id"]: (f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r["doc_id"] for r in rows], prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_blocks(spark, sf).collect()} == want


@pytest.mark.parametrize("max_bucket", [1, 4, 1000])
def test_links_in_large_buckets_lose_nothing(spark, max_bucket):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(40)}
    hub = rng.getrandbits(64)
    prints |= {hub ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(150)} | {0, 1, 3, 7, 2**63}
    p = 5
    for _ in range(12):  # a chain
        p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints.add(p)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, max_bucket)
    assert all((r["a"] ^ r["b"]).bit_count() <= 2 or bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 2 for r in edges.collect())
    found = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.components(edges).collect()}
    want = brute_roots(prints)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({p: found.get(p, p) for p in prints}) == groups(want)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_simhash_edges(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (None, "one"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "lonely words only here"), (7, "x y " * 100_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in texts], DOCS + ", fp string")
    prints = [brute_print(t, 3) for _, t in texts]
    want = sorted((i or -1, f"{p:016x}", c or -1) for (i, _), p, c in zip(texts, prints, brute_components([i for i, _ in texts], prints), strict=True))
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"] or -1) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 6, 7] and simhash.keep_one(df.limit(0)).count() == 0


# urls ----------------------------------------------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.where), default=None)


def test_url_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op6_path_templates(spark, sf).collect()}
    assert got.keys() == {r["page_id"] for r in rows}
    sums = {}
    for r in rows:
        g, (host, path) = got[r["page_id"]], brute_url(r["url"])
        rule = brute_rule(host, path)
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule and rule.where)
        s = sums.setdefault((host, g["template"]), [0, 0])
        s[0] += rule is not None
        s[1] += rule is not None and rule.verdict == "block"
    for r in rows:
        g = got[r["page_id"]]
        n, k = sums[g["host"], g["template"]]
        assert g["purity"] == pytest.approx((k + 0.8) / (n + 4))
        rule = brute_rule(g["host"], g["path"])
        assert g["verdict"] == (rule.verdict if rule else "block" if g["purity"] >= 0.5 else "allow")


def test_url_parts_and_templates(spark):
    given = [None, "", "no scheme/x", "http://", "HTTP://A.Example.COM/En/1?q#f", "x://y://z/a?b", "http://h?x=/y", "http://com/", "http://xcom/", "http://net/es/1", "http://net/es", "http://É.NET/fr/ü/\n?x", "http://a.net/fr/1"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(given)] + [(None, "http://q.org/a/1", 1)] * 2, "page_id long, url string, host int")
    got = urls.judge(df).collect()
    assert len(got) == len(given) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path = brute_url(given[r["page_id"]])
            rule = brute_rule(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.where)
    assert urls.judge(df.limit(0)).count() == 0
    pages = [(i, f"http://s.net/{a}/{b}/{i}.html", 0) for i, (a, b) in enumerate([("es", "x"), ("fr", "x"), ("en", "x"), ("en", "x"), ("rare", "y")] * 4 + [("once", "z")])]
    tree = {r["path"].split("/")[1]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, n int")).collect()}
    assert tree["es"]["template"] == tree["fr"]["template"] == "/~/x/*" and tree["en"]["template"] == "/en/x/*" and tree["once"]["template"].startswith("/*/")
    assert tree["en"]["verdict"] == "allow" and tree["es"]["verdict"] == "block"


# warc ----------------------------------------------------------------------------------------------------------------


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute_warc(rows, least=0):
    first = {}
    for i, html in rows:
        p = (html or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, html in rows:
        p = (html or "").encode()
        ref = first.get(p)
        again = ref is not None and ref != i and len(p) >= least
        out.append((i, len(p), b32(p), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=repr)


def test_warc_query(spark, sf):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op9_warc_zstd(spark, sf).collect()
    assert all(r["valid"] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_warc(rows)


def test_warc_edges_and_files(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 30), (None, "é" * 30), (4, "é" * 30), (3, "é" * 30), (None, "only"), (None, "only"), (9, "x" * 300_000)]
    df = spark.createDataFrame([(i, f"http://x/{i}\r\ny" if i else None, h, "c") for i, h in rows], "page_id long, url string, html string, id string")
    for least in (0, 10):
        archives = warc.cut(warc.write(df, least_bytes=least))
        got = warc.read(archives).collect()
        assert all(r["valid"] for r in got)
        assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute_warc(rows, least)
        assert all(b32(r["payload"]) == r["payload_digest"] for r in got if r["record_type"] == "response")
    for r in archives.collect():
        (tmp_path / r["archive"]).write_bytes(r["content"])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read(files, name_col="path").filter("valid").count() == len(rows)
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_warc_reader_validates():
    dictionary = b"some raw dictionary " * 20
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    good = [warc.record(i, f"http://x/{i}", b"body" * i, None, "1970-01-01T00:00:00Z") for i in range(4)]
    short = good[1].replace(b"Content-Length: ", b"Content-Length: 1", 1)
    broken = good[2].replace(b"bodybody", b"bodyBODY")
    data = warc.dictionary_frame(dictionary) + b"".join(press.compress(x) for x in (good[0], short, broken, b"junk", good[3]))
    rows = list(warc.read_archive("a", data))
    assert [r["valid"] for r in rows] == [True, False, False, False, True] and "digest" in rows[2]["error"]
    assert rows[-1]["payload"] == b"body" * 3
    cut = list(warc.read_archive("a", data[:-5]))
    assert not cut[-1]["valid"] and len(cut) == 5
    raw = warc.struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + press.compress(good[3])
    assert [r["valid"] for r in warc.read_archive("raw", raw)] == [True]
    assert [r["valid"] for r in warc.read_archive("none", zstandard.compress(good[0]) + zstandard.compress(good[1]))] == [True, True]


# toxicity ------------------------------------------------------------------------------------------------------------


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        v = {int(t): float(rng.random()) + 0.01 for t in rng.choice(12, rng.integers(1, 5), replace=False)}
        n = sum(x * x for x in v.values()) ** 0.5
        rows.append({t: x / n for t, x in v.items()})
    rows += rows[:40]  # ties
    index = toxicity.Index(rows, [0] * len(rows), block=16)
    dense = np.array([[v.get(t, 0.0) for t in range(12)] for v in rows])
    for q in range(0, 440, 7):
        sims = np.round(dense @ dense[q], 12)
        want = [i for i in np.lexsort((np.arange(len(rows)), -sims)) if sims[i] > 0 and i != q][:9]
        ids, got = index.nearest(rows[q], 9, without=q)
        assert np.allclose(got, sims[want]) and ids.tolist() == want


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op10_toxicity_neighbours(spark, sf).collect()
    assert len(got) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught = sum(p for y, p in held if y == 1) / sum(y == 1 for y, _ in held)
    wrong = sum(p for y, p in held if y == 0) / sum(y == 0 for y, _ in held)
    assert caught > 0.9 and wrong < 0.01


def test_toxicity_edges(spark):
    rows = [(i, f"w{i} {'stupid' if i % 2 else 'calm'} v{i * 7} {'fool' if i % 2 else 'sea'} x{i}", i % 2) for i in range(120)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, label int")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a stupid one"), (3, "a stupid one"), (4, "calm sea"), (5, "stupid " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    every = docs.select("doc_id", "text").unionByName(learned.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    learned = learned.select((F.col("doc_id") + 100).alias("doc_id"), "label")
    model = toxicity.train(every, learned, least_evidence=10.0)
    got = [(r["doc_id"], r["r"]["score"]) for r in docs.select("doc_id", toxicity.score(model, "text").alias("r")).collect()]
    of = dict(got)
    assert len(got) == 6 and of[3] > 0.7 and of[5] > 0.7 and of[4] < 0.5 and of[1] == of[2] and 0 <= of[1] <= 1
    none = toxicity.train(docs.limit(0), learned.limit(0))
    assert 0 <= none.score("stupid")["score"] <= 1
    assert 0 <= toxicity.train(every, learned.filter("label = 0")).score("stupid")["score"] <= 0.5


# pipeline ------------------------------------------------------------------------------------------------------------


def kept_of_copies(texts: dict[int, str]) -> list[int]:
    """The smallest id of every group linked at Jaccard 0.8 of five-word shingles, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
            root[max(top(a), top(b))] = min(top(a), top(b))
    return [i for i in texts if top(i) == i]


def test_pipeline_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language.train(docs)
    left = {}
    for i, r in rows.items():
        got = language._predict(model, [r["text"]]).to_pylist()[0]
        if got["lang"] != "und" and got["certainty"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            left[i] = r["text"]
    left = {i: left[i] for i in kept_of_copies(left)}
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[j : j + 10]) for w in items for j in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(g) for g in grams}
    clean = lambda w: not any(tuple(w[p : p + n]) in grams for n in sizes for p in range(len(w) - n + 1))
    left = {i: pii.mask(t) for i, t in left.items() if clean(decontam.words_of(t))}
    codec = bpe.Codec(queries.VOCABULARY, queries.PATTERN)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == left.keys() and len(got) == len(left)
    for r in got:
        ids = codec.encode([left[r["doc_id"]]])[0]
        assert r["text"] == r["decoded"] == left[r["doc_id"]] and bytes(r["token_ids"]) == ids.tobytes() and r["n_tokens"] == len(ids)
        assert (r["lang"], r["source"]) == (rows[r["doc_id"]]["lang"], rows[r["doc_id"]]["source"])


def test_pipeline_stages_on_awkward_rows(spark, sf):
    texts = [(1, None), (2, ""), (3, "..."), (None, "the and of that with this"), (4, "the and of that with this"), (4, "the and of that with this"), (5, "was it the a@b.cd in of and " * 3000)]
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", None, None, "kept") for i, t in texts], DOCS + ", token_ids string")
    for frame in (df, df.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = stage(spark, frame, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert frame.columns == df.columns
        out = frame.collect()
        assert sorted(r["doc_id"] for r in out) == ([] if not out else sorted({4, 5}))

"""Filter audit, prefix BPE and centroid clustering against plain loops, the plain library and SQL, odd rows included."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import byte_bpe, centroids, filter_audit, queries

SF = "/root/testdata/sf0.001"
BPE = lambda: queries.vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    path, pattern = BPE()
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=byte_bpe.encoder_of(path, pattern).ranks.ranks, special_tokens={})


@pytest.mark.parametrize("name", ["op11_filter_cube", "op13_hamerly"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    rows = lambda frame: sorted(map(tuple, frame[columns].astype(object).to_numpy().tolist()), key=repr)
    assert columns == sorted(want.columns) and rows(found) == rows(want)


def plain_audit(docs, labels):
    """All orders played through, document by document."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = defaultdict(Counter)
    for i, text, lang in docs:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {f for f, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text), i is not None and i > least[text])) if bad}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[lang or "", "".join(order), step]
                c["redundant"] += gone and f in fails
                if not gone and f in fails:
                    gone = True
                    c.update(removed=1, good_lost=i in good, toxic_lost=i in toxic)
                c["kept"] += not gone
                c["unique_fails"] += fails == {f}
    sums = Counter()
    for (part, order, step), c in out.items():
        sums[part, order[step - 1]] += c["removed"]
    return sorted((p, o, s, *(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), sums[p, o[s - 1]]) for (p, o, s), c in out.items())


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(150))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (None, long, "en"), (4, None, "fr"), (5, "", "fr"), (6, "", ""), (7, long + " #", "en"), (8, "A" * 40, "en"), (9, "same " * 200, "fr"), (10, "É日 " * 300_000, "fr"), (None, None, None), (11, long.upper(), "en"), (1, long, "en")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (8, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1), (7, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for c in ("A", "E", "n", "part", "mask", "quality", "kept", "__tid"):
        frame = frame.withColumn(c, F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)).withColumn("part", F.lit("y"))
    rows = filter_audit.audit(frame, marks).collect()
    assert sorted(tuple(r) for r in rows if r["part"] is not None) == plain_audit(docs, labels)
    everywhere = [r for r in rows if r["part"] is None]
    assert len(everywhere) == 600 and all(r["kept"] == sum(o["kept"] for o in rows if o["part"] is not None and (o["filter_order"], o["step"]) == (r["filter_order"], r["step"])) for r in everywhere[:20])
    assert filter_audit.audit(frame.where("false"), marks).where("part is not null").count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(frame, marks, {c: F.lit(True) for c in "ABCDFG"})


def test_encoding_is_that_of_the_library(spark, plain):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    for r in queries.op12_prefix_bpe(spark, SF).collect():
        ids, raw = plain.encode_ordinary(texts[r["doc_id"]]), texts[r["doc_id"]].encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())


def test_every_character_splits_as_in_the_library(plain):
    encoder = byte_bpe.encoder_of(*BPE())
    for c in [*range(0xD800), *range(0xE000, 0x3400 + 0xE000), *range(0x1F000, 0x1FB00)]:
        s = f"x{chr(c)}y {chr(c)}{chr(c)} 1{chr(c)}2 '{chr(c)} {chr(c)}z  {chr(c)}\n"
        assert encoder.lists([s.encode()])[0] == plain.encode_ordinary(s), hex(c)


def test_neighbours_fit_by_the_definition():
    ranks = byte_bpe.encoder_of(*BPE()).ranks
    rng = random.Random(2)
    assert ranks.proper
    for _ in range(20_000):
        a, b = rng.choices(range(len(ranks.strings)), k=2)
        assert ranks.fits(a, b) == (ranks.merged(ranks.strings[a] + ranks.strings[b]) == [ranks.strings[a], ranks.strings[b]])


def test_vocabulary_whose_tokens_have_no_merge_tree():
    """abc is never reached (bc merges first), and a token of higher rank stands inside one of lower rank."""
    ranks = byte_bpe.Ranks({b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 5, b"cab": 4, b"ca": 6, b"ab": 7})
    for n in range(1, 8):
        for s in map(bytes, itertools.product(b"abc", repeat=n)):
            assert [ranks.strings[t] for t in ranks.tokens(ranks.extend(s, []))] == ranks.merged(s), s


def test_edits_are_exact(plain):
    encoder, rng = byte_bpe.encoder_of(*BPE()), random.Random(3)
    parts = ["a", "b", "'", "s", "ll", "re", " ", "  ", "\n", "é", "日", "1", "23", "!", "the", " the", "ing", "🙂", "́"]
    for _ in range(1_500):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 30)))
        own = encoder.prefixes(text)
        assert own.ids == plain.encode_ordinary(text)
        for _ in range(3):
            at = rng.randrange(0, len(text) + 1)
            gone, more = rng.randrange(0, min(4, len(text) - at) + 1), "".join(rng.choices(parts, k=rng.randrange(0, 4)))
            text, own = text[:at] + more + text[at + gone :], own.edit(at, gone, more)
            assert own.text == text and own.ids == plain.encode_ordinary(text) and own.last == encoder.prefixes(text).last


def test_edits_of_a_long_match_touch_few_bytes(monkeypatch):
    encoder, rng = byte_bpe.encoder_of(*BPE()), random.Random(5)
    text = "".join(rng.choices("abcde", k=200_000))
    own = encoder.prefixes(text)
    asked = []
    real = byte_bpe.Ranks.extend
    monkeypatch.setattr(byte_bpe.Ranks, "extend", lambda self, data, last, until=None: (lambda n: (real(self, data, last, until), asked.append(len(last) - n))[0])(len(last)))
    changed = own.edit(100_000, 3, "hello")
    assert sum(asked) < 500 and changed.last == encoder.prefixes(changed.text).last


def test_encoding_of_odd_rows(spark, plain):
    long = "the quick brown fox " * 150_000 + "x" * 300_000
    rows = [(1, "some text, it's fine"), (1, "some text, it's fine"), (2, None), (3, ""), (None, " \n\t  "), (4, long), (5, "<|endoftext|>é\x1c\x85")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("ids", "n_tokens", "last", "ids_sha256"):
        docs = docs.withColumn(c, F.lit("x"))
    out = byte_bpe.encode_digests(docs, BPE).collect()
    want = sorted((str(i), len(plain.encode_ordinary(t or "")) if t != long else None, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"] if r["text"] != long else None, r["decoded_sha256"]) for r in out) == want
    assert byte_bpe.encode_digests(docs.where("false"), BPE).count() == 0
    assert sorted(r["ids"] for r in byte_bpe.encode_texts(docs.where("text is null or length(text) < 1000"), BPE).collect()) == sorted(plain.encode_ordinary(t or "") for _, t in rows if t != long)
    # appends and edits of stored tables
    edits = byte_bpe.encode_with_prefixes(docs.where("text is null or length(text) < 1000").select("doc_id", "text"), BPE)
    edits = edits.withColumns({"at": F.when(F.col("doc_id") == 1, 5).cast("int"), "gone": F.when(F.col("doc_id") == 1, 4).cast("int"), "more": F.lit("ll be 'r")})
    for r in byte_bpe.edit_texts(edits, BPE, "at", "gone", "more").collect():
        old = dict(rows)[r["doc_id"]] or ""
        text = old[:5] + "ll be 'r" + old[9:] if r["doc_id"] == 1 else old + "ll be 'r"
        assert r["text"] == text and r["ids"] == plain.encode_ordinary(text) and len(r["last"]) == len(text.encode())


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v)]
    centroids_ = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids_))[::-1]
    for _ in range(rounds):
        own = [near(v)[0] for _, v in kept]
        for j in range(len(centroids_)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids_[j] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [near(v) for _, v in kept]
    sums = Counter()
    for j, d in final:
        sums[j] += d
    return sorted((str(i), j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids_[j])).encode()).hexdigest()) for (i, _), (j, d) in zip(kept, final))


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(300)] + [(400 + i, [0.5, 0.25, -0.125, 0.0]) for i in range(200)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 3
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, 0.2, 0.3, 0.5]), (901, None), (902, [1.0, 2.0]), (903, [1.0, None, 2.0, 3.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, []), (907, [1000.5, -1000.5, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("row", "x", "cluster", "sums", "distance"):
        frame = frame.withColumn(c, F.lit("x"))
    for k, rounds in ((3, 4), (1, 2), (5, 0)):
        got = sorted((str(r[0]), *r[1:]) for r in centroids.cluster(frame, k, 4, rounds).collect())
        assert got == plain_clusters(rows, k, rounds)
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>")
    assert sorted((str(r[0]), *r[1:]) for r in centroids.cluster(few, 8, 4, 2).collect()) == plain_clusters(rows[:2], 8, 2)
    assert centroids.cluster(frame, 8, 9, 2).count() == 0


def test_bounds_spare_scans_and_never_lie(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(8, 16)) * 20
    x = np.floor(1024 * (middles[rng.integers(0, 8, 4_000)] + rng.normal(size=(4_000, 16)))).astype(np.int64)
    c = x[:8].copy()
    own, upper, lower = centroids.nearest(x, c)
    scans = []
    for _ in range(12):
        before, c = c, np.array([x[own == j].sum(0) // max((own == j).sum(), 1) if (own == j).any() else c[j] for j in range(8)])
        own, upper, lower, n = centroids.Step(c, before).assign(x, own, upper, lower)
        d = centroids.squared_distances(x, c)
        assert (own == d.argmin(1)).all()
        rest = d.copy()
        rest[np.arange(len(x)), own] = np.iinfo(np.int64).max
        assert (upper >= np.sqrt(d.min(1).astype(np.longdouble))).all() and (lower <= np.sqrt(rest.min(1).astype(np.longdouble))).all()
        scans.append(n)
    assert scans[-1] < len(x) / 10

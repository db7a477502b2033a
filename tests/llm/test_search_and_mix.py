"""Near-duplicates, exact search, mixing and the pipeline against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import mixing, neardup, topk
from tideline.llm.common import words


def shingles(text, size):
    w = words(text)
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def components(rows, size, percent):
    """By comparing all pairs."""
    sets, parent = {k: shingles(t, size) for k, t in rows}, {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def planted(n=60, seed=5):
    """Chains and families of near copies, some just under and just over the threshold; short texts that differ by a word."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n // 6):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([6, 8, 12, 40, 90, 200]))]
        texts.append(base)
        for _ in range(5):
            base = list(draw.choice(texts[-5:]))
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                base[draw.randrange(len(base))] = draw.choice(vocabulary)
            texts.append(base)
    return [(i, " ".join(t).upper() if i % 7 == 0 else "\n".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, percent):
    rows = planted()
    want, sizes = components(rows, size, percent)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs, size=3, percent=85).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[8]["component_id"] == 7 and not by[8]["kept"] and by[0]["n_shingles"] == 0 and by[0]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(no_docs).count() == 0


def test_hot_group_of_near_copies_equals_brute_force(spark):
    """Copies of one text with more and more words changed share bands without end; only some of their pairs are links."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(draw.choice([1, 2, 3, 4, 6, 8, 12, 30])):
            t[draw.randrange(len(t))] = f"x{draw.randrange(40)}"
        rows.append((i, " ".join(t if i % 3 else [f"y{i}"] * 60 + t[:60])))
    want, sizes = components(rows, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {k: (want[k], sizes[k]) for k in want}
    assert 20 < len(set(want.values())) < 240


def test_prefixes_meet_every_pair_that_is_alike(spark):
    draw = random.Random(4)
    sets = {i: {draw.randrange(400) for _ in range(draw.choice([1, 3, 20, 60]))} for i in range(40)}
    sets |= {i + 40: {x for x in sets[i] if draw.random() > 0.08} or sets[i] for i in range(40)}
    table = spark.createDataFrame([(i, i, sorted(x)) for i, x in sets.items()], "k long, c long, shingles array<long>")
    met = table.selectExpr("k", "c", "CAST(size(shingles) AS LONG) AS n", "explode(shingles) AS h")
    first = neardup.prefixes(met, 80)
    got = {tuple(sorted(r)) for r in neardup.across(first, 80).distinct().collect()}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert alike <= got and len(alike) > 10


def test_rows_that_share_a_key_are_one_document(spark):
    draw = random.Random(8)
    a, b = (" ".join(f"{p}{draw.randrange(10**6)}" for _ in range(40)) for p in "ab")
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (7, b + " more"), (8, "alone in the world"), (5, a), (9, None), (9, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (6, 5), (7, 5), (8, 8), (9, 9)}


def test_estimate_is_near_jaccard():
    draw = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        pool = draw.integers(0, 2**64 - 1, 3000, dtype=np.uint64)
        n = int(3000 * share)
        a, b = np.unique(pool[: n + (3000 - n) // 2]), np.unique(np.concatenate([pool[:n], pool[n + (3000 - n) // 2 :]]))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        j, used = neardup.estimate(neardup.sketch(a, 512), neardup.sketch(b, 512), len(a), len(b))
        assert abs(j - exact) < 5 * (exact * (1 - exact) / used) ** 0.5 + 0.01


def test_components_of_a_long_chain(spark):
    n = 200
    order = random.Random(3).sample(range(n), n)
    links = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "a long, b long")
    assert {r["k"]: r["c"] for r in neardup.components(links).collect()} == dict.fromkeys(range(n), 0)


def best(rows, k, every):
    want = set()
    ok = [(i, [int(np.floor(64 * float(v))) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    for q, x in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(x) == len(y))
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return want


def test_topk_equals_brute_force(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(v) for v in draw.integers(-3, 4, 4) / 64]) for i in range(300)]  # many ties
    rows += [(300 + i, [float(v) for v in draw.normal(size=4)]) for i in range(60)]
    rows += [(400, None), (420, [1.0, None, 0.0, 2.0]), (440, [float("nan"), 0.0, 0.0, 1.0]), (460, [1e6, -1e6, 3e5, 0.0]), (480, [1.0, 2.0]), (481, [2.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS rank", "'x' AS score")
    for block in (4096, 8):
        got = {tuple(r) for r in topk.top_k(spark, df, k=7, every=20, block_rows=block, bins=16).collect()}
        assert got == best(rows, 7, 20)


def test_topk_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark, spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in topk.top_k(spark, spark.createDataFrame([(0, [1.0]), (3, [2.0])], schema)).collect()] == [(0, 1, 3, 64 * 128)]


def fill(budget, children):
    """Water level among (name, capacity, weight), in whole numbers."""
    order = sorted(children, key=lambda c: (c[1] / c[2], c[1], c[2], c[0]))
    out, left = {}, budget
    for at, (name, capacity, weight) in enumerate(order):
        weights = sum(c[2] for c in order[at:])
        if left * weight < capacity * weights:
            out |= {n: left * w // weights for n, _, w in order[at:]}
            break
        out[name], left = capacity, max(left - capacity, 0)
    return out


def test_mixture_equals_brute_force(spark):
    draw = random.Random(8)
    rows = [(i, " ".join("x" * draw.randrange(1, 30)), draw.choice(["en", "de"]), draw.choice(["s1", "s2", "s3", "s4"]) if i % 3 else "s1") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"domains": {"a": 3, "b": 1}, "languages": {"en": 2}, "sources": {"s3": 5}}
    domain = F.when(F.col("source").isin("s1", "s2"), "a").otherwise("b")
    for share, epochs in ((0.5, 2), (1.5, 3), (0.9, 1)):
        leaf = lambda r: ("a" if r[3] in ("s1", "s2") else "b", r[2], r[3])
        n = {r[0]: len(r[1].split()) + 1 for r in rows}
        leaves = defaultdict(int)
        for r in rows:
            leaves[leaf(r)] += n[r[0]]
        cap = lambda *head: sum(v * epochs for k, v in leaves.items() if k[: len(head)] == head)
        budget = {}
        top = fill(int(sum(leaves.values()) * round(share * 1000) // 1000), [(d, cap(d), weights["domains"][d]) for d in {k[0] for k in leaves}])
        for d, b in top.items():
            mid = fill(b, [(g, cap(d, g), weights["languages"].get(g, 1)) for g in {k[1] for k in leaves if k[0] == d}])
            for g, c in mid.items():
                low = fill(c, [(s, cap(d, g, s), weights["sources"].get(s, 1)) for s in {k[2] for k in leaves if k[:2] == (d, g)}])
                budget |= {(d, g, s): v for s, v in low.items()}
        want = {}
        for k, total in leaves.items():
            full, tail = divmod(budget[k], total)
            for i in sorted((r[0] for r in rows if leaf(r) == k), key=lambda i: hashlib.md5(f"11|{full}|{i}".encode()).hexdigest()):
                take = max(0, min(n[i], tail))
                tail -= take
                if full or take:
                    want[i] = (full, take)
        got = mixing.pick(docs, domain, share=share, epochs=epochs, **weights).collect()
        assert {r["doc_id"]: (r["full_epochs"], r["tail_tokens"]) for r in got} == want
        whole = mixing.mix(docs, domain, share=share, epochs=epochs, **weights).groupBy("doc_id").count().collect()
        assert {r["doc_id"]: r["count"] for r in whole} == {i: f + (t > 0) for i, (f, t) in want.items()}


def test_mixture_odd_rows(odd_docs, no_docs):
    out = mixing.pick(odd_docs, F.lit(None), share=1.0, epochs=1).collect()
    assert len(out) == odd_docs.count() and all(r["domain"] == "none" for r in out)
    assert mixing.mix(odd_docs, F.lit(None), share=1.0, epochs=1).columns == odd_docs.columns
    assert mixing.mix(odd_docs, F.lit(None), share=1.0, epochs=1).count() == odd_docs.count()
    assert mixing.pick(no_docs, F.lit("d")).count() == 0 and mixing.mix(no_docs, F.lit("d")).count() == 0
    assert mixing.pick(odd_docs, F.col("source"), domains={"src1": 0}, share=1.0).where("domain = 'src1'").count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "mixture", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        path = f"/tmp/checkpoints/stage-test-{name}"
        stage(spark, before, sf).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        if name != "tokens":
            assert after.columns == columns and after.select("doc_id").distinct().count() == after.count() <= before.count()
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want, _ = components(rows, 5, 80)
            assert {r["doc_id"] for r in after.collect()} == {k for k, c in want.items() if k == c}
        if name == "tokens":
            assert after.count() == before.count() and after.where("NOT exact").isEmpty()
        before = after
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = spark.read.parquet("/tmp/checkpoints/stage-test-quality")
    good = docs.join(labels.where("quality = 1"), "doc_id")
    assert first.join(good.select("doc_id"), "doc_id").count() > 0.95 * good.count()


def test_pipeline_of_an_empty_table(spark, no_docs):
    import corpus_pipeline

    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0

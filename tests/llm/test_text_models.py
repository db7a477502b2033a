"""Language ID, quality and language-model scoring: held-out accuracy, proper distributions, brute force, odd rows."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import language, lmscore, quality
from tideline.llm.common import held_out, load, words

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = load(spark, SF, "documents")
    model = language.train(docs, ~held_out("doc_id", 4, 2), most_rows=800)
    got = language.identify(docs, model).where(held_out("doc_id", 4, 2)).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.98 and 0 <= got[1] <= got[2] <= 1


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9):
        code = language.codewords(n)
        assert len({tuple(c) for c in code}) == n
        if n >= 4:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3  # one wrong bit is mended


def test_ngrams_of_chunks_equal_those_of_the_whole(monkeypatch):
    text = "Ein länger Text, der in Stücke zerfällt. " * 40
    whole = language.ngram_counts(text, 12)
    monkeypatch.setattr(language, "CHUNK", 97)
    assert (language.ngram_counts(text, 12) == whole).all()


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = language.train(odd_docs, F.lit(True))
    out = language.identify(odd_docs, model)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns.count("score") == 1
    for r in rows:
        bare = r["text"] is None or not any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == bare and (r["lang_pred"] in ("en", "und"))
    empty = language.train(no_docs, F.lit(True))
    assert language.identify(no_docs, empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs, empty).collect()} == {"und"}
    assert language.confident(odd_docs, model).columns == odd_docs.columns


def test_quality_held_out(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    model = quality.train(docs, labels, ~held_out("doc_id", 3, 1))
    got = quality.score(docs, model).join(labels, "doc_id").where(held_out("doc_id", 3, 1)).select("quality", "predicted", "score").toPandas()
    assert (got["quality"] == got["predicted"]).mean() > 0.95 and got["score"].between(0, 1).all()
    assert (got[got["quality"] == 1]["predicted"] == 1).mean() > 0.97


def test_quality_score_is_a_sparse_dot_product():
    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << 10).astype(np.float32), 0.3, 30.0, 10)
    text = "Some words!! and SOME more 12 words, and words."
    at, x = quality.Featurizer(10).vector(text)
    z = 0.3 + 30.0 * float(model.weights[at] @ x)
    assert math.isclose(model.scorer()(text), 1 / (1 + math.exp(-z)), rel_tol=1e-4)


def test_quality_looks_at_the_order_of_words():
    make = quality.Featurizer(18)
    a, b = (set(make.vector(t)[0].tolist()) for t in ("alpha beta gamma", "gamma beta alpha"))
    assert a != b and len(a & b) >= 3


def test_quality_weights_equal_ftrl_in_dictionaries(spark, some_docs):
    labels = load(spark, "/root/testdata/sf0.001", "labels")
    model = quality.train(some_docs, labels, F.lit(True), bits=14, epochs=2, seed=7)
    text = {r["doc_id"]: r["text"] for r in some_docs.collect()}
    make, rows = quality.Featurizer(14), []
    for r in labels.where("quality IS NOT NULL").select("doc_id", "quality").distinct().collect():
        if r["doc_id"] in text:
            at, x = make.vector(text[r["doc_id"]])
            rows.append((at.astype(np.int32).tobytes(), x.tobytes(), r["quality"]))
    rows.sort()
    alpha, beta, l1, l2, bias, ones = 2.0, 1.0, 1e-4, 1e-3, 1 << 14, sum(y for *_, y in rows)
    z, n = Counter(), Counter()
    z[bias] = -math.log((ones + 1) / (len(rows) - ones + 1)) * (beta / alpha + l2)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    draw = np.random.default_rng(7)
    for _ in range(2):
        for i in draw.permutation(len(rows)):
            at, x, y = rows[i]
            one = dict(zip(np.frombuffer(at, np.int32).tolist(), (np.frombuffer(x, np.float32) * np.float32(model.scale)).tolist(), strict=True)) | {bias: 1.0}
            p = 1 / (1 + math.exp(-min(max(sum(weight(k) * v for k, v in one.items()), -30), 30)))
            step = {k: ((p - y) * v, weight(k)) for k, v in one.items()}
            for k, (g, w) in step.items():
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
    want = np.array([weight(k) for k in range(bias)])
    assert len(rows) > 50 and np.abs(want).max() > 0.01
    assert np.allclose(model.weights, want, atol=1e-4) and math.isclose(model.bias, weight(bias), abs_tol=1e-4)


def test_language_decoding_equals_loops(spark, some_docs):
    model = language.train(some_docs, F.lit(True), bits=10)
    assert len(model.languages) > 2 and model.code.shape == (len(model.languages), model.bias.size)
    for r in some_docs.limit(80).collect():
        lang, score, unsure, second = model.predict(r["text"])
        if lang == language.UNDETERMINED:
            continue
        counts = Counter()
        data = b" " + r["text"].encode().translate(language.FOLD) + b" "
        for i in range(len(data)):
            for k, shift in ((1, 0), (2, 1 << 24), (3, 77)):
                if i + k <= len(data):
                    whole = data[i] if k == 1 else (data[i] * 256 + data[i + k - 1] + shift)
                    if k == 3:
                        whole = (data[i] * 256 + data[i + 1] + (1 << 24)) * 256 + data[i + 2] + shift
                    counts[whole % 2**32 * 2654435761 % 2**32 >> 32 - 10] += 1
        size = math.sqrt(sum(counts.values()))
        loss = {}
        for name, word in zip(model.languages, model.code, strict=True):
            total = 0.0
            for bit, side in enumerate(word):
                margin = float(model.bias[bit]) + sum(math.sqrt(c) / size * float(model.weights[k, bit]) for k, c in counts.items())
                total += float(model.trust[bit]) * math.log1p(math.exp(-float(side) * margin))
            loss[name] = total
        order = sorted(loss, key=loss.get)
        odds = {name: math.exp(-v) for name, v in loss.items()}
        assert (lang, second) == (order[0], order[1]) or loss[order[1]] - loss[order[0]] < 1e-4
        assert math.isclose(score, odds[order[0]] / sum(odds.values()), abs_tol=1e-3)


def test_samples_are_bounded_however_often_a_key_repeats(spark):
    docs = spark.range(3000).selectExpr("id % 2 AS doc_id", "concat('word ', id) AS text", "'en' AS lang")
    docs = docs.unionByName(spark.range(2000).selectExpr("1 AS doc_id", "'same' AS text", "'en' AS lang"))
    from tideline.llm.common import bounded

    assert bounded(docs, 100, 1).count() == 100 and bounded(docs.where("text = 'same'"), 100, 1).count() == 1


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels, F.lit(True))
    out = quality.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not (r["text"] or "").split()}) == 1
    assert quality.score(no_docs, quality.train(no_docs, labels.limit(0), F.lit(True))).count() == 0
    assert quality.keep_good(odd_docs, model).columns == odd_docs.columns


def brute(docs, learn):
    c = Counter()
    for k, t in docs:
        if learn(k):
            c.update(words(t) + [lmscore.END])
    n, v = sum(c.values()), len(c)
    return c, n, v


def test_lm_counts_and_base_match_brute_force(spark, some_docs):
    import zlib

    rows = [(r["doc_id"], r["text"]) for r in some_docs.collect()]
    c, n, v = brute(rows, lambda k: zlib.crc32(str(k).encode()) % 5 != 1)
    got = {r["doc_id"]: r for r in lmscore.score(some_docs, ~held_out("doc_id", 5, 1), head=1000).collect()}
    better = 0
    for k, t in rows:
        w = words(t) + [lmscore.END]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        better += r["score"] > r["base_score"]
    assert better > 0.9 * len(rows)


def test_lm_distributions_add_up_to_one(spark, some_docs):
    tree = lmscore.fit(some_docs.select(F.col("text").alias("t")), singles=60, classes=16, least=2.0**-8)
    lex = tree.lexicon
    assert math.isclose((10**tree.root).sum(), 1, rel_tol=1e-9) and len(tree.root) == lex.symbols
    assert any(len(s) for s in tree.states)
    draw = np.random.default_rng(3)
    for _ in range(40):
        before = draw.integers(1, lex.symbols, 3)
        probe = np.concatenate([np.append(before, s) for s in range(lex.symbols)])
        begins = np.repeat(np.arange(lex.symbols) * 4, 4)
        assert math.isclose((10 ** tree.log10(probe, begins)[3::4]).sum(), 1, rel_tol=1e-5)
    # Within a class: its words and one that is unknown.
    within = Counter()
    for r in lex.vocabulary.where("h <> 0").collect():
        code = int(lex.codes(np.array([r["h"]]))[0])
        if code <= lex.classes:
            within[code - 1] += (r["c"] + 0.5) / (lex.class_n[code - 1] + 0.5 * (lex.class_v[code - 1] + 1))
    assert all(math.isclose(p + 0.5 / (lex.class_n[k] + 0.5 * (lex.class_v[k] + 1)), 1, rel_tol=1e-9) for k, p in within.items())


def test_lm_odd_rows(spark, odd_docs, no_docs):
    out = lmscore.score(odd_docs, F.lit(True)).collect()
    assert len(out) == odd_docs.count()
    assert all(r["n_tokens"] >= 1 and r["score"] <= 0 and math.isfinite(r["score"]) for r in out)
    assert lmscore.score(no_docs, F.lit(True)).count() == 0
    untrained = lmscore.score(odd_docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(r["n_known"] == 0 for r in untrained)


def test_lm_tree_grows_with_the_corpus(spark):
    """A passage repeated 40 times is learnt however many other tokens there are, and tables joined give what a held head gives."""
    draw = np.random.default_rng(5)
    passage = "amber birch cedar dahlia elm fir"
    noise = [" ".join(f"w{x}" for x in draw.zipf(1.3, 400) % 50_000) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(noise)] + [(1000 + i, passage) for i in range(40)] + [(2000, "fir elm dahlia cedar birch amber")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") < 2000
    held = {r["doc_id"]: r["score"] for r in lmscore.score(docs, learn).collect()}
    joined = {r["doc_id"]: r["score"] for r in lmscore.score(docs, learn, head=50, term_head=50).collect()}
    assert held[1000] > held[2000] + 8
    assert all(math.isclose(held[k], joined[k], rel_tol=1e-9) for k in held)


def dictionary_tree(texts, depth, few, seen, pull, root):
    """A suffix tree in dictionaries, by recursion. root: log10 P of a symbol. Texts are lists of symbols, the end (0) included."""
    follow = [{} for _ in range(depth + 1)]
    for t in texts:
        for length in range(1, depth + 1):
            for i in range(length, len(t)):
                follow[length].setdefault(tuple(t[i - length : i]), Counter())[t[i]] += 1
    states = {}

    def log10(ctx, sym):
        if not ctx:
            return root[sym]
        below = log10(ctx[1:], sym)
        if ctx not in states:
            return below
        told, total, back = states[ctx]
        return math.log10((told[sym] + pull * 10**below) / (total + pull)) if sym in told else below + back

    for length in range(1, depth + 1):
        made = {}
        for ctx, nexts in follow[length].items():
            total, told = sum(nexts.values()), {s: c for s, c in nexts.items() if c >= seen}
            if total < few or not told:
                continue
            p = {s: 10 ** log10(ctx[1:], s) for s in told}
            left, free = total - sum(told.values()), 1 - sum(p.values())
            evidence = sum(c * math.log(c / total / p[s]) for s, c in told.items()) + (left * math.log(left / total / free) if left else 0)
            if evidence > 0.5 * len(told) * math.log(max(total, 2)):
                made[ctx] = told, total, math.log10((left + pull * free) / ((total + pull) * free))
        states |= made
    return states, log10


@pytest.mark.parametrize("how", [{"term_head": 50, "head": 100}, {}])
def test_lm_score_equals_a_tree_of_dictionaries(spark, some_docs, how):
    few, seen, pull = 8, 3, 16.0
    docs = some_docs.orderBy("doc_id").limit(50)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lex = lmscore.learn_words(docs.select(F.col("text").alias("t")), few=few)
    c = Counter(w for t in texts.values() for w in words(t))
    code = dict(zip(c, lex.codes(lmscore.hashes(list(c), 256)).tolist(), strict=True))
    assert {w for w in c if c[w] >= few} == {w for w in c if code[w] > 256} and c.most_common(1)[0][1] > 100
    of = Counter({0: len(texts)})
    for w, n in c.items():
        of[code[w]] += n
    symbols = 1 + sum(s > 256 for s in of) + 256
    root = {s: math.log10((n + 0.5) / (of.total() + 0.5 * symbols)) for s, n in of.items()}
    coded = {k: [*(code[w] for w in words(t)), 0] for k, t in texts.items()}
    states, log10 = dictionary_tree(coded.values(), 3, few, seen, pull, root)
    assert {len(s) for s in states} == {1, 2, 3}
    kinds = Counter(s for w, s in code.items() if s <= 256)
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, F.lit(True), few=few, seen=seen, pull=pull, **how).collect()}
    for k, t in texts.items():
        want = sum(log10(tuple(coded[k][max(i - 3, 0) : i]), s) for i, s in enumerate(coded[k]))
        want += sum(math.log10((c[w] + 0.5) / (of[code[w]] + 0.5 * (kinds[code[w]] + 1))) for w in words(t) if code[w] <= 256)
        assert math.isclose(got[k], want, rel_tol=1e-9)


def test_lm_lookups_find_what_they_ask_for(spark, some_docs, monkeypatch):
    made, write = {}, lmscore.materialize
    monkeypatch.setattr(lmscore, "materialize", lambda df, name, **how: made.setdefault(name, write(df, name, **how)) if name in ("lm-terms", "lm-scores") else write(df, name, **how))
    lmscore.score(some_docs, F.lit(True), few=8, seen=3, term_head=0)
    terms = set((np.array([r["key"] for r in made["lm-terms"].select("key").collect()]).view(np.uint64) * lmscore.MIX[1]).tolist())
    asked = [k for r in made["lm-scores"].select(F.explode("asked.data").alias("data")).collect() for k in lmscore.undealt(bytes(r["data"]), 2)[0].tolist()]
    assert len(terms) > 1000 and terms <= set(asked)
    assert sum(k not in terms for k in asked) < 0.02 * len(asked)
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 100)
    there = spark.createDataFrame([(int(k),) for k in keys], "key long").select("key", lmscore.spread(F.col("key")).alias("s")).collect()
    assert [r["s"] for r in there] == lmscore.spread(np.array([r["key"] for r in there])).tolist()


def test_lm_leaves_no_shuffle_files(spark, some_docs):
    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for i in range(blocks.size()) if (b := blocks.apply(i).name()).startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffles(), spark.conf.get(setting)
    out = lmscore.score(some_docs, F.lit(True), few=8, seen=3, term_head=50)
    ends = time.time() + 20
    while (left := shuffles() - before) and time.time() < ends:
        time.sleep(0.2)  # they are deleted in the background
    assert not left and spark.conf.get(setting) == was
    assert out.count() == some_docs.count() == len(out.collect())


def test_confident_leaves_out_what_the_flag_calls_ambiguous(spark):
    docs = load(spark, SF, "documents")
    model = language.train(docs, ~held_out("doc_id", 4, 2), most_rows=800)
    texts = {n: [r["text"] for r in docs.where((F.col("lang") == n) & (F.length("text") > 200)).orderBy("doc_id").limit(15).collect()] for n in ("en", "de")}
    mixed = [" ".join(a.split()[:k] + b.split()[: 24 - k]) for a, b in zip(texts["en"], texts["de"], strict=True) for k in range(1, 24)]
    unsure = [t for t in mixed if (p := model.predict(t))[2] and p[1] >= 0.4]
    assert unsure
    made = spark.createDataFrame([(i, t) for i, t in enumerate(unsure + texts["en"])], "doc_id int, text string")
    kept = {r["doc_id"] for r in language.confident(made, model).collect()}
    assert not kept & set(range(len(unsure))) and len(kept) == len(texts["en"])
    clean = language.identify(docs.where("length(text) > 200 AND lang IS NOT NULL"), model)
    assert clean.where("ambiguous").count() < 0.01 * clean.count()


def test_quality_sees_all_of_long_words_and_texts(monkeypatch):
    make = quality.Featurizer(12)
    plain, mixed = "a" * 2000, "a" * 1000 + "9.-" * 300 + "a" * 100
    shapes = [next(make.spans(t))[1] for t in (plain, mixed)]
    assert len(shapes[0]) == len(shapes[1]) == 1 and shapes[0][0] != shapes[1][0]  # one word each, told apart by what is far inside
    text = "one two three four five six " * 30
    whole = make.vector(text)
    monkeypatch.setattr(quality, "SPAN", 7)
    assert all((a == b).all() for a, b in zip(whole, make.vector(text), strict=True))

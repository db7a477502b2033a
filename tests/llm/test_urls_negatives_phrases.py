"""URL filters, hard negatives and collocations against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import collocations, negatives, urls

RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"), urls.Rule("net", "/es/", "block")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def parse(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    asked = re.match(r"[^?#]*\?([^#]*)", rest)
    parts = sorted((p for p in asked[1].split("&") if p and not re.match(r"(utm_[^=]*|ref|gclid|fbclid)(=|\Z)", p)), key=str.encode) if asked else []
    name = re.sub(r"^www\.|\.\Z", "", re.sub(r"(:80|:443)\Z", "", host))
    return host, path, name + (re.sub(r"/+\Z", "", path) or "/") + ("?" + "&".join(parts) if parts else "")


def judged(url, listed):
    host, path, canonical = parse(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict, canonical, None
    hit = canonical in listed if canonical is not None else None
    return host, path, None, "block" if hit else "allow", canonical, hit


URLS = [None, "", "no url", "://", "x://", "http://a.org", "http://a.org/", "HTTP://WWW.A.Org:80/?utm_source=x&b=2&a=1#top", "https://a.org/?a=1&b=2", "http://a.org/p//", "http://a.org/p?x#y?z",
        "http://b.example.com/EN/x", "http://b.example.com/en/x", "http://www.example.com/en/", "http://notexample.com/en/", "http://example.com", "http://x.net/es/?", "http://net/es/", "http://x.net/fr/", "http://é.org/ñ?ref=1&ref2",
        "http://k.org/" + "y" * 3_000_000, "http://u.org?q", "http://u.org/?q", "ftp://q.org/a\nb#c", "http://u.org./?utm_=&&"]


@pytest.mark.parametrize(("most_blocks", "parts"), [(1 << 20, 1024), (1, 2), (1, 1024)])
def test_verdicts_equal_brute_force(spark, most_blocks, parts):
    rows = [(i, u, "clash", 5) for i, u in enumerate(URLS * 2 + ["http://hot.org/a"] * 60 + ["http://cold.org/a"] * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, Verdict string, host int")
    listed = ["http://hot.org/a/", "https://a.org/?b=2&a=1", "http://u.org/?q", None, "nothing", "http://hot.org/a", "ftp://q.org/a\nb", *(f"http://l.org/{i}" for i in range(500))]
    got = urls.judge(pages, spark.createDataFrame([(u,) for u in listed], "url string"), RULES, most_blocks=most_blocks, parts=parts)
    assert got.columns == ["page_id", "url", *urls.ADDED]
    known = {parse(u)[2] for u in listed} - {None}
    assert sorted((r[0], *r[2:]) for r in got.collect()) == sorted(((i, *judged(u, known)) for i, u, _, _ in rows), key=lambda r: r[0])


def test_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("a.org/"), "id").alias("k"))
    table, blocks = urls.bloom(keys, "k", 20_000)
    assert blocks == 1024 and table.count() <= blocks
    held = urls.probed(keys, (table, blocks), "k", "maybe").agg(F.count_if("maybe")).first()[0]
    others = urls.probed(keys.select(F.concat("k", F.lit("x")).alias("k")), (table, blocks), "k", "maybe").agg(F.count_if("maybe")).first()[0]
    assert held == 20_000 and others < 200


def test_no_pages_and_no_list(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge(pages.limit(0), pages, RULES).count() == 0
    assert [r["verdict"] for r in urls.judge(pages, pages.limit(0), RULES).collect()] == ["allow"]


def negatives_by_hand(rows, every, scale, positives=5, count=5, percent=80):
    good = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [int(x) * int(scale) if abs(x) > 2**53 else math.floor(x * scale) for x in v], label))
    out = []
    for i, a, label in good:
        if i % every:
            continue
        score = [(max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(a, b, strict=True)))), j, m) for j, b, m in good if j != i and len(b) == len(a)]
        score.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in score if s[2] == label][:positives]:
            hits = [s for s in score if s[2] != label and percent * p <= 100 * s[0] <= 100 * p][:count]
            out += [(i, j, n + 1, k, p, s) for n, (s, k, _) in enumerate(hits)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_hard_negatives_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + 0.3 * draw.normal(size=5)).round(1).tolist(), int(draw.integers(3))) for i in range(500)]
    rows += [(600 + i, rows[7][1], i % 2) for i in range(40)]  # copies of one vector: ties
    rows += [(700, [0.0] * 5, 1), (702, [-1.0] * 5, 2), (704, [1.0, 2.0], 1), (706, [2.0, 1.0], 0), (708, [1.5, 1.5], 1)]
    rows += [(None, [1.0] * 5, 1), (710, None, 1), (712, [1.0, None, 0.0, 0.0, 0.0], 1), (714, [float("nan")] * 5, 1), (716, [float("inf")] * 5, 1), (718, [1.0] * 5, None), (720, [], 1), (722, [], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("clash")).withColumn("score", F.lit(1))
    want = negatives_by_hand(rows, 2, 256.0)
    for how in ({}, {"unit_rows": 16, "unit_anchors": 16, "pivots": 40}):
        assert sorted(map(tuple, negatives.mine(df, every=2, **how).collect())) == want
    assert len(want) > 1000


def test_hard_negatives_of_huge_components_and_repeated_keys(spark):
    rows = [(0, [1e307, 1.0], 1), (1, [1e300, -2.0], 1), (2, [1e306, 3.5], 2), (3, [-1e307, 1.0], 2), (4, [1e308, 0.0], 2), (0, [0.5, 0.25], 1), (6, [0.5, 0.5], 1), (7, [0.5, 0.25], 2), (8, [1e12, 1e12], 1), (9, [1e12, 1e12 - 1], 2)]
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, VECTORS), every=2).collect()))
    assert got == negatives_by_hand(rows, 2, 256.0) and len(got) > 3
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1)], VECTORS)).count() == 0


def phrases_by_hand(rows, least, longest, covered=80, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                s, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows_.append((s, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows_[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(6)
    vocabulary = ["The", "of", "état", "x\x01", "x", "a-b", "漢字", "\x1f", "z\u2028z", "d'un", "0"]
    rows = []
    for i in range(120):
        t = "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "\t ", ", ", "\n", "!"]) for _ in range(draw.choice([0, 1, 3, 40, 120])))
        rows.append((t, draw.choice(["en", "fr", None, "und"])))
    rows += [("a very common pair of words " * 400, "en"), (None, "en"), ("", None), (" \t\n", "fr"), ("?!", "de"), ("w" * 50_000 + " one two. " * 3000, "en")]
    return rows + [rows[5]] * 3


@pytest.mark.parametrize(("longest", "least", "how"), [(4, 5, {}), (4, 3, {"span": 40, "slice_bytes": 37}), (3, 5, {"span": 1000}), (2, 9, {})])
def test_phrases_equal_brute_force(spark, texts, longest, least, how):
    df = spark.createDataFrame(texts, "text string, lang string").selectExpr("*", "'clash' AS phrase", "1 AS n", "'c' AS w1").repartition(5)
    got = sorted(map(tuple, collocations.phrases(df, least=least, longest=longest, most=50, **how).collect()))
    want = phrases_by_hand(texts, least, longest, most=50)
    assert got == want and len(want) > 20


def test_no_phrases(spark):
    assert collocations.phrases(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_texts_of_some_mb_cross_tries(spark):
    draw = random.Random(1)
    text = " ".join(draw.choice("abcdefgh") for _ in range(300_000))
    got = collocations.phrases(spark.createDataFrame([(text, "en")], "text string, lang string"), least=30, span=10_000, slice_bytes=5_000)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand([(text, "en")], 30, 4)

"""The operators' queries over the driver's tables, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import collocations, language, lmscore, media, mixing, neardup, negatives, pieces, quality, tokenfile, urls
from tideline.llm.common import held_out, load, materialize
from tideline.llm.sharding import shard
from tideline.llm.topk import top_k


def public_tokenizer(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that aren't held out."""
    docs = load(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out("doc_id", 4, 2))
    thin = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return language.identify(thin, model).drop("text")


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labelled ones that aren't held out."""
    docs = load(spark, sf_dir, "documents")
    model = quality.train(docs, load(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    thin = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return quality.score(thin, model).drop("text")


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together (law `bytes`)."""
    out = shard(load(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket")


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a tree learnt from those that aren't held out."""
    docs = load(spark, sf_dir, "documents")
    out = lmscore.score(docs, ~held_out("doc_id", 5, 1))
    return out.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return pieces.encode(load(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), keep=["doc_id"])


def op5_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    return top_k(spark, load(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles are 85 % alike."""
    return neardup.near_duplicates(load(spark, sf_dir, "documents"), size=3, percent=85)


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to Simple-8b files in ascending doc_id order, and read back."""
    path = tokenfile.new_path(spark)
    tokenfile.write(load(spark, sf_dir, "documents"), path, public_tokenizer("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(spark, path, with_ids=False)


#: The tables have no domain: sources are dealt into four by their number.
DOMAIN = "concat('d', CAST(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS STRING))"
WEIGHTS = {"domains": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "languages": {"en": 4, "de": 3, "fr": 3, "es": 2}}


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of half the tokens takes of each document."""
    return mixing.pick(load(spark, sf_dir, "documents"), F.expr(DOMAIN), share=0.5, epochs=4, **WEIGHTS)


def op10_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with an image of their bytes; what the images give when their references are resolved."""
    docs = load(spark, sf_dir, "documents")
    store = materialize(media.store_of(docs), "media")
    measured = materialize(media.measure(store), "media-measured")
    parts = media.parts_of(media.pages_of(docs), "doc_id").where(F.col("kind") == "media")
    found = media.resolve(parts, measured)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


#: Words of hosts whose pages make up the list.
UNWANTED = r"(^|[.-])(pills|casino|adult|bets|ads|spam)([.-]|\z)"
URL_RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"), urls.Rule("net", "/es/", "block"), urls.Rule("net", "/fr/", "block")]


def op11_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by five rules; the list is what the tables have on hosts with unwanted words."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.rlike(urls.host_of(urls.rest_of(F.col("url"))), F.lit(UNWANTED)))
    return urls.judge(pages, listed, URL_RULES).drop("url")


def op12_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector; where vec_id is divisible by 7 the label is another one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = load(spark, sf_dir, "embeddings").withColumn("label", label.cast("long"))
    return negatives.mine(vectors, every=100, scale=256.0, positives=5, count=5)


def op13_count_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to four words of each language."""
    return collocations.phrases(load(spark, sf_dir, "documents"), least=30, longest=4, covered=80, most=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_codes": op1_language_codes,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_viterbi_pieces": op4_viterbi_pieces,
    "op5_histogram_topk": op5_histogram_topk,
    "op6_hierarchical_mix": op6_hierarchical_mix,
    "op7_quality_ftrl": op7_quality_ftrl,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_simple8b": op9_simple8b,
    "op10_interleaved_media": op10_interleaved_media,
    "op11_blocked_bloom": op11_blocked_bloom,
    "op12_voronoi_negatives": op12_voronoi_negatives,
    "op13_count_tries": op13_count_tries,
}

def _split_sql(name: str, table: str, parent: str, node: str, budget: str, weight: str, out: str) -> str:
    """A level of the budget tree: children fill up in order of capacity for weight, the rest share what is left."""
    order = f"PARTITION BY {parent} ORDER BY capacity / ({weight}), capacity, {weight}, {node}"
    return f"""
        {name}_a AS (SELECT *, {weight} AS w, greatest({budget} - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest,
                     sum({weight}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {table}),
        {name}_b AS (SELECT *, row_number() OVER ({order}) AS i, CAST(rest AS HUGEINT) * w < CAST(capacity AS HUGEINT) * ws AS open FROM {name}_a),
        {name}_c AS (SELECT *, min(CASE WHEN open THEN i END) OVER (PARTITION BY {parent}) AS first_open FROM {name}_b),
        {name} AS (SELECT a.*, CASE WHEN a.first_open IS NULL OR a.i < a.first_open THEN a.capacity ELSE CAST((CAST(b.rest AS HUGEINT) * a.w) // b.ws AS BIGINT) END AS {out}
                   FROM {name}_c a LEFT JOIN {name}_c b ON b.i = a.first_open AND {" AND ".join(f"a.{p} = b.{p}" for p in parent.split(", "))})"""


_DOMAIN_SQL = "coalesce('d' || CAST(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS VARCHAR), 'none')"
_MIX_SQL = rf"""
    WITH t AS (SELECT doc_id, {_DOMAIN_SQL} AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
                      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 4 AS BIGINT) AS capacity FROM t GROUP BY ALL),
        tops AS (SELECT 0 AS root, domain, CAST(sum(capacity) AS BIGINT) AS capacity, (SELECT CAST(sum(tokens) * 500 AS BIGINT) // 1000 FROM leaves) AS b FROM leaves GROUP BY domain),
        {_split_sql("l0", "tops", "root", "domain", "b", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END", "b0")},
        mid AS (SELECT x.*, l0.b0 FROM (SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY ALL) x JOIN l0 USING (domain)),
        {_split_sql("l1", "mid", "domain", "lang", "b0", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 3 WHEN 'es' THEN 2 ELSE 1 END", "b1")},
        low AS (SELECT leaves.*, l1.b1 FROM leaves JOIN l1 USING (domain, lang)),
        {_split_sql("l2", "low", "domain, lang", "source", "b1", "1", "budget")},
        plan AS (SELECT domain, lang, source, CAST(budget // tokens AS INTEGER) AS full_epochs, CAST(budget % tokens AS BIGINT) AS tail FROM l2),
        h AS (SELECT t.*, full_epochs, tail, md5('11|' || full_epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM t JOIN plan USING (domain, lang, source)),
        s AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM h),
        o AS (SELECT doc_id, domain, lang, source, n_tokens, full_epochs, CAST(greatest(0, least(n_tokens, tail - begin)) AS BIGINT) AS tail_tokens FROM s)
    SELECT * FROM o WHERE full_epochs > 0 OR tail_tokens > 0"""

ORACLE_SQL: dict[str, str] = {
    "op5_histogram_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_hierarchical_mix": _MIX_SQL,
    "op11_blocked_bloom": r"""
        WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        b AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&') AS asked FROM a),
        c AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
                     regexp_replace(regexp_replace(host, '(:80|:443)\z', ''), '^www\.|\.\z', '', 'g') || coalesce(nullif(regexp_replace(path, '/+\z', ''), ''), '/')
                     || coalesce('?' || nullif(array_to_string(list_sort(list_filter(asked, lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|\z)'))), '&'), ''), '') AS canonical FROM b),
        d AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                             WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM c),
        e AS (SELECT *, CASE WHEN rule IS NULL AND canonical IS NOT NULL THEN canonical IN (SELECT canonical FROM d WHERE regexp_matches(host, '(^|[.-])(pills|casino|adult|bets|ads|spam)([.-]|\z)') AND canonical IS NOT NULL) END AS listed FROM d)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, canonical, listed FROM e""",
    "op12_voronoi_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
        p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op13_count_tries": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t),
        w AS (SELECT lang, pid, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM p),
        x AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY pid ORDER BY pos)),
        g AS (SELECT lang, 1 AS k, w1 AS phrase FROM x UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL
              UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2),
        u AS (SELECT c.*, cut, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
              FROM c, range(1, 4) q(cut) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1 :], ' ') WHERE cut < c.k),
        m AS (SELECT lang, k, phrase, a, l, r, score FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        d AS (SELECT m.lang, m.phrase, max(o.a) AS longer FROM m JOIN m o ON m.lang = o.lang AND o.k > m.k AND contains(' ' || o.phrase || ' ', ' ' || m.phrase || ' ') GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM m JOIN n USING (lang) LEFT JOIN d USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000""",
}

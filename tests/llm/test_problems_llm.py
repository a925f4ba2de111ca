"""The llm problem operators on small tables: nulls, ties, repeats, empty tables, extra columns with clashing names."""

import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import matching, packing, stuffing, tokens
from tidemark.llm.topn import latest_scores, top_n_per_group

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file here")


def top(spark, rows, n):
    df = spark.createDataFrame(rows, "g string, h int, id long, score double, __s string, lo string, top_rank string")
    return {(r.g, r.h, r.id, r.top_rank) for r in top_n_per_group(df, ["g", "h"], "score", ["id"], n).collect()}


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[3] is not None and r[3] == r[3]:
            groups.setdefault(r[:2], []).append((-(r[3] + 0.0), r[2]))
    return {(*g, i, k + 1) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:n])}


def test_top_n_with_ties_nulls_and_a_hot_group(spark):
    rnd = random.Random(2)
    value = lambda: rnd.choice([None, float("nan"), -0.0, 0.0, 1.0, -3.0, float("inf"), float("-inf"), rnd.gauss(0, 1), 1e300, 1e-300])
    rows = [(g, h, i, value(), "", "", "") for i, (g, h) in enumerate([("hot", 1)] * 3000 + [(rnd.choice(["a", "b", None]), rnd.choice([1, None])) for _ in range(200)])]
    for n in (1, 3, 7):
        assert top(spark, rows, n) == brute(rows, n)
    same = [("t", 1, i, 5.0, "", "", "") for i in range(500)]
    assert top(spark, same, 3) == brute(same, 3)
    assert top(spark, [], 3) == set()


def test_latest_score_counts_even_if_missing(spark):
    s = spark.createDataFrame([(1, 7, 2.0), (3, 7, None), (2, 7, 3.0), (4, 8, 1.0), (5, None, 1.0)], "score_seq long, panel_id long, score double")
    assert {(r.panel_id, r.score) for r in latest_scores(s).collect()} == {(7, None), (8, 1.0)}


TEXTS = [None, "", " ", "\n\n", "Hello world", "it's  the\t\tend ", "<|endoftext|> is text", "價格上漲 3.5%", "naïve café​ x", "🚀🚀 to the moon", "x" * 50_000, "word " * 30_000, "Hello world", "\u0000� ", "٣ ١٢ ½"]


@needs_vocabulary
def test_encoding_equals_the_tokenizer_and_decodes(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t, "w", "b") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, block string")
    coded = tokens.encode_corpus(docs)
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokens.decode_corpus(coded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in tokens.encode_corpus(docs, counts_only=True).collect()}
    assert sizes == {i: len(v) for i, v in got.items()}


@needs_vocabulary
def test_encoding_of_repeats_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    got = tokens.encode_corpus(docs).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 0), (0, 1), (1, 2), (1, 2)]
    assert tokens.encode_corpus(docs.limit(0)).collect() == []
    assert tokens.decode_corpus(spark.createDataFrame([(1, [999_999]), (2, None)], "doc_id long, ids array<int>")).orderBy("doc_id").collect()[0].text is None


def test_encoding_in_many_blocks(spark, monkeypatch):
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary file here")
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 50)
    docs = spark.createDataFrame([(i, f"alpha beta {i} gamma {i * i}") for i in range(60)], "doc_id long, text string")
    many = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(docs).collect()}
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 10**9)
    assert many == {r.doc_id: list(r.ids) for r in tokens.encode_corpus(docs).collect()}


def packed(spark, sizes, **kw):
    df = spark.createDataFrame([(i, n, "c") for i, n in sizes], "doc_id long, n_tokens long, shard string")
    rows = packing.pack(df, **kw).collect()
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r.container_id, []).append((r.offset, r.n_tokens))
        docs.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= kw.get("capacity", packing.CAPACITY) and len(b) <= kw.get("max_pieces", packing.MAX_PIECES)
    return bins, docs


def test_packing_keeps_everything_and_fills(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice([1, 5, 40, 300, 700, 2047, 2048, 2049, 9000])) for i in range(3000)] + [(9000, 0), (9001, None)]
    bins, docs = packed(spark, sizes)
    want = {i: n for i, n in sizes if n}
    assert {d: sum(n for _, n in v) for d, v in docs.items()} == want
    for d, v in docs.items():
        assert len(v) == -(-want[d] // 2048) and sorted(s for s, _ in v) == [2048 * k for k in range(len(v))]
    assert sum(want.values()) / (2048 * len(bins)) > 0.98
    assert packed(spark, [])[0] == {}


def test_packing_respects_every_capacity(spark):
    bins, _ = packed(spark, [(i, 1) for i in range(100)], capacity=64, max_pieces=7)
    assert len(bins) == 15
    assert list(packing.best_fit(np.array([6, 5, 4, 4, 1]), 10, 9, 100.0)) == [0, 1, 0, 1, 1]
    assert max(np.bincount(packing.best_fit(np.array([5, 5, 5, 5]), 20, 9, 50.0))) == 2
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), 10, max_pieces=0)


def test_cost_decides_the_container(spark):
    # 6 and 5 leave 4 and 5 of 10 tokens. By tokens alone 4 goes to 6; with a cost of 45 only 5 has room for its 16.
    assert list(packing.best_fit(np.array([6, 5, 4]), 10, 9, 100.0)) == [0, 1, 0]
    assert list(packing.best_fit(np.array([6, 5, 4]), 10, 9, 45.0)) == [0, 1, 1]
    # 8 alone exceeds 45 and shares with none, though 2 would fit its tokens.
    assert list(packing.best_fit(np.array([8, 6, 2]), 10, 9, 45.0)) == [0, 1, 1]
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, rnd.choice([3, 40, 60, 90, 130])) for i in range(500)], "doc_id long, n_tokens long")
    rows = packing.pack(df, capacity=100, max_pieces=10, max_cost=5000.0).collect()
    cost, count, room = {}, {}, {}
    for r in rows:
        k = r.container_id
        cost[k], count[k], room[k] = cost.get(k, 0) + r.n_tokens**2, count.get(k, 0) + 1, room.get(k, 0) + r.n_tokens
    assert all(c <= 5000 or count[k] == 1 for k, c in cost.items()) and max(count.values()) <= 10 and max(room.values()) <= 100
    assert sum(room.values()) == df.groupBy().sum("n_tokens").first()[0]
    loose = packing.pack(df, capacity=100, max_pieces=10).select("container_id").distinct().count()
    assert len(cost) > loose  # the cost closes containers that have room


SENTENCES = ["The company reported revenue of $5 million in the quarter, up from a year ago.", "Management expects the second plant to open before the end of the year.", "Orders from larger accounts slipped late in the quarter because of the weather.", "The auditor resigned after the committee declined to widen the scope of its work.", "Seasonal patterns make the first three months the weakest stretch of any year."]


def test_stuffed_pages(spark):
    rnd = random.Random(3)
    good = [" ".join(rnd.sample(SENTENCES, 5)) + f" Case {i} was closed on day {i * 7}." for i in range(40)]
    links = "\n".join(f"https://shop.site{i}.example.com/page-{i * 31}" for i in range(60))
    bad = ["cheap loans fast loans best cheap loans now " * 20, links, "#loans #cheap #fast #now " * 30, "If you want cheap loans then cheap loans is best cheap loans. " * 20, SENTENCES[0] + "\n" + "token presale " * 60]
    fine = [SENTENCES[0] + " See https://site.example.com/a and #tag.", "", None, " \n ", "short", good[0] + "\n\n(in thousands)\nNet sales 5,123 4,001\nTaxes 12 13\n", good[1] + "\nhttps://www.site.test/1"]
    texts = good + bad + fine + [bad[0]]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, ratio double")
    got = sorted(r.doc_id for r in stuffing.stuffed_pages(docs).collect())
    n = len(good)
    assert got == [*range(n, n + len(bad)), len(texts) - 1]
    assert stuffing.stuffed_pages(docs.limit(0)).collect() == []


def test_stuffing_measures(spark):
    rows = [
        ("see hxxp://bad[.]example[.]com/x, [a](https://b.example/c) and #tag #two x-y:z", "en"),
        ("Привет мир", "en"),
        ("Привет мир", "ru"),
        ("hello", None),
        ("One plain sentence stands here. Get cheap loans fast, cheap loans now.", "de"),
        ("需要は弱く、注文は減った。", "ja"),
        ("no mark at the end of this line\nhttps://a.example/b.html", "fr"),
        ("word " * 2000, "en"),
    ]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = docs.select(
        stuffing.language_class(F.col("text"), F.col("lang")).alias("kind"),
        stuffing.punctuated(F.col("text")).alias("part"),
        stuffing.blocks_of(F.col("text")).alias("blocks"),
        stuffing.folded(F.col("text")).alias("fold"),
    ).collect()
    assert [r.kind for r in got] == ["en", "cyrillic", "ru", "latin", "de", "ja", "fr", "en"]
    assert "example" not in got[0].fold and "#" not in got[0].fold
    assert [round(r.part, 2) for r in got] == [0, 0, 0, 0, 0.45, 0.93, 0, 0]
    assert "".join(got[-1].blocks) == "word " * 2000 and {len(b) for b in got[-1].blocks[:-1]} <= set(range(600, 1001))
    assert len(got[0].blocks) == 1


def test_each_gate_of_stuffed_pages_decides(spark):
    rnd = random.Random(4)
    good = [" ".join(rnd.sample(SENTENCES, 5)) + f" Case {i} was closed on day {i * 7}." for i in range(40)]
    words = "".join(chr(97 + rnd.randrange(26)) if rnd.random() < 0.85 else " " for _ in range(1500))
    repeated = " ".join([SENTENCES[0]] * 8)
    texts = [*good, words, repeated, "cheap loans fast " * 60]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in stuffing.stuffed_pages(docs).collect()] == [42]  # neither unpunctuated nor redundant alone


def people(spark, n, seed=1):
    rnd = random.Random(seed)
    syl = ["bra", "cor", "del", "fen", "gal", "hul", "jor", "kel", "lom", "mar", "nev", "orl", "pel", "qui", "ras", "sel", "tor", "ulv", "ven", "wex"]
    lines = [("Bancorp", 6022, "Regional banks"), ("Foods", 2000, "Packaged food"), ("Logistics", 4213, "Trucking"), ("Realty", 6798, "REIT")]
    states = [("TX", "Texas"), ("OH", "Ohio"), ("CA", "California"), ("NY", "New York")]
    filers, listings, truth = [], [], set()
    for i in range(n):
        name = ("".join(rnd.sample(syl, 3))).capitalize()
        line, sic, trade = rnd.choice(lines)
        st, state = rnd.choice(states)
        city = ("".join(rnd.sample(syl, 2)) + "ville").capitalize()
        shares, day = int(10 ** rnd.uniform(6, 9)), f"20{rnd.randrange(10, 24)}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 28):02d}"
        filers.append((i, f"{name} {line} Inc", None, sic, st, city, shares, day, "clash"))
        if i % 3:
            k = rnd.randrange(3, len(name) - 1)
            typo = name[:k] + name[k + 1] + name[k] + name[k + 2 :] if i % 5 == 0 else name
            listings.append((10_000 + i, f"C{i}", f"{typo} {line} Incorporated", trade if i % 4 else None, state if i % 7 else None, city if i % 6 else None, int(shares * rnd.uniform(0.98, 1.02)) if i % 8 else None, day, "clash"))
            truth.add((i, 10_000 + i))
        else:
            listings.append((10_000 + i, f"C{i}", f"{''.join(rnd.sample(syl, 3)).capitalize()} {line} Corp", trade, rnd.choice(states)[1], "Elsewhere", int(10 ** rnd.uniform(6, 9)), "2009-01-01", "clash"))
    f = spark.createDataFrame(filers, "cik long, company_name string, former_name string, sic int, state_code string, city string, shares long, day string, name string").withColumn("first_filed", F.to_date("day"))
    v = spark.createDataFrame(listings, "listing_id long, code string, vendor_name string, industry string, hq_state string, hq_city string, shares long, day string, name string").withColumn("listed_on", F.to_date("day"))
    return f, v, truth


def test_matching(spark):
    f, v, truth = people(spark, 400)
    got = matching.match(f, v).collect()
    pairs = {(r.cik, r.listing_id) for r in got}
    assert len({r.listing_id for r in got}) == len(got) and all(0.5 <= r.confidence <= 1 for r in got)
    assert len(pairs & truth) >= 0.95 * len(truth) and len(pairs & truth) >= 0.98 * len(pairs)


def test_matching_of_nothing_and_nulls(spark):
    f, v, _ = people(spark, 30)
    assert matching.match(f.limit(0), v).collect() == [] and matching.match(f, v.limit(0)).collect() == []
    blank = v.select(*[F.lit(None).cast(t).alias(c) if c != "listing_id" else F.col(c) for c, t in v.dtypes])
    assert matching.match(f, blank).collect() == []

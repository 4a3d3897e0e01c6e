"""The training-data operators against brute force, round trips and awkward rows."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dbpulse.llm import chat, components, decontaminate, embedding_dedup, mixing, near_copies, quality, queries, simhash, suffix_dedup, tokens, toxicity, url_filter
from tests.compare import SF, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=DOCS, source="src0"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in texts], schema)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


# ---- components ---------------------------------------------------------------------


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- 1 SimHash ----------------------------------------------------------------------


def brute_components(codes, distance):
    up = list(range(len(codes)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= distance:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def test_forest_of_one_bucket_is_brute_force():
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    codes = list({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(6))) & (2**64 - 1) for b in base for _ in range(12)})
    i, j = simhash.link_forest(np.zeros(len(codes), np.int64), np.array(codes, np.uint64), 4)
    up = list(range(len(codes)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert [root(x) for x in range(len(codes))] == brute_components(codes, 4)


def test_near_links_lose_no_link(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(60)]
    codes = sorted({b ^ (sum(1 << k for k in r.sample(range(64), r.randrange(7)))) for b in base for _ in range(4)})
    rows = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"))
    got = {x.node: x.component for x in components.connected_components(links).collect()}
    assert [got.get(i, i) for i in range(len(codes))] == brute_components(codes, 4)


def test_fingerprint_counts_repeats_and_lowers_ascii_only(spark):
    def plain(text, n=4):
        import xxhash

        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ")
        s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))

    for text in ("One two Ünd DREI vier", "a b", "a a a a a a a b", "É É é x y z"):
        assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0
    long = words(3000, 1)
    old, simhash.SHINGLES_AT_ONCE = simhash.SHINGLES_AT_ONCE, 100
    try:
        assert simhash.fingerprint(long) == plain(long)
    finally:
        simhash.SHINGLES_AT_ONCE = old


def test_simhash_awkward_rows(spark):
    text = words(300, 2)
    rows = docs(spark, [(5, text), (3, text), (3, text), (9, None), (8, ""), (None, text), (7, words(200, 3))])
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.simhash_groups(rows.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2))).collect())
    assert [(a, c) for a, _, c in got] == [(-1, None), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert {b for a, b, _ in got if a in (8, 9)} == {"0" * 16}
    assert sorted(r.doc_id or -1 for r in simhash.keep_one_per_group(rows).collect()) == [-1, 3, 3, 7, 8]
    assert simhash.simhash_groups(rows.limit(0)).count() == 0


def test_simhash_query_is_brute_force(spark):
    """The whole registered query against plain Python over the whole table."""
    import re

    import xxhash

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    codes = []
    for r in sorted(rows):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        codes.append(sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)))
    ids = sorted(r.doc_id for r in rows)
    roots = brute_components(codes, 4)
    want = [(i, f"{c:016x}", ids[k]) for i, c, k in zip(ids, codes, roots)]
    assert sorted(tuple(r) for r in queries.op1_simhash(spark, SF).collect()) == want


@pytest.mark.parametrize("rows", [3, 50])
def test_large_buckets_are_cut_and_lose_no_link(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
    r = random.Random(16)
    base = [r.getrandbits(64) & ~0xFFFFFFFFFF for _ in range(3)]
    codes = sorted({b ^ (sum(1 << k for k in r.sample(range(64), r.randrange(7)))) for b in base for _ in range(60)})
    made = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)], "fp long, rep long")
    for blocks in (None, 7):
        got = {x.node: x.component for x in components.connected_components(simhash.near_links(made, blocks=blocks)).collect()}
        assert [got.get(i, i) for i in range(len(codes))] == brute_components(codes, 4)


def test_more_blocks_for_more_fingerprints():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**10, 10**12)] == [6, 6, 7, 8]


def near_texts(r):
    """Groups of texts whose copies have some words changed, one group much larger than the rest."""
    out = []
    for group, size in enumerate([60] + [6] * 12):
        base = words(90, 900 + group).split()
        for _ in range(size):
            own = list(base)
            for at in r.sample(range(90), r.randrange(6)):
                own[at] = f"w{r.random()}"
            out.append(" ".join(own))
    return out + ["two words", "Two  WORDS", "", None]


def test_pipeline_near_copies_are_brute_force_at_0_8(spark):
    import corpus_pipeline

    texts = near_texts(random.Random(8))
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else {()} for t in texts]
    up = list(range(len(texts)))
    at = lambda i: i if up[i] == i else at(up[i])
    likes = []
    for i in range(len(texts)):
        for j in range(i):
            like = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            likes.append(like)
            if like >= 0.8:
                a, b = at(i), at(j)
                up[max(a, b)] = min(a, b)
    assert all(any(low <= x < low + 0.05 for x in likes) for low in (0.7, 0.75, 0.8, 0.85, 0.9))
    table = docs(spark, list(enumerate(texts)))
    groups = {r.doc_id: r.group_id for r in near_copies.near_groups(table).collect()}
    assert groups == {i: at(i) for i in range(len(texts))}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()} == {i for i in up if at(i) == i}
    assert corpus_pipeline.drop_near_copies(spark, table.limit(0), "").count() == 0


# ---- 2 URL filter -------------------------------------------------------------------


def test_list_entry_holds_only_while_valid(spark):
    entries = spark.createDataFrame(
        [("domain", "bad.org", "block", "2024-01-10"), ("domain", "bad.org", "remove", "2024-01-20"), ("prefix", "a.bad.org/ok/", "allow", "2024-01-12"), ("host", None, "block", "2024-01-01")],
        "kind string, pattern string, action string, changed_at string",
    ).withColumn("changed_at", F.to_date("changed_at"))
    asked = [(1, "http://A.bad.org/x", "2024-01-09"), (2, "https://a.bad.org:80/x?q", "2024-01-10"), (3, "http://u@a.bad.org/ok/y", "2024-01-15"), (4, "http://bad.org", "2024-01-20"), (5, None, "2024-01-15"), (6, "no url", "2024-01-15"), (7, "http://xbad.org/", "2024-01-15"), (7, "http://xbad.org/", "2024-01-15"), (8, "http://bad.org", None)]
    captures = spark.createDataFrame(asked, "page_id long, url string, d string").withColumn("fetched_at", F.to_date("d"))
    got = sorted((r.page_id, r.verdict) for r in url_filter.judge(captures, entries).collect())
    assert got == [(1, "keep"), (2, "block"), (3, "allow"), (4, "keep"), (5, "keep"), (6, "keep"), (7, "keep"), (7, "keep"), (8, "keep")]
    assert url_filter.judge(captures.limit(0), entries.limit(0)).count() == 0


def test_large_lists_are_shuffled_with_salted_patterns(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    for share in (1, 10_000):
        monkeypatch.setattr(url_filter, "HOT_SHARE", share)
        same(queries.op2_url_filter(spark, SF), queries.ORACLE_SQL["op2_url_filter"])


def test_very_long_paths_make_only_prefixes_of_the_list_s_depths(spark):
    """200,000 segments: all prefixes together would be far beyond memory."""
    entries = spark.createDataFrame([("prefix", "a.org/x/", "block"), ("prefix", "a.org/x/x/x/end", "allow"), ("prefix", "b.org/x/x", "block")], "kind string, pattern string, action string").withColumn("changed_at", F.to_date(F.lit("2024-01-01")))
    urls = [(1, "http://a.org/" + "x/" * 200_000), (2, "http://a.org/x/x/x/end"), (3, "http://b.org/x/x"), (4, "http://b.org/x/x/"), (5, "http://a.org/x"), (6, "http://a.org"), (7, "http://a.org/y/x/")]
    captures = spark.createDataFrame(urls, "page_id long, url string").withColumn("fetched_at", F.to_date(F.lit("2024-02-01")))
    assert {r.page_id: r.verdict for r in url_filter.judge(captures, entries).collect()} == {1: "block", 2: "allow", 3: "block", 4: "keep", 5: "keep", 6: "keep", 7: "keep"}


def test_url_filter_clashing_columns(spark):
    own = ["host", "path", "kind", "pattern", "rank", "verdict", "valid_from", "b", "hot", "salt"]
    captures, entries = queries.captures_of(spark.read.parquet(f"{SF}/pages.parquet")), queries.list_of(spark.read.parquet(f"{SF}/pages.parquet"))
    clash = lambda df: df.select("*", *[F.lit(0).alias(n) for n in own if n not in df.columns])
    got = url_filter.judge(clash(captures), clash(entries))
    same(got, queries.ORACLE_SQL["op2_url_filter"])


# ---- 3 decontamination --------------------------------------------------------------


def test_short_item_in_a_long_document(spark):
    item, far = words(30, 10), words(4000, 11)
    w = item.split()
    near = " ".join(w[:24]) + " " + words(10, 12)  # 20 of 26 shingles: 0.77
    nearer = " ".join(w[:25])  # 21 of 26: 0.81
    rows = docs(spark, [(1, far + " " + item.upper() + "\n" + far), (2, far), (3, near), (4, far + nearer + " zz"), (5, None), (6, ""), (None, item), (7, " ".join((far, nearer)))])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "ab cd"), (1, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, round(r.containment, 2)) for r in decontaminate.contained_items(rows, items).collect())
    assert got == [(1, 1, 1.0), (7, 1, 0.81)]
    assert sorted(r.doc_id or -1 for r in decontaminate.drop_contaminated(rows, items).collect()) == [-1, 2, 3, 4, 5, 6]
    assert decontaminate.contained_items(rows, items.limit(0)).count() == 0


def test_decontamination_clashes_and_stock_phrases(spark):
    stock = words(12, 500)
    items = [(i, " ".join((words(8, 510 + i), stock, words(8, 530 + i)))) for i in range(12)] + [(50, words(3, 560)), (51, stock)]
    texts = [(1, items[4][1]), (2, stock), (3, " ".join((words(500, 570), items[7][1], words(500, 571)))), (4, words(30, 572) + " " + items[12][1]), (5, items[2][1][:60]), (3, words(50, 573))]
    clash = lambda df: df.withColumn("key", F.lit("own")).withColumn("set_id", F.lit(1)).withColumn("w", F.lit(2)).withColumn("__id", F.lit(3))
    rows, tests = clash(docs(spark, texts)), clash(spark.createDataFrame(items, "item_id long, text string"))

    def five(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    held = {}
    for i, t in texts:
        held.setdefault(i, set()).update(five(t))
    want = sorted((d, i) for d, h in held.items() for i, t in items if len(h & five(t)) >= 0.8 * len(five(t)) - 1e-9)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(rows, tests).collect()) == want
    kept = decontaminate.drop_contaminated(rows, tests)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in texts if i not in {d for d, _ in want})


@pytest.mark.parametrize("limits", [(0, 1 << 25), (200_000, 0)])
def test_large_item_tables_are_joined_without_broadcast(spark, monkeypatch, limits):
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", limits[0])
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limits[1])
    same(queries.op3_decontamination(spark, SF), queries.ORACLE_SQL["op3_decontamination"])


# ---- 4 and 7 classifiers ------------------------------------------------------------


def held_out_quality(spark, name, label):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect()}
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    pairs = [(got[r.doc_id].predicted, r[label]) for r in truth if r.doc_id in got and got[r.doc_id].held_out]
    tp = sum(p == t == 1 for p, t in pairs)
    return sum(p == t for p, t in pairs) / len(pairs), tp / max(1, sum(t for _, t in pairs)), tp / max(1, sum(p for p, _ in pairs))


@pytest.mark.parametrize("name, label", [("op4_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    accuracy, recall, precision = held_out_quality(spark, name, label)
    assert accuracy > 0.95 and recall > 0.8 and precision > 0.95


@pytest.mark.parametrize("method", [quality, toxicity])
def test_classifier_awkward_rows(spark, method):
    good, bad = words(80, 20), " ".join(["idiot!!", "SCUM!!"] * 30)
    rows = docs(spark, [(i, good if i % 2 else bad) for i in range(40)] + [(50, None), (51, ""), (None, "x"), (52, words(60_000, 21))]).withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(51, None), (None, 1)], "doc_id long, label int")
    model = method.fit(rows.select("doc_id", "text"), labels)
    scored = method.score(rows, model)
    assert scored.columns == [*rows.columns, "score"]
    got = scored.collect()
    assert len(got) == 44 and all(0 <= r.score <= 1 for r in got)
    nothing = method.fit(rows.select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in method.score(rows, nothing).collect()} == {0.5}
    one = method.fit(rows.select("doc_id", "text"), labels.filter("label = 1"))
    assert min(r.score for r in method.score(rows, one).collect()) > 0.99


def test_trees_walk_as_grown():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.grow(x, y, trees=30)
    assert ((trees.predict(x) > 0.5) == (y == 1)).mean() > 0.97


def test_slots_do_not_hang_on_piece_size(monkeypatch):
    texts = [words(5000, 4).encode().replace(b" ", space) for space in (b" ", b"\n", b"\t", b"\r\n", b"\x0b", b"\x0c  ")]
    texts.append(b"a" * 3000 + b"\t" + b"b" * 3000 + b" c d " + b"e" * 4000)
    whole = [toxicity.slots(t) for t in texts]
    for n in (1, 50):
        monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", n)
        assert all(np.array_equal(toxicity.slots(t), w) for t, w in zip(texts, whole))


@pytest.mark.parametrize("method", [quality, toxicity])
def test_classifier_repeated_rows_clashes_and_empty_tables(spark, method):
    rows = docs(spark, [(i % 20, words(40, i % 20) if i % 2 else " ".join(["idiot!!", "SCUM!!"] * 20)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    assert method.fit(rows, labels).__dict__.keys() == method.fit(rows.dropDuplicates(["doc_id"]), labels).__dict__.keys()
    twice, once = method.score(rows, method.fit(rows, labels)).collect(), method.score(rows, method.fit(rows.dropDuplicates(["doc_id"]), labels)).collect()
    assert len(twice) == 40 and sorted((r.doc_id, r.score) for r in twice) == sorted((r.doc_id, r.score) for r in once)
    clash = rows.withColumn("Score", F.lit("own")).withColumn("__text", F.lit("x")).withColumn("label", F.lit(3)).withColumn("slots", F.lit(4))
    got = method.score(clash, method.fit(clash, labels))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "Score_given", "__text_given", "label", "slots", "score"]
    assert sorted((r.doc_id, r.score) for r in got.collect()) == sorted((r.doc_id, r.score) for r in twice)
    assert {r.Score_given for r in got.collect()} == {"own"}
    none = rows.limit(0)
    assert method.score(none, method.fit(none, labels)).count() == 0
    assert {r.score for r in method.score(rows, method.fit(none, labels)).collect()} == {0.5}


def test_toxicity_sample_is_bounded(spark):
    rows = docs(spark, [(i, words(40 + i, i)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    assert len(toxicity.fit(rows, labels, sample_slots=2_000).index) <= 2_000
    assert {r.score for r in toxicity.score(rows, toxicity.fit(rows, labels, sample_slots=1)).collect()} == {0.5}


# ---- 5 mixing -----------------------------------------------------------------------


def test_pattern_stays_within_one_block():
    weights = {"a": 7, "b": 3, "c": 1, "d": 5}
    period = mixing.pattern(weights)
    taken = dict.fromkeys(weights, 0)
    for slot, source in enumerate(period * 3, 1):
        taken[source] += 1
        assert all(abs(taken[s] - w * slot / 16) < 1 for s, w in weights.items())
    assert {s: period.count(s) for s in weights} == weights


def test_schedule_keeps_every_row_and_the_shares(spark):
    rows = docs(spark, [(i, "x" * 100) for i in range(600)]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b").when(F.col("doc_id") < 580, None).otherwise("zz")).withColumn("slot", F.lit(9))
    rows = rows.unionByName(rows.limit(1)).unionByName(docs(spark, [(None, None)]).withColumn("slot", F.lit(1)))
    got = mixing.schedule(rows, {"a": 3, "b": 1}, 2, block_chars=500).collect()
    assert len(got) == 602
    order = sorted((r.slot, r.mix_rank, r.mix_source) for r in got)
    first = [s for slot, _, s in order if slot < 60]  # all three still have blocks
    assert abs(len({(r.slot) for r in got if r.slot < 60 and r.mix_source == "a"}) - 30) <= 1
    assert set(first) == {"a", "b", "(other)"}
    assert mixing.schedule(rows.limit(0), {"a": 1}).count() == 0
    assert {r["slot_given"] for r in got} == {1, 9}


def placed_one_by_one(rows, weights, block_chars):
    """(source, id, length) -> block and slot of each row, by running totals over the sorted rows of a source."""
    period = mixing.pattern(weights)
    run, rank, out = dict.fromkeys(weights, 0), dict.fromkeys(weights, 0), []
    for order, null_first, source, i, n in sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, s, i, len(t or "")) for i, t, s in rows):
        s = source if source in weights and source != mixing.OTHER else mixing.OTHER
        block, rank[s] = run[s] // block_chars, rank[s] + 1
        run[s] += n
        slot = block // weights[s] * len(period) + [k for k, p in enumerate(period) if p == s][block % weights[s]]
        out.append((s, rank[s], i, n, block, slot))
    return sorted(out, key=str)


def test_schedule_with_null_and_repeated_ids_and_long_texts(spark):
    rows = [(None, None, "a")] * 90 + [(None, "x" * (k % 7), "a") for k in range(80)] + [(5, "y" * k, "b") for k in range(70)] + [(5, "same", "b")] * 60
    rows += [(k, "z" * (k % 11), "ab"[k % 2]) for k in range(100)] + [(1000, "L" * 5_000, "a"), (1001, "L" * 300_000, "b"), (1002, "", "zz")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__part", F.lit("mine"))
    want = placed_one_by_one(rows, {"a": 3, "b": 1, mixing.OTHER: 2}, 100)
    for hot_rows in (20, 10**9):
        got = mixing.schedule(table, {"a": 3, "b": 1}, 2, block_chars=100, hot_rows=hot_rows)
        assert sorted(((r.mix_source, r.mix_rank, r.doc_id, len(r.text or ""), r.block, r.slot) for r in got.collect()), key=str) == want
        assert {r["__part_given"] for r in got.collect()} == {"mine"}
    # rows of one id, and rows that are equal, are in several parts
    sizes = {}
    real = mixing.cut_lineage
    try:
        mixing.cut_lineage = lambda df: real(df) if "__part" not in df.columns or df.agg(F.max("__part")).first()[0] in (0, None) else sizes.setdefault("cut", real(df))
        mixing.schedule(table, {"a": 3, "b": 1}, 2, block_chars=100, hot_rows=20).count()
    finally:
        mixing.cut_lineage = real
    assert sizes["cut"].filter("doc_id is null and text is null").select("__part").distinct().count() > 1


# ---- 6 suffixes ---------------------------------------------------------------------


def brute_repeats(rows, length=50):
    data = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("large", [1, 4096])
def test_repeats_are_brute_force(spark, large):
    r, base = random.Random(3), words(400, 30)
    rows = [(0, base), (4, None), (5, ""), (6, "short"), (None, base[100:300]), (None, base[100:300])]
    for i in range(7, 40):
        a = r.randrange(len(base) - 300)
        part = base[a : a + r.randrange(30, 300)]
        rows.append((i, words(10, i) + part[: len(part) // 2] + r.choice(["", "Ü", "xx"]) + part[len(part) // 2 :] + words(5, i + 100)))
    rows += [(41, "a" * 500), (42, "a" * 300 + "b"), (43, "ab" * 200), (44, "ab" * 90), (0, base[:200]), (45, base[:49]), (46, base[:50]), (47, "é" * 80), (48, "é" * 40)]
    found = suffix_dedup.repeated_passages(docs(spark, rows).withColumn("bucket", F.lit("x")), blocks=5, buckets=3, large=large, texts=True).collect()
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found) == brute_repeats(rows)
    assert all(sum(s.end - s.start for s in x.spans) == x.n_removed and len(x.spans) == x.n_spans for x in found)
    assert suffix_dedup.repeated_passages(docs(spark, []), blocks=2, buckets=2).count() == 0
    clash = docs(spark, rows[:9]).select("*", *[F.lit("own").alias(n) for n in ("n_bytes", "KEPT_text", "spans", "__block")])
    got = suffix_dedup.repeated_passages(clash, blocks=2, buckets=2, texts=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_bytes_given", "KEPT_text_given", "spans_given", "__block_given", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept_text"]
    assert sorted((x["n_bytes"], x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()) == brute_repeats(rows[:9])
    assert {x.spans_given for x in got.collect()} == {"own"}


def test_windows_are_sorted_digit_by_digit():
    r = np.random.default_rng(4)
    around = r.integers(97, 99, (400, 76)).astype(np.uint8)
    around[:, 26:50] = 97
    around[200:, :60] = around[:200, :60]
    key, doc = r.integers(0, 3, 400).astype(np.uint64), r.integers(0, 30, 400)
    key[200:] = key[:200]
    left, right = r.integers(0, 27, 400).astype(np.uint8), r.integers(0, 27, 400).astype(np.uint8)
    got = suffix_dedup._sorted_windows(key, around, left, right, doc, 50)
    first: dict = {}
    inside = [(i, o) for i in range(400) for o in range(27) if left[i] >= 26 - o and right[i] >= o]
    for i, o in inside:
        k = (key[i], o, around[i, o : o + 50].tobytes())
        first[k] = min(doc[i], first.get(k, doc[i]))
    want = np.zeros(400, np.uint32)
    for i, o in inside:
        if first[key[i], o, around[i, o : o + 50].tobytes()] < doc[i]:
            want[i] |= np.uint32(1 << o)
    assert np.array_equal(got, want) and want.any()


def test_long_text_in_pieces(spark, monkeypatch):
    base = words(2000, 31)
    rows = [(1, base), (2, words(20, 32) + base[1000:9000] + words(20, 33))]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    found = suffix_dedup.repeated_passages(docs(spark, rows), blocks=1, buckets=1).collect()
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found) == brute_repeats(rows)


# ---- 8 tokens -----------------------------------------------------------------------


def tokenizer(model):
    from tokenizers import Tokenizer, models, normalizers

    least = min(model.pieces.values())
    vocabulary = [("<unk>", least), *model.pieces.items(), *((f"<0x{b:02X}>", least) for b in range(256))]
    out = Tokenizer(models.Unigram(vocabulary, 0, True))
    out.normalizer = normalizers.Sequence([normalizers.Prepend(tokens.MARK), normalizers.Replace(" ", tokens.MARK)])
    return out


def test_counts_are_the_tokenizers(spark):
    import public_tokenizers

    model = tokens.read_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))
    exact = tokenizer(model)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", " ", "a  b   ", "☃☃x", "  lead", "日本語", "a\n\nb", "▁▁x ▁y", words(20_000, 40)]
    rows = docs(spark, list(enumerate(texts)) + [(None, None)]).withColumn("n", F.lit(1))
    clash = docs(spark, [(1, "a b"), (1, "a b"), (2, None)]).withColumn("n_tokens", F.lit("own")).withColumn("__text", F.lit(1))
    twice = tokens.count_tokens(clash, model)
    assert twice.columns[5:] == ["n_tokens_given", "__text_given", "n_tokens"] and sorted((r.doc_id, r.n_tokens) for r in twice.collect()) == [(1, 2), (1, 2), (2, 0)]
    assert tokens.count_tokens(clash.limit(0), model).count() == 0
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(rows, model).collect()}
    assert got[None] == 0
    assert [got[i] for i in range(len(texts))] == [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ties_keep_the_earliest_start():
    model = tokens.Unigram({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0, "▁ab": -3.0})
    exact = tokenizer(model)
    for text in ("a", "ab", "aab", "abab ab", "b"):
        assert tokens.Counter(model).count(text) == len(exact.encode(text, add_special_tokens=False).ids)


# ---- 9 embeddings -------------------------------------------------------------------


def test_vectors_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MEMBERS", 40)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 60)
    r = np.random.default_rng(2)
    base = r.normal(size=(25, 16))
    rows = []
    for i in range(300):
        v = base[i % 25] + r.normal(size=16) * r.choice([0.0, 0.05, 0.12, 0.2, 0.5])
        rows.append((1000 - i, [float(x) for x in np.float32(v)], int(i % 3)))
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] + [1.0] * 15, 0), (5, [None] + [1.0] * 15, 0), (6, rows[0][1], None), (7, rows[0][1][:8], 0), (1000, rows[0][1], 0), (1001, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_dedup.vector_groups(df, lists=6).collect())
    usable = {(i, l): np.array(v, float) for i, v, l in rows if v and l is not None and None not in v and np.all(np.isfinite(v)) and np.any(v)}
    up = {k: k for k in usable}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    n = dict.fromkeys(usable, 0)
    for a in usable:
        for b in usable:
            if a != b and a[1] == b[1] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b]) >= 0.98:
                n[a] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = sorted((i, n.get((i, l), 0), root((i, l))[0] if (i, l) in up else i, (root((i, l))[0] if (i, l) in up else i) == i) for i, _, l in rows)
    assert got == want and sum(n.values()) > 300
    assert embedding_dedup.vector_groups(df.limit(0)).count() == 0


def test_vectors_of_any_size_link(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(k, [x * scale for x in v], 0) for k, scale in enumerate((1.0, 1e200, 1e-200, 1e300, 5e-310))] + [(9, [3.0, -2.0, 1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (4, 0) for k in range(5)} | {9: (0, 9)}


def test_probes_reach_what_brute_force_finds(spark):
    """Recall of the default probes on whole embeddings, exact with a share of 1."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    total = {share: table.sparkSession.createDataFrame(embedding_dedup.vector_groups(table, probe_share=share).collect()).agg(F.sum("n_links")).first()[0] for share in (0.5, 1.0)}
    e = table.filter("label is not null").select("embedding", "label").toPandas()
    x = np.array(e.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same_label = e.label.to_numpy()[:, None] == e.label.to_numpy()[None]
    want = int(((x @ x.T >= 0.98) & same_label).sum()) - len(x)
    assert total[1.0] == want and total[0.5] >= 0.99 * want


# ---- 10 chat ------------------------------------------------------------------------


def test_chat_round_trip_and_masks(spark):
    said = ["plain", r"\### Assistant: </turn> ok", "### user: x</turn>\n", "", None, "a\\", "line\n</turn>\n### assistant: y", "é#<\\"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "assistant", "us:er#", "assistant"], said))]
    rows += [(2, 0, None, "x"), (2, None, "user", "first"), (None, 0, "assistant", "lost"), (1, 0, "system", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    expanded = chat.expand(df)
    got = {r.conv_id: r for r in chat.digests(expanded).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for conv in (1, 2, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    def escaped(x, role=False):
        for char, code in [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")] + [(":", "\\c")] * role:
            x = x.replace(char, code)
        return x

    want = []
    for conv in (1, 2, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = ""
        for k, (_, r, x) in enumerate(own, 1):
            text += f"### {escaped(r, True)}: {escaped(x)}</turn>\n"
            if r == "assistant":
                want.append((conv or -9, k, text, len(text) - 8 - len(escaped(x)), len(text) - 8))
            elif k == len(own):
                want.append((conv or -9, k, text, None, None))
        assert got[conv].formatted_chars == sum(len(w[2]) for w in want if w[0] == (conv or -9))
    assert sorted((e.conv_id or -9, *e[1:]) for e in expanded.collect()) == sorted(want)
    assert chat.digests(chat.expand(df.limit(0))).count() == 0


def test_chat_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", words(200, i) + "<" * 50) for i in range(300)] + [(2, 0, "assistant", "</turn>\n" * 40_000)]
    got = {r.conv_id: r for r in chat.digests(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv, n in ((1, 300), (2, 1)):
        loss = "".join(x for c, _, r, x in rows if c == conv and r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_ids_that_stand_for_several_vectors_or_labels(spark, tmp_path):
    """Links of an id are added up and reach on through it, as the SQL says."""
    a, b, far = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (2, b, 1), (1, a, 2), (3, b, 2), (4, far, 1), (5, a, None), (5, far, 3), (6, far, 3), (1, None, 1), (None, a, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op9_embedding_dedup(spark, str(tmp_path))
    have = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got.collect())
    assert have == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False)]
    same(got.filter("vec_id is not null"), queries.OP9_SQL.replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet' WHERE vec_id IS NOT NULL"))


def test_many_lists_are_fitted_in_two_levels(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ONE_LEVEL", 8)
    x = np.random.default_rng(1).normal(size=(600, 5))
    centres = embedding_dedup._centroids(x / np.linalg.norm(x, axis=1, keepdims=True), 40)
    assert 30 <= len(centres) <= 50 and np.isfinite(centres).all()


# ---- queries and pipeline -----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    clean = {i: words(120, 200 + i) for i in range(12)}
    item = words(30, 300)
    rows = [(i, t) for i, t in clean.items()] + [(20, clean[3]), (21, words(60, 301) + " " + item + " " + words(60, 302)), (22, words(50, 303) + " " + clean[5][:400] + " " + words(50, 304)), (23, None), (24, "")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*clean, 22, 23}
    assert all(got[i].text == t for i, t in clean.items())
    assert clean[5][:400] not in got[22].text and got[22].n_chars == len(got[22].text)
    assert len({r.mix_rank for r in got.values()}) == len(got)
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == [f.split()[0] for f in DOCS.split(", ")]


def test_pipeline_awkward_tables(spark, tmp_path):
    """Clashing columns come back from each stage, repeated rows stay repeated, an empty table passes."""
    import corpus_pipeline

    text, item = words(120, 400), words(30, 401)
    rows = [(1, text), (1, text), (2, None), (2, None), (None, words(90, 402)), (3, text + " " + words(3, 403)), (4, words(60, 404) + " " + item), (5, text[:300] + words(80, 405))]
    clash = ["score", "N_Bytes", "kept_text", "spans", "block", "slot", "__id", "mix_rank", "n_removed", "component_id"]
    given = docs(spark, rows)
    for k, name in enumerate(clash):
        given = given.withColumn(name, F.lit(f"own {k}"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given.write.parquet(f"{tmp_path}/full/documents.parquet")
    out = given
    # without labels every score is 0.5, so nothing may be rejected by the limit here
    old, corpus_pipeline.TOXIC_FROM = corpus_pipeline.TOXIC_FROM, 0.6
    try:
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == given.columns
        last = corpus_pipeline.mix_sources(spark, out, "").collect()
        assert sorted(r.doc_id or -1 for r in last) == [-1, 1, 1, 2, 2, 5]
        assert {r["N_Bytes"] for r in last} == {"own 1"} and {r["block_given"] for r in last} == {"own 4"} and {r["slot_given"] for r in last} == {"own 5"}
        empty = given.limit(0)
        for _, stage in corpus_pipeline.STAGES:
            empty = stage(spark, empty, str(tmp_path))
            assert empty.count() == 0
    finally:
        corpus_pipeline.TOXIC_FROM = old


def test_operators_run_where_the_package_is_not(tmp_path):
    """Executors get functions and models by value: workers are started in another folder, without this package on their path."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    program = f"""
import sys, os
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "shared").getOrCreate()
from dbpulse.llm import queries
def seen(batches):
    import importlib.util
    for batch in batches:
        assert importlib.util.find_spec("dbpulse") is None
        yield batch
assert spark.range(1).mapInArrow(seen, "id long").count() == 1
for name in ("op1_simhash", "op4_quality", "op6_suffix_dedup", "op7_toxicity", "op8_token_counts", "op9_embedding_dedup"):
    assert queries.QUERIES[name](spark, {SF!r}).count() > 0
"""
    clean = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


def test_scoring_sends_no_text_back_from_python(spark):
    rows = docs(spark, [(1, "a b"), (2, None), (2, ""), (None, "a b")])
    scored = toxicity.score(rows, toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0, toxicity.BITS))
    assert [r.score for r in scored.collect()] == [0.5] * 4
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan

"""The operators against plain versions: hand-made rows, and whole small tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.llm import archives, classifier, decontaminate, hosts, licenses, mixing, near_dups, quality, sharding, substrings
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
CLASHES = "n_words long, hits string, items string, shard string, slot int, features string, score string, kept_text string, __held int"
WORDS = [f"w{i}" for i in range(400)]


def passage(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


def tricky_texts():
    """Null, empty, blank, short, exact and near copies, ties, a long text, odd characters."""
    base = passage(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (0, passage(0, 40)),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "One  two"),
        (6, base),
        (7, base),
        (7, base),
        (8, near),
        (9, passage(9, 30) + "\n" + base[:400] + " " + passage(10, 30)),
        (10, " ".join([passage(11, 20)] * 6)),
        (11, passage(12, 30_000)),
        (12, "É ñ ß " * 30 + "x\x00y \x1c z\u00a0q \ud7ff 漢字 #*|"),
        (13, "ONE two"),
        (None, base),
        (None, None),
        (14, "Same line here\nSame line here\n\nother\n" * 20),
        (15, "w" * 70_000 + " " + passage(1, 60)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    """The tricky texts with clashing extra columns, over several partitions."""
    rows = spark.createDataFrame([(i, t, None if i == 3 else f"s{(i or 0) % 4}") for i, t in tricky_texts()], "doc_id long, text string, source string")
    extra = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in CLASHES.split(", "))]
    return rows.select("*", *extra).repartition(5)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


def tables(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


# Benchmark decontamination

ITEMS = [(1, passage(1, 120)), (2, "one"), (2, "one"), (3, None), (4, ""), (5, "É ñ ß é"), (6, passage(10, 12)), (None, passage(0, 12)), (7, "w1 w2 w3")]


@pytest.mark.parametrize("block_rows", [2_000_000, 40])
def test_decontamination(spark, docs, block_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_benchmark_words(docs, items, block_rows=block_rows)
    assert set(found.columns) == set(docs.columns)
    found = found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), "items")
    got = [(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found.collect()]
    want = brute.contamination(tricky_texts(), ITEMS)
    assert ordered(g[:3] for g in got) == ordered(w[:3] for w in want)
    by_id = {w[0]: w[3] for w in want}
    assert all(len([x for x in g[3].split(",") if x]) == by_id[g[0]] for g in got if g[0] is not None)


def test_decontamination_without_rows_or_items(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_benchmark_words(docs, none).where(F.size("hits") > 0).count() == 0
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_benchmark_words(nothing, items).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    hit = Counter(w[0] for w in brute.contamination(tricky_texts(), ITEMS) if w[5])
    assert kept.count() == len(tricky_texts()) - hit.total()


# Removal of repeated passages


def test_substrings(docs, nothing):
    got = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows(got, "*") == ordered(brute.repeats(tricky_texts()))
    assert substrings.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("span", [4, 8, 13, 30])
def test_substrings_at_any_offset(spark, span):
    shared = passage(5, span)
    texts = [(i, f"{passage(100 + i, i)} {shared} {passage(200 + i, 9)}") for i in range(26)]
    got = substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), span=span)
    assert rows(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)), "*") == ordered(brute.repeats(texts, span))


# Near-duplicates


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, nothing, words):
    got = near_dups.near_duplicates(docs, words=words)
    want = [(d, n, c if n else d) for d, n, c in brute.similar_components([x for x in tricky_texts() if x[0] is not None], words, 0.8)]
    assert rows(got.where("doc_id is not null"), "*") == ordered(want)
    assert got.where("doc_id is null and component_id is not null").count() == 0
    assert near_dups.near_duplicates(nothing).count() == 0


def test_large_group_of_near_copies_is_one_component(spark):
    base = passage(3, 300).split()
    texts = []
    for i in range(600):
        draw, copy = random.Random(i), list(base)
        for _ in range(4):
            copy[draw.randrange(300)] = f"edit{draw.randrange(10_000)}"
        texts.append((i, " ".join(copy)))
    texts += [(1000 + i, passage(5000 + i, 80)) for i in range(100)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame, words=2).collect()}
    want = {d: c for d, _, c in brute.similar_components(texts, 2, 0.8)}
    assert got == want
    assert near_dups.keep_one_of_each(frame, words=2).count() == len(set(want.values()))


def test_star_of_copies_that_only_their_original_links(spark):
    """Each copy is near its original but far from the other copies; plain sets prove every link."""
    base, copies = passage(3, 300).split(), 2500
    texts = [(copies, " ".join(base))]
    for i in range(copies):
        draw, copy = random.Random(i), list(base)
        for _ in range(5):
            copy[draw.randrange(300)] = f"edit{draw.randrange(1_000_000)}"
        texts.append((i, " ".join(copy)))
    sets = [brute.shingles(t, 5) for _, t in texts]
    assert all(10 * len(s & sets[0]) >= 8 * len(s | sets[0]) for s in sets)
    got = near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=5)
    assert {r.component_id for r in got.collect()} == {0}, "recall below 1"


@pytest.mark.parametrize("block", [7, 4096])
def test_region_links_join_what_a_region_holds(spark, block):
    """Of one region with a large component and many single classes; blocks put out a forest."""
    base = passage(4, 200).split()
    texts = [(i, " ".join([*base[: 40 + i % 3], f"x{i}", *base[41 + i % 3 :]])) for i in range(60)] + [(60 + i, passage(900 + i, 50)) for i in range(9)]
    held = spark.createDataFrame(texts, "node long, text string")
    regions = held.select(F.lit(1).cast("long").alias("part"), "node", F.lit(200).cast("long").alias("n_shingles"))
    comps = held.select("node", F.when(F.col("node") < 20, 0).otherwise(F.col("node")).cast("long").alias("comp"))
    links = near_dups.region_links(regions, comps, held, 5, 80, block=block)
    joined = {r.node: r.comp for r in near_dups.merged(comps, links).collect()}
    want = {d: c for d, _, c in brute.similar_components(texts, 5, 0.8)}
    assert joined == want and set(want.values()) == {0, *range(60, 69)}
    assert links.count() == 40 if block == 4096 else links.count() <= 40 * -(-69 // block) * 2
    assert near_dups.region_links(regions, comps.withColumn("comp", F.lit(7).cast("long")), held, 5, 80).count() == 0


def test_linked_is_exact():
    draw = random.Random(6)
    import numpy as np

    sets = [np.array(sorted(draw.sample(range(60), draw.randrange(20, 50))), np.uint64) for _ in range(80)]
    comp = np.arange(80) // 2
    found = near_dups.linked(sets, comp, np.arange(40), np.arange(80), 70)
    assert len(found) < 40
    up = dict.fromkeys(range(40))
    root = lambda x: x if up[x] is None else root(up[x])

    def join(pairs):
        for key in up:
            up[key] = None
        for a, b in pairs:
            if root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
        return [root(c) for c in range(40)]

    near = lambda x, y: 100 * len(x & y) >= 70 * len(x | y)
    plain = [set(s.tolist()) for s in sets]
    assert join(found) == join([(comp[i], comp[j]) for i in range(40) for j in range(80) if near(plain[i], plain[j])])


def test_rows_that_share_an_id_are_each_linked_by_their_text(spark):
    one, two, three = passage(1, 100), passage(2, 100), passage(3, 100)
    texts = [(1, one), (1, two), (1, two), (2, one + " more"), (3, two + " more"), (4, three), (4, three), (5, ""), (5, None), (5, three + " x"), (None, one)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("__row", F.lit(1)).repartition(4)
    got = near_dups.near_duplicates(frame)
    assert rows(got, "doc_id", "component_id") == ordered([(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (5, 5), (5, 4), (None, None)])
    kept = near_dups.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert rows(kept, "doc_id", "text") == ordered([(1, one), (1, two), (4, three), (5, ""), (5, None), (None, one)])


def test_keep_one_of_each_keeps_columns_and_rows_without_id(docs):
    kept = near_dups.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 2
    assert kept.where("doc_id in (6, 7, 8)").count() == 1


# Mixing


def test_mix_reaches_targets(spark):
    draw = random.Random(1)
    units = [(i, f"s{i % 3}" if i % 10 else None, draw.randrange(0, 900)) for i in range(3000)]
    units += [(9000 + i, "hot", draw.randrange(1, 900)) for i in range(2000)]
    frame = spark.createDataFrame(units, "doc_id long, source string, size long")
    got = mixing.mix(frame, chunk_units=200).collect()
    sizes = Counter()
    for _, source, size in units:
        sizes[source] += size
    want = brute.water_fill(sizes)
    taken = Counter()
    for r in got:
        assert r.copies in (0, 1, 2)
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.copies * r["size"] * r.n_rows
    for source, words in taken.items():
        assert words == pytest.approx(want[source], rel=0.002)
    again = mixing.mix(frame.repartition(7), chunk_units=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_tricky_rows(docs, nothing):
    units = docs.select("doc_id", "source", mixing.text_words(F.col("text")).alias("size"))
    assert mixing.mix(units).agg(F.sum("n_rows")).first()[0] == docs.count()
    assert mixing.mix(nothing.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert taken.count() > 0


def test_sources_of_repeated_rows_come_near_their_target(spark):
    """A source that is one row many times, beside one of many chunks and one of few long rows."""
    units = [(1, "a", 100)] * 1000 + [(10 + i, "b", 50 + i % 90) for i in range(2000)] + [(5000 + i, "c", 300) for i in range(200)] + [(6000, None, 7)] * 3
    frame = spark.createDataFrame(units, "doc_id long, source string, size long").repartition(3)
    taken, rows_of = Counter(), Counter()
    target = {}
    for r in mixing.mix(frame, chunk_units=150).collect():
        taken[r.source] += r.copies * r["size"] * r.n_rows
        rows_of[r.source] += r.n_rows
        target[r.source] = r.target
        assert r.copies <= 2
    assert rows_of == Counter(s for _, s, _ in units)
    assert all(abs(taken[s] - target[s]) <= 300 for s in taken)
    texts = [(d, " ".join(["w"] * n), s, f"row {i}") for i, (d, s, n) in enumerate(units)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, name string").repartition(4)
    got = mixing.take_mix(docs)
    times = Counter(r.name for r in got.collect())
    assert max(times.values()) <= 2 and got.columns == docs.columns
    words = got.where("source = 'a'").count() * 100
    assert abs(words - target["a"]) <= 300


# Archives

PAGES = [
    (1, "http://a.example.com/x?y=1", "one"),
    (2, "https://B.example.com:80/x", "one"),
    (3, None, None),
    (4, "no url", ""),
    (5, "http://a.example.com/x?y=1", "one"),
    (5, "http://a.example.com/x?y=1", "one"),
    (None, "http://c.example.org", "one"),
    (7, "http://c.example.org/\r\nWARC-Type: odd", "é" * 90_000 + "\r\n\r\nWARC/1.1\r\n"),
]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    place = archives.archive_folder(spark)
    directory = archives.write_index(archives.write_archive(pages, place), place, block_lines=2)
    got = archives.read_archive(directory, place)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == ordered(brute.captures([(p, h) for p, _, h in PAGES]))
    texts = {(r.page_id, bytes(r.payload).decode()) for r in got.where("record_type = 'response'").collect()}
    assert texts == {(1, "one"), (3, ""), (None, "one"), (7, PAGES[-1][2])}
    assert directory.count() >= 4
    found = archives.look_up(directory, place, ["com,example,a)/x?y=1", "missing", "org,example,c)"])
    assert sorted(str(r.page_id) for r in found.collect()) == ["1", "5", "5", "None"]


def test_searches_find_every_capture_of_a_key_once(spark):
    """One key over many blocks, keys between blocks, missing keys, a directory in several parts."""
    urls = ["http://hot.example.com/"] * 90 + [f"http://h{i % 13}.example.org/{i % 29}" for i in range(160)] + [None, "", "é漢://ﬁ.x/𝄞", "é漢://\ue000.x/"]
    pages = spark.createDataFrame([(i, u, f"body {i % 50}") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(4)
    place = archives.archive_folder(spark)
    directory = archives.write_index(archives.write_archive(pages, place), place, block_lines=7)
    keyed = pages.select("page_id", archives.capture_key(F.col("url")).alias("key")).collect()
    everything = spark.createDataFrame([(r.key,) for r in keyed] + [("missing",), (None,)], "key string")
    for size in (200_000, 5):
        got = archives.find_captures(directory, place, everything, payloads=False, directory_rows=size)
        assert sorted(r.page_id for r in got.collect()) == list(range(len(urls)))
        asked = spark.createDataFrame([("com,example,hot)/",), ("org,example,h3)/3",), ("zzz",), ("a",)], "key string")
        some = archives.find_captures(directory, place, asked, directory_rows=size)
        assert sorted(r.page_id for r in some.collect()) == sorted(r.page_id for r in keyed if r.key in ("com,example,hot)/", "org,example,h3)/3"))
    whole = archives.read_archive(directory, place)
    assert whole.count() == len(urls)


def test_small_payloads_are_all_responses_and_empty_archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    place = archives.archive_folder(spark)
    lines = archives.write_archive(pages, place, least_bytes=4)
    assert lines.where("type = 'revisit'").count() == 0
    empty = archives.archive_folder(spark)
    directory = archives.write_index(archives.write_archive(pages.where("false"), empty), empty)
    assert archives.read_archive(directory, empty).count() == 0


# License scans


def test_license_places(spark, docs, nothing):
    texts = [
        (1, "Under the MIT  License, or the GNU General-Public License; mit license."),
        (2, "cc by cc by cc byte xcc by"),
        (3, None),
        (4, "the apachee license and the mitlicense"),
        (5, "Permission is hereby granted, free of charge to any persn obtaining a copi"),
        (6, "apache licences are odd, acpache license"),
        (7, "mit\nlicense é mit license"),
        (8, passage(3, 500)),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    for i, text in texts:
        n, n_base, first, last, labels = brute.license_places(text)
        at = [p.word for p in got[i].places]
        assert (got[i].n_words, len(at), min(at, default=None), max(at, default=None)) == (n, n_base, first, last)
        assert ",".join(sorted({p.label for p in got[i].places})) == labels
    assert {n.label for n in got[4].notices} >= {"apache"}
    assert {n.label for n in got[5].notices} == {"mit"} and got[5].notices[0].edits == 2 and 0 < got[5].score < 1
    assert got[8].score == 0 and not got[8].notices
    assert licenses.scan_licenses(docs).count() == docs.count()
    assert licenses.scan_licenses(nothing).count() == 0


def test_notices_side_by_side_are_all_reported(spark):
    """Whichever of them are exact, and beside hundreds of others."""
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    spans = lambda text: [(n, a, e) for n, a, _, e in scanner.scan(licenses.fold(text.encode()))[1] if n == "apache"]
    assert [e for _, _, e in spans("apach license apache license apache licens")] == [1, 0, 1]
    assert [e for _, _, e in spans("apache license apach license")] == [0, 1]
    forms = ["apache license", "apach license", "apache licens", "apache license"]
    draw = random.Random(9)
    told = [draw.choice(forms) for _ in range(300)]
    assert len(spans(" and ".join(told))) == 300
    frame = spark.createDataFrame([(1, " and ".join(told))], "doc_id long, text string")
    notices = [n for n in licenses.scan_licenses(frame).first().notices if n.label == "apache"]
    assert [n.first_word for n in notices] == list(range(0, 900, 3)) and [n.edits for n in notices] == [int(t != forms[0]) for t in told]
    assert all(n.last_word == n.first_word + 1 for n in notices)


def test_seeds_find_what_a_full_search_finds():
    draw = random.Random(4)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    for _ in range(150):
        n = draw.choice(licenses.NOTICES)
        text = list(n.text)
        for _ in range(draw.randrange(n.edits + 1)):
            at = draw.randrange(len(text))
            text[at : at + 1] = draw.choice(["", "x", text[at] + "q"])
        body = licenses.fold(f"{passage(draw.random(), 6)} {''.join(text)} {passage(draw.random(), 6)}".encode())
        i = licenses.NOTICES.index(n)
        if scanner.patterns[i].search(body):
            assert n.label in {x[0] for x in scanner.scan(body)[1]}


# Quality classifier


def test_classifier_on_held_out_rows(spark):
    scored = entry.queries()["op6_quality_classifier"](spark, "/root/testdata/sf0.01")
    both = scored.join(tables(spark, "labels").select("doc_id").limit(0).unionByName(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), allowMissingColumns=True), "doc_id")
    held = both.where("held_out")
    right = held.where("predicted = quality").count() / held.count()
    most = max(r["count"] for r in held.groupBy("quality").count().collect()) / held.count()
    assert right > 0.95 and right > most


def test_classifier_of_tricky_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 0), (6, 1), (10, 0), (12, None), (None, 1), (99, 1), (14, 7)], "doc_id long, label int")
    model = classifier.train(docs, labels)
    got = classifier.score_quality(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "score"]
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.count() == docs.count()
    none = classifier.train(nothing, labels)
    assert classifier.score_quality(docs, none).agg(F.countDistinct("score")).first()[0] == 1
    assert classifier.score_quality(nothing, model).count() == 0


# Quality rules


def test_clean_texts_are_kept_at_any_length_and_in_any_script(spark):
    draw = random.Random(2)
    prose = lambda n, letters: " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(n))
    english = " ".join(draw.choice(["the", "of", "and"]) if draw.random() < 0.3 else f"w{draw.randrange(30_000)}" for _ in range(150_000))
    texts = [(1, english), (2, prose(206, "абвгдежзиклмнопрстуфх")), (3, prose(120, "漢字仮名交じり文章")), (4, prose(300, "αβγδεζηθικλμν")), (5, prose(200, "qwxzjk"))]
    kept = quality.keep_good(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]


def test_quality_counts(docs, nothing):
    got = quality.measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("f"))
    assert rows(got, "*") == ordered((i, *brute.quality_counts(t)) for i, t in tricky_texts())
    assert quality.measured(nothing).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert all(not brute.quality_counts(r.text)[5] for r in kept.collect())


def test_rules_reject_junk_and_keep_prose(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = entry.queries()["op7_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0
    assert got.where("quality = 0 and kept").count() == 0


# Sharding


def test_shards_are_exact_and_gapless(spark, docs, nothing):
    frame = spark.range(2003).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("slot"))
    got = sharding.shuffle_into_shards(frame, [F.col("doc_id")], shards=8, part_rows=100)
    held = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    assert len(held) == 8
    assert all(r.lo == 0 and r.hi == r.n - 1 and r.d == r.n for r in held)
    assert max(r.n for r in held) - min(r.n for r in held) <= 1
    assert got.select("doc_id").distinct().count() == 2003
    again = sharding.shuffle_into_shards(frame.repartition(9), [F.col("doc_id")], shards=8, part_rows=100)
    assert rows(got, "doc_id", "shard", "slot") == rows(again, "doc_id", "shard", "slot")
    assert sharding.shuffle_into_shards(docs, [F.col("doc_id"), F.col("text")], shards=30).count() == docs.count()
    assert sharding.shuffle_into_shards(nothing, [F.col("doc_id")]).count() == 0


def test_communication_matrix():
    parts = [7, 0, 1000, 13, 250_000, 3]
    matrix = sharding.communication_matrix(parts, 8, seed=3)
    assert [sum(r) for r in matrix] == parts
    columns = [sum(c) for c in zip(*matrix, strict=True)]
    assert max(columns) - min(columns) <= 1
    assert min(x for r in matrix for x in r) >= 0
    draw = random.Random(0)
    mean = sum(sharding.hypergeometric(draw, 30, 70, 20) for _ in range(4000)) / 4000
    assert mean == pytest.approx(6, abs=0.15)
    assert sharding.hypergeometric(draw, 10**11, 7 * 10**11, 10**8) == pytest.approx(10**8 / 8, rel=0.01)


# URL filters


def test_url_parts_and_rules(spark):
    urls = [
        None, "", "no scheme/en/", "http://A.Example.COM/en/7?x#y", "http://x.com/en/1", "http://xcom/en/", "http://com/en/", "s://a://b.net/de/8",
        "http://example.net/de/81", "http://sub.example.net/de/8/x", "http://b.org?/es/", "http://b.org/es/#/", "http://ÀB.org/es/", "http://h.org\n/es/x", "://x.net/de/",
        "http://u@h.co.uk:81/p", "http://1.2.3.4/en/",
    ]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    rules = [hosts.UrlRule(*r) for r in brute.RULES]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.filter_urls(frame, none, rules).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute.url_parts(u)
        assert got[i] == (host, path, rule, verdict or "allow"), u
    assert hosts.filter_urls(frame.where("false"), none, rules).count() == 0


def test_reputation_shrinks_towards_domain_and_suffix(spark):
    pages, labels = [], []

    def add(host, n, bad, labelled=True):
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            if labelled:
                labels.append((len(pages) - 1, i < bad))

    for k in range(20):
        add(f"good{k}.clean.com", 30, 1)
        add(f"bad{k}.spam.net", 30, 29)
    add("new.spam.net", 3, 0, labelled=False)
    add("new.clean.com", 3, 0, labelled=False)
    add("one.clean.com", 1, 1)
    labels += [(0, True), (10**6, True), (None, True), (1, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = hosts.filter_urls(frame, spark.createDataFrame(labels, "page_id long, bad boolean"), [])
    verdicts = {(r.host, r.verdict) for r in got.collect()}
    assert ("new.spam.net", "block") in verdicts
    assert {("new.clean.com", "allow"), ("one.clean.com", "allow"), ("good3.clean.com", "allow"), ("bad3.spam.net", "block")} <= verdicts

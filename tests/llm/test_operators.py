"""Each operator against brute force on small tables full of odd cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, graph, html, jaccard, lines, packing, quality, queries, substring, tokens, toxicity, warc

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, length int, start string"


def table(spark, docs, schema=SCHEMA):
    """Documents with extra columns whose names the operators use themselves."""
    rows = docs.items() if isinstance(docs, dict) else docs
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", 1, "y") for k, t in rows], schema)


def words(draw, n, vocabulary=60):
    return [f"w{draw.randrange(vocabulary)}{draw.choice(['', '', ',', 'É'])}" for _ in range(n)]


def corpus(seed=3):
    """Null, empty, blank, short, long, copied, near-copied and overlapping texts."""
    draw = random.Random(seed)
    base = words(draw, 160, 400)
    docs = {0: " ".join(base), 1: None, 2: "", 3: " \n\t ", 4: "One two", 5: "one  TWO"}
    for i in range(6, 30):
        w = list(base)
        for _ in range(draw.choice([0, 1, 2, 5, 9])):
            w[draw.randrange(len(w))] = f"new{draw.randrange(99)}"
        docs[i] = " ".join(w)
    for i in range(30, 50):
        w = words(draw, draw.randrange(5, 200))
        at = draw.randrange(100)
        docs[i] = "\n".join([" ".join(w), " ".join(base[at : at + draw.randrange(20, 60)]), " ".join(words(draw, 9, 5))])
    docs[50], docs[51] = docs[30], docs[0].upper()
    docs[52] = " ".join(words(draw, 6000, 3000)) + " " + docs[0]
    docs[53] = "same words again and again " * 40
    return docs


def test_op1_round_trip_random_access_and_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    docs = corpus() | {60: "don't WE'LL 'so 3.14 <|endoftext|>\x1c İ ﬁ ǅ 你好 👍🏽", 61: "a b c ßÉ×÷"}
    out = f"file://{tmp_path}/tokens"
    tokens.write_token_files(table(spark, docs), out, path, partitions=3)
    whole = Tokenizer.from_file(path)
    want, at = {}, 0
    for k in sorted(docs):
        ids = [*whole.encode(docs[k] or "", add_special_tokens=False).ids, 1]
        want[k] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in tokens.read_tokens(spark, out).collect()}
    assert got == want
    stream = [i for k in sorted(docs) for i in want[k][3]]
    for start, count in ((0, 5), (at // 2, 700), (at - 3, 10)):
        assert tokens.read_range(spark, out, start, count).tolist() == stream[start : start + count]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_op1_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_000).astype(np.uint32)
    payload = tokens.pack(ids, bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    assert (tokens.unpack(payload, bits, 0, len(ids)) == ids).all()
    assert (tokens.unpack(payload, bits, 12_345, 77) == ids[12_345:12_422]).all()


def test_op1_repeated_and_null_ids_and_empty_table(spark, tmp_path):
    path = queries.tokenizer_path()
    tokens.write_token_files(table(spark, [(1, "b"), (1, "a"), (None, "c"), (1, "a")]), f"file://{tmp_path}/a", path)
    got = [(r.doc_id, r.start, r.n_tokens) for r in tokens.read_tokens(spark, f"file://{tmp_path}/a").orderBy("start").collect()]
    assert got == [(None, 0, 2), (1, 2, 2), (1, 4, 2), (1, 6, 2)]
    tokens.write_token_files(table(spark, []), f"file://{tmp_path}/b", path)
    assert tokens.read_tokens(spark, f"file://{tmp_path}/b").count() == 0


def test_op2_against_brute_force(spark, monkeypatch):
    docs = corpus()
    base = docs[0].split()
    items = {1: " ".join(base[10:40]), 2: " ".join(base[20:26]).upper(), 3: "w1", 4: None, 5: "", 6: ";;;", 7: " ".join(base[10:23]), 8: " ".join(words(random.Random(9), 30))}
    want = brute.contamination(docs, items)
    frame = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for size in (decontaminate.BLOCK_WINDOWS, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", size)
        judged = decontaminate.contamination(table(spark, docs), frame).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("h"), "contaminated")
        assert {r[0]: tuple(r)[1:] for r in judged.collect()} == want
    none = decontaminate.contamination(table(spark, docs), frame.limit(0))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == len(docs)
    assert decontaminate.contamination(table(spark, []), frame).count() == 0


def test_op2_same_id_other_text_and_nul(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = decontaminate.contamination(table(spark, [(1, "alpha\x00beta gamma"), (1, "other"), (None, "x alpha beta gamma")]), item).orderBy("n_words").collect()
    assert [(r.doc_id, r.n_words, r.n_hit) for r in rows] == [(1, 1, 0), (1, 3, 3), (None, 4, 3)]


def test_op3_article_of_awkward_pages():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="post"><header><h1>Site</h1><p>Welcome to all of the pages that we have for you and for your friends on this site.</p></header>
    <div id="cookie-notice"><p>We use cookies so that this is better for all of you, and by going on you agree to it.</p></div>
    <article class="post"><h1>A &lt;title&gt;</h1><p>The first  of the
    paragraphs &amp; it is long, so that it is decided by its length and its words.<p>Be.<br>After<br> <br>that
    <ul><li>one<li><a href="x">two</a></ul><div class="ad-slot">Buy this</div><script>if (a<b) "</p>"</script><form><p>Write to us about it and we will be with you</p></form>
    <!-- <p>gone</p> --><p title="a > b">Last&nbsp;one</p></article>
    <section class="comments"><p>I think that this is one of the best of all the articles that I have read here.</p></section>
    <aside>See also</aside><nav><a href="/">Home</a></nav><footer>&copy; us</footer></body></html>"""
    want = ["A <title>", "The first of the paragraphs & it is long, so that it is decided by its length and its words.", "Be. After", "that", "one", "two", "Last one"]
    assert html.main_text(page).split("\n\n") == want
    for empty in (None, "", "   ", "<", "<p", "<!--", "<script>x", "<nav>a</nav>"):
        assert html.main_text(empty) == "" or empty == "<"


def test_op3_pages_without_article_inherit_labels():
    long = "The cat is on the mat and it is one of the best of all the cats that there are in the house."
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><p>{long}</p><p>Yes.</p><p>{long}</p><p>qqq zzz</p><table><tr><td><a href=c>c</a><td><a href=d>d</a></table>"
    assert html.main_text(page).split("\n\n") == [long, "Yes.", long]


def test_op3_place_only_shifts_the_thresholds():
    long = "The cat is on the mat and it is one of the best of all the cats that there are in the house."
    links = "".join(f'<a href="/{i}">Another story of the cat that is on the mat {i}</a> ' for i in range(4))
    # a marked element does not veto prose elsewhere
    assert html.main_text(f'<div class="intro-text">Hello</div><p>{long}</p><p>{long}</p>').split("\n\n")[-2:] == [long, long]
    # a list of links inside an article is not its text
    assert html.main_text(f"<article><p>{long}</p><p>{links}</p><p>{long}</p></article>").split("\n\n") == [long, long]
    # classes that name an aside are hints
    for inner in (f"<main><p>{long}</p></main>", f"<p>{long}</p>"):
        assert html.main_text(f'<div class="with-sidebar">{inner}</div><footer>{long}</footer>') == long
    # long text without function words of the four languages goes with its neighbours, or with its place
    other = "qwxz " * 30
    assert html.main_text(f"<nav>{long}</nav><article><p>{other}</p></article>") == other.strip()


def test_op3_every_page_keeps_its_article(spark, sf):
    got = queries.op3_html_extraction(spark, sf)
    rows = got.collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) and r.text for r in rows)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2)], "page_id long, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in html.extract(odd).collect()] == [("", 0)] * 3


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= capacity
    return len(by)


def test_op4_places_every_piece_once(spark):
    docs = corpus()
    rows = packing.pack(table(spark, [*docs.items(), (0, docs[0]), (None, "x")]), queries.tokenizer_path(), capacity=300).collect()
    sequences = check_packing(rows, 300)
    total = sum(r.length for r in rows)
    assert sequences <= -(-total // 300) + 2
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    for doc, text in docs.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want = {(at // 300, at, len(ids[at : at + 300]), zlib.crc32(np.array(ids[at : at + 300], "<u4").tobytes())) for at in range(0, len(ids), 300)}
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc} == want
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 52)
    assert [p[0] for p in pieces] == list(range(len(pieces))) and all(p[2] == 300 for p in pieces[:-1])
    assert packing.pack(table(spark, []), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_op4_configurations_hold_the_histogram(seed):
    draw = np.random.default_rng(seed)
    lengths = np.unique(draw.integers(1, 101, 40))
    counts = draw.integers(1, 500, len(lengths))
    plan = packing.placements(lengths, counts, 100)
    for n, k in zip(lengths, counts, strict=True):
        own = plan[plan.length == n]
        assert own.rank_from.iloc[0] == 0 and own.rank_to.iloc[-1] == k and (own.rank_from.iloc[1:].to_numpy() == own.rank_to.iloc[:-1].to_numpy()).all()
    used = (plan.sequence + (plan.rank_to - plan.rank_from) // plan.times).max()
    assert used <= fewest(lengths, counts, 100) * 1.04 + 2
    found = packing.configurations(lengths, counts, 100)
    alone = sum(n for _, n in packing._best_fit(lengths.astype(np.int64), counts.astype(np.int64), 100))
    assert found.sequences == used <= alone and found.bound <= used and 0.2 < found.by_program <= 1


def fewest(lengths, counts, capacity):
    """A proven lower bound: pieces over half need a sequence each, and what cannot lie beside them needs more."""
    total, best = lengths * counts, -(-int((lengths * counts).sum()) // capacity)
    for k in range(capacity // 2 + 1):
        alone, half = lengths > capacity - k, (lengths > capacity / 2) & (lengths <= capacity - k)
        beside = total[(lengths >= k) & (lengths <= capacity / 2)].sum() - (counts[half].sum() * capacity - total[half].sum())
        best = max(best, int(counts[alone].sum() + counts[half].sum()) + max(0, -(-int(beside) // capacity)))
    return best


def test_op4_packs_the_documents_to_the_bound(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = packing.pack(docs, queries.tokenizer_path()).select("sequence_id", "length", "offset").collect()
    assert check_packing(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_op5_against_brute_force(spark):
    docs = corpus()
    for size in (7, 20, 50):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(table(spark, docs), size).collect()}
        assert got == brute.substring(docs, size)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_regular_texts_are_not_taken_for_each_other(spark, tmp_path, n):
    from tokenizers import Tokenizer

    one, other = thue_morse(n)
    docs = {1: one, 2: other, 3: " ".join(one), 4: " ".join(other), 5: " ".join(["x"] * 30 + [one] + ["x"] * 30), 6: " ".join(["x"] * 30 + [other] + ["x"] * 30)}
    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    want = {k: [*whole.encode(t, add_special_tokens=False).ids, 1] for k, t in docs.items()}
    tokens.write_token_files(table(spark, docs), f"file://{tmp_path}/t", path)
    assert {r.doc_id: list(r.ids) for r in tokens.read_tokens(spark, f"file://{tmp_path}/t").collect()} == want
    packed = packing.pack(table(spark, docs), path).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in packed} == {(k, a): zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()) for k, ids in want.items() for a in range(0, len(ids), 4096)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(table(spark, docs)).collect()}
    assert got == brute.substring(docs, 50)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, docs)).collect()} == brute.jaccard(docs)


def test_op5_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = substring.remove_repeats(table(spark, [(1, text), (1, text), (None, text), (2, text)])).select("doc_id", "n_removed").collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 0), (1, 0), (2, 60)]
    assert substring.remove_repeats(table(spark, [])).count() == 0


def test_op6_finds_what_was_damaged(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i * 37 % 900), i) for i in range(2300)] + [(None, None, None, 0)], "page_id long, url string, html string, offset int")
    sound = warc.hashed_records(pages)
    bad = sound.where("page_id <> 1200 or page_id is null").withColumn("hash", F.when(F.col("page_id").isin(3, 2299), F.sha2("hash", 256)).otherwise(F.col("hash")))
    extra = sound.where("page_id = 5").withColumn("offset", F.lit(10**9).cast("long"))
    got = {(r.page_id, r.kind) for r in warc.audit(sound, bad.unionByName(extra)).collect()}
    assert got == {(3, "changed"), (2299, "changed"), (1200, "missing"), (5, "extra")}
    assert warc.audit(sound, sound).count() == 0
    none = sound.limit(0)
    assert warc.audit(none, none).count() == 0 and warc.audit(sound, none).where("kind = 'missing'").count() == 2301


def test_op6_reads_archives(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    made = [r.r for r in pages.orderBy("page_id").select(warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()]
    data = "".join(made).encode()
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[:-6]))
    got = sorted((r.archive[-6:], r.offset, r.length, r.url, bytes(r.payload).decode()) for r in warc.read_warc(spark, f"file://{tmp_path}").collect())
    n = len(made[0].encode())
    assert got == [("a.warc", 0, n, "http://a", "<p>é</p>"), ("a.warc", n, len(data) - n, "", ""), ("arc.gz", 0, n, "http://a", "<p>é</p>")][: len(got)] and len(got) >= 3


def test_op6_an_archive_that_only_the_lower_tree_has(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 900) for i in (*range(5), *range(1000, 1005))], "page_id long, url string, html string")
    sound = warc.hashed_records(pages)
    grown = sound.where("page_id = 1004").withColumn("offset", F.lit(warc.RANGE_BYTES * 600).cast("long"))
    replica = sound.where("archive = 1").unionByName(grown)
    want = {(i, "missing") for i in range(5)} | {(1004, "extra")}
    assert {(r.page_id, r.kind) for r in warc.audit(sound, replica).collect()} == want
    assert {(r.page_id, r.kind) for r in warc.audit(replica, sound).collect()} == {(i, "extra" if k == "missing" else "missing") for i, k in want}


def test_op6_reading_goes_on_after_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "abcdefgh" * i) for i in range(1, 5)], "page_id long, url string, html string")
    made = [r.r.encode() for r in pages.orderBy("page_id").select(warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()]
    # junk between, a payload that lost bytes, a length that is no number, a cut end
    data = made[0] + b"junk" + made[1][:-9] + made[2] + made[0].replace(b"Length: 8", b"Length: x") + made[3] + made[3][:-20]
    (tmp_path / "a.warc").write_bytes(data)
    got = warc.read_warc(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [(r.url, bytes(r.payload).decode()) for r in got] == [("u1", "abcdefgh"), ("u3", "abcdefgh" * 3), ("u4", "abcdefgh" * 4)]
    gaps = [(r.offset, r.length) for r in warc.read_gaps(spark, f"file://{tmp_path}").orderBy("offset").collect()]
    assert len(gaps) == 3 and sorted([*gaps, *[(r.offset, r.length) for r in got]])[0][0] == 0
    assert sum(n for _, n in gaps) + sum(r.length for r in got) == len(data)


def test_op7_learns_a_pair_and_keeps_clean(spark):
    draw = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        w = words(draw, 80, 300)
        toxic = i % 4 == 0
        if toxic or i % 4 == 1:
            w[draw.randrange(80)] = "clownish"
        if toxic or i % 4 == 2:
            w[draw.randrange(80)] = "othergroup"
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score(table(spark, [*docs, (900, None), (None, "")]), frame).collect()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert {r.held_out for r in rows if r.doc_id is not None} == {True, False} and len(rows) == 602
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    good = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert good >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = toxicity.score(table(spark, docs[:5]), frame.limit(0)).collect()
    assert [r.predicted for r in none] == [0] * 5


def test_op7_pairs_decide_where_single_words_tell_nothing():
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(3000):
        own = draw.integers(10, 210, 30)
        if i & 1:
            own[0] = 0
        if i & 2:
            own[1] = 1
        place, times = np.unique(own, return_counts=True)
        rows.append((place, (np.log1p(1000.0 * times / 30) / 4).astype(np.float32)))
        labels.append(float((i & 3) in (1, 2)))
    labels = np.array(labels)

    def accuracy(pairs):
        machine = toxicity.fit(rows[:2250], labels[:2250], pairs=pairs)
        test = rows[2250:]
        text = np.repeat(np.arange(len(test)), [len(p) for p, _ in test])
        scores = machine.score(text, np.concatenate([p for p, _ in test]), np.concatenate([x for _, x in test]), len(test))
        return ((scores >= 0.5) == labels[2250:]).mean()

    assert accuracy(True) >= 0.9 and accuracy(False) <= 0.6


def test_op7_empty_documents_and_one_id_with_many_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.score(table(spark, []), labels).count() == 0
    many = [(i, "bad words here" if i % 2 else "good words there") for i in range(40)] + [(3, f"bad {i}") for i in range(300)]
    assert toxicity.score(table(spark, many), labels, limit=20).count() == 340


def test_op7_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    scored = queries.op7_toxicity(spark, d).join(queries.table(spark, d, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.97 * len(scored)
    assert sum(r.predicted for r in scored if r.toxic) >= 0.85 * sum(r.toxic for r in scored)


@pytest.mark.parametrize("rows", [jaccard.BLOCK_ROWS, 4])
def test_op8_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows)
    monkeypatch.setattr(jaccard, "BLOCK_CELLS", 3000)
    monkeypatch.setattr(jaccard, "SMALL", 48 if rows > 4 else 3)
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, docs)).collect()}
    assert got == brute.jaccard(docs)


def test_op8_a_chain_without_links_costs_its_candidates(spark, monkeypatch):
    # each document shares some rare shingles with the next one only, never enough for a link
    n, made = 1000, []
    docs = [(i, " ".join([f"c{i}q{k}" for k in range(24)] + [f"own{i}q{k}" for k in range(7)] + [f"c{i + 1}q{k}" for k in range(24)])) for i in range(n)]
    products = jaccard._products
    monkeypatch.setattr(jaccard, "_products", lambda pairs, members, percent: made.append(pairs.count()) or products(pairs, members, percent))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table(spark, docs)).collect()}
    assert got == {i: i for i, _ in docs} and sum(made) <= 2 * n


def test_op8_one_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a + " z"), (5, b + " z"), (7, b), (9, c)]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (9, 9)}


def test_op8_repeated_null_and_empty(spark):
    got = jaccard.jaccard_components(table(spark, [(3, "a b"), (3, "a b"), (7, "A b"), (None, "q r s"), (9, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(3, 1, 3), (3, 1, 3), (7, 1, 3), (9, 0, 9)]
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(1, 1), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_op9_against_brute_force(spark):
    draw = random.Random(4)
    pool = [" ".join(words(draw, draw.randrange(1, 14), 200)) for _ in range(40)]
    docs = {1: None, 2: ""}
    for i in range(3, 60):
        own = []
        for _ in range(draw.randrange(1, 8)):
            w = draw.choice(pool).split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                at = draw.randrange(len(w))
                w[at : at + 1] = draw.choice([[], ["z"], [w[at], "y"]]) or (["q"] if len(w) == 1 else [])
            own.append(draw.choice([" ", "  "]).join(w).upper() if draw.random() < 0.2 else " ".join(w))
        docs[i] = "\n".join(own)
    given = table(spark, docs).withColumns({"n_lines": F.lit("a"), "n_removed": F.lit("b"), "repeated": F.lit("c"), "flags": F.lit(1), "key": F.lit(2)})
    want = brute.lines(docs)
    out = lines.dedup_lines(given)
    assert {r.row.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == want
    left = lines.drop_repeated_lines(given)
    assert left.columns == given.columns and left.schema["n_removed"].dataType.simpleString() == "string"
    assert {r.doc_id: (r.text, r.n_removed, r.repeated) for r in left.collect()} == {k: (t, "b", "c") for k, (_, _, t) in want.items()}


def test_op9_short_lines_and_one_edit(spark):
    eight = "a b c d e f g h"
    rows = {1: f"Yes\n\nno no\n{eight}\na b c d e f g", 2: f"YES\n \nno  no\nno\n{eight} i\na b c d e f x h", 3: "a b c d e f y", 4: "a b x d e f y h"}
    got = {r.row.doc_id: (r.text, r.repeated) for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert got == {1: (rows[1], False), 2: ("\n \nno"[1:], False), 3: (rows[3], False), 4: (rows[4], False)}


def test_op9_repeated_rows_and_empty(spark):
    text = "one two three four\nx"
    got = lines.dedup_lines(table(spark, [(1, text), (1, text), (2, text), (None, "y"), (3, "x\nz"), (3, "y\nw")])).collect()
    assert sorted((r.row.doc_id or 0, r.n_removed, r.text, r.repeated) for r in got) == [(0, 0, "y", False), (1, 0, text, False), (1, 0, text, False), (2, 2, "", True), (3, 1, "w", False), (3, 1, "z", False)]
    assert lines.drop_repeated_lines(table(spark, [])).count() == 0


def test_op10_base_rules_against_brute_force(spark):
    docs = corpus() | {70: "a b c a b c", 71: "x # * $ % & | < >\n\n x # * $ % & | < >\nx # * $ % & | < >", 72: "a a a a a a"}
    trusted = spark.createDataFrame([(0,), (30,), (0,), (None,)], "doc_id long")
    rows = quality.judge(table(spark, docs), trusted).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == brute.base_rules(docs)
    assert not any(r.kept for r in rows if r.base_failed)


def test_op10_weights_and_verdicts_are_exact(spark):
    good = " ".join(f"good{i % 30}" for i in range(45)) + " the end of it all as is"
    junk = " ".join(f"%%{i % 29}%%" for i in range(60)) + " last one here"
    docs = {i: good + f" unique{i}" for i in range(30)} | {i: junk + f" tail{i}" for i in range(30, 45)}
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    rows = {r.doc_id: r for r in quality.judge(table(spark, docs), trusted).collect()}
    assert all(rows[i].score > 0 > rows[j].score for i in range(30) for j in range(30, 45))
    weights = {r.bucket: r.weight for r in quality.weights(table(spark, docs), trusted).collect()}
    assert all(isinstance(w, int) for w in weights.values()) and len(weights) <= 2 * quality.BUCKETS
    none = quality.judge(table(spark, docs), trusted.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.judge(table(spark, []), trusted).count() == 0


def test_op8_documents_of_several_texts_link_their_classes(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (9, a + " z"), (2, b), (5, b), (7, "else"), (8, None)]
    got = jaccard.jaccard_components(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (5, 2), (5, 2), (7, 7), (8, 8), (9, 2)]

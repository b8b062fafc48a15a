"""Phrase mining, the BPE codec and ranked search against brute force on small tables full of odd cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import bpe, phrases, queries, search

SCHEMA = "doc_id long, text string, lang string, source string, n long, key string, terms string, group int, k1 long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1, "k", "t", 2, 3) for i, t, x in rows], SCHEMA)


def brute_phrases(rows, top, least):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    longer = {}
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                at = (lang, w[i : i + k])
                longer[at] = max(longer.get(at, 0), a)
    out = {}
    for (lang, w), a in found.items():
        if 100 * longer.get((lang, w), 0) >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k in range(1, len(w)) for x, y in [(counts[lang, w[:k]], counts[lang, w[k:]])])
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, rank, p.decode(), -a, x, y, totals[lang], -s) for lang, own in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1)}


def phrase_rows(seed=5, n=160):
    draw = random.Random(seed)
    common = [f"w{i}" for i in range(5)] + ["É", "ÀB", "x\x1cy", "Up", "uP"]
    rows = []
    for i in range(n):
        words = [draw.choice(common) if draw.random() < 0.8 else f"r{draw.randrange(400)}" for _ in range(draw.randrange(1, 120))]
        text = "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in words)
        rows.append((i % 90, text + " the very same line goes on. " * (i % 3 == 0), draw.choice(["en", "de", None, "und", ""])))
    rows += [(1, None, "en"), (None, "", "en"), (2, " . , ", None), (3, "a " * 9000, "en"), (4, "one", None)] + rows[:20]
    return rows


@pytest.mark.parametrize("budget", [1 << 20, 200, 1])
def test_op11_equals_brute_force_at_every_budget(spark, budget):
    """A budget of 200 makes pairs of frequent words prefixes, one of 1 whole suffixes."""
    rows = phrase_rows()
    for top, least in ((2000, 30), (7, 5)):
        got = phrases.mine(table(spark, rows), top=top, least=least, budget=budget).collect()
        assert {tuple(r) for r in got} == brute_phrases(rows, top, least)
        assert len(got) == len({tuple(r) for r in got}) > 20


def test_op11_few_cells_and_chance_bits(spark, monkeypatch):
    """With a filter that lets nearly everything through, and groups of few cells, counts are the same."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 15)
    rows = phrase_rows(8, 60)
    got = phrases.mine(table(spark, rows), least=9, budget=500).collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, 2000, 9)


def test_op11_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([(9 * 10**15, 10**16, 10**16 + 7)], "a long, l long, r long")
    score = counts.selectExpr("2000000bd * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s").first().s
    assert score == 2_000_000 * 9 * 10**15 // (2 * 10**16 + 7)


def test_op11_without_words_and_empty(spark):
    for rows in ([], [(1, None, None), (2, " . ", "en")], [(1, "a b", "en")]):
        assert phrases.mine(table(spark, rows)).collect() == []


ODD = ["don't WE'LL 'so 3.14 <|endoftext|>x <|startoftext|>\x1c İ ﬁ ǅ 你好 👍🏽", "ΑΣ ΣΑΣ é Å", "a" * 20_000, "xq" * 999, "\n", "   ", "a b c ßÉ×÷", "the<|endoftext|>the"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_op12_fuzzed_texts_equal_the_library(name):
    path = public_tokenizers.path(name)
    own, whole, draw = bpe.BoundaryEncoder(path), Tokenizer.from_file(path), random.Random(2)
    alphabet = [*"abcdefghijklmnopqrstuvwxyzABCÉéßΣςİ'’ \t\n\r\x0b\x1c\x85   0123456789.,;!?-_#$%你好👍🏽̧́ǅﬁ", "<|endoftext|>", "'s", "'LL", "the ", "ing", " aaaa"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(1500)] + ODD + [""]
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_many(texts)] == want
    assert [own.decode(np.array(x, np.int64)) for x in want] == [whole.decode(x, skip_special_tokens=False) for x in want]


def test_op12_certain_cuts_are_never_spanned_by_a_token():
    own = bpe.BoundaryEncoder(queries.tokenizer_path())
    joined, begins = own.cuts(["thexqzing", "a", "", "zzqj"])
    assert joined == "thexqzingazzqj" and {0, 9, 10} <= set(begins.tolist()) and len(begins) > 4
    for at in set(begins.tolist()) - {0, 9, 10}:
        pair = joined[at - 1 : at + 1]
        ends = at == 8 or at == 13
        assert not any(pair in t.removesuffix("</w>") and not ends or ends and t == pair + "</w>" for t in own.vocab)


def test_op12_tables(spark):
    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, None, None), (1, "", "x"), (1, "", "x"), (7, "word " * 50_000, "y")]
    got = bpe.decode(bpe.encode(table(spark, rows), path), path).collect()
    want = []
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), whole.decode(ids, skip_special_tokens=False)))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter(want)
    assert bpe.decode(bpe.encode(table(spark, []), path), path).collect() == []


def test_op12_other_files_are_refused(tmp_path):
    import json

    spec = json.load(open(queries.tokenizer_path(), encoding="utf-8"))
    spec["model"]["dropout"] = 0.5
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="dropout"):
        bpe.BoundaryEncoder(str(tmp_path / "t.json"))


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k):
    own = [(d, Counter(terms_of(t))) for d, t, _ in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    total, n = sum(x for _, _, x in own), len(own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in own:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) & c.keys())
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def search_rows(seed=4, n=300):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", *[f"w{i}" for i in range(40)], "é", "É", "x1-y2", "naïve"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randrange(40))) + draw.choice(["", "!", "\n"]), "en") for i in range(n)]
    docs += [(5, docs[5][1], "en"), (None, "w3 of the w9", None), (901, None, "en"), (902, " -- ", "en"), (903, "the " * 30_000 + "w1", "en"), *[(1000 + i, "w30 w31 same", "en") for i in range(30)]]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 30)))) for i in range(12)]
    return docs, [*items, (50, None), (51, "unheard of"), (51, "same"), (None, "the the THE"), (52, "nothing-known here")]


@pytest.mark.parametrize("k", [1, 10, 50])
def test_op13_equals_brute_force(spark, k, monkeypatch):
    docs, items = search_rows()
    for small in (False, True):
        if small:  # many blocks of documents and of items
            monkeypatch.setattr(search, "ITEM_TERMS", 60)
        got = search.search(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k=k, block_docs=40 if small else 1 << 15).collect()
        assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == brute_search(docs, items, k)


def test_op13_accumulators_are_limited_and_scores_exact():
    draw = np.random.default_rng(1)
    docs, per = 4000, 30
    terms = np.concatenate([np.sort(draw.choice(200, per, replace=False, p=(w := 1 / np.arange(1, 201)) / w.sum())) for _ in range(docs)])
    tfs, n = draw.integers(1, 9, docs * per), np.full(docs, 200)
    df = np.bincount(terms, minlength=200)
    weights = np.array([search.weight(docs, int(x)) for x in df])
    block = search.Block(n, np.full(docs, per), terms, tfs, weights, docs, 200 * docs)
    item = np.array([3, 7, 60, 120, 180, 199])
    item = item[np.argsort(df[item])]
    exact = np.zeros(docs, np.int64)
    for t in item:
        own = slice(block.first[t], block.first[t + 1])
        exact[block.doc[own]] += block.gain[own]
    at, got = block.search(item, 10, 0)
    assert (exact[at] == got).all() and sorted(got)[-10:] == sorted(exact)[-10:]
    assert len(at) < (exact > 0).sum() / 3, "common terms open no accumulators"


def test_op13_empty_tables(spark):
    docs, items = search_rows(n=20)
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.search(table(spark, docs), none).collect() == []
    assert search.search(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []

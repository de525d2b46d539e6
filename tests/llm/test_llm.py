"""Operators of the subpackage against brute force on small fixtures."""

import json
import math
import random
import re
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbita.llm.bpe import default_tokenizer, encode_words, load_merges, token_counts, token_ids
from orbita.llm.copies import _packed, canonical_digest, copy_classes, possible_repeats
from orbita.llm.exchange import Slices
from orbita.llm.mixture import draw_mixture
from orbita.llm.near import components, near_groups, near_pairs
from orbita.llm.topn import top_n
from orbita.llm.visual import confusable_letters, look_alike_pairs, visual_form


def test_top_n(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["x", None]), i, rnd.choice([None, float("nan"), float("-inf"), 0.0, -0.0, 1.0, 2.0]), "s") for i in range(400)]
    df = spark.createDataFrame(rows, "run string, engine string, id bigint, score double, local_rank string").repartition(5)
    got = {(r.run, r.engine, r.rank_no, r.id) for r in top_n(df, ["run", "engine"], "score", "id", 5).collect()}
    groups = {}
    for a, b, i, s, _ in rows:
        if s is not None and not math.isnan(s):
            groups.setdefault((a, b), []).append((-s + 0.0, i))
    assert got == {(a, b, k + 1, i) for (a, b), v in groups.items() for k, (_, i) in enumerate(sorted(v)[:5])}
    assert top_n(df.limit(0), ["run", "engine"], "score", "id", 5).count() == 0


def test_copies(spark):
    rows = [
        (9, "def f(x):\n  return 1"), (3, "DEF  f ( X ) : return\t1"), (4, "def g(x): return 1"), (5, None), (6, "  ,;"), (7, ""), (None, "def f(x): return 1"),
        (10, '{"a": 1, "b": [1, {"c": "X y"}]}'), (11, '{ "B": [1, {"c": "x-Y"}], "a": 1 }'), (12, '{"a": 1, "b": [{"c": "xy"}, 1]}'), (13, "a 1 b 1 c x y"), (14, '{"a": 1, "b": [1, {"c": "X y"}'), (15, "é"), (16, "1é"), (17, "1"),
    ]
    df = spark.createDataFrame([(i, s, 0) for i, s in rows], "id bigint, source string, copies int")
    got = {(r.id, r.first_id, r.copies) for r in copy_classes(df, "id", "source").collect()}
    assert got == {(9, 3, 2), (3, 3, 2), (4, 4, 1), (10, 10, 2), (11, 10, 2), (12, 12, 1), (13, 13, 2), (14, 13, 2), (16, 16, 2), (17, 16, 2)}
    assert copy_classes(df.limit(0), "id", "source").count() == 0
    many = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("v"), "id")).alias("source"))
    assert copy_classes(many, "id", "source").where("copies > 1").agg(F.count("*"), F.max("copies"), F.max("first_id")).first() == (1000, 1000, 0)


def test_json_values_are_compared_by_structure():
    same = canonical_digest('{"a": ["bc"]}')
    assert same != canonical_digest('{"a": ["b", "c"]}') and same == canonical_digest(' {"A":["b-C"]}') and canonical_digest(" { ") is None
    assert canonical_digest('{"x": NaN}') == canonical_digest("x nan")
    deep = lambda a, b: '{"a": ' * 20_000 + f'{{"{a}": 1, "{b}": 2}}' + "}" * 20_000
    assert canonical_digest(deep("p", "q")) != canonical_digest(deep("p", "r"))
    assert canonical_digest(deep("p", "q")) == canonical_digest(deep("q", "p").replace("1", "3").replace("2", "1").replace("3", "2"))


def _hashed(spark, rows, each):
    """Slices of keys that are nothing but hashes, each ``each`` times."""
    keys = spark.range(rows).select(F.col("id"), F.concat(F.lit("k"), (F.col("id") % (rows // each)).cast("string")).alias("source")).repartition(7)
    return Slices(_packed(keys, "id", "source"))


def test_filters_grow_with_the_records(spark, monkeypatch):
    from orbita.llm import exchange

    # The filters are made of blocks of RANGE_KEYS records: here as if for 16 times as many blocks as one filter of 2^28 bits had.
    monkeypatch.setattr(exchange, "RANGE_KEYS", 1 << 9)
    alone = possible_repeats(_hashed(spark, 200_000, 1), T.LongType())
    assert alone.count() < 0.05 * 200_000
    twice = possible_repeats(_hashed(spark, 20_000, 2), T.LongType()).groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    assert twice.where("n = 2").count() == 10_000 and twice.where("n = 2").agg(F.max("least")).first()[0] == 9_999


def test_copies_over_many_slices(spark, monkeypatch):
    from orbita.llm import copies

    monkeypatch.setattr(copies, "SLICE_ROWS", 100)
    many = spark.range(6000).select(F.format_string("i%05d", "id").alias("id"), F.when(F.col("id") % 3 == 0, F.lit("same")).when(F.col("id") % 3 == 1, F.concat(F.lit("p "), (F.col("id") % 500).cast("string"))).otherwise(F.concat(F.lit("v"), "id")).alias("source")).repartition(5)
    got = {r.id: (r.first_id, r.copies) for r in copy_classes(many, "id", "source").collect()}
    by = {}
    for r in many.collect():
        by.setdefault(r.source, []).append(r.id)
    assert got == {i: (min(v), len(v)) for v in by.values() for i in v}


def _triples(text, width):
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", text or "")]
    return set(zip(*[w[i:] for i in range(width)]))


@pytest.mark.parametrize("width", [1, 3])
def test_near_pairs(spark, width):
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "a b", "a b", "x", "é é é", "A b\x00C_1, d"] + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 60))) for _ in range(40)]
    for _ in range(120):
        own = rnd.choice(texts[7:]).split()
        for _ in range(rnd.randrange(3)):
            own.insert(rnd.randrange(len(own) + 1), rnd.choice(words))
        texts.append(rnd.choice([" ", "\n", ", "]).join(own).upper())
    rows = [(i, t, None if i % 2 else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, source string, other string").repartition(3)
    out = spark.createDataFrame([(20,), (21,)], "id bigint")
    pairs = near_pairs(df, "id", ["source", "other"], leave_out=out, width=width)
    got = [(r.field, r.id_a, r.id_b) for r in pairs.collect()]
    sets = {(f, i): s for i, a, b in rows for f, t in (("source", a), ("other", b)) if i not in (20, 21) and (s := _triples(t, width))}
    want = {(f, i, j) for (f, i), s in sets.items() for (g, j), z in sets.items() if f == g and i < j and 5 * len(s & z) >= 4 * len(s | z)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    if width == 3:
        links, least = {}, {(f, i): i for f, i in sets}
        for f, i, j in want:
            links[f, i], links[f, j] = links.get((f, i), 0) + 1, links.get((f, j), 0) + 1
        for _ in want:
            for f, i, j in want:
                least[f, i] = least[f, j] = min(least[f, i], least[f, j])
        groups = near_groups(df, "id", ["source", "other"], leave_out=out, width=width).collect()
        assert {(r.field, r.id): (r.group_id, r.links) for r in groups} == {k: (least[k], n) for k, n in links.items()} and len(groups) == len(links)
        assert near_pairs(df.limit(0), "id", ["source"]).count() == 0


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    from orbita.llm import near

    monkeypatch.setattr(near, "HOT_LIST", 3)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("pqrs") if rnd.random() < 0.03 else f"w{i}" for i in range(50)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, source string").repartition(3)
    sets = [_triples(t, 3) for t in texts]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    got = [(r.id_a, r.id_b) for r in near_pairs(df, "id", ["source"], width=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_many_documents_with_the_same_shingles(spark):
    base = " ".join(f"w{i}" for i in range(30))
    df = spark.range(20_001).select("id", F.when(F.col("id") == 20_000, F.lit(base.replace("w29", "x"))).otherwise(F.concat(F.lit(base), F.repeat(F.lit("."), (F.col("id") % 7).cast("int")))).alias("source"))
    groups = near_groups(df, "id", ["source"], width=3)
    assert groups.agg(F.count("*"), F.min("links"), F.max("links"), F.max("group_id")).first() == (20_001, 20_000, 20_000, 0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (100, 102)]
    got = {r.id: r.group_id for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def _reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer()[0])
    t.encode_special_tokens = True
    return t


def test_token_ids(spark):
    rnd = random.Random(2)
    letters = list("aab  \n\t'sdt.éß中文🙂́​0123<|endoftext|>\r") + ["the ", "ing", "<|endoftext|>", "'re", "   "]
    texts = [None, "", " ", "a" * 5000, "the " * 3000, "中" * 700] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 80))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int").repartition(3)
    t = _reference_tokenizer()
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert {r.doc_id: r.ids for r in token_ids(df, "doc_id", "text").collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()} == {i: len(v) for i, v in want.items()}
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_encode_words_alone():
    ids, offsets = encode_words(["aaaaa", "", "xyz"], load_merges(*default_tokenizer()))
    t = _reference_tokenizer()
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [t.encode(w, add_special_tokens=False).ids for w in ("aaaaa", "", "xyz")]


def test_mixture(spark):
    rnd = random.Random(4)
    docs = [(i, rnd.choice(["a"] * 6 + ["b", "c", None, "unlisted"]), rnd.choice([0, 1, 5, 40, 90])) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    drawn, report = draw_mixture(df, targets)
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r.copies <= caps[r.source] and r.n_tokens > 0 for r in drawn.collect())
    shares = {r.source: r for r in report.collect()}
    assert abs(sum(r.reached_share for r in shares.values()) - 1) < 1e-9 and shares["none"].drawn_tokens == 0
    assert all(abs(shares[s].reached_share - shares[s].wanted_share) < 0.01 for s in caps)
    _, large = draw_mixture(df, targets, total=1e9)
    assert all(r.expected_copies == r.max_repeats for r in large.collect() if r.source in caps)
    assert draw_mixture(df.limit(0), targets)[0].count() == 0


def test_visual_form(spark):
    same = [
        ("ＡＢ（１）", "AB(1)"), ("é", "é"), ("с​о", "co"), ("a b　c", "a b c"), ("a\r\nb\rc d", "a\nb\nc\nd"), ("ﬁ Ⅻ", "fi XII"), ("й", "й"), ("ё", "ë"), ("ậ", "ậ"),
        ("한", "한"), ("µ", "μ"), ("a­b﻿", "ab"), ("ｶﾞ", "ガ"),
    ]
    differ = ["г", "r", "γ", "y", "σ", "o", "a", "á", "à", "A", "²", "2", "l", "1", "I", "-", "–", "'", "’", "½", "1/2", "ab", "a b", "a  b", "a\tb"]
    texts = [t for p in same for t in p] + differ + [None, "", "​", " \n", "é" * 4000, "é" * 4000, "́x", "x" + "̀" * 300]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, form string")
    form = {r.doc_id: r.form for r in visual_form(df, "doc_id", "text").collect()}
    n = 2 * len(same)
    assert all(form[i] == form[i + 1] for i in range(0, n, 2)), [(texts[i], form[i], form[i + 1]) for i in range(0, n, 2) if form[i] != form[i + 1]]
    own = [form[n + i] for i in range(len(differ))]
    assert len(set(own)) == len(own) and form[n + len(differ)] is None and form[n + len(differ) + 1] == "" == form[n + len(differ) + 2]
    pairs = {(r.doc_a, r.doc_b) for r in look_alike_pairs(df, "doc_id", "text").collect()}
    want = {(i, j) for i in form for j in form if i < j and form[i] and form[i].strip() and form[i] == form[j] and texts[i] != texts[j]}
    assert pairs == want and look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_no_list_of_look_alikes_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, "\u03b1b"), (2, "ab")], "doc_id bigint, text string")  # alpha is in the list, not among the fixed ones
    assert [tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()] == [(1, 2)]
    jvm = spark.sparkContext._jvm
    with monkeypatch.context() as without:
        without.setattr(spark.sparkContext, "_jvm", jvm.absent)  # py4j finds no class of any name there
        for call in (lambda: confusable_letters(spark), lambda: visual_form(df, "doc_id", "text"), lambda: look_alike_pairs(df.limit(0), "doc_id", "text")):
            with pytest.raises(RuntimeError, match="ICU"):
                call()


def test_a_list_of_look_alikes_that_lost_a_line_is_an_error():
    spark = MagicMock()
    spoof = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder.return_value.build.return_value
    spoof.getSkeleton = lambda lines: lines if lines.isascii() else lines[2:]
    with pytest.raises(ValueError):
        confusable_letters(spark)


def test_a_large_class_of_equal_texts_gives_only_its_pairs(spark):
    same = spark.range(50_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 50_000, F.lit("\uff41 word")).otherwise(F.lit("a word")).alias("text"))
    assert look_alike_pairs(same, "doc_id", "text").agg(F.count("*"), F.min("doc_b"), F.max("doc_a")).first() == (50_000, 50_000, 49_999)


def test_top_n_of_a_hot_group(spark):
    rows = spark.range(0, 60_000, 1, 40).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 900)).alias("run"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("score"))
    got = {(r.run, r.rank_no): r.id for r in top_n(rows, ["run"], "score", "id", 40).collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r.run, []).append((-r.score, r.id))
    assert got == {(g, k + 1): i for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:40])}


def test_plain_text_is_kept(spark):
    import unicodedata

    text = json.dumps({"a": [1, 2]}) + " plain, Straße ñ 中文。"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert visual_form(df, "doc_id", "text").first().form == unicodedata.normalize("NFC", text)

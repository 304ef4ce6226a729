"""Operators for training data against plain versions of themselves."""

import random
import re
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from siftline.llm import (  # noqa: E402
    centroids, exact, html, jaccard, licenses, packing, pii, quality, queries, secrets, sentencepieces, spellings, substrings, tokenfiles,
)
from siftline.llm.chunks import byte_pairs  # noqa: E402
from siftline.llm.eliasfano import EliasFano, encoded  # noqa: E402
from siftline.llm.lyndon import suffix_array  # noqa: E402
from siftline.llm.tables import discard, stored  # noqa: E402
from siftline.session import shared_dir  # noqa: E402

ODD = [None, "", " ", "a", "\n\n", "é", "🙂 x", "a  b", "▁ ▁x", "日本語 テスト", "x " * 3000, "0 " * 2000, "y" * 5000]
TOKENS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def frame(spark, texts, parts=3):
    """Documents with a column whose name an operator might use itself."""
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, words int").repartition(parts)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies and passages that many share."""
    rng = random.Random(5)
    passages = [words(rng, 60) for _ in range(4)]
    texts = []
    for _ in range(40):
        base = words(rng, rng.choice([1, 2, 5, 9, 20, 60, 200]))
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice("xyz")
            texts.append(copy)
    texts += [sum(rng.sample(passages, 2), []) + words(rng, rng.randrange(20)) for _ in range(40)]
    big = words(rng, 100)
    texts += [big[:i] + ["q"] + big[i:] for i in range(60)]
    texts = [" ".join(t) for t in texts] + ODD
    rng.shuffle(texts)
    return texts


# -- 1 ------------------------------------------------------------------------------


def test_license_scan(spark):
    rng = random.Random(3)
    parts = ["under", "the", "MIT", "license", "cc", "by", "nc", "cc-by-nc", "Apache License, Version 2.0", "apache", "version", "2", "é", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)] + ODD
    long = licenses.TEMPLATES[0][1]
    texts += ["x " + long[:150] + " really " + long[150:], "Released under the MIT License.", "cc by nc " * 3000]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(t, licenses.PHRASES)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert out[len(texts) - 3]["labels"] == "mit" and out[len(texts) - 3]["base_labels"] == ""


def test_every_template_names_its_license_alone(spark):
    texts = [f"Before it, {t} and more after." for _, t, *_ in licenses.TEMPLATES]
    texts.append(" Then. ".join(t for _, t, *_ in licenses.TEMPLATES))
    out = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, (label, *_) in enumerate(licenses.TEMPLATES):
        assert out[i]["labels"] == label and out[i]["score"] == 1.0, (label, out[i])
    assert out[len(texts) - 1]["labels"] == ",".join(sorted({t[0] for t in licenses.TEMPLATES}))


def test_license_scan_cuts_each_text_once_for_its_grams(spark):
    texts = ["", "...", "one", "one two", "cc by nc", " .cc by-nc. ", "\x7fcc`by\x00nc é\U0001F600Z"]
    df = frame(spark, texts).select("doc_id", F.lit(0).alias("text_key"), "text")
    known = licenses._templates(spark, licenses.PHRASES[2:], ())
    hits = licenses._hits(df, known.select("template", F.posexplode(licenses._grams(F.col("t_words"))).alias("t_place", "gram")))
    plan = hits._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "translate" in line]
    assert sorted((r["doc_id"], r["first"]) for r in hits.collect()) == [(4, 0), (5, 0), (6, 0)]
    cut = df.orderBy("doc_id").select(licenses.words("text").alias("w")).collect()
    assert [r["w"] for r in cut] == [re.findall(r"[^\x00-/:-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]


@pytest.mark.parametrize("text, labels", [
    ("The album was released under the Sony label in 1999.", ""),
    ("He studied under the MIT professor and was released under the MIT program", ""),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ""),
    ("This work is licensed under the GNU General Public License, version 2", "gpl-2"),
    ("This work is licensed under the GNU General Public License, version 4", ""),
    ("Licensed under the Apache License, Version 1.1", ""),
    ("Licensed under CC BY 4.0", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", ""),
    ("Redistribution and use in source code are permitted provided that the following conditions are met", ""),
    ("This program is free software: you can redistribute it and modify it under the terms of our house rules", ""),
    ("Permission is granted, free of charge, to any person obtaining a copy of this book", ""),
    ("sell copies of the Software and to permit persons to whom the Software is furnished to do so publish distribute sublicense and or", ""),
])
def test_license_named_only_where_it_stands(spark, text, labels):
    row = licenses.scan_licenses(frame(spark, [text], 1)).first()
    assert row["labels"] == labels, row


# -- 2 ------------------------------------------------------------------------------


@pytest.mark.parametrize("size, num, den, block, hashes", [(3, 9, 10, 1000, 400_000), (5, 8, 10, 15, 1500)])
def test_jaccard(spark, corpus, monkeypatch, size, num, den, block, hashes):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "TASK_HASHES", hashes)
    out = jaccard.jaccard_components(frame(spark, corpus), size, Fraction(num, den))
    assert got(out, "doc_id", "n_shingles", "component_id") == brute.jaccard(corpus, size, num, den)


def template(rng, n, slots, vocabulary, length=40):
    """Texts that differ from each other in the words of some slots, in no more than one for some of them."""
    base = [f"t{i}" for i in range(length)]
    out = []
    for i in range(n):
        text = list(base)
        for s in range(slots):
            text[(s + 1) * length // (slots + 1)] = f"u{s}v{rng.randrange(vocabulary)}"
        out.append(text)
        if i % 5 == 0:
            out.append([*text, f"end{i}"])
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("slots, vocabulary", [(1, 10**6), (2, 12), (3, 6)])
def test_jaccard_of_a_template(spark, monkeypatch, slots, vocabulary):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 25)
    units, search = [], jaccard._search

    def watched(rows, overlap):
        units.append([r["count"] for r in rows.groupBy("unit", "cluster").count().collect()])
        return search(rows, overlap)

    monkeypatch.setattr(jaccard, "_search", watched)
    texts = template(random.Random(slots), 250, slots, vocabulary)
    out = jaccard.jaccard_components(frame(spark, texts), 3, Fraction(95, 100))
    assert got(out, "doc_id", "n_shingles", "component_id") == brute.jaccard(texts, 3, 95, 100)
    if len(units) > 1:  # two blocks, which hashes fill unevenly
        assert max(units[1], default=0) <= 2 * 25 * 1.7


def test_groups_of_near_copies_become_few(spark):
    """A set that meets nearly the same sets behind 30 hashes is sent to few groups, and all that met still meet."""
    rows = [(30 * f + m, 100 * f + c, 9) for f in range(5) for m in range(30) for c in range(20) if c != m]
    both = jaccard._together(spark.createDataFrame(rows, "meeting long, class_id long, n long")).toPandas()
    met = [set(own) for _, own in both.groupby("meeting")["class_id"]]
    assert len(both) <= 3 * 100 and max(map(len, met)) <= 20
    for f in range(5):
        for m in range(30):
            assert any({100 * f + c for c in range(20) if c != m} <= own for own in met)


def test_tables_of_near_dedup_go_when_read(spark, corpus):
    """Neither shuffle files of a written table nor tables that hold hashes of all documents are left behind."""
    blocks = lambda: str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" "))
    before = set(re.findall(r"shuffle_\S+", blocks()))
    table = stored(spark.range(20_000).selectExpr("id", "id % 7 as k").groupBy("k").count(), "counts")
    assert not set(re.findall(r"shuffle_\S+", blocks())) - before and table.count() == 7
    discard(table)
    root = Path(shared_dir(spark).removeprefix("file:")) / "siftline"
    assert not Path(table._stored_at).exists()
    known = set(root.iterdir())
    assert jaccard.one_of_each(frame(spark, corpus)).count()
    left = {p.name.split("-")[0] for p in set(root.iterdir()) - known}
    assert "documents" in left and not left & {"shingles", "sets", "routed", "members", "apart"}


# -- 3 ------------------------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(800):
        text = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(40))] + [0]
        assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("counters", [1023, 20])
def test_suffix_dedup(spark, corpus, monkeypatch, counters):
    monkeypatch.setattr(substrings, "TASK_ANCHORS", 2000)
    monkeypatch.setattr(substrings, "TASK_BYTES", 20_000)
    monkeypatch.setattr(substrings.frequent_grams, "__defaults__", (counters,))
    texts = [*corpus, "a" * 700, "ab" * 300, "a" * 199, "a" * 200, "\0" * 300]
    out = substrings.repeat_digests(substrings.remove_repeats(frame(spark, texts)))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(texts)


def test_suffix_dedup_without_ids_and_with_shared_ones(spark):
    rng = random.Random(8)
    quote = " ".join(words(rng, 80))
    texts = ["a start " + quote, quote + " an end", "b " + quote + " c", "b " + quote + " c", " ".join(words(rng, 90, 10**6)), None, ""]
    ids = [None, 4, None, None, 4, 4, None]
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(2)
    out = substrings.repeat_digests(substrings.remove_repeats(rows))
    plain = sorted((str(i), *r[1:]) for i, r in zip(ids, brute.repeats(texts)))
    assert sorted((str(r[0]), *r[1:]) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == plain


# -- 4 ------------------------------------------------------------------------------


@pytest.mark.parametrize("counters", [1023, 3])
def test_exact_dedup(spark, corpus, counters):
    texts = [*corpus, *["same \t text"] * 40, *["same text"] * 5, *["other"] * 9]
    out = exact.exact_duplicates(frame(spark, texts), counters=counters)
    assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(texts)


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    out = exact.exact_duplicates(df).collect()
    assert sorted((r["text_sha256"] == brute.sha("a"), r["kept"]) for r in out).count((True, True)) == 1
    assert sum(r["kept"] for r in out) == 2 and {r["group_size"] for r in out} == {2, 3}


def test_rows_left_by_exact_dedup_are_those_op4_keeps(spark):
    rows = [(1, "a  b"), (1, "a b"), (2, "a b"), (3, "c"), (3, "c"), (3, "d"), (None, "c"), (None, "e"), (None, "e"), (None, None), (4, "")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5)
    found = exact.exact_duplicates(df)
    want = sorted((str(r["doc_id"]), r["text_sha256"]) for r in found.collect() if r["kept"])
    left = exact.without_copies(df)
    assert sorted((str(r["doc_id"]), brute.exact([r["text"]])[0][4]) for r in left.collect()) == want
    assert left.columns == df.columns and len(want) == 5


@pytest.mark.parametrize("counters", [1023, 3])
def test_rows_left_by_exact_dedup_keep_columns_of_any_name(spark, counters):
    ids = [3, 3, None, None, None, None, 7, 2, 2, None, None]
    texts = ["a  b", "a b", "a b", "only", "only", "only ", "", None, "", "last", "last"]
    rows = [(i, t, f"k{n}", n, "part", n * 2, "row") for n, (i, t) in enumerate(zip(ids, texts))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _nth int, _part string, `digest.x` int, row string").repartition(4)
    left = exact.without_copies(df, counters=counters)
    assert left.columns == df.columns
    out = sorted((str(r["doc_id"]), r["text"] or "", r["_nth"]) for r in left.collect())
    assert [r[:2] for r in out] == [("2", ""), ("3", "a  b"), ("None", "last"), ("None", "only"), ("None", "only ")]
    assert all(int(r["_key"][1:]) == r["_nth"] and r["digest.x"] == 2 * r["_nth"] and r["_part"] == "part" for r in left.collect())
    marks = exact.exact_duplicates(df, counters=counters)
    assert marks.where("kept").count() == 5 and marks.count() == len(rows)


# -- 5 ------------------------------------------------------------------------------


def test_packing(spark, corpus):
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENS[0])
    rows = [r.asDict() for r in packing.pack_documents(frame(spark, corpus), *TOKENS, window=256, group_docs=64).collect()]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    for i, t in enumerate(corpus):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    filled = sum(r["length"] for r in rows) / (256 * len(sequences))
    assert filled > 0.9


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(9)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    rooms, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, w) for w, room in enumerate(rooms) if room >= lengths[i]]
        if not fits:
            rooms.append(100)
            fits = [(100, len(rooms) - 1)]
        least = min(room for room, _ in fits)
        want[i] = least
        rooms[[w for room, w in fits if room == least][-1]] -= lengths[i]
    windows, offsets = packing.best_fit_decreasing(lengths, 100)
    assert len(set(windows)) == len(rooms)
    assert all(100 - offsets[i] == want[i] for i in range(len(lengths)))


# -- 6 ------------------------------------------------------------------------------


def test_sentencepiece(spark, corpus):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*corpus, " a ", "a ", "<s> </s><unk> <0x0A>", "a\tb \n c"]
    out = {r["doc_id"]: r for r in sentencepieces.encode_pieces(frame(spark, texts), path).collect()}
    digests = {r["doc_id"]: r for r in sentencepieces.piece_digests(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        joined = ",".join(map(str, ids))
        assert (out[i]["n_tokens"], out[i]["ids"], out[i]["decoded"]) == (len(ids), joined, model.decode(ids))
        assert (digests[i]["ids_sha256"], digests[i]["decoded_sha256"]) == (brute.sha(joined), brute.sha(model.decode(ids)))


def test_byte_pairs_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(TOKENS[0]), random.Random(1)
    parts = ["it's", "we'll", "The", "été", "12", "3.4", " ", "  ", "\n", "\t", "a_b", "--", "日本", " ", "x.", "y,", "'s", "ª", "🙂"]
    parts += ["<|endoftext|>", "<|endoftext"]
    for _ in range(500):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(byte_pairs(*TOKENS).encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    for text in ("a <|endoftext|> b", "<|endoftext|>", "日本 <|endoftext|>x", "<|endoftext|><|endoftext|> é"):
        ids = np.frombuffer(byte_pairs(*TOKENS).encode(text), "<u4").tolist()
        assert ids == Tokenizer.from_file(TOKENS[0]).encode(text, add_special_tokens=False).ids and 50256 in ids


# -- 7 ------------------------------------------------------------------------------


def test_pii(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "@", "x", ".", "-", "1", "12", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 123-4567", "192.168.0.1", "256.1.1.1"]
    parts += ["é", "🙂", " ", "\n", "+", "0", "_", "DE89370400440532013000", "mail"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    texts += [*ODD, "1 " * 20000, "a" * 50000, "a." * 20000 + "@", "+1" + "(" * 20000, "1." * 20000]
    out = {r["doc_id"]: r for r in pii.pii_digests(pii.find_pii(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = brute.pii(t)
        assert out[i]["base_sha256"] == brute.sha(",".join("%s:%d:%d" % x for x in want)), t
        assert [out[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone")]


def test_added_personal_data_needs_its_checks(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE89 3704 0044 0532 0130 01.", "my ssn is 123-45-6789", "part 123-45-6789", None]
    out = got(pii.pii_digests(pii.find_pii(frame(spark, texts))), "doc_id", "spans")
    assert [s for _, s in out] == ["iban:5:32", "", "ssn:10:21", "", ""]
    masked = dict(got(pii.masked(frame(spark, ["write a@b.cd or +1 555 123 4567!", None, "none"])).where("text is not null"), "doc_id", "text"))
    assert masked == {0: "write <EMAIL> or <PHONE>!", 2: "none"}


def test_iban_ends_where_its_country_says(spark):
    cases = {
        "IBAN DE89370400440532013000 Please pay": "iban:5:27", "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": "iban:5:32",
        "GB82 WEST 1234 5698 7654 32 And more": "iban:0:27", "DE89 3704 0044 0532 0130 00 I said": "iban:0:27",
        "BE68 5390 0754 7034 EUR 20": "iban:0:19", "NR12 IBAN DE89 3704 0044 0532 0130 00 2024": "iban:10:37",
        "XX46370400440532013000 Please": "iban:0:22", "XX46 3704 0044 0532 0130 00 Please": "iban:0:27", "DE89370400440532013000X": "",
        "DE89370400440532013001 Please": "", "GB82 WEST 1234 5698 7654 32, DE89370400440532013000 Or": "iban:0:27,iban:29:51",
    }
    out = got(pii.find_pii(frame(spark, list(cases))), "doc_id", "pii")
    shown = [",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans if x["kind"] == "iban") for _, spans in out]
    assert dict(zip(cases, shown)) == cases


def test_masking_keeps_columns_of_any_name(spark):
    rows = [(1, "to a@b.cd now", "mine", "own"), (None, None, None, None), (2, "", "p", "q"), (1, "to a@b.cd now", "mine", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string, _pii_email string")
    out = pii.masked(df)
    assert out.columns == df.columns
    plain = [(1, "to <EMAIL> now", "mine", "own"), rows[1], rows[2], (1, "to <EMAIL> now", "mine", "own")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, plain))


def test_local_phone_with_points_only(spark):
    out = dict(got(pii.pii_digests(pii.find_pii(frame(spark, ["please call 555.123.4567", "555 123.4567 (mobile)", "v 555.123.4567"]))), "doc_id", "spans"))
    assert out == {0: "phone_local:12:24", 1: "phone_local:0:12", 2: ""}


# -- 8 ------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="home has-sidebar"><header class="top"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="wrap-%d"><div class="post-content"><h2>A &amp; B</h2><p>One<br>two
<a href=x>three</a><p>Four<div class="ad">Buy</div><ul><li>i1<li>i2</ul></div>
<div class="sidebar">Side</div><div class="comments"><p>%s</p></div></div><form><input>mail</form><footer>&copy;</footer></body></html>"""
TEXT = "A & B\nOne two three\nFour\ni1\ni2"


def test_html(spark):
    pages = [(i, f"https://Host.example/{i}", PAGE % (i, "nice post " * 40)) for i in range(4)]
    pages += [(10, None, "<p>only"), (11, "x", None), (12, "x", ""), (13, "x", "a < b > c <"), (14, "x", "<div><p>" * 300 + "deep"), (4, "https://host.example/4", PAGE % (4, ""))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in html.extract_pages(df).collect()}
    assert [out[i]["text"] for i in (0, 1, 2, 3, 4)] == [TEXT] * 5
    assert [out[i]["text"] for i in (10, 11, 12, 13, 14)] == ["only", "", "", "a < b > c <", "deep"]
    assert all(r["n_chars"] == len(r["text"]) for r in out.values()) and out[10]["url"] is None
    assert html.extract_pages(df.limit(0)).count() == 0


def test_consensus_overrules_a_page_where_its_path_has_enough(spark):
    short = '<body><div class="main"><p>%s</p></div><div class="box"><p>%s</p></div></body>'
    pages = [(i, "http://h/", short % ("article text " * 30, "box")) for i in range(6)]
    pages += [(6, "http://h/", short % ("brief text " * 20, "box text " * 50)), (7, "http://h/", short % ("tiny", "box text " * 50))]
    out = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[6] == ("brief text " * 20).strip() and out[7] == ("box text " * 50).strip()


LONG = "<p>" + "A long article of many words. " * 20 + "</p>"


@pytest.mark.parametrize("page, text", [
    ('<div class="container has-sidebar"><main>%s</main></div>', "%s"),
    ('<div class="layout sidebar-right"><div class="a">%s</div><div class="sidebar">Side</div></div>', "%s"),
    ('<form id="aspnetForm"><div><article>%s</article></div></form>', "%s"),
    ('<form id="aspnetForm"><div>%s</div></form><div class="site-footer">Firm</div>', "%s"),
    ('<div class="page no-login">%s</div>', "%s"),
    ('<h1>Title</h1><p>Lead</p><div class="x">%s</div>', "Title\nLead\n%s"),
    ('<div class="post"><h1>Title</h1><article>%s</article></div>', "Title\n%s"),
    ('<div class="x">%s</div><div class="comments"><p>' + "nice post " * 200 + "</div>", "%s"),
    ('<div class="x"><p>Short.</div><div class="cookie-notice">' + "we use cookies " * 5 + "</div><form>mail us</form>", "Short."),
    ('<article>%s</article><div class="related-posts"><article>Another one</article></div>', "%s"),
])
def test_articles_in_ordinary_layouts(page, text):
    body = ("A long article of many words. " * 20).strip()
    full = "<html><body>" + page.replace("%s", LONG) + "</body></html>"
    assert html.main_text(html.read_page(full), []) == text.replace("%s", body)


def test_deep_pages_take_little_memory():
    import tracemalloc

    for page in ("<div>" * 100_000 + "deep text", "<div><p>t" * 50_000, "<div class=a>" * 50_000 + "</p>" * 50_000 + "x"):
        tracemalloc.start()
        assert html.main_text(html.read_page(page), [])
        assert tracemalloc.get_traced_memory()[1] < 120e6
        tracemalloc.stop()


def test_random_pages_equal_a_plain_version():
    rng = random.Random(12)

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 3, 30])))
            return rng.choice(["<p>%s</p>", "<h1>%s</h1>", '<p><a href="x">%s</a></p>', "<p>one <a href=y>%s</a> two</p>"]) % words
        tag = rng.choice(["div", "div", "div", "section", "article", "main", "form", "nav", "footer", "header"])
        name = rng.choice(["", "a", "b2", "sidebar", "sidebar-left", "has-sidebar", "comments", "post-content", "site-header", "x ad", "col-3 share"])
        inner = "".join(element(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f'<{tag} class="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    pages = ["<body>" + "".join(element(4) for _ in range(rng.randrange(1, 4))) + "</body>" for _ in range(1500)]
    names = [brute.html_best(p) for p in pages]
    for page, name in zip(pages, names):
        own = html.read_page(page)
        best = html.best_path(own, own.scores())
        assert (None if best is None else own.name(best)) == name
        for winning in ([], [rng.choice(names) or "body"]):
            assert html.main_text(own, winning) == brute.html_text(page, winning)
    assert sum(n is not None and n.count("/") > 1 for n in names) > 100


def test_title_lead_and_closing_beside_the_body_container(spark):
    page = (
        '<body><div class="page"><div class="links"><a href=x>%s</a></div><div class="post"><h1><a href=y>Title</a></h1><div class="lead"><p>The lead, see'
        ' <a href=z>this</a>.</div><div class="sidebar">Side</div><div class="text"><p>%s</div><div class="more"><a href=o>Other page</a></div>'
        '<div class="end"><p>Closing.</div></div></div></body>'
    )
    pages = [(i, "http://h/", page % ("Elsewhere " * 30, "body text %d " % i * 40)) for i in range(3)]
    out = html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {
        i: "\n".join(["Title", "The lead, see this.", ("body text %d " % i * 40).strip(), "Closing."]) for i in range(3)
    }


# -- 9 ------------------------------------------------------------------------------


def test_quality(spark, corpus):
    rng = random.Random(8)
    texts = [*corpus, *[" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(100)], "same line\n" * 30, "a b\v c\f d\r e\x85 f  g # $"]
    out = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeat = brute.quality(t)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeat), t
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])
    kept = quality.passing(frame(spark, texts))
    assert got(kept, "doc_id") == [(i,) for i in range(len(texts)) if out[i]["kept"]] and "spans" in kept.columns


def test_longest_repeats():
    rng = random.Random(6)
    docs = [[rng.randrange(3) for _ in range(rng.randrange(25))] for _ in range(40)]
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    ends = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs])
    longest = quality.longest_repeats(doc * 3 + np.array([w for d in docs for w in d]), ends).tolist()
    want = []
    for d in docs:
        for i in range(len(d)):
            best = 0
            for j in range(len(d)):
                k = 0
                while j != i and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
    assert longest == want


# -- 10 -----------------------------------------------------------------------------


def test_secrets(spark):
    rng = random.Random(3)
    parts = ["token", "secret", "PassWord", "api_key", "apikey", "passwd", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGH1234567"]
    parts += ["abcdef0123456789ab", "deadbeef", "é", "x", "\n", "0123", "/+", "=="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)] + ODD
    base = [r.kind for r in secrets.RULES[: secrets.BASE]]
    for t in texts:
        assert [x for x in secrets.secret_spans(t or "") if x[0] in base] == brute.secrets(t), t
    out = {r["doc_id"]: r for r in secrets.secret_digests(secrets.find_secrets(frame(spark, texts[-400:]))).collect()}
    for i, t in enumerate(texts[-400:]):
        assert out[i]["base_sha256"] == brute.sha(",".join("%s:%d:%d" % x for x in brute.secrets(t)))
    assert secrets.secret_spans("key ghp_" + "a1B2" * 9) == [("github", 4, 44)]


# -- 11 -----------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (1, 10, 1000, 2**40, 2**62):
            values = np.sort(rng.integers(0, top, n).astype(np.uint64))
            packed = encoded(values)
            read = EliasFano(packed)
            assert (read.values(0, n) == values).all()
            for _ in range(20 if n else 0):
                i, x = int(rng.integers(n)), int(rng.integers(0, top + 1))
                assert read.select(i) == int(values[i]) and read.below(x) == int(np.searchsorted(values, np.uint64(x)))
    ends = np.cumsum(rng.integers(1, 2000, 100_000)).astype(np.uint64)
    assert 8 * len(encoded(ends)) < len(ends) * (2.2 + np.log2(int(ends[-1]) / len(ends)))


def token_rows(rows):
    """(doc, start, ids) in the order of the files, by the tokenizer itself."""
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(TOKENS[0]), [], 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_token_output(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "READ_IDS", 700)
    path = str(tmp_path / "ids")
    tokenfiles.write_tokens(frame(spark, corpus), path, *TOKENS, shard_ids=3000)
    tokens = tokenfiles.read_tokens(spark, path)
    want = token_rows(enumerate(corpus))
    assert got(tokens, "doc_id", "start", "ids") == want
    import zlib

    assert got(tokenfiles.token_digests(tokens), "doc_id", "start", "n_tokens", "ids_crc32") == [
        (doc, start, len(ids) // 4, zlib.crc32(ids)) for doc, start, ids in want
    ]
    with pytest.raises(Exception, match="holds a table"):
        tokenfiles.write_tokens(frame(spark, corpus[:3]), path, *TOKENS)


def test_token_output_without_ids_and_with_repeated_ones(spark, tmp_path):
    path = str(tmp_path / "ids")
    rows = [(7, "x y", 1), (None, "a b", 1), (7, "x y", 2), (-3, None, None), (None, None, 3), (7, "z", None)]
    tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, ids int"), path, *TOKENS)
    out = sorted(tokenfiles.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, None, -3, 7, 7, 7]
    assert sorted(bytes(r["ids"]) for r in out) == sorted(ids for _, _, ids in token_rows([r[:2] for r in rows]))
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:i]) for i in range(6)]


def test_a_shard_gives_single_documents(tmp_path):
    from pyarrow import fs

    store, path = fs.LocalFileSystem(), str(tmp_path / "one")
    writer = tokenfiles.ShardWriter(store, path, 2)
    docs = [np.arange(i % 7 + 1, dtype="<u2") for i in range(1000)]
    for i, ids in enumerate(docs):
        writer.add(3 * i, ids.tobytes())
    writer.close()
    shard = tokenfiles.Shard(store, path)
    for i in (0, 1, 255, 256, 999):
        assert shard.document(i).tolist() == docs[i].tolist() and shard.doc_ids(i, i + 1) == [3 * i]
    cuts = [shard.starting_in(a, a + 100) for a in range(0, sum(map(len, docs)), 100)]
    assert cuts[0][0] == 0 and cuts[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))


# -- 12 -----------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_centroid_clusters(spark, chunk):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(5)]) for i in range(150)] + [(900 + i, [0.25] * 5) for i in range(60)]
    odd = [(1, None), (2, []), (3, [0.1] * 4), (4, [0.1, None, 0.1, 0.1, 0.1]), (5, [float("nan")] * 5), (6, [float("inf")] + [0.0] * 4)]
    rows += [(7, [-300.0] * 5), (7, [-300.0] * 5), (None, [0.5] * 5)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, cluster int").repartition(3)
    out = centroids.centroid_clusters(df, k=9, rounds=4, dim=5, chunk=chunk)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(brute.centroids(rows, 9, 4), key=repr)


def test_fewer_vectors_than_clusters_and_far_ones(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert got(centroids.centroid_clusters(df, dim=2), "vec_id", "cluster", "distance") == [(1, 0, 0), (2, 0, 0)]
    with pytest.raises(Exception, match="would leave 64 bits"):
        centroids.centroid_clusters(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dim=1).collect()


# -- 13 -----------------------------------------------------------------------------


def test_spelling_variants(spark, corpus):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(5, 12))) for _ in range(60)] + ["ñ" * 3000]
    texts = []
    for word in base:
        for _ in range(4):
            at = rng.randrange(len(word))
            other = word[:at] + rng.choice(["", "x", "ab", "É"]) + word[at + rng.randrange(2) :]
            texts += [f"{other}, {word.upper()}-{word} "] * rng.choice([5, 6, 30])
    texts = [" ".join(texts[i : i + 40]) for i in range(0, len(texts), 40)] + corpus
    want = brute.spellings(list(enumerate(texts)))
    assert sum(x[1] is not None for x in want) > 20
    assert got(spellings.spelling_variants(frame(spark, texts)), "word", "form", "root", "n", "n_near", "form_n") == want


def test_signatures_meet_for_every_near_pair(spark):
    words = ["aaaaaa", "aaaaab", "aaaaa", "baaaaa", "abaaaa", "abcdef", "abcdeg", "xbcdef", "abcxdef", "bcdef", "abcde", "abdcef", "ééééé", "éééé"]
    found = spellings.near_words(spark.createDataFrame([(w,) for w in words], "word string"))
    assert got(found, "word", "other") == sorted((a, b) for a in words for b in words if brute.one_apart(a, b))


# -- all ----------------------------------------------------------------------------


def test_empty_tables(spark, tmp_path):
    documents = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_null_ids_and_repeated_rows(spark, tmp_path):
    rows = [(1, "a b c d e", "en", None, None), (1, "a b c d e", "en", None, None), (None, None, None, None, None), (None, "a b c d e", None, "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name, query in queries.QUERIES.items():
        if name.startswith(("op8_", "op12_", "op13_")):  # other tables, or not a row per document
            continue
        assert query(spark, str(tmp_path)).count() == 4, name

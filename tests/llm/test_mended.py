"""Cases that earlier versions got wrong: ids shared by documents, class differences, clashing names, features, curves."""

import zlib

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from fieldspark.llm import bpe_trie, bytebpe, common, decontaminate, parity_join, token_counts, toxicity
from fieldspark.llm.common import append, plain_words
from fieldspark.llm.queries import VOCABULARY

from .test_operators import brute_hits, labelled

# --- splitting ---------------------------------------------------------------


def test_splits_of_all_characters_equal_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    pre = bytebpe.PreTokens({}, bytebpe.stand_ins())
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for i in range(0, len(every), 1024):
        text = "".join(f"a{c}1{c}!{c}\n" for c in every[i : i + 1024])
        got = [len(w) for w in pre.words(text)]
        ends = sorted({b for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)})
        assert np.cumsum(got).tolist() == ends
    odd = [chr(c) for c in bytebpe.stand_ins()]
    assert odd  # the packages differ here; else this test says nothing
    texts = [f"a{c}'s {c}{c}9 {c}" for c in odd[:: max(1, len(odd) // 200)]] + ["a\u0558's", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: e.ids for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_trie.encode(df, VOCABULARY).collect()}
    assert ids == want
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, VOCABULARY).collect()} == {i: len(v) for i, v in want.items()}


# --- names -------------------------------------------------------------------


def test_helper_columns_do_not_clash(spark):
    columns = "text string, text_ string, __text string, spans string, items string, __spans string"
    df = spark.createDataFrame([("a b", "1", "2", "3", "4", "5")], columns)
    got = append(df, "text", "n bigint", lambda: lambda texts: [[len(t) for t in texts]]).first()
    assert got.asDict() == {"text": "a b", "text_": "1", "__text": "2", "spans": "3", "items": "4", "__spans": "5", "n": 3}
    bench = spark.createDataFrame([("x", "a b"), ("y", "c")], "item_id string, text string")
    got = decontaminate.find_overlaps(df, bench, group_bytes=1).first()
    assert (got.spans, got["items"], got["__spans"], got.hit_items) == ("3", "4", "5", ["x"])


def test_repeated_benchmark_rows(spark):
    words = " ".join(f"w{i}" for i in range(14))
    docs = [(1, words), (2, "w0 w1"), (3, "q " + words[:40])]
    items = [("a", words)] * 50 + [("b", "w0 w1"), ("a", "w0 w1"), (None, "w0 w1")]
    got = decontaminate.overlap_report(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"))
    for r in got.collect():
        n, hit, found = brute_hits(dict(docs)[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))


# --- one document of each group ----------------------------------------------


def kept_by_hand(rows):
    """Rows as documents of their own: of each set of linked ones the first by number, then digest of the text."""
    import hashlib

    distinct = sorted({(d is None, d or 0, hashlib.md5((t or "").encode()).digest(), t) for d, t in rows}, key=lambda k: k[:3])
    numbered = [(i, k[3]) for i, k in enumerate(distinct)]
    from .test_operators import brute_components

    first = {i: c for i, _, c in brute_components(numbered)}
    out = sorted(str((k[1], k[3])) for i, k in enumerate(distinct) if not k[0] and first[i] == i)
    return out + sorted(str((None, t)) for d, t in rows if d is None)


def test_keep_one_with_shared_numbers(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(2, a), (5, a), (5, b), (9, b), (1, "c " * 9), (1, "c " * 9), (1, None), (None, a), (None, a), (4, ""), (3, a + " x"), (7, b + " x"), (7, "alone")]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id bigint, text string, old int, row string")
    got = parity_join.keep_one(df)
    assert got.columns == df.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    plain = sorted(str(r) for r in found if r[0] is not None) + sorted(str(r) for r in found if r[0] is None)
    assert plain == kept_by_hand(rows)


# --- toxicity ----------------------------------------------------------------


def test_derivatives_equal_finite_differences():
    rng = np.random.default_rng(3)
    parts = []
    for length, often in ((64, 1), (64, 3), (10, 2), (1, 5)):
        f = rng.integers(0, 6, (length, toxicity.SLOTS)).astype(np.uint16)
        f[rng.random(length) < 0.5] = 0
        parts.append((f.tobytes(), rng.integers(0, 2, length).astype(np.uint8).tobytes(), often))
    block = toxicity.Sequences.of(parts)
    w, t = rng.normal(size=6) * 0.5, rng.normal(size=(2, 2)) * 0.5
    _, by_word, by_move = toxicity.likelihood(block, w, t)
    step = 1e-5
    for i in range(6):
        up, down = w.copy(), w.copy()
        up[i] += step
        down[i] -= step
        assert (toxicity.likelihood(block, up, t)[0] - toxicity.likelihood(block, down, t)[0]) / (2 * step) == pytest.approx(by_word[i], abs=1e-4)
    for i in (0, 1):
        for j in (0, 1):
            up, down = t.copy(), t.copy()
            up[i, j] += step
            down[i, j] -= step
            assert (toxicity.likelihood(block, w, up)[0] - toxicity.likelihood(block, w, down)[0]) / (2 * step) == pytest.approx(by_move[i, j], abs=1e-4)


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    parts = [(rng.integers(0, 4, (20, toxicity.SLOTS)).astype(np.uint16).tobytes(), rng.integers(0, 2, 20).astype(np.uint8).tobytes(), 1 + i % 3) for i in range(40)]
    whole = toxicity.train(toxicity.Sequences.of(parts), 4, rounds=5)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    split = toxicity.train(toxicity.Sequences.of(parts), 4, rounds=5)
    assert np.allclose(whole[0], split[0], atol=1e-9) and np.allclose(whole[1], split[1], atol=1e-9)


def test_curve_never_falls():
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.4).astype(float)
    total = y * rng.random(400) * 5
    for most in (np.zeros(400), -total, 1 / (1 + total), rng.random(400)):
        curve = toxicity.fit_curve(np.column_stack([total, np.abs(most)]), y, np.ones(400))
        assert curve[1] >= 0 and curve[2] >= 0


def test_features_and_labelled_tokens():
    assert toxicity.features_of("vequté".encode()) == ["vequté".encode(), "vequt*".encode(), b"vequ*"]
    look = toxicity.Remembered({b"vequ*": 3, b"bad": 7}, toxicity.numbered)
    f, s = toxicity.labelled_tokens(plain_words("so bad a vequxyz and a very long way to bad".encode()), 1, look)
    assert f.tolist() == [[0] * 4, [7, 0, 0, 0], [0] * 4, [3, 0, 0, 0], *[[0] * 4] * 6, [7, 0, 0, 0]]
    assert s.tolist() == [0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1]


def test_beginnings_carry_over_to_unseen_words(spark):
    docs, labels, n = labelled(spark)
    more = [(5000 + i, f"w{i % 400} xyzzy{i:05d}q w{i % 7}", i) for i in range(600)]
    extra = spark.createDataFrame([(i, t if k % 4 == 0 else t.replace("xyzzy", "w")) for i, t, k in more], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(k % 4 == 0)) for i, _, k in more], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs.select("doc_id", "text").union(extra), labels.union(marks)).where("doc_id >= 5000 AND held_out").collect()
    assert sum(r.predicted == int((r.doc_id - 5000) % 4 == 0) for r in got) / len(got) > 0.95
    assert all(r.toxic_spans for r in got if r.predicted)


def test_repeated_numbers_and_long_texts_in_the_fit(spark):
    docs, labels, n = labelled(spark)
    again = docs.select("doc_id", "text")
    once = toxicity.fit(again, labels)
    assert toxicity.fit(again.union(again).union(again), labels).words == once.words
    rows, counts = toxicity.sampled(again.union(again), labels, 100)
    assert rows.groupBy("toxic").count().where("count > 100").isEmpty() and sum(counts.values()) > 400
    long = spark.createDataFrame([(10_000 + i, "w1 " * 40_000 + "qwertz " * (i % 2)) for i in range(40)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(10_000 + i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    assert b"qwertz" in toxicity.fit(long, marks).words  # beyond 100 KB, after all else


def test_held_out_quality_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 3) == 1 for i in got.doc_id)
    ranks, toxic = got.score.rank(), got.toxic == 1
    n1, n0 = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert got[got.predicted == 1].toxic.mean() > 0.95 and got[toxic].predicted.mean() > 0.85
    for low, high in ((0.0, 0.1), (0.9, 1.01)):  # where nearly all scores are
        part = got[(got.score >= low) & (got.score < high)]
        assert abs(part.score.mean() - part.toxic.mean()) < 0.05
    assert regex.search(r"^\d+:\d+", got[got.predicted == 1].toxic_spans.iloc[0])


def test_slices_of_texts():
    texts = [b"a" * n for n in (3, 3, 3, 20, 1, 0, 9)]
    parts = list(bpe_trie.sliced(texts, 7))
    assert [t for p in parts for t in p] == texts and [list(map(len, p)) for p in parts] == [[3, 3], [3], [20], [1, 0], [9]]
    assert list(bpe_trie.sliced([])) == []


def test_forgotten_words_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe_trie, "REMEMBERED", 8)
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    bpe = bytebpe.ByteBpe.read(VOCABULARY)
    alone = {i for token, i in bpe.ids.items() if bpe.merge(token) == [i]}
    encoder = bpe_trie.TrieEncoder(bpe, alone, bytebpe.stand_ins())
    texts = ["one two three four five", "", "six seven eight one two", "x" * 70 + " nine ten", "one six unfathomably", "three " + "x" * 70]
    for text in texts * 3:  # one call each: words pass from the newer to the older memory and back, or are lost
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.older and len(encoder.known) < 12


def test_parts_that_handed_over_all_their_pairs_are_not_looked_at_again(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:40] + [f"x{i}" for i in range(20)]), " ".join(words[:40] + [f"y{i}" for i in range(20)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    state = parity_join.Join(docs)
    state.test(state.met.where("kind = 1").select("a", "b").distinct())
    found = state.left_over(True)
    cut = found.where("cut").select("run").distinct()
    assert state.left_over(False, cut.limit(0)).isEmpty()
    assert {r.component_id for r in parity_join.join_documents(docs).collect()} == {0, 1, 2}


def test_batches_are_bounded_by_their_bytes(spark):
    docs = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text")
    sizes = common.append(docs, "text", "n bigint", lambda: lambda texts: [[len(texts)] * len(texts)], keep=["id"]).collect()
    assert len(sizes) == 40 and max(r.n for r in sizes) <= 10

"""Each operator against a plain version on small tables with nulls, empty and long texts, repeated rows, clashing columns and no rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldspark.llm import bpe_trie, chat_format, decontaminate, parity_join, sharding, token_counts, toxicity, url_templates, warc, weighted_sampling
from fieldspark.llm.chat_template import Template
from fieldspark.llm.common import plain_words, spaced_words
from fieldspark.llm.url_templates import Rule

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Columns that operators use for their own results, as callers may bring them.
CLASHING = "doc_id bigint, text string, n bigint, node bigint, score double, row int, words string, hit_spans string, shard int"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 0.5, 3, "x", "y", 9) for i, t in rows], CLASHING)


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    rows = [(None, "no number at all here"), (1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (6, "a b c"), (7, "A b  C")]
    for group in range(6):
        base = words(rng, rng.choice([9, 30, 70, 200])).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((100 + len(rows), " ".join(copy)))
    rows += [(900 + i, words(rng, 40)) for i in range(10)]
    rows += [rows[-1], (950, rows[-1][1]), (960, "é ü 漢字 \x00\u2028 <|endoftext|> it's 12345  \r\n" * 5), (970, words(rng, 30_000))]
    return rows


# --- op1 ---------------------------------------------------------------------


def test_rules_and_malformed_urls(spark):
    urls = [None, "", "no scheme/path", "http://A.Example.org/es/x?q#f", "https://example.org/en/12", "ftp://badexample.org/es/1", "http://x.com", "http://fr.com/fr/?a", "http://h/p#://z"]
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)], "page_id bigint, url string, host string, label string")
    labels = spark.createDataFrame([], "id bigint, label int")
    rules = [Rule(True, "org/"), Rule(False, "example.org/es/"), Rule(False, "example.org/en/1"), Rule(True, "com/fr/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(pages, labels, rules).collect()}
    assert got == {
        0: ("", "", None, "allow"),
        1: ("", "", None, "allow"),
        2: ("", "", None, "allow"),
        3: ("a.example.org", "/es/x", "example.org/es/", "block"),
        4: ("example.org", "/en/12", "example.org/en/1", "block"),
        5: ("badexample.org", "/es/1", "org/", "allow"),
        6: ("x.com", "", None, "allow"),
        7: ("fr.com", "/fr/", "com/fr/", "allow"),
        8: ("h", "/p", None, "allow"),
    }
    assert url_templates.judge(pages.limit(0), labels, rules).count() == 0


def test_impure_templates_are_blocked(spark):
    rows = [(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)] + [(None, 1), (3, None)], "id bigint, label int")
    got = url_templates.judge(pages, labels, []).collect()
    assert {(r.template, r.verdict) for r in got} == {("/bad/*9", "block"), ("/good/*9", "allow")}
    alike = labels.select("id", F.lit(1).alias("label"))
    merged = url_templates.judge(pages, alike, []).collect()
    assert {(r.branch, r.verdict) for r in merged} == {("**", "allow")}


# --- op2 ---------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = spaced_words((t or "").encode())
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(top(i), []).append(doc_id)
    smallest = {r: min((d for d in ids if d is not None), default=None) for r, ids in least.items()}
    return sorted(((d, len(s), smallest[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_components_equal_brute_force(spark, texts):
    got = sorted((tuple(r) for r in parity_join.join_documents(frame(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_components(texts)
    assert parity_join.join_documents(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 4, 5, 8, 12, 16, 33, 64, 65, 130, 260])
def test_linked_sets_share_a_key(length):
    """Pairs at the very threshold meet in a part, across size bands too."""
    rng = np.random.default_rng(length)
    for _ in range(40):
        union = rng.integers(0, 2**64, length, np.uint64)
        kept = -(-75 * length // 100)
        one = int(rng.integers(0, length - kept + 1))
        a, b = np.unique(union[: kept + one]), np.unique(np.concatenate([union[:kept], union[kept + one :]]))
        assert parity_join.linked(a.tobytes(), b.tobytes())
        assert parity_join.near_enough(len(a), len(b), parity_join.bit_sketch(a), parity_join.bit_sketch(b))
        assert set(parity_join.join_keys(a).tolist()) & set(parity_join.join_keys(b).tolist())


def test_spanning_pairs_join_every_component():
    a, b = np.array([1, 1, 2, 3]), np.array([2, 3, 3, 4])
    chosen = parity_join._spanning(a, b, a, b, np.array([5, 1, 2, 9]))
    assert chosen.tolist() == [1, 2, 3]


def test_one_of_each_group_stays(spark, texts):
    docs = frame(spark, texts)
    kept = parity_join.keep_one(docs)
    assert kept.columns == docs.columns
    names = {d: c for d, _, c in brute_components(texts)}
    want = sorted({(d, t) for d, t in texts if d is None or names[d] == d}, key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want


# --- op3 ---------------------------------------------------------------------


def brute_hits(text, items, window=10):
    w, hit, found = plain_words((text or "").encode()), set(), set()
    for item, words_ in items:
        b = plain_words((words_ or "").encode())
        n = min(window, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), found


def test_hits_equal_brute_force(spark, texts):
    rows = texts[:-1]
    passage = rows[40][1]
    items = [(1, passage), (2, None), (3, "..."), (4, "One"), (None, "a b c"), (10, " ".join(passage.split()[3:15]).upper()), (10, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for doc_id, text in rows:
        n, hit, found = brute_hits(text, items)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((doc_id, n, hit, len(found), digest, hit > 0))
    docs = frame(spark, rows)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in decontaminate.overlap_report(docs, bench).select(*columns).collect()), key=str) == sorted(want, key=str)
    many = decontaminate.find_overlaps(docs.select("doc_id", "text"), bench, group_bytes=300).select("doc_id", F.size("hit_items").alias("k")).collect()
    assert sorted(((r.doc_id, r.k) for r in many), key=str) == sorted(((w[0], w[3]) for w in want), key=str)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert decontaminate.overlap_report(docs, bench.limit(0)).where("contaminated").count() == 0


# --- op4 ---------------------------------------------------------------------


def test_archives_come_back(spark):
    long, other = "é" * 600, "x" * 999
    rows = [(1, "http://a.b/c", long), (2, None, long), (3, "http://a.b/c", long), (4, "plain", other), (5, "http://A.b", other), (6, "http://q/", None), (7, "u\r\nv", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, pages).collect()}
    want = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = page_id in (1, 2)
        want[page_id] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
    assert got == want
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_look_up_finds_only_the_key(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/p{i}", f"page {i}") for i in range(300)], "page_id bigint, url string, html string")
    captures = warc.write_archives(pages, f"{tmp_path}/a")
    index = warc.write_index(captures, f"{tmp_path}/i")
    wanted = spark.createDataFrame([("org,h3)/p3",), ("org,h3)/none",), (None,)], "key string")
    assert [r.page_id for r in warc.look_up(wanted, index).collect()] == [3]


# --- op5, op8 ----------------------------------------------------------------


def test_tokens_equal_the_library(spark, texts):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    rows = [(d, t) for d, t in texts if d is not None]
    docs = frame(spark, rows)
    encoded = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_trie.round_trip(docs, VOCABULARY).collect()}
    counted = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs.select("doc_id", "text"), VOCABULARY).collect()}
    want_encoded, want_counted = set(), set()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want_encoded.add((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        want_counted.add((doc_id, len((text or "").encode()), len(ids), len(ids) > 1024))
    assert encoded == want_encoded
    assert counted == want_counted
    back = bpe_trie.decode(bpe_trie.encode(docs, VOCABULARY), VOCABULARY)
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe_trie.round_trip(docs.limit(0), VOCABULARY).count() == 0


# --- op6 ---------------------------------------------------------------------


def test_conversations_come_back(spark):
    tricky = ["", None, "\\", "<", "</turn>\n</chat>", "\\<turn>x</role>", "é\r\n\x00", "### Assistant: ok", "a" * 3000]
    rows = [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "system", None]), tricky[(c + t) % len(tricky)], 1) for c in range(5) for t in range(12)]
    rows += [(None, None, "user", "no id", 2), (3, 4, "user", "again", 2), (3, 4, "user", "again", 2)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece int")
    for limit in (chat_format.PIECE, 100):
        got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(table, limit=limit)).collect()}
        assert set(got) == {None, 0, 1, 2, 3, 4}
        for conv, r in got.items():
            turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
            loss = "".join(text for _, role, text in turns if role == "assistant")
            assert r.n_turns == len(turns)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(table.limit(0))).count() == 0


def test_template_errors_show_before_the_run():
    with pytest.raises(Exception):
        Template("{% for m in messages %}", {"escape": str})


def test_templates_reach_keys_only():
    """A dotted name is a key of the row, never an attribute of the object behind it."""
    reached = "{% for m in messages %}{{ m.__class__ }}{{ m.keys }}{% endfor %}"
    try:
        out = "".join(text for text, _ in Template(reached, {"escape": str}).pieces({"messages": [{"role": "user"}]}, 100))
    except Exception:  # noqa: BLE001  (refused outright)
        return
    assert "class" not in out and "method" not in out


# --- op7 ---------------------------------------------------------------------


def test_neighbours_and_edits(spark, texts):
    rows = [(d, t) for d, t in dict(texts).items() if d is not None]
    got = {r.doc_id: r for r in weighted_sampling.compare_neighbours(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    prints = weighted_sampling.Fingerprints()
    assert len(got) == len(rows)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", got[doc_id]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints.of(text.encode()), prints.of(edited.encode()))
        assert r.near_next == weighted_sampling.likeness(r.fingerprint, prints.of(after.encode()))
    assert weighted_sampling.compare_neighbours(frame(spark, [])).count() == 0
    assert [(r.doc_id, r.near_next) for r in weighted_sampling.compare_neighbours(frame(spark, [(5, "only one")])).collect()] == [(5, 1.0)]


def test_collisions_follow_generalised_jaccard():
    rng, prints, errors = random.Random(3), weighted_sampling.Fingerprints(1024), []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        a = {w: rng.randrange(1, 9) for w in WORDS[:120]}
        b = {w: n if rng.random() < share else rng.randrange(1, 9) for w, n in a.items()}
        exact = sum(min(a[w], b[w]) for w in a) / sum(max(a[w], b[w]) for w in a)
        text = lambda bag: " ".join(w for w, n in bag.items() for _ in range(n)).encode()
        errors.append(abs(weighted_sampling.likeness(prints.of(text(a)), prints.of(text(b))) - exact))
    assert max(errors) < 0.06


# --- op9 ---------------------------------------------------------------------


def labelled(spark, n=900):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        toxic = i % 5 == 0
        body = words(rng, 30).split()
        if toxic:
            body[rng.randrange(30)] = rng.choice(["vile1 vile2", "vile2 and vile3"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, "..."), (None, "vile1 vile2")]
    labels += [(n, 0), (None, 1), (0, 1), (1, None)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), n


def test_toxicity_on_held_out_documents(spark):
    docs, labels, n = labelled(spark)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == n + 4
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    tested = [(r.doc_id % 5 == 0, r.predicted) for r in got if r.held_out and r.doc_id < n]
    assert sum(bool(y) == bool(p) for y, p in tested) / len(tested) > 0.95
    empty = {r.score for r in got if r.doc_id in (n, n + 1, n + 2)}
    assert len(empty) == 1 and empty.pop() < 0.5
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped).words == toxicity.fit(docs, labels).words  # held-out labels teach nothing


def test_toxicity_spans_and_filter(spark):
    docs, labels, _ = labelled(spark)
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).where("doc_id IS NULL").first()
    assert [(s.start, s.stop) for s in found.toxic_spans] == [(0, 11)]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id % 5 = 0 AND doc_id < 900").count() == 0 and kept.where("doc_id % 5 <> 0 AND doc_id < 900").count() == 720
    assert toxicity.score_documents(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_marginals_equal_enumeration():
    model = toxicity.Field({b"x": 5.0, b"y": 0.7}, 0.2, ((1.0, 0.4), (0.6, 2.0)))
    sequence = [b"a", b"x", b"b", b"y", b"x"]
    factor = lambda w: model.other * model.words.get(w, 1.0)
    totals, weight_all = [0.0] * 5, 0.0
    for code in range(32):
        states = [(code >> i) & 1 for i in range(5)]
        weight = 1.0
        for i, s in enumerate(states):
            weight *= factor(sequence[i]) if s else 1.0
            weight *= model.moves[states[i - 1]][s] if i else 1.0
        weight_all += weight
        totals = [t + weight * s for t, s in zip(totals, states, strict=True)]
    assert model.marginals(sequence) == pytest.approx([t / weight_all for t in totals])


# --- op10 --------------------------------------------------------------------


def test_shards_and_slots(spark, texts):
    rows = texts + [(i, "same") for i in range(2000, 3500)] + [(7, "same")] * 300
    tree = sharding.even_tree(40)
    got = sharding.shard_documents(frame(spark, rows), tree, sharding.grow(tree)).collect()
    assert len(got) == len(rows)
    slots, shard_of = {}, {}
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "key" and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
        shard_of.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_documents(frame(spark, []), tree, sharding.grow(tree)).count() == 0
    with pytest.raises(ValueError):
        sharding.place(frame(spark, []), "doc_id", [])


def test_changed_weight_moves_keys_only_to_or_from_that_shard(spark):
    tree = sharding.even_tree(20)
    lighter = [sharding.Shard(s.shard, s.region, s.rack, 0.5 if s.shard == 3 else 1.0) for s in tree]
    rows = spark.range(4000).withColumnRenamed("id", "k")
    both = sharding.place(sharding.place(rows, "k", tree, "before"), "k", lighter, "after")
    # subtrees without the shard keep their keys unless these come from its own rack or region
    moved = both.where("before <> after").collect()
    assert moved and all(r.before < 10 for r in moved)

"""Defined cases of the corpus operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from firegrid.llm import ann, chat, decontam, jaccard, langid, maxent, mixing, quality, tokens, urls
from firegrid.llm.common import words
from firegrid.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, size long"
LONG = "ab cd. " * 30_000
ROWS = [(1, "one two three four five six", "en", "a", 1, 0.5, "x", 3), (2, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 0.1, "y", 1), (3, "", "en", "b", 0, 0.1, "y", 1), (None, "one two three four five six", None, "a", 1, 0.5, "x", 3),
        (5, LONG, "en", "a", 1, 0.5, "x", 3), (6, "un deux trois quatre", "fr", None, 2, 0.2, "z", 4), (7, " \n ", "fr", "b", 3, 0.3, "z", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_chat_cases(spark):
    kind = "conv_id long, turn long, role string, text string, block long, pos long"
    turn = lambda c, t, r, x: (c, t, r, x, 9, 9)
    rows = [turn(1, 0, "user", "hi"), turn(1, 1, "bot", "a <|x"), turn(2, 0, "user", "hi"),  # 2 is a snapshot of 1
            turn(3, 5, "user", "hi"), turn(3, 6, "bot", "a <|x"), turn(3, 6, "bot", "a <|x"),  # equal to 1, one row twice
            turn(None, None, None, None), turn(4, 0, "user", "hi"), turn(4, 1, "bot", "other")]
    got = {r["conv_id"]: r for r in chat.collapse_snapshots(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {1, None, 4} and got[1]["copies"] == 2 and got[1]["text"] == "<|user|>\nhi\n<|bot|>\na < |x\n"
    assert got[None]["text"] == "<||>\n\n" and got[4]["n_turns"] == 2
    assert chat.collapse_snapshots(spark.createDataFrame([], kind)).count() == 0


def test_chat_long_conversation_is_ranked_in_blocks(spark):
    rows = [(1, t, "u", str(t)) for t in range(3000)] + [(2, t, "u", str(t)) for t in range(1500)]
    got = chat.collapse_snapshots(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("part").collect()
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in got] == [(1, 0, 3000), (1, 1, 3000), (1, 2, 3000)]
    assert "".join(r["text"] for r in got) == "".join(f"<|u|>\n{t}\n" for t in range(3000))


def test_language_cases(docs, none):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify_folds(docs).collect()]
    assert len(got) == len(ROWS) and {(2, "und", 0.0), (3, "und", 0.0), (7, "und", 0.0)} <= set(got)
    assert langid.identify_folds(none).count() == 0


def test_trigrams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    whole = langid.trigrams(["Añb c-d" * 50, "x"])
    monkeypatch.setattr(langid, "PIECE", 16)
    parts = langid.trigrams(["Añb c-d" * 50, "x"])
    assert sorted(zip(*whole)) == sorted(zip(*parts)) and len(whole[0]) > 100


def test_nearest_cases(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(1000 + i, rows[7][1], "c") for i in range(60)] + [(2000, None, "c"), (2020, [0.0] * 8, "c"), (2040, [1.0, None] + [0.0] * 6, "c"),
             (2060, [float("nan")] * 8, "c"), (2080, [1.0], "c"), (None, rows[0][1], "c"), (5, rows[5][1], "c")]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).toPandas()
    ok = {i: np.array(v) for i, v, _ in rows[:360]}
    ids, m = np.array(sorted(ok)), np.stack([ok[i] for i in sorted(ok)])
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    hits = []
    for q, own in got.groupby("query_id"):
        s = (m * ok[q]).sum(axis=1)
        s[ids == q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & set(own.vec_id)) / 20)
    assert np.mean(hits) >= 0.9
    few = ann.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>, score string"))
    assert few.count() == 3
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>, score string")).count() == 0


def test_index_returns_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    index = ann.Index(codes)
    for radius in (0, 5, 20, 27, 64):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[3]).sum(axis=1) <= radius)
        assert (index.within(codes[3], radius) == want).all()


def test_language_model_cases(docs, none):
    got = maxent.score(docs).toPandas()
    assert len(got) == len(ROWS) and set(got[got.doc_id.isin([2, 3, 7])].n_tokens) == {1} and np.isfinite(got[["score", "base_score"]]).all(axis=None)
    assert maxent.score(none).count() == 0


def test_class_model_sums_to_one():
    rng = np.random.default_rng(3)
    w = rng.normal(size=(maxent.BUCKETS, maxent.CLASSES)).astype(np.float32)
    f = maxent.features(rng.integers(0, 9, 50).astype(np.uint64), rng.integers(0, maxent.CLASSES, 50), np.repeat([0, 1], 25))
    assert np.allclose(np.exp(maxent.log_softmax(w, f)).sum(axis=1), 1, atol=1e-5)


def test_part_model_sums_to_one_and_learns():
    rng = np.random.default_rng(4)
    kind = rng.integers(maxent.HEADS + 1, maxent.CLASSES, 4000)
    word = rng.integers(0, 9, 4000).astype(np.uint64)
    f = maxent.part_features(word, kind, np.repeat(np.arange(40), 100))
    target = np.concatenate([[0], word[:-1].astype(np.int64)])  # the word before decides
    learner = maxent.Learner(np.zeros((maxent.BUCKETS, maxent.PARTS), np.float32))
    for _ in range(20):
        learner.learn(f, target)
    log = maxent.log_softmax(learner.w, f)
    assert np.allclose(np.exp(log).sum(axis=1), 1, atol=1e-5)
    assert log[np.arange(4000), target].mean() > -0.5 > -np.log(maxent.PARTS)


def test_gains_are_averaged_by_many_tokens():
    gains = [np.full(maxent.GRID * maxent.CLASSES, g, np.float16).tobytes() for g in (1.0, -0.5)]
    got = maxent._averaged((7,), pd.DataFrame({"block": 7, "salt": 0, "seen": [300_000, 100_000], "gain": gains}))
    assert (got["block"][0], got["seen"][0]) == (7, 400_000)
    assert np.allclose(np.frombuffer(got["gain"][0], np.float16), 0.625)


def test_held_out_texts_shape_no_model(spark):
    import zlib
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10][:60]
    own = [(i, f"a{i % 7}b c{i % 5}d the e{i % 3}f and g{i}h") for i in learned]
    more = own + [(i, " ".join(f"zq{i}x{k}" for k in range(40))) for i in held]
    a, b = ({r.doc_id: r.score for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()} for rows in (own, more))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in learned)


def test_texts_as_word_numbers():
    texts = ["B a\x0bA  b\x1cc ", None, "", " \t", "\u00c4 \u00e4\u00a0x", "z " * 70_000]
    lot, codes, sizes = maxent.split_texts(pa.array(texts))
    want = [words(t) + [b""] for t in texts]
    assert [lot[i] for i in codes] == [w for own in want for w in own] and list(sizes) == [len(own) for own in want]
    assert len(set(lot)) == len(lot) and (maxent.unpack(maxent.pack(codes)) == codes).all()
    wide = np.array([0, 255, 256, 70_000, 2**32 - 1])
    assert (maxent.unpack(maxent.pack(wide)) == wide).all()
    lot, codes, sizes = maxent.split_texts(pa.array([], pa.string()))
    assert lot == [b""] and len(codes) == 0 and len(sizes) == 0


def test_url_cases(spark):
    kind = "page_id long, url string, host string, verdict string"
    rows = [(1, "http://A.com/x?y", "h", "v"), (2, None, "h", "v"), (3, "no scheme", "h", "v"), (4, "http://example.com/en/1", "h", "v"),
            (5, "http://www.Example.com/en/1", "h", "v"), (6, "x://com", "h", "v"), (7, "http://a.net/es/", "h", "v"), (8, "http://u.org/" + "q" * 600_000, "h", "v"),
            (9, "a://b://c/d", "h", "v"), (1, "http://A.com/x?y", "h", "v")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, kind)).collect()}
    show = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert show[1] == ("a.com", "/x", "com/", "allow") and show[2][:3] == show[3][:3] == ("", "", None)
    assert show[4][2:] == ("example.com/en/", "block") and show[5][2:] == ("www.example.com/en/", "allow") and show[6][:3] == ("com", "", None)
    assert show[7][2:] == ("net/es/", "block") and show[8][3] in ("allow", "block") and show[9][:2] == ("b:", "//c/d")
    assert urls.judge(spark.createDataFrame([], kind)).count() == 0
    assert [r["verdict"] for r in urls.judge(spark.createDataFrame(rows[5:6], kind)).collect()] == ["allow"]


def test_knapsack_against_all_subsets():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s, c, b = rng.choice(np.arange(1, 15), 4, replace=False), rng.integers(1, 4, 4), int(rng.integers(1, 60))
        best = max(x for x in (sum(a * k for a, k in zip(s, ks)) for ks in itertools.product(*(range(k + 1) for k in c))) if x <= b)
        got = mixing.knapsack(s, c, b)
        assert (got <= c).all() and (got * s).sum() == best


def test_targets_reshare_the_excess():
    assert mixing.targets({"a": 10, "b": 100, None: 50}) == {"a": 20.0, None: 100.0, "b": 120.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mixture_cases(docs, none):
    got = mixing.mixture(docs).toPandas()
    assert len(got) == len(ROWS) and (got.taken <= 2 * got["size"]).all()
    again = mixing.mixture(docs).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values)) == sorted(map(str, again[key].values))
    mix = mixing.expand(docs)
    assert mix.columns == docs.columns and mix.selectExpr("sum(size(split(trim(text), '\\\\s+')))").first()[0] > 0
    assert mixing.mixture(none).count() == 0 and mixing.expand(none).count() == 0


def test_jaccard_cases(docs, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()}
    assert got == {(1, 3, 1), (2, 0, 2), (3, 0, 3), (None, 3, 1), (5, 2, 5), (6, 1, 6), (7, 0, 7)}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 3, 5, 6, 7]
    assert jaccard.link(none).count() == 0


def test_jaccard_links_through_star_members(spark):
    """Chains of edits, so that many links run between members of different stars."""
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(90)]
        for _ in range(40):
            texts.append(" ".join(base))
            base[int(rng.integers(0, 90))] = f"x{rng.integers(0, 10**6)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(s.tolist()) for s in jaccard.shingle_sets(texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = [a if r == b else r for r in root]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.link(docs).collect()} == dict(enumerate(root))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (500, 450)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 450: 400, 500: 400}


def test_token_cases(docs, none):
    got = sorted(((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in tokens.token_table(docs).collect()), key=lambda r: (r[1]))
    assert [r[0] for r in got] == [0, 1, 2, 3, 3, 5, 6, 7] and [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert [r[2] for r in got if r[0] in (2, 3, 7)] == [1, 1, 1, 1]
    assert tokens.token_table(none).count() == 0


@pytest.mark.parametrize("ends", [[5], [1, 1, 1, 9], list(range(1, 400, 3)), [1_000_000], list(np.cumsum(np.random.default_rng(1).integers(1, 900, 1000)))])
def test_elias_fano_round_trip_and_select(ends):
    s = tokens.Segment.of(np.array(ends))
    back = tokens.Segment(s.n, s.low_bits, s.low.tobytes(), s.high.tobytes(), s.samples.tobytes())
    assert list(back.ends()) == ends and [back.end(i) for i in range(len(ends))] == ends
    if len(ends) > 500:
        assert 8 * (len(s.low) + len(s.high) + 4 * len(s.samples)) < 14 * len(ends)


def test_odd_texts_are_tokenised_as_whole_texts():
    from tokenizers import Tokenizer
    path = tokens.default_tokenizer()
    tok = Tokenizer.from_file(path)
    texts = ["It's  a\u00a0b\tc\x1cd", "ΟΔΟΣ. İstanbul, e\u0301! ab!!", "<\u0338 x<\u0338", "12.5|km |", "'s can't.", "\n\n", "ﬁ ｆ ß", "😀ab, \u200bz"]
    for t, ids in zip(texts, tokens.encode_texts(texts, path)):
        assert list(np.frombuffer(ids, "<u2")) == tok.encode(t, add_special_tokens=False).ids, t


def test_quality_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all()
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(none, labels.limit(0)).count() == 0
    assert set(quality.classify(docs, labels.limit(0)).toPandas().score) == {0.5}


def test_decontamination_cases(spark, docs, none):
    kind = "item_id long, text string, hash long"
    q = "A train leaves Paris at 9 and travels 120 km before it meets Anna who walks 3 km with Anna's dog"
    items = spark.createDataFrame([(1, q, 0), (2, None, 0), (3, "", 0), (4, "two words", 0), (1, q, 0)], kind)
    rows = [(1, "Intro. " + q.replace("120", "480").replace("Paris", "Rome").replace("Anna", "Berta") + " now. The end of it.", 0),  # new numbers and names
            (2, q.replace("Anna who", "Anna who").replace("Anna's", "Carl's"), 0), (3, "Two words!", 0), (4, "two words more", 0), (5, None, 0), (6, "", 0),
            (None, q, 0), (7, "leaves paris at 9 and some other story about walking", 0), (8, "x " * 100_000 + q, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, hash long")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(table, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 4), (None, 1), (8, 1)} and got[1, 1]["changed_slots"] >= 3
    assert decontam.clean(table, items).columns == table.columns and {r["doc_id"] for r in decontam.clean(table, items).collect()} == {4, 5, 6, 7}
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    item = "we add Anna then give Anna some red apples and Anna eats them while Anna sleeps in green fields of Anna near town"
    fill = lambda *names: item.replace("Anna", "{}").format(*names)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, fill("Bob", "Bob", "Bob", "Bob", "Bob")), (2, fill("Bob", "Carl", "Dora", "Emil", "Fritz"))]
    got = {r["doc_id"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1}


def test_words_are_cut_at_the_six_separators():
    assert words("A\u00a0B c\x1cd\x0be\x85f") == ["a\u00a0b".encode().replace(b"b", b"B").lower(), b"c\x1cd", "e\x85f".encode()]

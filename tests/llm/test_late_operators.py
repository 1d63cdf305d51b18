"""Token alignment, periodic runs and adaptive rules: brute force, SQL and defined cases."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from check import canonical
from firegrid.llm import alignment, jaccard, periodic, quality, rules, rules_sql, tokens
from firegrid.session import written

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, block long, salt int"
LONG = "ab cd. " * 30_000
ROWS = [(1, "one two three", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (3, "", "en", "b"), (None, "one two three", None, "a"),
        (5, LONG, "en", "a"), (6, "a▁b", "fr", None), (7, " \n ", "fr", "b"), (8, "x <|endoftext|>  </s> İ.", "fr", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4) for r in ROWS], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def crc(x):
    return zlib.crc32(str(x).encode())


# token alignment

@pytest.fixture(scope="module")
def library():
    """text -> (A ids with ends, B ids with ends) from whole texts, or None."""
    import sentencepiece
    from tokenizers import Tokenizer
    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = alignment._byte_letters()
    assert len(letters) == 256

    def run(text):
        ids = (a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or ""))
        parts = ([bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
                 [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        return [list(zip(x, np.cumsum([len(t) for t in p]).tolist())) for x, p in zip(ids, parts)]
    return run


def whole(pair):
    """(groups, links) of whole texts: groups by common ends, links by overlapping ranges, one byte at a time."""
    if pair is None:
        return [], []
    common = {e for _, e in pair[0]} & {e for _, e in pair[1]}
    groups, held = [], [[], []]
    for e in sorted({e for x in pair for _, e in x}):
        for k in (0, 1):
            held[k] += [str(i) for i, at in pair[k] if at == e] if len(pair[k]) < 3000 else [str(i) for i in ENDS[k].get(e, ())]
        if e in common:
            groups.append("|".join(",".join(h) for h in held))
            held = [[], []]
    owner = [[i for i, (_, e) in enumerate(x) for _ in range(e - (x[i - 1][1] if i else 0))] for x in pair]
    return groups, [(pair[0][i][0], pair[1][j][0]) for i, j in dict.fromkeys(zip(*owner))]


ENDS = [{}, {}]


def expected(rows, library):
    found = []
    for i, t in rows:
        pair = library(t)
        if pair:
            ENDS[:] = [{e: [k] for k, e in x} for x in pair]
        found.append((i, pair, *whole(pair)))
    count = Counter(x for *_, links in found for x in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted((str(i), len(p[0]) if p else 0, len(p[1]) if p else 0, len(g), len(x), sum(count[k] == most[k[1]] for k in x),
                   sum(count[k] for k in x), hashlib.sha256(";".join(g).encode()).hexdigest() if p else "") for i, p, g, x in found)


def test_alignment_against_whole_texts(spark, library):
    got = [(str(r[0]), *r[1:]) for r in map(tuple, entry.queries()["op11_token_alignment"](spark, FOLDER).collect())]
    assert sorted(got) == expected([(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()], library)


def test_alignment_cases(docs, none, library):
    got = [(str(r[0]), *r[1:]) for r in map(tuple, alignment.align(docs).collect())]
    assert sorted(got) == expected([r[:2] for r in ROWS], library)
    assert ("6", 0, 0, 0, 0, 0, 0, "") in got and ("2", 0, 0, 0, 0, 0, 0, "") in got
    assert alignment.align(none).count() == 0


def test_pieces_of_random_texts(library):
    rnd, letters, paths = random.Random(3), " \n\t  ab'İ́▁ﬁ中\U0001f600.,!|01<>_\x1c\xa0　", alignment.default_tokenizers()
    for _ in range(1500):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14))) + rnd.choice(["", "<|endoftext|>", " </s> x", "<0x41>"])
        numbers, entries = alignment._known([t], paths)
        got = None if any(entries[k] is None for k in numbers[0]) else ";".join(entries[k][4] for k in numbers[0])
        pair = library(t)
        assert got == (";".join(whole(pair)[0]) if pair else None), t


def test_bitmaps_return_their_members():
    rng = np.random.default_rng(1)
    for size in (1, 7, 8, 300, 5000):
        group = np.sort(rng.integers(0, 9, 700) ** 2 // 8)
        key = np.unique(group * size + rng.integers(0, size, 700))
        bitmaps = alignment.containers(key // size, key % size, 9, size)
        row, place = alignment.members(bitmaps, np.int64(size))
        assert sorted(zip(row.tolist(), place.tolist())) == sorted(zip((key // size).tolist(), (key % size).tolist()))
        assert max(len(x.as_py()) for x in bitmaps) <= (size + 7) // 8 + 1


def test_pair_counts_are_sums_over_documents(spark, docs, library):
    index = alignment.build_index(docs)
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_counts(index).collect()}
    each = [Counter(whole(library(t))[1]) for _, t in (r[:2] for r in ROWS if r[1] != LONG)]
    short = alignment.pair_counts(alignment.build_index(docs.where("doc_id IS NULL OR doc_id <> 5"))).collect()
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in short} == {k: (sum(k in c for c in each), sum(c[k] for c in each)) for c in each for k in c}
    assert max(n for n, _ in got.values()) >= 2 and max(n for _, n in got.values()) >= 29_000


# periodic runs

def brute_runs(w):
    """Every maximal stretch of each period, the smallest period of equal stretches."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in out.items())


def brute_digest(doc_id, text, plant):
    w = (text or "").encode().split()
    n = len(w)
    if plant and doc_id is not None and crc(doc_id) % 10 == 0 and n:
        g = crc(doc_id) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, q, m in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else [None] * 4),
            sha("".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)), n)


def test_runs_of_many_small_arrays():
    rnd, docs = random.Random(5), []
    for _ in range(1500):
        w = [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(0, 90))]
        a = rnd.randrange(len(w) + 1)
        w[a:a] = w[a:a + rnd.randrange(1, 12)] * rnd.randrange(9)
        docs.append(w)
    docs += [[bin(i).count("1") & 1 for i in range(900)], [1] * 1000, [0, 1] * 300, ([0, 0, 1] * 200 + [0, 1] * 100)]
    got = [[] for _ in docs]
    for i, (s, e, q) in zip(*periodic.pack_runs([np.array(x, np.int64) for x in docs])):
        got[i].append((int(s), int(q), int(e - s)))
    assert [sorted(x) for x in got] == [brute_runs(x) for x in docs]


@pytest.mark.parametrize("long", [periodic.LONG, 64])
def test_runs_of_documents(spark, long):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted(brute_digest(r.doc_id, r.text, True) for r in table.collect())
    found = periodic.digest(periodic.find_runs(periodic.planted(table), long))
    assert sorted(map(tuple, found.collect())) == want and sum(r[1] > 0 for r in want) > 10
    if long == periodic.LONG:
        assert sorted(map(tuple, entry.queries()["op12_periodic_runs"](spark, FOLDER).collect())) == want


def test_run_cases(docs, none):
    order = lambda rows: sorted(rows, key=str)
    got = periodic.digest(periodic.find_runs(docs)).collect()
    want = [brute_digest(i, t, False) for i, t, *_ in ROWS if t != LONG] + [brute_digest(5, "ab cd. " * 300, False)]
    strip = lambda r: (r[0], r[1], r[2], r[4]) if r[0] == 5 else tuple(r)
    assert order(map(strip, got)) == order(map(strip, want))
    assert [r.length for r in got if r.doc_id == 5] == [60_000] and [r.exponent_milli for r in got if r.doc_id == 5] == [30_000_000]
    assert periodic.collapse_digest(none).count() == 0


# adaptive rules

def test_adaptive_rules_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    got = entry.queries()["op13_adaptive_rules"](spark, FOLDER).toPandas()
    assert canonical(got) == canonical(db.execute(rules_sql.SQL).df()) and 0 < got.kept.sum() < len(got)


def test_adaptive_rules_run_no_python(spark):
    plan = entry.queries()["op13_adaptive_rules"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_rule_cases(docs, none):
    got = rules.judge(docs).collect()
    assert len(got) == len(ROWS) and all(r.base_failed and not r.kept for r in got)
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_words, long.word_chars, long.n_symbols, long.n_repeat_words) == (60_000, 150_000, 0, 60_000)
    assert [r.n_symbols for r in got if r.doc_id == 8] == [6]
    assert rules.judge(none).count() == 0 and rules.keep(none).columns == none.columns


def test_outliers_of_a_group_go(spark):
    word = lambda i, k: f"w{(i * 131 + k * 17) % 9973}"
    texts = {i: " ".join(word(i, k) for k in range(60)) for i in range(450)}
    texts[7] = " ".join(f"{word(7, k)}$$" for k in range(60))  # symbols
    texts[8] = "\n".join(["a line of several words again"] * 6 + [texts[8]])  # repeated lines
    texts[9] = " ".join(word(9, k) * 9 for k in range(60))  # long words
    rows = [(i, t, "en" if i % 3 else None, "s", 1, 2, "k", 3, 4) for i, t in texts.items()]
    kept = rules.keep(spark.createDataFrame(rows, DOCS))
    assert set(range(450)) - {r.doc_id for r in kept.collect()} == {7, 8, 9} and kept.columns == [f.split()[0] for f in DOCS.split(", ")]


# mended cases of earlier operators

def test_rows_of_one_id_with_different_texts_stay(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, b, "s"), (3, None, "s"), (None, a, "t")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a, "s"), (1, b, "s"), (3, None, "s"), (None, a, "t")]))


def test_linked_stars_are_not_listed_as_candidates(spark):
    """200 texts, each with one word of its own: they share almost all shingles and end in one component."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:i % 97], f"x{i}", *base[i % 97 + 1:]])) for i in range(200)]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    members = spark.createDataFrame([(1, 7, 100, [5], [0]), (2, 7, 100, [5], [0]), (3, 8, 100, [5], [0])],
                                    "star long, label long, n long, prefix array<long>, level array<tinyint>")
    assert {(r.a, r.b) for r in jaccard.candidates(members).collect()} == {(1, 3), (2, 3)}


def test_ids_of_pieces_equal_those_of_whole_texts():
    path = tokens.default_tokenizer()
    tok = tokens._loaded(path)[0]
    rnd, letters = random.Random(1), " \n.,!|abAİǺ̊Σςſßﬁक़क़12'$-中\U0001f600\xa0\x1c"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(14))) for _ in range(4000)] + ["a <|endoftext|> b.", "İ.", "x<|startoftext|>."]
    for t, ids in zip(texts, tokens.encode_texts(texts, path)):
        assert np.frombuffer(ids, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_statistics_are_bound_once(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = quality.keep_good(table, labels)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 6
    scored = quality.classify(table, labels).where("predicted = 1")
    assert written(kept.select("doc_id"), "kept").exceptAll(scored.select("doc_id")).count() == 0 and kept.count() == scored.count()


def test_caches_of_words_end_with_the_task():
    from firegrid.llm import decontam, jaccard
    from firegrid.llm.common import forgetting
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "doc_id": [1, 2], "text": ["some words that a worker would keep after its task"] * 2})
    assert list(forgetting(jaccard._repeated, jaccard.forget)([batch])) and not jaccard._KNOWN
    assert list(forgetting(decontam._rows(None, None), decontam.forget)([batch])) and not decontam.KNOWN


def test_word_stages_forget(spark, monkeypatch):
    from firegrid.llm import decontam, jaccard
    seen = []
    for module in (decontam, jaccard):
        monkeypatch.setattr(module, "forgetting", lambda task, forget: seen.append(forget) or task)
    text = "some words that a worker would keep after its task, as there are enough of them for one window of a template at least"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    jaccard.link(docs).count()
    decontam.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id")).count()
    assert seen.count(jaccard.forget) >= 3 and seen.count(decontam.forget) >= 3


def test_members_of_open_stars_are_not_paired(spark, monkeypatch):
    """Near copies of one text: those that link with it, and those that only link with some of these."""
    rng = np.random.default_rng(3)
    texts = []
    for i in range(260):
        t = [f"w{k}" for k in range(150)]
        for at in rng.choice(np.arange(2, 148), 2 if i < 160 else 4, replace=False):
            t[at] = f"v{at}" if rng.random() < 0.7 else f"n{i}x{at}"
        texts.append(" ".join(t))
    texts.append(" ".join(f"w{k}" for k in range(150)))
    sets = [set(s.tolist()) for s in jaccard.shingle_sets(texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    rows, keep = [], jaccard.written

    def counted(df, name):
        out = keep(df, name)
        if name == "pairs":
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    got = jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in range(len(texts))}
    assert len({top(i) for i in range(len(texts))}) > 1
    assert rows[-1] <= 12 * len(texts)  # members are told by their differences from a centre (1,656 pairs), not from each other (4,522)


def test_words_of_a_batch_travel_as_plain_lists(spark):
    from firegrid.llm import maxent
    got = maxent.score(spark.createDataFrame([(i, "some words to learn " * i) for i in range(1, 30)], "doc_id long, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(i#" in plan and "struct(i" not in plan
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: 4 * i + 1 for i in range(1, 30)}


def test_near_stars_without_links_are_not_listed(spark, monkeypatch):
    """Copies of one text with edits of their own: almost no two link, yet all share most shingles. Some are copies of a copy."""
    rng = np.random.default_rng(8)
    made = []
    for i in range(240):
        t = list(made[int(rng.integers(0, i))]) if i % 6 == 5 else [f"w{k}" for k in range(200)]
        for at in rng.choice(200, 1 if i % 6 == 5 else 3, replace=False):
            t[at] = f"n{i}x{at}"
        made.append(t)
    texts = [" ".join(t) for t in made]
    sets = [set(s.tolist()) for s in jaccard.shingle_sets(texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    listed, find = [], jaccard.candidates

    def counted(members):
        out = find(members)
        listed.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "candidates", counted)
    got = jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert 100 < len(set(root)) < len(texts)
    assert listed[0] <= 12 * len(texts)  # of 28,680 pairs

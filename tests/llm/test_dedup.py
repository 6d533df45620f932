"""op3 and op8 against brute force on small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodeworks.llm import near_dedup as near
from lodeworks.llm.hashing import ngrams, sliding
from lodeworks.llm.substring_dedup import FingerprintIndex, substring_dedup


def words_of(t):
    return [w.decode() for w in (t or "").encode().split()]


def brute_substring(texts, n=35, history=()):
    seen = Counter(tuple(w[i : i + n]) for t in [*texts, *history] for w in [words_of(t)] for i in range(len(w) - n + 1))
    out = []
    for t in texts:
        w, gone = words_of(t), set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (34, 35, 36, 60, 200)]
    out = [None, "", " \t ", "one", "The " * 34, "The " * 35, "The " * 120, "a b " * 40, text(35), text(34)]
    for _ in range(60):
        out.append(text(r.randint(0, 120)) + " " + r.choice(shared) + "\n" + text(r.randint(0, 80)))
    out += [text(50)] * 4 + [out[20]] * 3 + [text(20_000)]
    base = text(300).split()
    for _ in range(10):
        b = list(base)
        for _ in range(4):
            b[r.randrange(300)] = word()
        out.append("  ".join(b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(None if i % 17 == 0 else i // 2, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, k1 string, hash string")
    got = substring_dedup(df).collect()
    want = brute_substring(texts)
    key = lambda rows: Counter((r[0], *r[1:]) for r in rows)
    assert key(map(tuple, got)) == key((None if i % 17 == 0 else i // 2, *w) for i, w in enumerate(want))
    assert substring_dedup(df.limit(0)).count() == 0


def test_index_is_incremental(spark, tmp_path):
    texts = corpus(5)
    random.Random(0).shuffle(texts)
    index, done = FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=2), []
    for b in range(4):
        part = texts[b::4]
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in index.add(spark.createDataFrame([(i, t) for i, t in enumerate(part)], "doc_id long, text string")).collect()}
        assert got == dict(enumerate(brute_substring(part, history=done)))
        done += part
        assert len(index.runs()) <= 2
    index.compact()
    assert len(index.runs()) == 1
    again = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in index.add(spark.createDataFrame([(i, t) for i, t in enumerate(texts[1::4])], "doc_id long, text string"), 1).collect()}
    assert again == dict(enumerate(brute_substring(texts[1::4], history=texts[0::4])))


@pytest.mark.parametrize("lost", ["runs", "texts", "commits"])
def test_a_batch_that_died_is_added_again(spark, tmp_path, lost):
    """Between any two of its writes: what the second attempt returns is what the first would have."""
    import shutil

    r = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randrange(10**9)}" for _ in range(60))) for i in range(4)], "doc_id long, text string")
    index = FingerprintIndex(spark, f"file://{tmp_path}/index")
    assert [x["n_removed"] for x in index.add(df, 0).collect()] == [0] * 4
    shutil.rmtree(tmp_path / "index" / "commits")
    if lost != "commits":
        shutil.rmtree(tmp_path / "index" / lost)
    again = FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=7)
    assert again.committed() == again.runs() == []
    assert [x["n_removed"] for x in again.add(df, 0).collect()] == [0] * 4
    assert [x["n_removed"] for x in again.add(df, 0).collect()] == [0] * 4
    assert [x["n_removed"] for x in again.add(df, 1).collect()] == [60] * 4
    with pytest.raises(ValueError, match="comes after"):
        again.add(df, -1)


def test_runs_meet_where_they_are(spark, tmp_path):
    from lodeworks.llm.substring_dedup import _Runs, _keyed, anchor_postings

    runs = _Runs(spark, f"file://{tmp_path}/runs")
    texts = corpus(3)
    for i in range(2):
        runs.write(i, anchor_postings(_keyed(spark.createDataFrame(list(enumerate(texts[i::2])), "doc_id long, text string"), "doc_id", "text")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = runs.merged()
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = {tuple(x) for x in merged.collect()}
        runs.compact()
        assert runs.spans() == [(0, 1)] and {tuple(x) for x in runs.merged().collect()} == want and want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ngrams_and_sliding():
    h = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 35):
        g = ngrams(h, n)
        assert len(g) == 51 - n and g[3 if n < 40 else 0] == ngrams(h[3 : 3 + n], n)[0]
        assert (sliding(h, n) == [h[i : i + n].min() for i in range(51 - n)]).all()
    assert len(ngrams(h, 51)) == 0 and ngrams(h[:2], 2)[0] != ngrams(h[1::-1], 2)[0]


def shingles(t, n=5):
    w = words_of(t)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def brute_probability_jaccard(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in {*a, *b}) for d in a if d in b)


def arrays(c):
    items = sorted((hash(k) % 2**64, n) for k, n in c.items())
    return np.array([k for k, _ in items], np.uint64), np.array([n for _, n in items])


def test_similarity_is_probability_jaccard():
    r = random.Random(4)
    for _ in range(50):
        a, b = (Counter(r.choices("abcdefghij", k=30)) for _ in range(2))
        plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
        assert abs(near.similarity(arrays(a), arrays(b)) - max(plain, brute_probability_jaccard(a, b))) < 1e-9


def test_registers_agree_with_probability_jaccard():
    r = random.Random(5)
    a = Counter({i: r.randint(1, 5) for i in range(80)})
    b = Counter({i: r.randint(1, 5) for i in range(20, 100)})
    h = np.random.default_rng(1).integers(1, 2**63, 200).astype(np.uint64)
    rows = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    sig = near.prob_minhash(rows, np.r_[h[list(a)], h[list(b)]], np.array([*a.values(), *b.values()], float), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - brute_probability_jaccard(a, b)) < 0.03


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (rows[i][1] or "") == (rows[j][1] or ""):
                parent[find(i)] = find(j)
            elif a and b:
                plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
                if plain >= 0.8 or (plain > 0.3 and brute_probability_jaccard(a, b) >= 0.8):
                    parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return {frozenset(v) for v in out.values()}


def near_corpus():
    r = random.Random(9)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = [None, "", "one two", "one two", "one two three", "three two one"]
    for n in (6, 30, 200):
        for copies in (1, 4, 12):
            base = text(n)
            rows.append(" ".join(base))
            for _ in range(copies):
                b = list(base)
                for _ in range(max(1, n // 70)):
                    b[r.randrange(n)] = "edit"
                rows.append(" ".join(b))
    rows += [" ".join(text(100)) for _ in range(30)] + [rows[30]] * 5
    twice = text(60)
    return [*rows, " ".join(twice), " ".join(twice + twice)]


def test_near_dedup(spark):
    rows = list(enumerate(near_corpus()))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, k1 string, class_id string")
    got = near.near_dedup(df).collect()
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], []).append(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    assert {frozenset(v) for v in classes.values()} == brute_classes(rows)
    assert all(k == min(v) for k, v in classes.items())
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "x y"), (1, "x y"), (1, "other text"), (2, None), (3, "")], "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in near.drop_near_duplicates(df).collect())
    assert kept == [("1", "other text"), ("1", "x y"), ("2", ""), ("None", "a b c")]
    assert near.near_dedup(df.limit(0)).count() == 0


def test_components(spark):
    r = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [tuple(map(int, x)) for x in r.integers(200, 260, (30, 2))]
    got = {x["v"]: x["label"] for x in near.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    import itertools

    want = {}
    for a, b in pairs:
        if a != b:
            want.setdefault(a, {a}).add(b)
            want.setdefault(b, {b}).add(a)
    for a in want:
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += want[x]
        assert got[a] == min(seen), a
    assert len(got) == len(want) and itertools


def test_pairs_far_from_leaders_are_compared(spark):
    r = random.Random(3)
    text = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    template, rows = text(164), []
    for _ in range(240):
        rows.append(template + text(40))
    for _ in range(12):
        own = text(20)
        rows += [template + own + text(20) for _ in range(2)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    texts, _ = near.near_duplicate_classes(df, bands=6, per_band=1)
    got = sorted((x["class_id"], x["rep"]) for x in texts.collect() if x["class_size"] > 1)
    assert got == sorted((i, j) for i in range(240, 264, 2) for j in (i, i + 1))


def pairs_at(sets, least=0.8):
    return {(j, i) for i in range(len(sets)) for j in range(i) if near.similarity(sets[i], sets[j]) >= least}


@pytest.mark.parametrize("block", [4, 1024])
def test_prefixes_meet_for_every_similar_pair(spark, monkeypatch, block):
    """Texts of repeated and of single shingles around 0.8, in one bucket: no pair is missing, in groups of one block and of many."""
    monkeypatch.setattr(near, "GROUP_BLOCK", block)
    r = random.Random(8)
    base = [r.choices("abcdefghijklmnop", k=24) + r.choices("QRSTUVWXYZ", k=30) for _ in range(3)]
    texts = [" ".join(b[:i] + r.choices("abcdefghijklmnopqrstuvw", k=54 - i)) for b in base for i in (10, 46, 48, 50, 51, 52, 53) for _ in range(4)]
    sets = [arrays(shingles(t)) for t in texts]
    bodies = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    members = bodies.selectExpr("1L AS h", "tid")
    labels = spark.createDataFrame([], "v long, label long")
    prefixes = near._prefix_rows(members, labels, bodies, 0.8)
    met = near._candidates(prefixes, labels, 0.8, False)
    want = pairs_at(sets)
    assert len(want) > 50 and want <= {(x["a"], x["b"]) for x in met.collect()}
    assert {(x["a"], x["b"]) for x in near._verified(met, bodies, 0.8).collect()} == want


def test_one_link_among_a_thousand_texts_of_a_template(spark):
    """A template that texts fill differently (0.6 to 0.7 of each other), one pair at 0.8: the buckets hold hundreds of classes."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**9)}"
    base, rows = [word() for _ in range(300)], []
    for _ in range(1000):
        rows.append(base[:235] + [word() for _ in range(65)])
    rows[700] = rows[300][:270] + [word() for _ in range(30)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near.near_dedup(df).collect() if x["class_size"] > 1} == {300: 300, 700: 300}


def test_a_repeated_passage_hides_no_copy(spark):
    r = random.Random(6)
    text = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        base = text(300)
        rows += [base, base + text(8) * 100]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near.near_dedup(df).collect()} == {i: i - i % 2 for i in range(24)}

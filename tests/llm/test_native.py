"""op1, op4, op5, op7 and op10: against DuckDB on the test tables, against brute force on odd ones."""

import hashlib
import re

import pytest
from conftest import assert_same, rows_of
from pyspark.sql import functions as F

from lodeworks.llm import queries as q
from lodeworks.llm.chat_format import chat_format
from lodeworks.llm.decontaminate import decontaminate, decontamination_report
from lodeworks.llm.exact_dedup import exact_dedup
from lodeworks.llm.mixing import mix, mixed_documents, source_targets
from lodeworks.llm.url_filter import url_filter

DOCS = "doc_id long, text string, source string, keep_id string, h string, key string, size string"


def docs(spark, rows):
    """Documents with further columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x") for i, t, s in rows], DOCS)


ODD = [
    (3, "a  b\tc", "s"), (1, "a b c", "s"), (2, "a b\u00a0c", None), (4, None, "s"), (5, "", "t"), (None, "a b c", "t"), (None, None, None), (1, "a b c", "s"), (1, "a b c", "s"),
    (6, "word " * 5000, "t"), (7, " a b c", "u"), (8, "ÄÉ " * 3, "u"),
]


@pytest.mark.parametrize("key", sorted(q.ORACLE_SQL))
def test_equals_duckdb(key, spark, sf_dir, duck):
    assert_same(q.QUERIES[key](spark, sf_dir), duck, q.ORACLE_SQL[key])


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    out, kept = [], set()
    for (i, _, _), t in zip(rows, norm, strict=True):
        ids = [r[0] for r, u in zip(rows, norm, strict=True) if u == t]
        keep = min((x for x in ids if x is not None), default=None)
        first = i == keep and (t not in kept)
        if first:
            kept.add(t)
        out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    digest = {"digest": lambda c: F.lit("same")} if weak else {}
    got = exact_dedup(docs(spark, ODD), **digest)
    assert rows_of(got.columns, got.collect()) == rows_of(got.columns, brute_exact(ODD))
    assert exact_dedup(docs(spark, [])).count() == 0


RULES = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/x", "block"), ("net", "/x", "allow"), ("b.org", None, "block"), ("", "/", "block"), (None, "/", "block"), ("c.org", "/", None)]
URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/2?x", "http://example.com", "http://notexample.com/en/3", "http://a.b.example.com/en/#f", "http://q.net/es/1", "http://z.a.net/xyz", "http://a.net/x", "ftp://b.org", "http://x.b.org/any",
    None, "", "no scheme/en/", "http://", "http:///en/", "a://b://c.com/d", "http://c.org/", "http://example.com/en/1", "http://com/", "http://" + "s." * 200 + "com/" + "p/" * 2000,
]


def brute_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + (p or "")), len(h), v, h.lower() + (p or "")) for h, p, v in RULES if h and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("bound", [100, 2])
def test_url_filter(spark, bound):
    pages = spark.createDataFrame([(i if i % 7 else None, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = url_filter(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), broadcast_rules=bound)
    want = [(i if i % 7 else None, *brute_url(u)) for i, u in enumerate(URLS)]
    assert rows_of(got.columns, got.collect()) == rows_of(["page_id", "host", "path", "rule", "verdict"], want)
    none = url_filter(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(URLS)
    assert url_filter(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "bot", "hello"), (2, 0, "user", "hi"), (2, 1, "bot", "hello"), (2, 2, "user", "bye"), (3, 0, "user", "hi"), (4, 0, "user", "other"), (5, 0, "user", "hi"), (5, 1, "bot", "hello"), (5, 2, "user", "bye"),
    (6, 0, "user", None), (7, 0, "user", ""), (7, 1, None, "x"), (None, 0, "user", "lost"), (8, None, "user", "lost"), (2, 2, "user", "bye"), (9, 1, "user", "hi"), (10, 0, "user", "a"), (10, 0, "bot", "b"),
] + [(11, i, "user", f"t{i}") for i in range(600)] + [(12, i, "user", f"t{i}") for i in range(300)]


def brute_chat(rows, segment=256):
    line = lambda r, t: f"<|{r or ''}|>\n{t or ''}\n<|end|>\n"
    rows, convs, out = set(rows), {}, []
    for c, n, r, t in rows:
        if c is None or n is None:
            out.append((c, 0, 1, 1, line(r, t)))
        else:
            convs.setdefault(c, []).append((n, r is not None, r or "", t is not None, t or ""))
    turns = {c: tuple(sorted(v)) for c, v in convs.items()}
    prefixes = {v[:k] for v in turns.values() for k in range(1, len(v))}
    for v in set(turns.values()) - prefixes:
        same = [c for c in turns if turns[c] == v]
        for s in sorted({x[0] // segment for x in v}):
            out.append((min(same), s, len(v), len(same), "".join(line(x[2], x[4]) for x in v if x[0] // segment == s)))
    return out


def test_chat_format(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in TURNS], "conv_id long, turn long, role string, text string, segment string, n int")
    got = chat_format(df)
    assert rows_of(got.columns, got.collect()) == rows_of(["conv_id", "segment", "n_turns", "n_copies", "text"], brute_chat(TURNS))
    assert chat_format(df.limit(0)).count() == 0


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "short item"), (3, ""), (4, None), (None, "unnamed item text here"), (5, "One"), (1, "the QUICK brown fox jumps over the lazy dog again and again"), (12, "é É naïve words here to test ten of them é É")]
TEXTS = [
    (1, "So The Quick BROWN-fox; jumps over the lazy dog, again!", "s"), (2, "quick brown fox jumps over the lazy dog again and again and the quick", "s"), (3, "a SHORT item, and one", "s"), (4, "clean text of no interest", "s"), (5, "", "s"), (6, None, "s"), (None, "short item", "s"), (4, "clean text of no interest", "s"),
    (4, "other text short item", "s"), (7, "x " * 3000 + "short item", "s"), (8, "é é naïve words here to test ten of them é É", "s"), (9, "é É naïve words here to test ten of them é É", "s"),
]


def brute_contamination(rows, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        windows += [(i, tuple(w[a : a + k])) for a in range(len(w) - k + 1)] if k else []
    out = []
    for d, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for i, g in windows:
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    found |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination(spark, block, monkeypatch):
    if block == 3:
        monkeypatch.setattr("lodeworks.llm.decontaminate.BLOCK_BYTES", 400)
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, hash string")
    got = decontamination_report(docs(spark, TEXTS), bench, block=block)
    assert rows_of(got.columns, got.collect()) == rows_of(got.columns, brute_contamination(TEXTS, ITEMS))


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontamination_report(docs(spark, TEXTS), none).collect())
    assert decontamination_report(docs(spark, []), none).count() == 0


def test_decontaminate_spans_and_documents(spark):
    bench = spark.createDataFrame([(2, "short item")], "item_id long, text string")
    d = docs(spark, [(1, "keep, a Short-ITEM here. End!", "s"), (2, "nothing", "s"), (3, None, "s"), (4, "short item", "s")])
    assert {r["doc_id"]: r["text"] for r in decontaminate(d, bench, "spans").collect()} == {1: "keep, a here. End!", 2: "nothing", 3: None, 4: ""}
    left = decontaminate(d, bench)
    assert {r["doc_id"] for r in left.collect()} == {2, 3} and left.columns == d.columns
    with pytest.raises(ValueError, match="mode"):
        decontaminate(d, bench, "words")


def test_targets_are_a_water_level(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 300}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    assert got == pytest.approx(target)


@pytest.mark.parametrize("weights", [None, [("big", 1e9), ("s0", 1.0), ("s1", 1.0)], [("big", 1.0), ("s0", 1e-9)]])
def test_the_cut_is_that_of_a_full_sort(spark, monkeypatch, weights):
    """With steps that must be dealt again, equal finish times and many texts without words."""
    from lodeworks.llm import mixing

    monkeypatch.setattr(mixing, "STEPS", 4)
    monkeypatch.setattr(mixing, "EDGE", 2)
    rows = [(i, "w " * (i % 7 if i % 3 else 0), ["big", "s0", "s1", None][i % 4 if i < 40 else 0]) for i in range(300)]
    w = weights and spark.createDataFrame(weights, "source string, weight double")
    d = docs(spark, rows)
    plan = mix(d, w).collect()
    text = dict((i, t) for i, t, _ in rows)
    shuffled = lambda r: hashlib.md5(f"mix|{r['doc_id']}|{hashlib.md5(text[r['doc_id']].encode()).hexdigest()}".encode()).hexdigest()
    copies = []
    for s in {r["source"] for r in plan}:
        upto = 0
        for r in sorted((r for r in plan if r["source"] == s), key=shuffled):
            upto += r["size"]
            if r["target"] > 0 and r["size"]:
                copies += [((upto + k * r["source_size"]) / r["target"], shuffled(r), r) for k in range(2)]
    spend, want = sum({r["source"]: r["target"] for r in plan}.values()), {}
    for _, _, r in sorted(copies, key=lambda c: c[:2]):
        spend -= r["size"]
        if spend < 0:
            break
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["size"]
    assert {r["doc_id"]: r["taken"] for r in plan if r["taken"]} == want


def test_mix(spark):
    rows = [(i, "w " * (i % 13), "big" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(None, None, None), (None, "x y", None), (5, "w " * 5, "big"), (9000, "w " * 4000, "s1")]
    d = docs(spark, rows)
    got = mix(d).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own) + 1, s
    again = mix(d.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["key"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixed_documents(d)
    assert out.columns == d.columns
    words = out.select(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != "")))).first()[0]
    assert abs(words - sum(r["taken"] for r in got)) <= 10  # the repeated row stands once for each of its rows
    assert mix(docs(spark, [])).count() == 0

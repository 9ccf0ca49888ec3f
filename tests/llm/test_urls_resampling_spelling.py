"""URL rules, importance resampling and spelling variants against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from voxelloom.llm import importance, queries, spelling, url_rules
from voxelloom.llm.common import Remembered, pieces

DOCS = "doc_id bigint, text string, n bigint, tie string, rank int, word string"


def test_pieces():
    text = "ab cde  f" * 50
    for size in (1, 2, 7, 1000):
        parts = list(pieces(text, re.compile("[a-z]+"), size))
        assert "".join(parts) == text
        assert [w for p in parts for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)
    assert list(pieces("", re.compile("x"))) == [""]


def test_remembered_forgets():
    known = Remembered(len, limit=5)
    assert known["abc"] == 3 and known["defg"] == 4 and len(known) == 2
    known.trim()
    assert not known and known["abc"] == 3


# ---- 11: url rules ---------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, host int, rule int, tokens string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "://", "http://", "HTTP://Www.A.ORG", "http://a.org?x=/", "http://a.org/", "x://b.example.org/es/1",
            "http://example.org/en/19", "http://example.org/en/2#a://b", "http://notexample.org/es/1", "http://org/?q", "http://é.com/fr/É",
            "http://a.com/fr", "http://h.net/" + "word/" * 3000, "http://h.net/" + "7" * 5000, "a\nb://c.com/de/\n?q=1\n"]
    for i in range(400):
        host = rng.choice(["a", "b", "c"]) + "." + rng.choice(["casino", "news", "blog"]) + "." + rng.choice(["com", "org", "net", "example.org"])
        urls.append(f"http://{host}/{rng.choice(['de', 'fr', 'en', 'es'])}/{rng.randrange(300)}?ref={rng.choice('xyz')}")
    urls += urls[100:110] + [urls[5]] * 40
    rows = [(i, u, "<p>", 1, 2, "t") for i, u in enumerate(urls)] + [(None, urls[60], None, None, None, None), (7, urls[61], "", 0, 0, "")]
    return spark.createDataFrame(rows, PAGES)


def _low(text):
    return text.encode().lower().decode()


def _split(url):
    _, found, rest = (url or "").partition("://")
    host, path, query = re.fullmatch(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?.*", rest if found else "").groups()
    return _low(host), path, query or ""


def _tokens(host, path, query):
    out = set()
    for kind, text in (("h", host), ("p", path), ("q", query)):
        for w in re.findall(url_rules.PARTS[kind], _low(text)):
            out.add(f"{kind}:" + (w[0] + "#" * (len(w) - 1) if re.fullmatch("[0-9]+", w) else w))
    return frozenset(out)


def _given(host, path):
    fits = [(len(r), r, v) for r, v in url_rules.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def _judged(rows, support=url_rules.SUPPORT, confidence=url_rules.CONFIDENCE, items=url_rules.ITEMS):
    parsed = [(i, *_split(u)) for i, u in rows]
    labelled = {(h, p, _tokens(h, p, q), _given(h, p)[1]) for _, h, p, q in parsed if _given(h, p)[0]}
    need = max(url_rules.LEAST, math.ceil(support * len(labelled)))
    n, b = Counter(), Counter()
    for *_, tokens, verdict in labelled:
        n.update(tokens)
        b.update(tokens if verdict == "block" else ())
    share = sum(x[3] == "block" for x in labelled) / max(1, len(labelled))
    rank = {t: (-abs(b[t] / n[t] - share), t) for t in n if n[t] >= need}
    freq, says = Counter(), Counter()
    for *_, tokens, verdict in labelled:
        best = sorted(sorted((t for t in tokens if t in rank), key=rank.get)[:items])
        for size in range(1, len(best) + 1):
            for some in combinations(best, size):
                freq[some] += 1
                says[some, verdict] += 1
    rules = {k: c / freq[k[0]] for k, c in says.items() if c >= need and c / freq[k[0]] >= confidence}
    kept = [(-c, -says[k], len(k[0]), " ".join(k[0]), k[1], frozenset(k[0])) for k, c in rules.items()
            if not any(v == k[1] and set(s) < set(k[0]) and d >= c for (s, v), d in rules.items())]
    for i, host, path, query in parsed:
        rule, verdict = _given(host, path)
        hit = None if rule else min((k for k in kept if k[5] <= _tokens(host, path, query)), default=None)
        yield (i, host, path, rule, verdict or (hit[4] if hit else "allow"), hit and hit[3], hit and -hit[0])


def test_url_rules(pages):
    rows = [(r["page_id"], r["url"]) for r in pages.select("page_id", "url").collect()]
    want = Counter(_judged(rows))
    got = Counter(tuple(r) for r in url_rules.judge(pages).collect())
    assert got == want
    verdicts = Counter((r[4], r[5] is None) for r in got)
    assert verdicts["block", False] and verdicts["allow", False] and verdicts["allow", True]


def test_url_rules_loose(pages):
    """Low thresholds leave many rules, shorter and longer ones."""
    some = pages.where("page_id < 250")
    rows = [(r["page_id"], r["url"]) for r in some.select("page_id", "url").collect()]
    got = Counter(tuple(r) for r in url_rules.judge(some, support=0.02, confidence=0.6).collect())
    assert got == Counter(_judged(rows, 0.02, 0.6))
    assert any(r[5] and " " in r[5] for r in got)


def test_url_rules_drop_no_token_or_rule(pages, monkeypatch):
    """Every token and rule over the thresholds takes part, however many; a bound would give other rows here."""
    some = pages.where("page_id < 250")
    rows = [(r["page_id"], r["url"]) for r in some.select("page_id", "url").collect()]
    want = Counter(_judged(rows, 0.02, 0.6))
    assert len({r[5] for r in want}) > 3
    monkeypatch.setattr(url_rules, "TOKENS", 3)
    monkeypatch.setattr(url_rules, "MOST_RULES", 1)
    assert Counter(tuple(r) for r in url_rules.judge(some, support=0.02, confidence=0.6).collect()) == want


def test_url_rules_all_tokens_of_a_url(spark):
    """A pair of tokens tells blocked urls, behind eight tokens that tell more on their own."""
    t = "&".join(f"t{k}" for k in range(7))
    rows = [(i, f"http://com/de/{'x' * (i + 1)}?m&n&{t}") for i in range(20)]
    rows += [(20 + i, f"http://com/fr/{'x' * (i + 1)}?{'mn'[i % 2]}{'&' + t if i < 5 else ''}") for i in range(20)]
    rows += [(100, "http://w.net/?m&n"), (101, "http://w.net/?m"), (102, "http://w.net/?t1"), (103, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    short, whole = (Counter(tuple(r) for r in url_rules.judge(pages, items=n).collect()) for n in (url_rules.ITEMS, None))
    assert short == Counter(_judged(rows)) and whole == Counter(_judged(rows, items=None))
    assert [r[4:6] for found in (short, whole) for r in found if r[0] == 100] == [("allow", "q:n"), ("block", "q:m q:n")]


def test_url_query_mines_all_tokens(spark, tmp_path):
    """Urls of up to twelve frequent tokens, of which a triple behind nine others tells blocked ones."""
    t = "&".join(f"t{k}" for k in range(7))
    rows = [(i, f"http://com/de/{'x' * (i + 1)}?l&m&n&{t}") for i in range(20)]
    rows += [(20 + i, f"http://com/fr/{'x' * (i + 1)}?{('l&m', 'm&n', 'l&n')[i % 3]}{'&' + t if i < 5 else ''}") for i in range(20)]
    rows += [(100, "http://w.net/?l&m&n"), (101, "http://w.net/?l&m"), (102, "http://w.net/?t1"), (103, None)]
    spark.createDataFrame(rows, "page_id int, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in queries.op11_url_rules(spark, str(tmp_path)).collect())
    assert got == Counter(_judged(rows, items=None)) != Counter(_judged(rows))
    assert [r[4:6] for r in got if r[0] == 100] == [("block", "q:l q:m q:n")]


def test_url_rules_nothing_to_learn(pages, spark):
    assert url_rules.judge(pages.limit(0)).collect() == []
    rows = url_rules.judge(pages.where("page_id in (0, 1, 2, 3, 4)")).collect()
    assert {(r["host"], r["path"], r["rule"], r["verdict"], r["mined"]) for r in rows} == {("", "", None, "allow", None)}
    none = url_rules.judge(pages, rules=()).collect()
    assert len(none) == pages.count() and {r["verdict"] for r in none} == {"allow"}
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id int, url string")
    assert [tuple(r)[:5] for r in url_rules.judge(one).collect()] == [(1, "a.org", "/x", "org/", "allow")]


# ---- 12: importance resampling ---------------------------------------------------------------

@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 10))) for _ in range(60)]

    def typo(w):
        i, c = rng.randrange(len(w)), rng.choice("abcdefé")
        return rng.choice([w, w, w, w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
    texts = [None, "", "  ", "one", "É" * 3000, "z" * 3000 + " " + "z" * 2999, "word " * 5000, "漢字 🙂 don't_stop 3rd"]
    texts += [" ".join(typo(rng.choice(base)) for _ in range(rng.choice([5, 19, 20, 40, 300]))) for _ in range(120)]
    texts += ["z" * 3000 + " " + "z" * 2999]
    rows = [(i, t, 1, "a", 2, "b") for i, t in enumerate(texts)]
    rows += [rows[30]] * 30 + [(None, texts[31], None, None, None, None), (None, texts[32], 0, "", 0, "")] + [(40, texts[41], 0, "", 0, "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def target(spark, docs):
    texts = [r["text"] for r in docs.where("doc_id % 10 = 3").select("text").collect()]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "item_id bigint, text string")


def _features(text, buckets, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                        for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("buckets, longest", [(10_000, 1), (16, 3)])
def test_resampling(docs, target, buckets, longest):
    rows = [(r["doc_id"], *_features(r["text"], buckets, longest)) for r in docs.collect()]
    s, t = Counter(), Counter()
    for *_, f in rows:
        s.update(f)
    for r in target.collect():
        t.update(_features(r["text"], buckets, longest)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    want = []
    for doc_id, words, f in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    order = sorted((w for w in want if w[5] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    for rank, w in enumerate(order[:len(order) * 10 // 100], 1):
        w[4] = rank
    got = importance.resample(docs, target, buckets=buckets, longest=longest).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(w[:5]) for w in want)
    assert any(w[4] for w in want)


@pytest.mark.parametrize("fewest, run_rows", [(1, 10**6), (4, 50), (32, 10), (60, 1)])
def test_ranks(spark, fewest, run_rows):
    """A third of all rows is one score of one id; segments stay near their share."""
    rng = random.Random(1)
    keys = [(5, 7)] * 300 + [(rng.randrange(40), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(600)]
    rng.shuffle(keys)
    rows = spark.createDataFrame([(s, d, i) for i, (s, d) in enumerate(keys)], "score bigint, doc_id bigint, tie bigint").cache()
    got = {r["tie"]: r["rank"] for r in importance.ranked(rows, fewest, run_rows).collect()}
    order = sorted(range(len(keys)), key=lambda i: (-keys[i][0], keys[i][1] is None, keys[i][1] or 0, i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    assert importance.ranked(rows.limit(0)).collect() == []


def test_splitters_cut_ties():
    splitters = sorted(importance._order(5, 7, t) for t in range(10, 100, 10))
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 100), pa.array([7] * 100), pa.array(range(100))], ["score", "doc_id", "tie"])
    out = pa.Table.from_batches(importance._segments(splitters)(iter([batch]))).column("segment").to_pylist()
    assert max(Counter(out).values()) <= 11 and out == sorted(out)


def test_resampling_empty(docs, target):
    assert importance.resample(docs.limit(0), target).collect() == []
    rows = importance.resample(docs.where("doc_id < 4"), target.limit(0)).collect()
    assert {(r["doc_id"], r["weight"], r["rank"]) for r in rows if r["doc_id"] < 3} == {(0, 0, None), (1, 0, None), (2, 0, None)}


# ---- 13: spelling variants -------------------------------------------------------------------

def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows, shortest, least, ratio):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = _low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
            if len(word) >= shortest:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= least}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and _near(v, w)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= ratio * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        yield (w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)


@pytest.mark.parametrize("shortest, least, ratio, filter_bytes", [(7, 2, 10, 1 << 20), (5, 1, 2, 64), (7, 2, 2, 640)])
def test_spelling(docs, shortest, least, ratio, filter_bytes):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = set(_variants(rows, shortest, least, ratio))
    got = spelling.group_variants(docs, shortest, least, ratio, filter_bytes).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r[1] for r in want) and any(r[4] == 0 for r in want)
    if ratio == 2:
        assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms


def test_spelling_empty(docs, spark):
    assert spelling.group_variants(docs.limit(0)).collect() == []
    assert spelling.group_variants(docs.where("doc_id < 4")).collect() == []
    one = spark.createDataFrame([(1, "Sentence sentence SENTENCE")], "doc_id int, text string")
    assert [tuple(r) for r in spelling.group_variants(one).collect()] == [("sentence", None, "sentence", 3, 0, None)]


def test_filters_hold_their_words():
    """Every word and every edit that is a word passes; few others do."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(8)) for _ in range(2000)})
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, 8)
    blocks, _ = spelling.rounds({8: len(words)})
    made = spelling.Filter(blocks[8], 0, blocks[8])
    h = spelling.mix(spelling.hashes(codes))
    for lane in range(spelling.LANES):
        np.bitwise_or.at(made.lanes[:, lane], spelling.block_of(h, blocks[8]).astype(int), spelling.lane_bit(h, lane))
    assert len(made.holds(spelling.hashes(codes))) == len(words)
    other = np.frombuffer(("".join(rng.choice("efgh") for _ in range(80_000))).encode(), np.uint8).reshape(-1, 8)
    assert len(made.holds(spelling.hashes(other))) < 50
    alphabet = np.frombuffer(b"abcd", np.uint8)
    found = {(words[i], e.decode()) for i, e in spelling.replaced(codes, alphabet, made)}
    assert {(a, b) for a, b in combinations(words, 2) if _near(a, b)} <= found


def test_rounds_cover_every_block():
    blocks, parts = spelling.rounds({7: 1000, 8: 5, 9: 100_000}, most=64 * 100)
    assert all(sum(e - f for _, f, e in part) <= 100 for part in parts)
    assert {of: sum(e - f for part in parts for o, f, e in part if o == of) for of in blocks} == blocks
    assert spelling.rounds({}) == ({}, [])

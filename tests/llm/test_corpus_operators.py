"""The corpus operators against brute force on small fixtures, and on odd tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from voxelloom import scale
from voxelloom.llm import (bpe, decontaminate, disclosure, exact_dedup, gru, licences, quality, repeats, simhash, templates,
                           toxicity)
from voxelloom.operators import components

DOCS = "doc_id bigint, text string, lang string, k1 string, row int, label int"
RANKS = public_tokenizers.path(bpe.RANKS)


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice("ar bel cor dun es fal gim hor ist jun kal mos nev or pil".split()) + rng.choice("a e i o u".split())
                    for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, long repeats across documents, very short and very long texts; columns with clashing names."""
    rng = random.Random(5)
    passage = prose(rng, 90)
    texts = [None, "", "  \n\n", "one", "One two", "A b c", "é ñ 漢字 🙂 don't", "x" * 3000, "is " * 800, passage]
    texts += [prose(rng, n) for n in (5, 30, 80, 200, 400)]
    texts += [prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(5)]
    texts += [passage[:399], passage[:400] + "Q", "Q" + passage[3:403] + "Z", passage[50:500] + passage[50:500]]
    long = prose(rng, 300).split()
    for i in range(4):
        changed = list(long)
        changed[40 * i] = "other"
        texts.append(" ".join(changed))
    texts += texts[9:13] + [None, ""]
    rows = [(i, t, "en", "a", 1, 0) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "no id here", None, None, None, None), (3, prose(rng, 70), "en", "b", 2, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(corpus):
    return corpus.limit(0)


def plans_of(monkeypatch, out, *modules):
    """Plans of what ``out()`` stages through the modules, and of its result; small tables make Spark broadcast where it may."""
    seen = []

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return scale.stage(df)

    for module in modules:
        monkeypatch.setattr(module, "stage", noted)
    noted(out())
    return seen


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def pairs(corpus):
    return [(r["doc_id"], r["text"] or "") for r in corpus.select("doc_id", "text").collect()]


# ---- 1: repeats ------------------------------------------------------------------------------

def test_repeats(corpus):
    rows = [(d, t.encode()) for d, t in pairs(corpus)]
    seen = Counter(raw[i:i + 400] for _, raw in rows for i in range(len(raw) - 399))
    want = Counter()
    for d, raw in rows:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            if seen[raw[i:i + 400]] > 1:
                gone[i:i + 400] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        starts = [i for i, g in enumerate(gone) if g and not (i and gone[i - 1])]
        ends = [i + 1 for i, g in enumerate(gone) if g and not (i + 1 < len(gone) and gone[i + 1])]
        removed = ",".join(f"{a}:{b}" for a, b in zip(starts, ends))
        want[(d, len(raw), int(gone.sum()), len(starts), hashlib.sha256(kept).hexdigest(), removed)] += 1
    got = Counter(tuple(r) for r in repeats.remove(corpus).drop("kept").collect())
    assert got == want and any(k[2] for k in want)


def test_repeats_across_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    data = np.frombuffer(prose(random.Random(1), 900).encode(), np.uint8)
    first, last = np.array([0, 2000]), np.array([2000, len(data)])
    starts = sorted(s for _, lo, hi, _, _ in repeats.anchors(data, first, last) for a, b in zip(lo, hi) for s in range(a, b + 1))
    assert starts == [*range(1601), *range(2000, len(data) - 399)]


# ---- 2: decontamination ----------------------------------------------------------------------

def test_decontamination(spark, corpus):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((14, 20, 40, 60, 6))] + [(7, None), (8, "")]
    def spoilt(text, every):
        words = text.split()
        return " ".join("zzz" if i % every == every - 1 else w for i, w in enumerate(words))
    cases = [prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 50), prose(rng, 9) + " " + spoilt(items[2][1], 8),
             spoilt(items[3][1], 2), items[1][1].upper(), prose(rng, 200), items[1][1][:40],
             items[0][1] + " " + prose(rng, 80) + " " + items[2][1]]
    docs = spark.createDataFrame([(100 + i, t, "en", "a", 1, 0) for i, t in enumerate(cases)], DOCS).unionByName(corpus)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(100, 0), (101, 2), (103, 1), (106, 0), (106, 2)}
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 4


def test_stretch_is_the_best_one():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 2, 30), rng.integers(0, 2, 20)
        d = int(rng.integers(-10, 20))
        at, n, equal = decontaminate.stretch(a, b, d)
        low, high = max(d, 0), min(30, 20 + d)
        score = lambda i, j: sum(1 if a[k] == b[k - d] else -3 for k in range(i, j))
        best = max([score(i, j) for i in range(low, high) for j in range(i, high + 1)], default=0)
        assert equal - 3 * (n - equal) == best


def test_every_stretch_that_is_equal_enough_has_a_seed_and_is_accepted():
    def seen(n, gone, masks):
        return any(all(b == "0" or at + i not in gone for i, b in enumerate(m)) for m in masks for at in range(n - len(m) + 1))

    for n in range(1, 26):
        masks = decontaminate.masks_for([n] if n < 13 else [])
        for gone in combinations(range(n), n // 5):
            if not seen(n, set(gone), masks):
                pytest.fail(f"{n} tokens, substitutions at {gone}")
    rng = np.random.default_rng(4)
    for n, k in ((14, 1), (15, 2), (15, 3), (20, 4), (30, 6), (6, 1), (12, 2)):
        for _ in range(100):
            b = np.arange(n)
            a = np.concatenate([np.arange(1000, 1005), b, np.arange(1000, 1005)])
            a[5 + rng.choice(n, k, False)] = -1
            at, length, equal = decontaminate.accepted(a, b, 5)
            assert length >= min(13, n) and equal >= 0.8 * length and equal == int((a[at:at + length] == b[at - 5:at - 5 + length]).sum())
    for _ in range(300):
        a, b = (rng.random(40) < 0.72).astype(int), np.ones(int(rng.integers(5, 41)), int)
        least = min(13, len(b))
        some = any(5 * a[i:j].sum() >= 4 * (j - i) for i in range(len(b)) for j in range(i + least, len(b) + 1))
        assert (decontaminate.accepted(a, b, 0) is not None) == some


def test_decontamination_finds_spoilt_ends_and_short_items(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:14])), (2, " ".join(words[14:20])), (3, " ".join(words[20:23])), (4, " ".join(words[23:38]))]
    gone = lambda lo, hi, *at: " ".join("zz" if i in at else w for i, w in enumerate(words[lo:hi]))
    cases = [gone(0, 14, 1), "a b " + gone(14, 20, 2) + " c", gone(20, 23), gone(20, 23, 1), gone(23, 38, 3, 7, 11), gone(14, 20, 2, 4)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 0) for i, t in enumerate(cases)], DOCS)
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_token"], r["n_tokens"], r["n_equal"]) for r in got) == [
        (0, 1, 0, 14, 13), (1, 2, 2, 6, 5), (2, 3, 0, 3, 3), (4, 4, 0, 15, 12)]


# ---- 3: licences -----------------------------------------------------------------------------

def _licence_blocks(low, template):
    """Word sets of the lines, and of stretches over line ends as long as the template's phrase."""
    lines = [re.findall(licences.WORD, b) for b in low.split("\n")]
    yield from map(set, lines)
    words = [(w, i) for i, b in enumerate(lines) for w in b]
    for s in range(len(words) - template.length + 1):
        if words[s][1] < words[s + template.length - 1][1]:
            yield {w for w, _ in words[s:s + template.length]}


def _licence_labels(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for t in licences.template_sets():
        for b in _licence_blocks(low, t):
            if len(b & set(t.words)) >= t.need and b >= set(t.apart) and not any(b >= set(more) for more in t.longer):
                yield t.label


def test_licences(spark):
    texts = [None, "", "CC-BY and cc by", "General  Public\nLicense", "under the Apache License, Version 2.0 licensed\nx",
             "All rights, reserved. ALL RIGHTS RESERVED", "the license of the version", "apache license version", "éCC BY",
             "Licensed under CC BY 4.0\nand all\nrights are reserved under the\nGNU General Public License version 2 or 3", "mit " * 900]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        words = re.findall(licences.WORD, low)
        places = [(k, label) for phrase, label in licences.PHRASES for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(places))
        assert got[i]["first_word"] == min((k for k, _ in places), default=None)
        assert got[i]["labels"] == ",".join(sorted({*_licence_labels(t), *(label for _, label in places)}))


def test_licences_that_differ_in_a_word(spark):
    cases = {
        "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa", "Licensed under CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd",
        "Released under the BSD license.": "bsd", "Released under the MIT license.": "mit", "Released under the ISC license": "isc",
        "Released under the Apache license": "apache-2.0", "Released under the Foo license.": "",
        "This work is licensed under the GNU General Public License version 2": "gpl,gpl-2.0",
        "This work is licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
        "Licensed under the GNU Affero General Public License, version 3": "agpl-3.0,gpl",
        "Licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl-3.0"}
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 0) for i, t in enumerate(cases)], DOCS)
    got = {r["doc_id"]: r["labels"] for r in licences.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_wrapped_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    texts = [bsd, "x\n * " + bsd.replace("\n", "\n * ") + ".\ny", "Licensed under the Apache\nLicense,\nVersion 2.0", "all\nother rights are reserved",
             bsd.replace("\n", "\n\n" + "other words " * 8)]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(docs).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("bsd", 1.0), 2: ("apache-2.0", 1.0), 3: ("", 0.0), 4: ("", 0.0)}


# ---- 4: quality ------------------------------------------------------------------------------

def test_quality_learns_and_handles_lone_classes(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40) if i % 3 else " | ".join("#" * 5 for _ in range(30)), "en", "a", 1, 0) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = labels_of(spark, [(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 1), (5, None, None), (999, 0, 0)])
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(200))
    assert quality.accepted(docs, labels).count() == sum(i % 3 > 0 for i in range(200))
    lone = quality.classify(docs.limit(3), labels.where("quality = 1")).collect()
    assert {r["score"] for r in lone} == {1.0}


def test_discriminant_equals_the_dense_formula():
    rng = np.random.default_rng(4)
    x = [rng.normal(k, 1 + k, (50, quality.N_STATS)) for k in (0, 1)]
    n = np.array([50.0, 50.0])
    model = quality.fit(n, np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    z = (x[0][:1] - model.centre) / model.scale
    z = np.clip(z, -quality.CLIP, quality.CLIP)[0]
    logs = [-0.5 * (z - m) @ np.linalg.inv(f @ f.T) @ (z - m) - 0.5 * np.linalg.slogdet(f @ f.T)[1] for m, f in zip(model.means, model.factors)]
    assert np.isclose(model.difference(x[0][:1])[0], logs[1] - logs[0])


# ---- 5: SimHash ------------------------------------------------------------------------------

def brute_fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("longest", [64, 1])
def test_simhash(corpus, longest):
    rows = pairs(corpus)
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    low = {r: min((d for (d, _), q in zip(rows, roots) if q == r and d is not None), default=None) for r in roots}
    want = Counter((d, f"{p:016x}", low[r]) for (d, _), p, r in zip(rows, prints, roots))
    got = simhash.near_dedup(corpus, longest)
    assert Counter(tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize("longest", [64, 2])
def test_links_on_random_clusters(spark, longest):
    rng = random.Random(8)
    prints = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.append(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    roots = brute_components(prints)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp bigint"), longest).collect()
    at = {signed(p): i for i, p in enumerate(prints)}
    assert all(bin(prints[at[r["a"]]] ^ prints[at[r["b"]]]).count("1") <= 3 for r in edges)
    own = list(range(len(prints)))
    def find(i):
        while own[i] != i:
            i = own[i]
        return i
    for r in edges:
        own[find(at[r["a"]])] = find(at[r["b"]])
    assert len({find(i) for i in own}) == len(set(roots))


@pytest.mark.parametrize("longest", [64, 1])
def test_simhash_gathers_nothing_at_the_driver(corpus, monkeypatch, longest):
    """Staged tables are far larger than their files, by which Spark chooses what to broadcast."""
    near = simhash.near_dedup
    monkeypatch.setattr(simhash, "near_dedup", lambda docs: near(docs, longest))
    plans = plans_of(monkeypatch, lambda: simhash.deduplicated(corpus), simhash, components)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_position_sets_cover():
    sets = simhash.position_sets()
    assert all(any(set(s) <= set(five) for s in sets) for five in combinations(range(8), 5))


# ---- 6: disclosure ---------------------------------------------------------------------------

def test_base_spans_equal_the_plain_patterns(spark):
    texts = [None, "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112 79927398713",
             "+1 (017) 555-7713\n+49.30.1234567 +1+22222222222", "é@b.co ü x.@-.- 漢a%b@c.d.", "@" * 50 + "." * 50, "9" * 40]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 0) for i, t in enumerate(texts)], DOCS)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    got = {r["doc_id"]: r for r in disclosure.scan(docs).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), no, m.end(), k) for no, (k, p) in enumerate(plain.items()) for m in re.finditer(p, t or "") if ok(k, m[0]))
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t, joined, got[i])


@pytest.mark.parametrize("step", [disclosure.scan, disclosure.sanitised])
def test_disclosure_gathers_nothing_at_the_driver(spark, monkeypatch, step):
    """Numbers of rows and words, and words that repeat, are far larger than their files, by which Spark chooses."""
    rows = [(i, f"agent Zorblatt7 writes from jo@x.org on day {i}", "a", "b", 1, 0) for i in range(4)] + [(9, "plain words", "a", "b", 1, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    plans = plans_of(monkeypatch, lambda: step(docs), disclosure)
    assert len(plans) > 6 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_revealing_words(spark):
    line = "agent Zorblatt7 writes from jo@x.org the {} day"
    texts = [line.format(w) for w in ("first", "second", "third")] + ["the day is common"] * 20 + ["plain the words"]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["spans"] for r in disclosure.scan(docs).collect()}
    assert "term:6:15" in got[0] and "email" in got[0] and got[5] == ""
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(docs).collect()}
    assert set(clean) == {0, 1, 2} and "[EMAIL]" in clean[0] and "Zorblatt7" not in clean[0] and "the first day" in clean[0]


def test_revealing_words_against_brute_force(spark):
    """Words near entities, over line ends and in copies; entities that touch words, each other and the ends of the text."""
    rng = random.Random(4)
    people = [(f"p{i}@mail.org", f"Name{i}", f"+49 (30) 123 45{i}0") for i in range(4)]
    texts = []
    for _ in range(60):
        words = [rng.choice("a is the of Xu corpus day night é ü1 22".split()) for _ in range(rng.randrange(0, 60))]
        for mail, name, phone in rng.sample(people, rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [name, rng.choice(["", "\n\n", "at"]), rng.choice([mail, phone, "é" + mail, mail + ";" + mail])]
        texts.append(rng.choice([" ", "\n"]).join(words))
    texts += ["Name9\nsigns\np9@mail.org"] * 30 + [people[0][0] + people[1][0], "x " * 3000 + "p0@mail.org " + "y " * 3000, None, ""]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["spans"] for r in disclosure.scan(docs).collect()}
    base = {d: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",")) if k != "term"] if spans else [] for d, spans in got.items()}
    held, holders, both, n_docs = {}, Counter(), Counter(), Counter()
    for d, t in enumerate(texts):
        t = t or ""
        low = "".join(c.lower() if c.isascii() else c for c in t)
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(disclosure.TERM, low)]
        n_docs.update({w for *_, w in words})
        holders.update({(k, t[a:b]) for k, a, b in base[d]})
        for k, a, b in base[d]:
            before, behind = sum(w[0] < a for w in words), sum(w[0] < b for w in words)
            for i in (*range(max(0, before - disclosure.WINDOW), before), *range(behind, min(len(words), behind + disclosure.WINDOW))):
                if not any(words[i][0] < y and words[i][1] > x for _, x, y in base[d]):
                    held.setdefault(d, set()).add(((k, t[a:b]), words[i]))
        both.update({(e, w[2]) for e, w in held.get(d, ())})
    total = len(texts)
    told = {(e, w) for (e, w), n in both.items() if n >= 2 and np.log2(total / holders[e]) > 0
            and np.log2(n * total / (holders[e] * n_docs[w])) >= disclosure.SHARE * np.log2(total / holders[e])}
    for d in got:
        want = {(w[0], w[1]) for e, w in held.get(d, ()) if (e, w[2]) in told}
        assert {(int(a), int(b)) for k, a, b in (s.split(":") for s in got[d].split(",") if s) if k == "term"} == want
    assert sum("term" in s for s in got.values()) > 30


# ---- 7: templates ----------------------------------------------------------------------------

PAGE = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>menu</ul></nav><div class='cookie notice'>ok?</div>"
        "<{0}><h1>Head {1} &lt;b&gt;</h1><p>First&nbsp;  text <b>bold {1}<p>Second<br>line</{0}><section id=comments><p>nice</p></section>"
        "<footer>&copy; x</footer></body></html>")


@pytest.mark.parametrize("holder", ["article", "div"])
def test_templates(spark, holder):
    rows = [(i, f"http://h.example/{i}", PAGE.format(holder, f"no{i}")) for i in range(6)]
    rows += [(6, None, None), (7, "bad", ""), (8, "http://lone.example/", PAGE.format("main", "x"))]
    table = spark.createDataFrame([(*r, 1, "m") for r in rows], "page_id bigint, url string, html string, n bigint, path string")
    got = {r["page_id"]: r for r in templates.extract(table).collect()}
    for i in range(6):
        assert got[i]["text"] == f"Head no{i} <b>\n\nFirst text bold no{i}\n\nSecond line"
    assert got[6]["text"] == got[7]["text"] == "" and got[8]["text"].startswith("Head x")
    assert got[0]["n_chars"] == len(got[0]["text"])
    found = templates.vectors(table)
    valid = templates.classes(found).where("host = 'h.example'").collect()
    assert any(f"html/body/{holder}" in r["paths"] and "html/body/nav" in r["paths"] for r in valid)


BARE = ("<html><body><div class=rail><a href=/a>Menu {0}</a> <a href=/b>More</a></div><div class=flow><h1>Head {0}</h1><p>Text of {0} that goes on.</p>"
        "{1}<div class=offer>Our offer of the week</div></div><div class=base>Visits: {0}</div></body></html>")


def _host_pages(spark, htmls):
    return spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(htmls)], "page_id int, url string, html string")


def test_template_decides_without_marks(spark):
    """No element or name of these pages says what is the article."""
    htmls = [BARE.format(f"no{i}", "") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in templates.extract(_host_pages(spark, htmls)).collect()}
    assert got == {i: f"Head no{i}\n\nText of no{i} that goes on." for i in range(6)}
    assert all(templates.text_in(h, None, None) != got[i] for i, h in enumerate(htmls))


def test_weaker_words_count_in_templates_only(spark):
    own = '<section id="search"><p>methods</p></section><blockquote class="related">quote</blockquote>'
    htmls = [BARE.format(f"no{i}", own if i == 2 else "") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in templates.extract(_host_pages(spark, htmls)).collect()}
    assert got[2] == "Head no2\n\nText of no2 that goes on.\n\nmethods\n\nquote"
    every = [BARE.format(f"no{i}", f"<div class=related>See also {i}</div>") for i in range(6)]
    assert {r["text"].count("See also") for r in templates.extract(_host_pages(spark, every)).collect()} == {0}
    assert templates.text_in("<article>a<div class=related>b</div></article><div class=related>c</div>", None, None) == "a\n\nb"


def test_article_that_is_the_same_everywhere_and_layout_that_holds_no_most(spark):
    htmls = ["<html><body><div class=one>aaaa</div><article>bbbb</article><div class=two>cccc</div></body></html>"] * 4
    assert {r["text"] for r in templates.extract(_host_pages(spark, htmls)).collect()} == {"bbbb"}
    split = [f"<html><body><div class=one>aaaa {i}</div><div class=two>bbbb {i}</div></body></html>" for i in range(4)]
    assert sorted(r["text"] for r in templates.extract(_host_pages(spark, split)).collect()) == [f"aaaa {i}\n\nbbbb {i}" for i in range(4)]


def test_classes_against_brute_force(spark):
    """Tokens with equal occurrence vectors over a host's pages, vectors compared in full."""
    rng = random.Random(3)
    parts = ["<div class=a><p>x</p></div>", "<ul><li>y</ul>", "<section><h2>z</h2><p>w</p></section>", "<table><tr><td>q</td></table>"]
    rows = [(i, f"http://h{i % 3}.example/", "<html><body>" + "".join(rng.choices(parts, k=rng.randint(0, 5))) + "</body></html>") for i in range(40)]
    vectors = {}
    for i, url, h in rows:
        for path, cells in templates.tokens(h).items():
            vectors.setdefault((url, path), {})[i] = cells[0]
    groups = {}
    for (url, path), v in vectors.items():
        groups.setdefault((url[7:-1], tuple(sorted(v.items()))), set()).add(path)
    want = sorted((host, tuple(sorted(p))) for (host, v), p in groups.items() if len(v) >= templates.PAGES and len(p) >= templates.TOKENS)
    found = templates.classes(templates.vectors(spark.createDataFrame(rows, "page_id int, url string, html string")))
    assert sorted((r["host"], tuple(sorted(r["paths"]))) for r in found.collect()) == want and want


def test_deep_pages(spark):
    """Unclosed elements of any depth; formulas stay in the text."""
    page = "<article>" + "".join(f"<div class=a>text {i}" for i in range(5000)) + "<p>a <math><mi>x</mi></math> b"
    assert max(map(len, templates.tokens(page))) <= 1000 + len("/article.a")
    assert templates.tokens("<main><div>ab<div>c</div></div><nav>d</nav></main>")["main"][2] == 3
    table = spark.createDataFrame([(i, f"http://h.example/{i}", page) for i in range(4)], "page_id int, url string, html string")
    want = "\n\n".join([*(f"text {i}" for i in range(5000)), "a x b"])
    assert {r["text"] for r in templates.extract(table).collect()} == {want}


# ---- 8: exact dedup --------------------------------------------------------------------------

def test_exact_dedup(corpus):
    rows = pairs(corpus)
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    got = exact_dedup.exact_dedup(corpus).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    left = exact_dedup.deduplicated(corpus)
    assert left.columns == corpus.columns and Counter((r["text"] or "") for r in left.collect()) == Counter(groups.keys())


def test_chunks_join_to_the_text(corpus):
    bad = corpus.where("text is not null").where(F.array_join(exact_dedup.chunks(F.col("text")), "") != F.col("text"))
    assert bad.count() == 0


# ---- 9: byte-level BPE -----------------------------------------------------------------------

def test_bpe(corpus):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t in pairs(corpus):
        ids = np.array(library.encode_ordinary(t), dtype="<u4")
        want[(d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True)] += 1
    encoded = bpe.encode(corpus, RANKS)
    assert Counter(tuple(r) for r in encoded.drop("ids").collect()) == want
    assert Counter(tuple(r) for r in bpe.decode(encoded, RANKS).collect()) == Counter(pairs(corpus))


def test_perfect_hash_is_minimal():
    words = bpe.codec(RANKS).words
    assert sorted(words.rank_of_slot.tolist()) == list(range(words.n))
    assert words.find(words.key_of_slot[:500]) == words.rank_of_slot[:500].tolist()
    assert words.find([b"\x00no such token\x00"]) == [-1]


# ---- 10: toxicity ----------------------------------------------------------------------------

def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.start(rng, 5).items()}
    x, ids = rng.standard_normal((9, gru.WIDTH)), rng.integers(0, 9, (4, 6))
    mask, y, w = np.ones((4, 6), bool), np.array([1.0, 0, 1, 0]), np.ones(4)
    mask[1, 4:] = False
    _, grads, _ = gru.gradients(p, x, ids, mask, y, w)
    for k in ("uf", "ub", "wf", "cb", "keys", "query", "out"):
        at = tuple(int(rng.integers(0, s)) for s in p[k].shape)
        value, e = p[k][at], 2e-3  # states are in single precision
        p[k][at] = value + e
        up = gru.gradients(p, x, ids, mask, y, w)[0]
        p[k][at] = value - e
        down = gru.gradients(p, x, ids, mask, y, w)[0]
        p[k][at] = value
        assert np.isclose((up - down) / (2 * e), grads[k][at], rtol=2e-2, atol=1e-5)


def test_windows_cover_every_word():
    lengths = np.array([0, 1, 24, 25, 40, 41, 100])
    at, mask, doc = toxicity.windows(lengths)
    first = np.cumsum(lengths) - lengths
    for i, n in enumerate(lengths):
        assert sorted(set(at[doc == i][mask[doc == i]].tolist())) == list(range(first[i], first[i] + n))


def test_toxicity_learns(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = prose(rng, 120).split()
        if i % 3 == 0:
            words[rng.randrange(100)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(words), "en", "a", 1, 0))
    docs = spark.createDataFrame([*rows, (900, None, "en", "a", 1, 0), (None, "x", "", "", 1, 1)], DOCS)
    labels = labels_of(spark, [(i, 0, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (2, None, None)])
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    right = [got[i]["predicted"] == int(i % 3 == 0) for i in range(300) if got[i]["held_out"]]
    assert np.mean(right) > 0.9 and 0 <= got[900]["score"] <= 1
    assert {r["score"] for r in toxicity.classify(docs.limit(2), labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_takes_one_text_of_a_repeated_id(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 30) + (" vile" if i % 2 else ""), "en", "a", 1, 0) for i in range(40)]
    labels = labels_of(spark, [(i, 0, i % 2) for i in range(40)])
    once = toxicity.train(spark.createDataFrame(rows, DOCS), labels)
    many = toxicity.train(spark.createDataFrame(rows + rows[:1] * 50, DOCS), labels)
    assert np.array_equal(once["out"], many["out"])


# ---- all -------------------------------------------------------------------------------------

def test_empty_tables(spark, empty):
    labels = labels_of(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for out in (repeats.remove(empty), decontaminate.contaminated(empty, bench), licences.scan(empty), quality.classify(empty, labels),
                simhash.near_dedup(empty), disclosure.scan(empty), templates.extract(pages), exact_dedup.exact_dedup(empty),
                bpe.encode(empty, RANKS), toxicity.classify(empty, labels)):
        assert out.count() == 0


def test_filters_on_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for out in (quality.accepted(empty, labels_of(spark, [])), exact_dedup.deduplicated(empty), simhash.deduplicated(empty),
                decontaminate.decontaminated(empty, bench)):
        assert out.columns == empty.columns and out.count() == 0


def test_odd_rows_keep_their_count(spark, corpus):
    labels = labels_of(spark, [(i, i % 2, i % 2) for i in range(30)])
    n = corpus.count()
    for out in (licences.scan(corpus), quality.classify(corpus, labels), disclosure.scan(corpus), toxicity.classify(corpus, labels)):
        assert out.count() == n

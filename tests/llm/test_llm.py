"""The training-data operators against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabquarry.llm import chat, mixing, neardup, neighbours, packing, pii, quality, registry, sharding, substrings, suffixes, topk
from tabquarry.operators import base

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    body = [" ".join(rng.choices(words, k=90)) for _ in range(8)]
    texts = [None, "", "  \n ", "one two", "one two", "ONE TWO", body[0], body[0], body[0] + " tail", body[1], body[1].replace(" ", "\t", 3), body[2] * 40, "é ß 漢字 " * 30, *body[3:]]
    ids = [*range(len(texts) - 2), 3, None]
    return docs_of(spark, texts, ids, [None if i % 5 == 0 else f"s{i % 3}" for i in range(len(texts))])


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- 1 ------------------------------------------------------------------------------------------------------------
def test_mixing(spark, awkward):
    out = mixing.mix(awkward).collect()
    assert len(out) == awkward.count()
    total, sizes = sum(r["size"] for r in out), {}
    for r in out:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["copies"] <= 3
        sizes[r["source"]] = (r["source_size"], r["target"])
    assert sum(t for _, t in sizes.values()) == pytest.approx(total) and all(t <= 3 * s + 1e-9 for s, t in sizes.values())
    assert rows_of(mixing.mixed(awkward).orderBy("doc_id", "text")) == rows_of(mixing.mixed(awkward).orderBy("doc_id", "text"))
    assert mixing.mixed(awkward).columns == awkward.columns
    clash = awkward.withColumn("Size", F.lit(1)).withColumn("__mix", F.lit(2))
    assert mixing.mixed(clash).columns == clash.columns
    assert mixing.mix(awkward.limit(0)).count() == 0


def test_mixing_levels_agree(spark, monkeypatch):
    docs = docs_of(spark, ["w " * (1 + i % 7) for i in range(400)], sources=["hot" if i % 3 else f"s{i % 4}" for i in range(400)])
    plain = {tuple(r) for r in mixing.mix(docs).select("doc_id", "copies").collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 1)
    assert mixing.prefix_digits(400) > 0
    assert {tuple(r) for r in mixing.mix(docs).select("doc_id", "copies").collect()} == plain


# --- 2 ------------------------------------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    out = quality.op2_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    met = out.merge(labels, on="doc_id")
    met = met[met["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a in met[met["quality"] == 1]["score"] for b in met[met["quality"] == 0]["score"]]
    assert np.mean(pairs) > 0.9 and out["score"].between(0, 1).all()


def test_quality_edges(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(awkward, quality.fit(awkward, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    out = quality.score(awkward.withColumn("__row", F.lit(1)), quality.fit(awkward, one))
    assert out.count() == awkward.count() and out.columns[-2:] == ["__row", "score"]
    x, v = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(v) >= 0).all() and v.tolist() == [0.0, 0.5, 1.0]


# --- 3 ------------------------------------------------------------------------------------------------------------
def brute_substrings(rows, width=400):
    from collections import Counter

    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        left = np.frombuffer(r, np.uint8)[~gone].tobytes()
        spans = sum(1 for k, _ in itertools.groupby(gone.tolist()) if k)
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot, levels", [(1 << 20, 24), (0, 2)])
def test_substrings(spark, awkward, monkeypatch, hot, levels):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "LEVELS", levels)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted(rows_of(substrings.removed(awkward)), key=str) == sorted(brute_substrings(rows), key=str)
    assert substrings.removed(awkward.limit(0)).count() == 0
    clash = awkward.withColumn("__found", F.lit(1))
    assert substrings.strip_repeats(clash).columns == clash.columns


def test_substrings_with_hot_anchors(spark, monkeypatch):
    """A passage in many contexts, long runs of one and of few bytes, and a text of many slices."""
    monkeypatch.setattr(substrings, "HOT", 20_000)
    monkeypatch.setattr(substrings, "SLICE", 5000)
    rng = random.Random(9)
    word = lambda k=6: "".join(rng.choices("abcdefghijklmnop", k=k))
    body = lambda n: " ".join(word() for _ in range(n))
    passage = body(45)
    texts = [f"{body(rng.randint(5, 50))} {passage} {body(rng.randint(5, 50))}" for _ in range(60)]
    texts += [texts[3][100:700], texts[5] + body(20), "a" * 9000, "a" * 700 + body(90), "ab" * 3000, "xyzé" * 1500, body(2500) + passage]
    docs = docs_of(spark, texts)
    assert sorted(rows_of(substrings.removed(docs))) == sorted(brute_substrings(list(enumerate(texts))))


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(300):
        raw = bytes(rng.choices(b"abc"[: rng.randint(1, 3)], k=rng.randint(1, 50))) * rng.randint(1, 4)
        b = np.frombuffer(raw, np.uint8)
        sa = suffixes.suffix_array(b)
        names = np.unique(b, return_inverse=True)[1]
        assert suffixes._suffixes_of_names(names).tolist() == sa.tolist()
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        phi, plcp = suffixes.common_prefixes(b, sa)
        for i, j in enumerate(phi):
            n = 0
            while j >= 0 and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
                n += 1
            assert plcp[i] == n


# --- 4, 5 ---------------------------------------------------------------------------------------------------------
def vectors(spark, n=300, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dim)), 2)
    v[10:40] = v[9]  # many equal vectors, hence ties
    rows = [(int(i), [float(x) for x in r], "extra") for i, r in enumerate(v)]
    rows += [(n, None, "x"), (n + 1, [1.0, None, *[0.0] * (dim - 2)], "x"), (n + 2, [float("inf")] * dim, "x"), (n + 3, [0.0] * dim, "x"), (20, rows[20][1], "again"), (None, rows[0][1], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string"), rows


def test_topk(spark):
    df, rows = vectors(spark)
    def plain(rows):
        ok = [(i, j, [math.floor(64 * Fraction(x)) for x in v]) for j, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
        for i, j, v in ok:
            if i is not None and i % 20 == 0:
                score = lambda w: max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True))))  # noqa: B023, E731
                found = sorted((-score(w), k is None, k or 0, k) for k, m, w in ok if m != j)[:20]
                yield from ((i, r + 1, f[3], -f[0]) for r, f in enumerate(found))

    assert sorted(rows_of(topk.top_k(df, F.col("vec_id") % 20 == 0, 20)), key=str) == sorted(plain(rows), key=str)
    # components beyond 32 bits, beyond 64 bits, and scores beyond them; a row without an id
    far = [[4e7, 1.0], [1.0, 1.0], [3e17, -2.5], [-3e17, 0.25], [1e300, 0.0], [1.7e308, -1e308], [0.0, 0.5], [2.0**31, 2.0**31]]
    far = [(20 * i if i < 6 else None, v, "x") for i, v in enumerate(far)]
    wide = spark.createDataFrame(far, "vec_id long, embedding array<double>, query_id string")
    assert sorted(rows_of(topk.top_k(wide, F.col("vec_id") % 20 == 0, 20)), key=str) == sorted(plain(far), key=str)
    few = df.where("vec_id < 5")
    assert topk.top_k(few, F.col("vec_id") == 0, 20).count() == 4
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0, 20).count() == 0


def test_neighbours(spark):
    df, rows = vectors(spark, 400)
    ok = [(i, j, np.array(v)) for j, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found, hit, total = neighbours.nearest(df, F.col("vec_id") % 50 == 0, 5).collect(), 0, 0
    by: dict = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r["score"])
    for i, j, v in ok:
        if i is not None and i % 50 == 0:
            best = sorted((w @ v / math.sqrt((w @ w) * (v @ v)) for _, m, w in ok if m != j), reverse=True)[:5]
            hit += sum(s >= best[-1] - 1e-12 for s in by[i])
            total += 5
    assert hit / total >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0, 5).count() == 0
    points = np.array(list(itertools.product(range(4), repeat=3)))
    order = points[np.argsort(neighbours.hilbert(points, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()  # a curve: each step goes to a neighbouring cell


# --- 6 ------------------------------------------------------------------------------------------------------------
def test_neardup(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    texts = [None, "", "a b", "A  b", "a b c d e", " "]
    for _ in range(12):
        base = rng.choices(words, k=120)
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 6)):
            new = list(base)
            for _ in range(rng.randint(0, 6)):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append(" ".join(new))
    docs = docs_of(spark, texts, ids=[7 * i + 1 for i in range(len(texts))])
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                comp[i] = comp[j] = min(comp[i], comp[j])
    want = {(7 * i + 1, len(s), 7 * comp[i] + 1, comp[i] == i) for i, s in enumerate(sets)}
    got = neardup.link(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert {tuple(r) for r in got.collect()} == want
    kept = neardup.distinct_documents(docs.unionByName(docs.where("doc_id > 50")))
    full = [r["doc_id"] for r in kept.collect() if WORD.search(r["text"] or "")]
    assert sorted(full) == sorted(7 * i + 1 for i in range(len(texts)) if comp[i] == i and sets[i])
    assert neardup.link(docs.limit(0)).count() == 0


def plain_components(texts):
    """(set size, least linked index) of each text, by comparing all pairs."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 3 * max(len(sets[i]), len(sets[j])) <= 4 * min(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            x, y = sorted((top(i), top(j)))
            comp[y] = x
    return [(len(x), top(i)) for i, x in enumerate(sets)]


@pytest.mark.parametrize("dense, block, deepest_changes", [(256, 1024, 30), (4, 16, 30)])
def test_neardup_in_dense_regions(spark, monkeypatch, dense, block, deepest_changes):
    """A large group of near copies, many of them beyond the threshold of each other, a shared passage, and long texts."""
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base, passage, texts = rng.choices(words, k=150), rng.choices(words, k=80), []
    for i in range(260):
        new = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, deepest_changes])):
            new[rng.randrange(len(new))] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(new))
    texts += [" ".join(passage + rng.choices(words, k=rng.randint(2, 40))) for _ in range(80)]
    long = rng.choices(words, k=6000)
    texts += [" ".join(long), " ".join(long[:5000]), " ".join(long[:4000]), " ".join(long[2500:])]
    rng.shuffle(texts)
    want = {(i, n, c, c == i) for i, (n, c) in enumerate(plain_components(texts))}
    got = neardup.link(docs_of(spark, texts)).select("doc_id", "n_shingles", "component_id", "kept")
    assert {tuple(r) for r in got.collect()} == want
    assert len({r[2] for r in want}) > 20


def test_odd_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 5, 300, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.8, 0.95, 1.0):
            y = np.unique(np.concatenate([x[: max(1, int(share * n))], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            s, t = neardup.odd_sketch(x), neardup.odd_sketch(y)
            size = min(len(s), len(t))
            far = int(np.bitwise_count(neardup._bits([s], size) ^ neardup._bits([t], size)).sum())
            assert far <= len(x) + len(y) - 2 * both
            assert neardup.may_link(far, len(x), len(y)) or 100 * both < 75 * (len(x) + len(y) - both)


def test_components_contract_their_edges(spark):
    """A dense group's links are joined once; later rounds have only links between roots."""
    dense = [(a, b) for a in range(60) for b in range(a + 1, 60)]
    line = [(1000 + i, 1001 + i) for i in range(200)]
    written = []

    def keep(df):
        out = neardup.stored(df)
        if out.columns == ["a", "b"]:
            written.append(out.count())
        return out

    got = {r["id"]: r["comp"] for r in base.components(spark.createDataFrame(dense + line + [(5, 5)], "a long, b long"), keep).collect()}
    assert got == dict.fromkeys(range(60), 0) | dict.fromkeys(range(1000, 1201), 1000)
    assert written[0] == len(dense) + len(line) and sum(written[1:]) < 10


def test_neardup_odd_rows(spark, awkward):
    """Null and repeated ids, repeated rows and a clashing column."""
    clash = awkward.unionByName(awkward).withColumn("CID", F.lit(1)).withColumn("__dk", F.lit("x"))
    out = neardup.link(clash).collect()
    assert len(out) == 2 * awkward.count()
    kept = neardup.distinct_documents(clash)
    assert kept.columns == clash.columns
    words = [r for r in kept.collect() if WORD.search(r["text"] or "")]
    assert len({r["text"] for r in words}) == len(words) and kept.where("text is null").count() == 2


# --- 7 ------------------------------------------------------------------------------------------------------------
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m.group())
            ok = (True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns():
    rng = random.Random(8)
    fixed = ["a@b.co_x@d.ef", "a@b@c.de", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "+1 (234) 567-8901.", "x+12345678901y", "@a.b", "é@ü.de a.b-c%@x-y.z.", "1-2 3"]
    for text in fixed + ["".join(rng.choices("a1.@+ -_(4", k=rng.randint(0, 60))) for _ in range(3000)]:
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_terms_and_cleaning(spark, monkeypatch):
    monkeypatch.setattr(pii, "MIN_BITS", 1.0)
    texts = [f"text no{'x' * i} about Zebulon writes to a@x.org each day {'y' * i} rest" for i in range(6)] + [f"each day about the rest to text {'z' * i}" for i in range(30)] + [None, ""]
    docs = docs_of(spark, texts).withColumn("__new", F.lit(1))
    terms = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(docs).collect()}
    assert "zebulon" in terms and "day" not in terms
    out = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert out[0]["n_email"] == 1 and out[0]["n_term"] >= 1 and out[36]["n_email"] == 0
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "a@x.org" not in got[0] and "Zebulon" not in got[0] and got[36] is None and got[10] == texts[10]
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)  # the way beyond the bound gives the same
    assert {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()} == {i: r["spans"] for i, r in out.items()}
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_terms_in_a_repeated_signature(spark):
    """The same ten words around the address in otherwise different texts; copies of one text count once."""
    rng = random.Random(2)
    body = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))
    signed = [f"{body()} yours sincerely Quillon Varga office a@x.org call or write to us soon {body()}" for _ in range(6)]
    copied = [f"{body()} Solitary b@x.org {body()}"] * 9
    docs = docs_of(spark, signed + copied + [f"{body()} yours sincerely the office call or write to us soon" for _ in range(600)])
    terms = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(docs).collect()}
    assert terms == {"quillon": 1.0, "varga": 1.0}
    spans = {r["doc_id"]: r["n_term"] for r in pii.find(docs).collect()}
    assert all(spans[i] == (2 if i < 6 else 0) for i in spans)


def plain_disclosures(texts):
    """Disclosing terms from the definition, in plain Python."""
    held, near = {}, {}
    for text in {t for t in texts if t}:
        spans, words = plain_spans(text), []
        for m in WORD.finditer(text):
            w = m.group().lstrip(pii._EDGE)
            s, e = m.end() - len(w), m.end() - len(w) + len(w.rstrip(pii._EDGE))
            words.append((s, e, "" if any(a < e and s < b for a, _, b in spans) else pii.term_of(w)))
        for _, _, t in words:
            held.setdefault(t, set()).add(text)
        for a, k, b in spans:
            entity = (k, text[a:b].lower())
            held.setdefault(entity, set()).add(text)
            for _, _, t in [w for w in words if w[1] <= a][-5:] + [w for w in words if w[0] >= b][:5]:
                near.setdefault((t, entity), set()).add(text)
    n, out = len({t for t in texts if t}), {}
    for (t, entity), at in near.items():
        share = len(at) / len(held[t])
        if t and len(at) >= 3 and share >= 0.5 and math.log2(share * n / len(held[entity])) >= pii.MIN_BITS:
            out[t] = max(share, out.get(t, 0.0))
    return out


def test_pii_terms_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "MIN_BITS", 2.0)
    rng = random.Random(3)
    body = lambda n=12: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    url = "http://" + "u" * 300
    signs = ["jdoe77 a@x.org room 4711", f"Zo {url} 10.0.0.7 -- (Al)", "k9 +1 (234) - 567 8901 @handle", f"Vera{' ' * 250}b@x.org", "Mo\u00a0Li c@x.org \u0130pek", "the d@x.org and"]
    texts = [f"{body()} {s} {body(rng.randint(0, 3))}" for s in signs for _ in range(4)] + [f"{body(30)} the and - {body()} 4712" for _ in range(60)] + [None, "", "a@x.org"]
    texts += texts[:8]
    want = plain_disclosures(texts)
    assert {"jdoe77", "room", "4711", "--", "zo", pii.term_of(url), "al", "k9", "@handle", "vera", "mo\u00a0li", "\u0130pek".lower()} == set(want)
    docs = docs_of(spark, texts)
    assert {r["term"]: r["disclosure"] for r in pii.disclosing_terms(docs).collect()} == want
    out = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    marked = [{texts[i][int(s) : int(e)] for k, s, e in (x.split(":") for x in out[i].split(",")) if k == "term"} for i in (0, 4, 8, 12, 16, 20)]
    assert marked == [{"jdoe77", "room", "4711"}, {"Zo", url, "--", "Al"}, {"k9", "@handle"}, {"Vera"}, {"Mo\u00a0Li", "\u0130pek"}, set()]
    assert "u" * 20 not in pii.cleaned(texts[4], want) and "Zo" not in pii.cleaned(texts[4], want)
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert {r["term"]: r["disclosure"] for r in pii.disclosing_terms(docs).collect()} == want
    assert {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()} == out


# --- 8 ------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    texts = ["plain", None, "", chat.TRAP, "<|im_start|>", r"<\|im_end|>", r"<\\|x <|y|>", "<|nl|>\n", "a\n<|im_end|>\n<|im_start|>user\nb"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "we<|nl|>ird\nrole", "x"), (2, 0, "user", "same turn"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    want = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(texts)])
    loss = "".join(t or "" for _, _, r, t in rows[: len(texts)] if r == "assistant")
    assert out[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and out[1]["n_turns"] == len(texts)
    assert (out[1]["loss_sha256"], out[1]["loss_chars"]) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    assert out[2]["n_turns"] == 2 and out[None]["n_turns"] == 1
    assert out[2]["turns_sha256"] == hashlib.sha256(b"user\nsame turn\nwe<|nl|>ird\nrole\nx\n").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_random_turns(spark):
    """Whatever the turns hold, they read back; one text is very long, and some columns clash."""
    rng = random.Random(6)
    bits = ["<", "|", "\\", "im_start", "im_end", "|>", "<|im_start|>", "<|im_end|>", "<|nl|>", "\n", "user", "é", " "]
    some = lambda n: "".join(rng.choices(bits, k=rng.randint(0, n)))
    rows = [(i // 4, i, some(4), some(12)) for i in range(400)] + [(200, 0, "assistant", "<|im_end|>word " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"__form": F.lit(1), "Formatted": F.lit(2), "h": F.lit(3)})
    out = {r["conv_id"]: r["turns_sha256"] for r in chat.digests(chat.format_chats(df)).collect()}
    for c, group in itertools.groupby(rows, key=lambda r: r[0]):
        assert out[c] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in group).encode()).hexdigest()


# --- 9, 10 --------------------------------------------------------------------------------------------------------
def test_sharding(spark, awkward):
    docs = docs_of(spark, [f"text {i % 90} " + "x" * (i % 41) for i in range(600)], sources=[f"s{i % 7}" for i in range(600)])
    out = sharding.shard(docs).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.1 * sums.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert (out.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    odd = sharding.shard(awkward)
    assert odd.count() == awkward.count() and {r["size"] for r in odd.where("text_crc32 = 0").collect()} == {1}
    assert sharding.shard(awkward.limit(0)).count() == 0


def test_packing(spark, awkward):
    out = packing.pack(awkward, with_ids=True).toPandas()
    tok = packing.WordTokenizer(packing.tokenizer_path()).tokenizer
    want = sorted([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in awkward.collect())
    assert out["length"].max() <= 2048 and all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(out["ids"], out["ids_crc32"], strict=True))
    assert sorted(x for ids in out["ids"] for x in ids) == sorted(x for ids in want for x in ids)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert packing.pack(awkward.limit(0)).count() == 0


def test_packing_long_and_repeated_rows(spark, monkeypatch):
    """One very long text, rows that repeat whole, clashing columns: each id lies in one piece, and groups stay bounded."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 16)
    docs = docs_of(spark, ["word " * 90_000, *["the same text"] * 200, None, "x"], ids=[1, *[2] * 200, 3, None]).withColumns({"Length": F.lit(1), "__g": F.lit(0)})
    out = packing.pack(docs).toPandas()
    assert out[out["doc_id"] == 1]["start"].tolist() and out[out["doc_id"] == 1]["length"].sum() == 90_001
    assert (out["doc_id"] == 2).sum() == 200 and out["doc_id"].isna().sum() == 1
    assert out["sequence_id"].floordiv(1 << 32).value_counts().max() < 64


def test_words_are_remembered_once():
    """Parts of words and words share one memory, as workers keep it between stages; ids are the tokenizer's."""
    words = packing.WordTokenizer(packing.tokenizer_path())
    text = "tree Tree TREE tree, tree. , ... Ölbaum ölbaum! ÿ x1 İ a.b !? house house? House"
    got = words.encode([text, "", "tree!"])
    for ids, t in zip(got, [text, "", "tree!"], strict=True):
        assert ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids
    held = [m for m in vars(words).values() if isinstance(m, dict) and any(isinstance(k, str) for k in m)]
    assert sum("house" in m for m in held) == 1 and sum(map(len, held)) <= len(set(text.split())) + 7


def test_first_fit_decreasing():
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    bins: list[int] = []
    want: list = [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((j for j, used in enumerate(bins) if used + lengths[i] <= 128), len(bins))
        if b == len(bins):
            bins.append(0)
        want[i] = (b, bins[b])
        bins[b] += lengths[i]
    assert packing.first_fit_decreasing(lengths, 128) == want


# --- all ----------------------------------------------------------------------------------------------------------
def plain_mix(rows, size, source):
    """Copies of each row: targets by sharing out again and again, then one draw along the order."""
    sizes: dict = {}
    for r in rows:
        sizes[r[source]] = sizes.get(r[source], 0) + size(r)
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight, target, free = {n: i % 3 + 1 for i, n in enumerate(names)}, {}, set(names)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] >= 3 * sizes[n]}
        target.update({n: 3 * sizes[n] for n in over} or share)
        free = free - over if over else set()
    out = []
    for n in names:
        def place(r):
            z = size(r)
            return len(f"{z:b}") * 16 + (z >> max(0, len(f"{z:b}") - 4)), hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), z

        rate = target[n] / sizes[n] if sizes[n] else 0.0
        for k, r in enumerate(sorted((r for r in rows if r[source] == n), key=place), 1):
            out += [r] * int(math.floor(k * rate + mixing.offset()) - math.floor((k - 1) * rate + mixing.offset()))
    return out


def test_pipeline_against_plain_python(spark):
    """Each stage's whole rows from its predecessor's, by plain Python; the classifier's scores come from its model."""
    import corpus_pipeline as cp

    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = docs.collect()
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, DIR)
        if name == "quality":
            scores = model.score(np.array([quality.statistics(r["text"]) for r in rows]))
            rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
        elif name == "near_duplicates":
            rows.sort(key=lambda r: r["doc_id"])
            linked = plain_components([r["text"] for r in rows])
            rows = [r for i, r in enumerate(rows) if linked[i][1] == i]
        elif name == "personal_data":
            terms = plain_disclosures([r["text"] for r in rows])
            texts = [pii.cleaned(r["text"], terms) for r in rows]
            rows = [type(r)(**(r.asDict() | {"text": t, "n_chars": len(t)})) for r, t in zip(rows, texts, strict=True)]
        else:
            rows = plain_mix(rows, lambda r: len(WORD.findall(r["text"])), "source")
        assert order(got.collect()) == order(rows), name
        docs = spark.createDataFrame(rows, docs.schema)
    out = cp.run(spark, DIR).collect()
    tok = packing.WordTokenizer(packing.tokenizer_path()).tokenizer
    want = sorted((r["doc_id"], [*tok.encode(r["text"], add_special_tokens=False).ids, 1]) for r in rows)
    found: dict = {}
    for r in out:
        assert r["length"] == len(r["ids"]) <= 2048 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        found.setdefault((r["doc_id"], r["start"]), []).append(r["ids"])
    whole: dict = {}
    for (d, s), pieces in sorted(found.items()):
        assert all(p == pieces[0] for p in pieces) and s == len(whole.setdefault(d, []))
        whole[d] += pieces[0]
    assert dict(want) == whole
    bins: dict = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [0, *itertools.accumulate(n for _, n in sorted(b))][:-1]


def test_pipeline_stages_on_awkward_tables(spark, awkward, tmp_path):
    """Nulls, repeated rows, clashing columns and empty tables go through every stage."""
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(1, 1, 0), (6, 0, None), (7, 1, 1), (None, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward.unionByName(awkward).withColumns({"__row": F.lit(1), "CID": F.lit("c"), "Score": F.lit(2)}), awkward.limit(0)):
        for k, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns, name
            out.write.parquet(path := str(tmp_path / f"{docs.count()}-{k}"), mode="overwrite")
            if name != "packing":
                docs = spark.read.parquet(path)
        assert spark.read.parquet(path).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_writes_few_files_for_few_bytes(spark, monkeypatch, tmp_path):
    """Many partitions of a small table share files: each file that an executor writes can start processes of its own."""
    import corpus_pipeline as cp

    rng, words = random.Random(3), [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=40)) + f" me{i % 9}@example.org" for i in range(150)]
    texts += [t + " more" for t in texts[::2]] + texts[::3]
    docs_of(spark, texts).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs, most, seen = spark.read.parquet(str(tmp_path / "docs")), 2 * spark.sparkContext.defaultParallelism, []
    discard, cut = neardup.discard, pii.cut

    def counted(df):
        seen.append(len(df.inputFiles()))
        discard(df)

    def held(df):
        out = cut(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(neardup, "discard", counted)
    monkeypatch.setattr(pii, "cut", held)
    confs = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        for stage in (cp.drop_near_duplicates, cp.hide_personal_data, cp.mix_sources):
            stage(spark, docs, str(tmp_path)).write.parquet(path := str(tmp_path / stage.__name__))
            docs = spark.read.parquet(path)
            seen.append(len(docs.inputFiles()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(seen) > 15 and max(seen) <= most, seen


def test_registry():
    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 11) for n in registry.QUERIES if n.startswith(f"op{k}_")]

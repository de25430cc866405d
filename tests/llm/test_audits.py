"""Source divergence, language identification and filter interaction, against plain versions of each."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrispark.llm import interactions, language, source_audit

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# ------------------------------------------------------------------ filter interaction


def fails(text, name):
    words = WORD.findall(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }[name]


def plain_interaction(rows, labels):
    """rows: (id, text, lang); every order applied row by row."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = collections.defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        out = {n for n in "ABCD" if fails(t, n)} | ({"E"} if i is not None and first[t] < i else set())
        mine = [x for x in labels if i is not None and x[0] == i]
        parts[lang or ""].append((out, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    found = set()
    for part, docs in parts.items():
        lines, shapley = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                lines.append(("".join(order), k + 1, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
                shapley[f] += len(gone)
        found |= {(part, *x[:-1], shapley[x[-1]]) for x in lines}
    return found


def filter_rows():
    rng = np.random.default_rng(1)
    text = lambda n, kinds: " ".join(f"w{int(x)}" for x in rng.integers(0, kinds, n))
    rows = [(i, text(int(rng.integers(0, 500)), int(rng.integers(1, 900))) + ["", " #", " ABC DEF", " é&Ü"][i % 4], ["en", "fr", None, ""][i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], ["en", "de"][i % 2]) for i in range(30)]  # copies across languages
    rows += [rows[3], rows[3], (3, rows[3][1], "de"), (3, "another text of one id", "en"), (None, rows[5][1], "en"), (None, rows[5][1], "en"), (None, None, None), (200, None, "en"), (201, "", "en"), (202, "\t\n \x0b", "en")]
    rows += [(300, text(40_000, 30_000), "en"), (301, "x" * 300_000, "en")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_vocabulary_by_pieces(piece):
    for _, text, _ in filter_rows()[0]:
        raw = (text or "")[:5000].encode()
        assert interactions.vocabulary(raw, piece) == (len(raw.split()), len(set(raw.split())))


def test_every_order_of_the_filters(spark):
    rows, labels = filter_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("part", "mask", "digest", "n", "good", "_id", "id")]).repartition(5)
    got = interactions.audit_filters(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) == 4 * 600
    assert set(found) == plain_interaction(rows, labels)


def test_filters_of_ones_own(spark):
    rows, labels = filter_rows()
    docs, known = spark.createDataFrame(rows, "k bigint, body string, site string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = interactions.audit_filters(docs, known, {"x": lambda m: m.words > 100, "y": lambda m: m.marked}, None, "k", "body", "site").collect()
    assert {r["filter_order"] for r in got} == {"xy", "yx"}
    assert sum(r["shapley"] for r in got if r["step"] == 1 and r["filter_order"] == "xy") + sum(r["shapley"] for r in got if r["step"] == 2 and r["filter_order"] == "xy") == 2 * sum(len(WORD.findall(t or "")) > 100 or bool(re.search(r"[#$%&*|]", t or "")) for _, t, _ in rows)
    empty = docs.limit(0)
    assert interactions.audit_filters(empty, known, id_col="k", text_col="body", part_col="site").collect() == []
    with pytest.raises(ValueError):
        interactions.audit_filters(docs, known, {c: (lambda m: False) for c in "abcdefgh"}, None)
    with pytest.raises(ValueError):
        interactions.audit_filters(docs, known, {"E": lambda m: False})


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for k in interactions.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(n)


# ------------------------------------------------------------------ source divergence


def plain_divergence(rows):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [TERM.findall(t.translate(low)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs = collections.Counter(t for ts, r in zip(terms, rows, strict=True) if r[1] == lang for t in set(ts))
        keep = sorted((t for t, n in docs.items() if n >= source_audit.LEAST_DOCS), key=str.encode)
        sources = sorted({r[2] for r in rows if r[1] == lang})
        counts = {s: collections.Counter(t for ts, r in zip(terms, rows, strict=True) if r[1:] == (lang, s) for t in ts) for s in sources}
        total = sum(counts.values(), collections.Counter())

        def share(c):
            n = sum(c[t] for t in keep)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(keep)) for t in keep}

        p, q = {s: share(counts[s]) for s in sources}, share(total)
        for s in sources:
            pairs = [(b, sum(abs(p[s][t] - p[b][t]) for t in keep)) for b in sources if b != s]
            leads = [(t, p[s][t] - q[t]) for t in keep if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", leads, source_audit.TOP)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])}
    return out


def source_rows():
    rng = np.random.default_rng(2)
    vocab = [f"{a}{b}" for a in ("the", "Été", "zeta", "日本", "q") for b in "abcdefghijklmnopqrst"]
    rows = []
    for i in range(400):
        lean = rng.permutation(len(vocab))[:30] if i % 4 else np.arange(10)
        words = [vocab[int(k)] for k in rng.choice(lean, int(rng.integers(0, 60)))]
        rows.append((["; ", " ", "\x00", "9"][i % 4].join(words), ["en", "en", "xx", None][i % 4], [f"s{i % 5}", None, ""][int(rng.integers(0, 3))]))
    rows += [rows[0]] * 7 + [(None, "en", "quiet"), ("12 34 --", "en", "digits"), (None, None, None), ("few words", "solo", "one"), ("none kept", "rare", "a"), ("none kept", "rare", "b"), (None, "rare", "c")]
    rows.append((" ".join(vocab * 3000), "en", "long"))
    return rows


@pytest.mark.parametrize("held", [source_audit.HELD, 50])
def test_source_divergence(spark, monkeypatch, held):
    monkeypatch.setattr(source_audit.count_terms, "__defaults__", (*source_audit.count_terms.__defaults__[:-1], held))
    rows = source_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").select("*", *[F.lit("z").alias(c) for c in ("term", "n", "shard", "total", "part", "value")]).repartition(6)
    got = [tuple(r) for r in source_audit.audit_sources(docs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_divergence(rows)
    assert any(r[2] == "term" for r in got)
    assert source_audit.audit_sources(docs.limit(0)).collect() == []


# ------------------------------------------------------------------ language identification


def doubled(labels=3, units=5, seed=0):
    net = language.Net.fresh(labels, units, np.random.default_rng(seed))
    return language.Net(*[a.astype(np.float64) for a in net.arrays()])


def test_gradients_by_differences():
    rng = np.random.default_rng(4)
    net, x, target = doubled(), rng.integers(0, 256, (9, 6)), np.array([0, 1, 2, 0, 1, 2])
    x[6:, 2] = 0
    loss, grad = language.gradients(net, x, target)
    for a, g in zip(net.arrays(), grad.arrays(), strict=True):
        for place in zip(*[rng.integers(0, s, 12) for s in a.shape], strict=True):
            if a is net.byte:
                place = (place[0], x.reshape(-1)[place[1] % x.size], place[2])
            old = a[place]
            a[place] = old + 1e-5
            up = language.gradients(net, x, target)[0]
            a[place] = old - 1e-5
            down = language.gradients(net, x, target)[0]
            a[place] = old
            assert (up - down) / 2e-5 == pytest.approx(g[place], rel=1e-4, abs=1e-7)
    assert loss > 0


def plain_label(net, text):
    """Mean label probabilities over letters, position by position."""
    units = net.cand.shape[1]
    total, letters = np.zeros(len(net.bias)), 0
    for lo in range(0, len(text), language.SEGMENT):
        piece = text[lo : lo + language.SEGMENT]
        states = []
        for d in (0, 1):
            h, found = np.zeros(units), {}
            for t in range(len(piece)) if d == 0 else reversed(range(len(piece))):
                a = net.byte[d][piece[t]]
                u, r = (1 + np.tanh(a[: 2 * units] + net.gate[d] @ h)).reshape(2, units)
                c = np.tanh(a[2 * units :] + net.cand[d] @ (r * h))
                h = h + u / 2 * (c - h)
                found[t] = h
            states.append(found)
        for t, byte in enumerate(piece):
            if chr(byte).isascii() and not chr(byte).isalpha():
                continue
            z = np.exp(net.out[0] @ states[0][t] + net.out[1] @ states[1][t] + net.bias)
            total += z / z.sum()
            letters += 1
    return total / max(1, letters)


def test_pooled_labels(monkeypatch):
    net = doubled()
    rng = np.random.default_rng(5)
    alphabet = list("abcdefg XYZ.,19\n") + ["é", "ß", "日"]
    # Whole segments: the network reads what fills a segment up, so only these are alike to the last digit.
    texts = []
    for n in (1, 2, 5):
        raw = "".join(rng.choice(alphabet, 128 * n)).encode()
        texts.append(raw[: 128 * n])
    monkeypatch.setattr(language, "LAID", 256)
    got = language.pooled(net, [*texts, b""])
    for g, t in zip(got, texts, strict=False):
        assert g == pytest.approx(plain_label(net, t), abs=1e-5)
    assert got[3].tolist() == [0, 0, 0]
    monkeypatch.setattr(language, "SIDE", 2)
    assert language.pooled(net, [*texts, b""]) == pytest.approx(got, abs=1e-6)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_language(docs).join(docs.select(F.col("doc_id").alias("id"), "lang", "text"), "id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts(spark):
    words = {"aa": "alpha beta gamma delta epsilon", "bb": "uno dos tres cuatro cinco seis", "cc": "日本 東京 大阪 京都"}
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words[lang].split(), int(rng.integers(1, 80)))), lang) for i in range(240) for lang in [list(words)[i % 3]]]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 .. —…", "bb"), (None, "alpha beta", "bb"), (1003, "alpha beta gamma " * 60_000, "bb"), (1004, "uno dos tres", None), (1005, "京都", None), (7, rows[7][1], "cc"), (7, rows[7][1], "cc")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").select("*", *[F.lit("z").alias(c) for c in ("key", "crc", "r", "snippets", "score", "id")]).repartition(3)
    got = collections.defaultdict(set)
    found = language.identify_language(docs, steps=120).collect()
    assert len(found) == len(rows) + len(odd)
    for r in found:
        got[r["id"]].add((r["held_out"], r["lang_pred"], r["score"] > 0))
    for i in (1000, 1001, 1002):
        assert {x[1:] for x in got[i]} == {("und", False)}
    assert got[None] == {(False, "aa", True)}
    assert [next(iter(got[i]))[1] for i in (1003, 1004, 1005)] == ["aa", "bb", "cc"]
    assert len(got[7]) == 1
    assert sum(next(iter(got[i]))[1] == lang for i, _, lang in rows) >= 0.95 * len(rows)
    one = language.identify_language(docs.where("lang = 'aa'")).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("aa", 1.0), ("und", 0.0)}
    none = language.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert language.identify_language(docs.limit(0)).collect() == []

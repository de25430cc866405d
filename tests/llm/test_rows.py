"""Embeddings, pages, rules, licences, mixing, perplexity and the pipeline."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrispark.llm import divergence, lattice, licenses, mixing, pages, perplexity
from attrispark.llm.license_texts import TEXTS

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.12).astype(float).tolist()) for i in range(160)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [1.0, None] + [0.0] * 14), (206, rows[0][1][:8]), (207, []), (208, [float("inf")] * 16), (209, [2 * x for x in rows[1][1]]), (None, rows[0][1])]
    got = {r["id"]: (r["n_links"], r["component"]) for r in lattice.dedup_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    valid = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in valid])
    linked = unit @ unit.T >= 0.9
    ids = [i for i, _ in valid]
    component = {i: i for i in ids}
    for _ in range(20):
        for a, i in enumerate(ids):
            for b in np.flatnonzero(linked[a]):
                component[i] = component[ids[b]] = min(component[i], component[ids[b]])
    links = sum(int(x.sum()) - 1 for x in linked)
    assert sum(g[0] for g in got.values()) >= 0.97 * links
    close = sum(got[i] == (int(linked[a].sum()) - 1, component[i]) for a, i in enumerate(ids))
    assert close >= 0.95 * len(ids)
    for i in (202, 203, 204, 205, 206, 207, 208):
        assert got[i] == (0, i)
    assert got[None] == (0, None)
    assert lattice.dedup_embeddings(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


@pytest.mark.parametrize("dim", [16, 64, 200])
def test_recall_of_single_links(spark, dim):
    """Pairs at the threshold that nothing else links, at default parameters."""
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=(2, 400, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.901 * a + (1 - 0.901**2) ** 0.5 * b
    rows = [(2 * i, x.tolist()) for i, x in enumerate(a)] + [(2 * i + 1, x.tolist()) for i, x in enumerate(b)]
    links = lattice.lattice_links(spark.createDataFrame(rows, "node bigint, embedding array<double>")).collect()
    found = {frozenset((r["a"], r["b"])) for r in links}
    unit = np.stack([a, b], axis=1).reshape(-1, dim)
    assert all(unit[i] @ unit[j] >= 0.9 for i, j in map(tuple, found))
    assert sum(frozenset((2 * i, 2 * i + 1)) in found for i in range(400)) >= 0.95 * 400 or dim == 16


def test_crowded_cells_are_worked_through_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    near = base + rng.normal(size=(300, 16)) * 0.02
    rows = [(i, x.tolist()) for i, x in enumerate(near)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(50)]
    monkeypatch.setattr(lattice, "CELL", 32)
    monkeypatch.setattr(lattice._segments, "__defaults__", (100,))
    monkeypatch.setattr(lattice._pieces, "__defaults__", (100,))
    got = {r["id"]: (r["n_links"], r["component"]) for r in lattice.dedup_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert all(got[i] == (299, 0) for i in range(300))


def test_lattice_decodes_to_the_nearest_point():
    x = np.random.default_rng(3).normal(size=(300, 8)) * 1.5
    found = lattice.decode(x)
    others = found[:, None, :] + lattice.NEIGHBOURS
    assert (((x - found) ** 2).sum(1)[:, None] <= ((x[:, None, :] - others) ** 2).sum(2) + 1e-9).all()
    assert len(lattice.NEIGHBOURS) == 240


PAGE = """<!doctype html><html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><a href=/>Home</a></nav>
<div class="content post-{n}"><h1>Title &amp; more</h1><p>First   paragraph {n} with <b>bold<p>Second &eacute;<br>line<ul><li>item a<li>item b</ul>
<div class="ad-slot">BUY</div><form><label>Email</label></form></div>
<aside>About the author</aside><section id="comments"><p>Nice post, a long long comment by a reader of this page</p></section><footer>&copy; x</footer>"""


def test_pages(spark):
    rows = [(i, f"https://u@Host.example:80/{i}", PAGE.format(n=i)) for i in range(5)] + [(10, None, None), (11, "x", ""), (12, "https://other.example", "plain words only"), (13, "https://host.example/x", "<p>No such container here, but words."), (14, "https://host.example/deep", "<div>" * 3000 + "deep text" + "</div>" * 3000)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(table).collect()}
    for i in range(5):
        assert got[i] == f"Title & more\nFirst paragraph {i} with bold\nSecond é line\nitem a\nitem b"
    assert got[10] == got[11] == ""
    assert got[12] == "plain words only"
    assert got[13] == "No such container here, but words."
    assert got[14] == "deep text"
    assert pages.extract_pages(table.limit(0)).collect() == []


def test_headings_stay_with_what_they_head():
    page = '<body>skip<div class="x1"><p>unnamed box</p></div><div class="wrap"><h1>Head</h1><div class="inner"><p>{}</p></div></div><article><p>teaser</p></article></body>'
    assert pages.extract(page.format("text " * 60), []) == "Head\n" + ("text " * 60).strip()
    inside = '<article><h1>Head</h1><div class="intro"><p>intro</p></div><div class="inner"><p>{}</p></div></article>'
    assert pages.extract(inside.format("text " * 60), []) == "Head\nintro\n" + ("text " * 60).strip()


def test_host_consensus_overrules_a_page_of_its_own_mind(spark):
    good = '<div class="main-text"><p>{}</p></div><div class="other"><p>short</p></div>'
    odd = '<div class="main-text"><p>{}</p></div><div class="other"><p>{}</p></div>'
    rows = [(i, "http://a.example/", good.format("words " * 30)) for i in range(4)] + [(9, "http://a.example/9", odd.format("article " * 20, "teaser " * 70))]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == ("article " * 20).strip()


def test_text_beyond_the_path_of_a_host_is_kept_unless_the_host_knows_it_as_an_aside(spark):
    """By hand: five pages know main/lead; on one more, main also has a section that no other page has."""
    lead = '<main><div class="lead"><p>{}</p></div></main>'
    more = '<main><div class="lead"><p>{}</p></div><div class="rest"><p>{}</p></div></main>'
    rows = [(i, "http://b.example/", lead.format("words " * 30)) for i in range(5)] + [(9, "http://b.example/9", more.format("lead " * 30, "rest " * 70))]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(table).collect()}
    assert got[0] == ("words " * 30).strip()
    assert got[9] == ("lead " * 30).strip() + "\n" + ("rest " * 70).strip()
    known = [(20 + i, "http://b.example/k", more.format("words " * 90, "rest " * 2)) for i in range(5)]
    again = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows + known, table.schema)).collect()}
    assert again[9] == ("lead " * 30).strip()


def test_names_of_wrappers_and_sibling_sections_lose_no_article():
    text = ("text " * 60).strip()
    for name in ("content-sidebar-wrap", "layout-with-sidebar"):
        page = f'<body><header>Site</header><div class="{name}"><article><h1>Head</h1><p>{text}</p></article><div class="sidebar"><p>side</p></div></div></body>'
        assert pages.extract(page, []) == "Head\n" + text
    assert pages.extract(f'<body><article><p>article</p></article><div class="post-comments"><p>{text}</p></div></body>', []) == "article"
    more = ("more " * 20).strip()
    page = f'<body><main><div class="part-a"><p>{text}</p></div><div class="part-b"><p>{more}</p></div></main></body>'
    assert pages.extract(page, []) == text + "\n" + more


def rules_by_hand(text):
    found = WORD.findall(text or "")
    count = collections.Counter(tuple(found[k : k + 3]) for k in range(len(found) - 2))
    covered = {j for k in range(len(found) - 2) if count[tuple(found[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "Word", "other", "thing,", "is", "été"], n))
    texts = [prose(200) for _ in range(30)] + [" ".join(f"$$$ {x}###" for x in prose(150).split()), "a b c " * 60, None, "", "one two", "x\nx\n\nx\n y", "a b c a b c a b c", prose(3000)]
    rows = [(i, t, "en" if i % 7 else None, "clash") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words string")
    got = {r["id"]: r for r in divergence.quality_rules(table).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], rules_by_hand(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert not got[30]["kept"]
    assert divergence.quality_rules(table.limit(0)).collect() == []


def test_quality_rules_judge_every_language(spark):
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join(rng.choice("the of and Word other thing, is été a in to that it was for on are with as be".split(), n))
    texts = [*(prose(120) for _ in range(6)), " ".join(f"$$$ {x}###" for x in prose(110).split()), " ".join(f"longerthaneight{k}" for k in range(120))]
    languages = divergence.LANGUAGES + 30
    table = spark.createDataFrame([(8 * n + k, t, f"l{n}") for n in range(languages) for k, t in enumerate(texts)] + [(-1, texts[-1], "no common words")], "doc_id bigint, text string, lang string")
    got = {r["id"]: (r["class_distance"], r["word_distance"], r["kept"]) for r in divergence.quality_rules(table).collect()}
    assert len(got) == 8 * languages + 1 and got[-1] == (0, 0, True)
    assert got[0][2] and not got[7][2]
    for n in range(languages):
        for k in range(8):
            assert got[8 * n + k] == got[k] and None not in got[k]


def test_jensen_shannon_distance(spark):
    row = spark.range(1).select(divergence.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), divergence.distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("near")).first()
    assert row["far"] == pytest.approx(1) and row["near"] == 0


def test_licenses(spark):
    mit = TEXTS["MIT"]
    rows = [(1, mit.replace("<year> <copyright holders>", "2021 Ann").upper()), (2, TEXTS["ISC"].replace("\n\n", "\r\n\r\n")), (3, mit.replace("MIT License\n", "").replace("sublicense", "sub-licence").replace('"', "“")), (4, None), (5, ""), (6, mit + " and more"), (6, mit), (None, mit)]
    got = collections.Counter((r["id"], r["license_id"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == {(1, "MIT"): 1, (2, "ISC"): 1, (3, "MIT"): 1, (4, None): 1, (5, None): 1, (6, None): 1, (6, "MIT"): 1, (None, "MIT"): 1}
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_whole_licenses(spark):
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-UC", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows = []
    for file, name in names.items():
        with open(f"/usr/share/common-licenses/{file}") as f:
            text = f.read()
        rows += [(name, text), (name, text.upper().replace("\n\n", "\r\n \r\n")), (None, text[: len(text) // 2])]
        if "END OF TERMS AND CONDITIONS" in text:
            rows.append((f"{name}-terms", text[: text.index("END OF TERMS AND CONDITIONS") + 27]))
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")).collect()
    assert {r["id"]: r["license_id"] for r in got} == {i: name for i, (name, _) in enumerate(rows)}


def fill(sizes, weights, total):
    """Targets by filling up one source after the other."""
    open_, target = set(sizes), {}
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def balanced_rates(rows, target, limit, tilt):
    """Rates by nested bisection: rows (source, size), the length multiplier outside, the source's inside."""
    by = collections.defaultdict(list)
    for s, n in rows:
        if n:
            by[s].append((n, n.bit_length()))
    mean = sum(n * c for v in by.values() for n, c in v) / sum(n for v in by.values() for n, _ in v)

    def rate(s, m):
        v = by[s]
        if target[s] >= limit * sum(n for n, _ in v) - 1e-9:
            return lambda c: limit
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(n * min(limit, math.exp(mid + m * c)) for n, c in v) > target[s] else (mid, hi)
        return lambda c: min(limit, math.exp(lo + m * c))

    lo, hi = -tilt, tilt
    for _ in range(60):
        m = (lo + hi) / 2
        shift = sum(n * r(c) * (c - mean) for s, v in by.items() for r in [rate(s, m)] for n, c in v)
        lo, hi = (lo, m) if shift > 0 else (m, hi)
    return {(s, c): rate(s, lo)(c) for s, v in by.items() for _, c in v}, lo


def test_mixing(spark):
    rng = np.random.default_rng(6)
    names = ["b", "a", None, "ä", "Z", "solo"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), names[int(rng.integers(0, 5))]) for i in range(400)] + [(900, None, "a"), (901, "", "b"), (902, "word " * 5000, "Z"), (903, "v", "solo"), (903, "v", "solo")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(table).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()))
    rates, multiplier = balanced_rates([(s, len((t or "").split())) for _, t, s in rows], want, 2, mixing.TILT)
    assert abs(multiplier) > 0.001
    taken, cells, words = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["copies"] == (math.ceil(r["taken"] / r["size"]) if r["size"] else 0)
        if r["size"]:
            cell = r["source"], r["size"].bit_length()
            assert r["rate"] == pytest.approx(rates[cell], rel=1e-6)
            assert math.floor(r["rate"]) * r["size"] <= r["taken"] <= math.ceil(r["rate"]) * r["size"]
            cells[cell] += r["taken"]
            words[cell] += r["size"]
        taken[r["source"]] += r["taken"]
    for cell, n in words.items():  # copies follow the rates, not the source's mean
        assert abs(cells[cell] - rates[cell] * n) <= 1
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(table.repartition(7)).collect()), key=str)
    assert mixing.mix_sources(table.limit(0)).collect() == []


def slow_model(texts, order):
    """Interpolated modified Kneser-Ney probabilities by definition."""
    def grams(t):
        s = [0] * (order - 1) + [int(x) for x in perplexity.symbols(t.encode())]
        return [tuple(s[k : k + order]) for k in range(len(s) - order + 1)]

    levels = [collections.Counter(g for t in texts for g in grams(t))]
    for _ in range(order - 1):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))

    def discounts(level):
        n = [sum(c == k for c in level.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        return [0] + [max(0.0, min(k - 1e-3, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)]

    tables = []
    for level in levels:
        d, total, left = discounts(level), collections.Counter(), collections.Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        tables.append((level, d, total, left))

    def p(g):
        if not g:
            return 1 / perplexity._SYMBOLS
        level, d, total, left = tables[order - len(g)]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        c = level[g]
        return (c - d[min(c, 3)] if c else 0) / total[h] + left[h] / total[h] * p(g[1:])

    def score(t):
        each = [math.log(p(g)) for g in grams(t)]
        return math.exp(-sum(each) / len(each))

    return score


@pytest.mark.parametrize("text", ["", "plain", "\u0dde\u0ddd\u0fff\u1000", "日本語 é\U0010ffff\U0001f600", "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000, 7)]))])
def test_symbols_can_be_read_back(text):
    found, out = perplexity.symbols(text.encode()).tolist(), []
    assert all(0 < x < perplexity._SYMBOLS for x in found)
    while found:
        x = found.pop(0) - 1 if len(found) < 100 else None
        if x is None:  # long: without popping
            i = 0
            while i < len(found):
                y = found[i] - 1
                if y >= perplexity.NEAR:
                    y = (y - perplexity.NEAR) << perplexity.FAR_BITS | found[i + 1] - 1
                    i += 1
                out.append(chr(y))
                i += 1
            break
        out.append(chr(x if x < perplexity.NEAR else (x - perplexity.NEAR) << perplexity.FAR_BITS | found.pop(0) - 1))
    assert "".join(out) == text


def test_perplexity(spark):
    rng = np.random.default_rng(8)
    make = lambda: " ".join(rng.choice(["ana", "bel", "été", "co", "dida", "日本"], int(rng.integers(3, 30))))
    texts = [make() for _ in range(40)] + [None, "", "QQ##QQ", "a", make() * 40]
    table = spark.createDataFrame([(i, t, "en" if i % 3 else None, 1.5) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(31, 1, 1), (32, 0, 0), (33, None, None), (34, 1, 0), (34, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    scored = {r["doc_id"]: (r["perplexity"], r["held_out"]) for r in perplexity.score_perplexity(table, labels).collect()}
    held = {i for i, (_, h) in scored.items() if h}
    assert held <= set(range(30))
    score = slow_model([texts[i] for i in range(30) if i not in held], 5)
    for i, t in enumerate(texts):
        if t:
            assert scored[i][0] == pytest.approx(score(t), rel=1e-4)
        else:
            assert scored[i][0] is None
    verdict = {r["id"]: r["kept"] for r in perplexity.classify_quality(table, labels).collect()}
    assert not verdict[40] and not verdict[41] and not verdict[42]
    assert all(verdict[i] for i in range(40))
    assert perplexity.classify_quality(table.limit(0), labels).collect() == []
    unlabelled = perplexity.classify_quality(table, labels.limit(0)).collect()
    assert all(r["kept"] == bool(texts[r["id"]]) for r in unlabelled)


def test_thresholds_are_held_out_quantiles(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = perplexity.score_perplexity(docs, labels).select("doc_id", "lang", "perplexity", "held_out", F.char_length("text").alias("n")).collect()
    short = {r["doc_id"]: perplexity.SHORT / math.sqrt(max(1, r["n"] or 0)) for r in rows}
    lang, held = {r["doc_id"]: r["lang"] for r in rows}, collections.defaultdict(list)
    for r in rows:
        if r["held_out"] and r["perplexity"] is not None:
            held[r["lang"]].append(math.log(r["perplexity"]) - short[r["doc_id"]])
    large = {g: sorted(v)[math.ceil(perplexity.QUANTILE * len(v)) - 1] for g, v in held.items() if len(v) >= perplexity.FEW}
    assert len(large) >= 3
    verdict = {r["id"]: r for r in perplexity.classify_quality(docs, labels).collect()}
    for i, r in verdict.items():
        if lang[i] in large:
            assert math.log(r["threshold"]) == pytest.approx(large[lang[i]] + short[i], rel=1e-6)
    junk = [i for i, in labels.where("quality = 0").select("doc_id").collect()]
    assert sum(not verdict[i]["kept"] for i in junk) >= 0.93 * len(junk)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = corpus_pipeline.quality(spark, docs, SF)
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    assert len(clean & kept) >= 0.97 * len(clean)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r["doc_id"] for r in rows} <= kept
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096


def test_documents_without_an_id_are_judged_by_their_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in perplexity.keep_quality(docs, labels).select("doc_id").collect()}
    texts = {r["doc_id"]: r for r in docs.collect()}
    known = {r["doc_id"] for r in labels.collect()}
    free = sorted(i for i in texts if i not in known and texts[i]["text"])[:40]
    bare = docs.withColumn("doc_id", F.when(F.col("doc_id").isin(free), F.lit(None)).otherwise(F.col("doc_id")))
    bare = bare.unionByName(bare.limit(0).unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (None, "", None, "s", 0)], bare.schema)))
    got = perplexity.keep_quality(bare, labels).collect()
    assert {r["doc_id"] for r in got} - {None} == kept - set(free)
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted(texts[i]["text"] for i in free if i in kept)


def test_pipeline_stages_one_by_one(spark, tmp_path):
    """Every stage's rows from what the one before it kept, by plain means."""
    import corpus_pipeline
    import duckdb
    from tokenizers import Tokenizer

    from attrispark.llm import oracle
    from attrispark.llm.queries import tokenizer_path

    from .test_text import slow_fingerprint

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    odd = [(100_001, None, "en", "src1", 0), (100_002, "", None, None, 0), (100_003, rows[0]["text"], "xx", None, 5), (100_004, "word " * 30_000, "en", "src2", 5), (rows[1]["doc_id"], rows[1]["text"], rows[1]["lang"], rows[1]["source"], 1), (None, rows[2]["text"], "en", "src3", 1), (None, None, None, None, None)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([tuple(r) for r in rows] + odd, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        stages.append(docs.collect())
    quality, near, passages, mixed, packed = stages
    verdict = {r["id"] for r in perplexity.classify_quality(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in quality} - {None} == verdict - {None}

    named = [r for r in quality if r["doc_id"] is not None]
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in named}
    group = {i: i for i in prints}
    for _ in range(8):
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == sorted(set(group.values()))
    assert sum(r["doc_id"] is None for r in near) == sum(r["doc_id"] is None for r in quality)

    seen, want = set(), []
    for r in sorted(near, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")):
        words = WORD.findall(r["text"] or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if (key := tuple(words[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        if not any(gone):
            want.append((r["doc_id"], r["text"]))
        elif not all(gone):
            want.append((r["doc_id"], " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    assert collections.Counter((r["doc_id"], r["text"]) for r in passages) == collections.Counter(want)

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/stage2/*.parquet'")
    taken = {i: n for i, n in duck.sql(f"SELECT doc_id, sum(taken) FROM ({oracle.source_mixing()}) GROUP BY 1").fetchall()}
    words_of = collections.Counter()
    for r in mixed:
        words_of[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert {i: n for i, n in words_of.items() if n} == {i: n for i, n in taken.items() if n}

    tokenizer = Tokenizer.from_file(tokenizer_path())
    lengths, used = collections.Counter(), collections.Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    wanted = collections.Counter()
    for r in mixed:
        wanted[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert lengths == wanted and max(used.values()) <= 4096


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def made_page(rng, host: int, k: int) -> tuple[str, str]:
    """A page of the host's template and its article, from parts whose role is known."""
    words = lambda n: " ".join(rng.choice(["reed", "lake", "stone &amp; sand", "tide", "<b>gull</b>", "caf&eacute;", "north  \n wind"], n))
    plain = lambda t: " ".join(re.sub("</?b>", "", t).replace("&amp;", "&").replace("&eacute;", "é").split())
    blocks = [("h1", words(4))] + [("p", words(int(n))) for n in rng.integers(12, 60, int(rng.integers(3, 9)))]
    inner = "\n".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    junk = [f'<div class="ad-slot-{k}">{words(9)}</div>', "<form><label>Mail</label><input></form>", f"<script>var x = '<p>{k}</p>'</script>"]
    inner = inner.replace("</p>\n<p>", f"</p>{junk[k % 3]}<p>", 1)
    menu = "<nav><ul>" + "".join(f'<li><a href="/{i}">{w}</a>' for i, w in enumerate("home news about".split())) + "</ul></nav>"
    comments = f'<section class="comments"><p>{words(int(rng.integers(5, 90)))}</p></section>'
    side = f"<aside><p>{words(30)}</p></aside>"
    wrap = [lambda x: f'<main><article class="post id-{k}">{x}</article></main>', lambda x: f'<div id=page><div class="story body{k}">{x}</div>{side}</div>', lambda x: "<div>" * 80 + f"<div class=deep>{x}</div>" + "</div>" * 80][host]
    html = f"<html><head><title>{k}</title></head><body><header class=top>{words(6)}</header>{menu}{wrap(inner)}{comments}<footer>{words(12)}</footer></body></html>"
    return html, "\n".join(plain(x) for _, x in blocks)


def test_pages_of_known_parts_and_votes_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(12)
    made = [(h * 100 + k, f"http://h{h}.example/{k}", *made_page(rng, h, k)) for h in range(3) for k in range(40)]
    made += [(900 + i, *made[i][1:]) for i in range(5)]  # repeated rows
    table = spark.createDataFrame([m[:3] for m in made], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(table).collect()}
    assert got == {m[0]: m[3] for m in made}
    # The same by plain counting of votes.
    votes = collections.defaultdict(collections.Counter)
    for _, url, html, _ in made:
        votes[url.split("/")[2]][pages.best_path(pages.parse(html)[1])[0]] += 1
    paths = {h: [p for p, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= pages.VOTES * sum(c.values())] for h, c in votes.items()}
    assert got == {m[0]: pages.extract(m[2], paths[m[1].split("/")[2]]) for m in made}
    # And where the paths are too many to broadcast and hosts large.
    monkeypatch.setattr(pages, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(pages, "PART", 7)
    assert {r["page_id"]: r["text"] for r in pages.extract_pages(table).collect()} == got


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "<p>low down</p>" + "</div>" * 20000
    assert pages.extract(deep, []) == "low down"
    long = "<article>" + "".join(f"<p>part {i} of it</p>" for i in range(30000)) + "</article>"
    assert pages.extract(long, []).count("\n") == 29999
    tie = "<div class=a><p>one two three</p></div><div class=b><p>six five four</p></div>"
    assert pages.extract(tie, []) == "one two three\nsix five four"


def test_a_form_is_judged_by_what_it_holds():
    story = " ".join(f"word{i}" for i in range(80))
    page = f'<html><body><form id="aspnetForm" action="x"><input type=hidden><nav>menu here</nav><div class=main><h1>Head</h1><p>{story}</p></div><label>Mail</label><button>Send</button></form><form class=search><p>Find things</p></form></body></html>'
    assert pages.extract(page, []) == f"Head\n{story}"
    assert pages.extract(f"<body><article><p>{story}</p><form><p>Your vote</p></form></article></body>", []) == story
    comment = f"<body><article><p>short text</p></article><form class=comment-form><p>{story}</p></form></body>"
    assert story not in pages.extract(comment, [])


def test_sections_of_one_wrapper_stay_together(spark):
    long = lambda k: " ".join(f"w{k}n{i}" for i in range(90))
    two = "<body><div class=wrap><div class=a><p>{a}</p></div><div class=b><p>{b}</p></div></div><div class=tail><p>{c}</p></div></body>"
    assert pages.extract(two.format(a=long(0), b="last section", c="c"), []) == f"{long(0)}\nlast section"
    # A section with a text of its own on every page stays; one that the host repeats goes.
    rows = [(k, "http://own.example/", two.format(a=long(k), b=f"closing words {k}", c="c")) for k in range(30)]
    rows += [(100 + k, "http://same.example/", two.format(a=long(k), b="subscribe today", c="c")) for k in range(30)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"{long(k)}\nclosing words {k}" and got[100 + k] == long(k) for k in range(30))


def test_very_long_texts_of_rules_and_licences(spark):
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rng.integers(0, 3000, 300_000)]
    lines = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    lines[5], lines[700] = lines[4], lines[4]
    text = "\n".join(lines) + " # $"
    rows = [(1, text, "en"), (2, text, "en"), (3, "x" * 2_000_000, "en"), (None, "few words", None), (None, None, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("*", *[F.lit("z").alias(c) for c in ("id", "_t", "_lang", "digest", "license")])
    got = {}
    for r in divergence.quality_rules(table).collect():
        got.setdefault(r["id"], []).append(r)
    found = WORD.findall(text)
    seen = collections.Counter(zip(found, found[1:], found[2:], strict=False))
    covered = {k + j for k, t in enumerate(zip(found, found[1:], found[2:], strict=False)) if seen[t] > 1 for j in range(3)}
    for i in (1, 2):
        (r,) = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(found), sum(map(len, found)), 2, 2, len(covered))
    assert (got[3][0]["n_words"], got[3][0]["word_chars"]) == (1, 2_000_000)
    assert len(got[None]) == 2 and all(r["base_failed"] and not r["kept"] for r in got[None])
    name = next(iter(TEXTS))
    long = spark.createDataFrame([(1, text), (2, TEXTS[name].replace(" ", "  " * 3000)), (3, None)], "doc_id bigint, text string").withColumn("license", F.lit("clash"))
    assert {r["id"]: r["is_license"] for r in licenses.scan_licenses(long).collect()} == {1: False, 2: True, 3: False}

"""Operators on texts against brute force, with odd rows among them."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attrispark.llm import packing, simhash, suffixes
from attrispark.llm.components import components
from attrispark.llm.queries import tokenizer_path
from attrispark.llm.substrings import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, kept_text string, n_words string"


def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "béta", "gamma,", "Delta", "eps", "ζeta", "eta.", "theta", "12", "#x"]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = make(60)
    rows = [make(int(n)) for n in rng.integers(0, 120, 20)]
    rows += [f"{make(15)}\n{passage}  {make(9)}" for _ in range(6)]
    rows += [rows[3]] * 3 + [passage, "", None, "   \n\t ", "one", make(4000) + " " + passage, "x" * 1000, "x" * 1000]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts())], SCHEMA).repartition(3)


def test_substrings(docs):
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        found = WORD.findall(t or "")
        gone = [False] * len(found)
        for k in range(len(found) - 19):
            key = tuple(found[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want[i] = (" ".join(w for w, g in zip(found, gone, strict=True) if not g), len(found), sum(gone))
    got = {r["doc_id"]: (r["kept_text"], r["n_words"], r["n_removed"]) for r in dedup_substrings(docs).collect()}
    assert got == want


def test_suffixes(docs):
    raw = [(t or "").encode() for t in texts()]
    count = collections.Counter(t[k : k + 400] for t in raw for k in range(len(t) - 399))
    want = {}
    for i, t in enumerate(raw):
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want[i] = (hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest(), len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))))
    got = {r["doc_id"]: (hashlib.sha256(r["kept_bytes"]).hexdigest(), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.dedup_suffixes(docs).collect()}
    assert got == want


def test_suffixes_of_a_very_long_text_after_empty_ones(spark):
    rng = np.random.default_rng(12)
    passage = "".join(rng.choice(list("abcdefgh"), 500))
    noise = lambda n: "".join(rng.choice(list("ijklmnopqrstuvwxyz"), n))
    long = noise(300_000) + passage + noise(300_000) + passage + noise(1000)
    rows = [(0, None), (1, ""), (2, long), (3, "short " + passage), (4, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    # One block, in the order of ids, is where the empty texts lead.
    a = suffixes.anchors([(t or "").encode() for _, t in rows], 400, 128)
    assert set(a[0].tolist()) == {2, 3} and a[1].max() > 1 << 19
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.dedup_suffixes(table).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 2: (len(long), 1000, 2), 3: (506, 500, 1), 4: (0, 0, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=8), max_size=7))
def test_loser_tree_sorts_and_knows_prefixes(runs):
    sorted_runs = [sorted(r) for r in runs]
    prefixes = [[0, *(suffixes.shared(a, b) for a, b in zip(r, r[1:], strict=False))][: len(r)] for r in sorted_runs]
    out = list(suffixes.LoserTree([[(x, b"", 0) for x in r] for r in sorted_runs], prefixes))
    merged = [x[0] for _, x in out]
    assert merged == sorted(x for r in runs for x in r)
    for (_, a), (k, b) in zip(out, out[1:], strict=False):
        assert k == suffixes.shared(a[0], b[0])


@pytest.mark.parametrize("limit", [0, 64])
def test_groups_of_many_contexts(monkeypatch, limit):
    """Pairs and offset-by-offset counting agree with all strings compared."""
    monkeypatch.setattr(suffixes, "PAIRWISE", limit)
    rng = np.random.default_rng(2)
    length, core = 12, b"abcd"
    some = lambda n: bytes(rng.choice(list(b"xy"), n).tolist())
    rows = sorted({(core + some(8 - lo), some(hi), False) for lo, hi in rng.integers(0, 6, (30, 2)) if lo <= hi})
    prefixes = [0, *(suffixes.shared(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))]
    strings = [{o: (r[1][::-1] + r[0])[len(r[1]) - o : len(r[1]) - o + length] for o in range(length - len(r[0]), len(r[1]) + 1)} for r in rows]
    count = collections.Counter((o, s) for x in strings for o, s in x.items())
    got = suffixes.repeated_offsets(rows, prefixes, length)
    for x, spans in zip(strings, got, strict=True):
        assert {o for o, s in x.items() if count[o, s] > 1} == {o for lo, hi in spans for o in range(lo, hi + 1)}


def slow_fingerprint(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.simhash_groups(docs).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts())}
    assert {i: g[0] for i, g in got.items()} == prints
    group = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    assert {i: g[1] for i, g in got.items()} == group
    assert {r["doc_id"] for r in simhash.dedup_simhash(docs).collect()} == set(group.values())


def test_anchor_covering_loses_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (1, 2, 3, 4)]
    points = sorted({int(b) for b in base} | set(near))
    signed = [(p, p - (1 << 64) if p >> 63 else p) for p in points]
    number = {p: i for i, (p, _) in enumerate(signed)}
    links = simhash.near_links(spark.createDataFrame([(i, s) for i, (_, s) in enumerate(signed)], "node bigint, fp bigint"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = list(range(len(points)))
    for _ in range(6):
        for p in points:
            for q in points:
                if (p ^ q).bit_count() <= 3:
                    want[number[p]] = want[number[q]] = min(want[number[p]], want[number[q]])
    assert [got.get(i, i) for i in range(len(points))] == want
    for bad in (-1, 4):
        with pytest.raises(ValueError):
            simhash.near_links(links, bad)


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(1, "a b c d"), (1, "e f g h i"), (None, "a b c d"), (7, "e f g h i"), (9, "something else here")]
    got = collections.Counter((r["id"], r["component"]) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == {(1, 1): 2, (7, 1): 1, (9, 9): 1, (None, None): 1}
    every = spark.createDataFrame([*rows, (None, None), (1, "a b c d"), (9, "something else here")], "doc_id bigint, text string")
    kept = collections.Counter(map(tuple, simhash.dedup_simhash(every).collect()))
    assert kept == {(1, "a b c d"): 1, (9, "something else here"): 1, (None, "a b c d"): 1, (None, None): 1}


@pytest.mark.parametrize("run", [dedup_substrings, suffixes.dedup_suffixes, simhash.simhash_groups, lambda d: packing.pack_documents(d, tokenizer_path())])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("run", [dedup_substrings, suffixes.dedup_suffixes, lambda d: packing.pack_documents(d, tokenizer_path())])
def test_null_and_repeated_ids_keep_their_rows(spark, run):
    rows = [(None, "a b", "x", "y"), (None, None, "x", "y"), (3, "a b", "x", "y"), (3, "a b", "x", "y")]
    assert run(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(docs, tokenizer_path(), capacity=256, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts()):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["length"] for r in mine] == [256] * ((len(ids) - 1) // 256) + [(len(ids) - 1) % 256 + 1]
        assert b"".join(bytes(r["ids"]) for r in mine) == ids.tobytes()
        assert all(r["start"] == 256 * r["piece"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in mine)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("text", ["It's <|endoftext|> A<|ENDOFTEXT|>B", "Ḣ̱ ΑΣ İx", "naïve CAFÉ, l'été", "a\x1cb\x85c\xa0d", "日本語 text", "x" * 3000])
def test_word_tokens_equal_whole_text_tokens(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(pa.array([text]), tokenizer_path())[0].tolist() == [*want, packing.END_ID]


def test_every_character_has_its_ids_among_letters_and_marks():
    """Characters below U+0180 take the short way beside letters; the others, and those that change on the way, don't."""
    from tokenizers import Tokenizer

    frames = ["{}", "A{}b", "{}.", "é{}###", "a.{}", "x'{}", "İ{}"]
    texts = [f.format(chr(c)) for c in [*range(0x250), 0x300, 0x307, 0x3A3, 0x1E9E, 0x212A, 0x3000] for f in frames]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids, bounds = packing.token_ids(pa.array(texts), tokenizer_path())
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], text


def test_words_of_letters_pass_by_normalizer_and_split(monkeypatch):
    """Normalizing and splitting each word took most of the packing's time; words of letters need neither, marks at their end or not."""
    known = packing.WordIds(tokenizer_path())
    whole, given_to_it = known.tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, **how):
            given_to_it.extend(texts)
            return whole.encode_batch_fast(texts, **how)

    known.tokenizer = Watched()
    monkeypatch.setitem(packing._KNOWN, tokenizer_path(), known)
    text = "Straße naïve ÉTÉ, Onorsh,%%% erings### über. 日本"
    assert packing.token_ids(pa.array([text]), tokenizer_path())[0].tolist() == [*whole.encode(text, add_special_tokens=False).ids, packing.END_ID]
    seen = "".join(given_to_it)
    assert "日本" in seen and not any(w in seen for w in ("stra", "na", "onorsh", "erings", "ber"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9) | st.lists(st.integers(5, 15), max_size=9))
def test_dominance_reduction_keeps_the_optimum(lengths):
    """With the fixed sets the fewest sequences are as few as without."""
    capacity = 20

    def fewest(items):
        items, best = sorted(items, reverse=True), len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for room in sorted(set(bins)):
                if items[k] <= room:
                    rest = list(bins)
                    rest.remove(room)
                    place(k + 1, [*rest, room - items[k]])
            place(k + 1, [*bins, capacity - items[k]])

        place(0, [])
        return best

    counts = np.bincount(lengths, minlength=capacity + 1)
    left = counts.copy()
    fixed = packing.reduce_dominated(left, capacity)
    assert all(sum(s) <= capacity for s, _ in fixed)
    used = np.bincount([x for s, t in fixed for _ in range(t) for x in s], minlength=capacity + 1) if fixed else np.zeros(capacity + 1, int)
    assert (used + left == counts).all()
    assert sum(t for _, t in fixed) + fewest([x for x in range(capacity + 1) for _ in range(left[x])]) == fewest(lengths)


def test_suffixes_of_a_text_beyond_one_piece(spark):
    """A text scanned in pieces, with repeats across their borders and an empty text before it."""
    rng = np.random.default_rng(9)
    text = "".join(map(chr, rng.integers(97, 123, 620_000)))
    passage = text[262_000:262_900]  # over the border of the first piece
    text = text[:500_000] + passage + text[500_000:]
    rows = [(1, None), (2, ""), (3, text), (4, "x" + passage[:450])]
    got = {r["doc_id"]: r for r in suffixes.dedup_suffixes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen = collections.Counter(hash(t[i : i + 400]) for _, t in rows if t for i in range(len(t) - 399))
    for i, t in rows:
        t = t or ""
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k : k + 400] = True
        assert got[i]["n_removed"] == gone.sum()
        assert bytes(got[i]["kept_bytes"]).decode() == "".join(np.array(list(t), dtype=str)[~gone]) if t else not got[i]["kept_bytes"]
    assert got[3]["n_removed"] >= 1800


@pytest.mark.parametrize("bits", [60, 62, 12])
def test_windows_of_one_cut_digest_hide_nothing(spark, bits):
    """Digests of 4, 2 and 52 bits: all windows that the text holds twice are found, whatever shares their digest."""
    from attrispark.llm import divergence

    rng = np.random.default_rng(bits)
    texts = [[f"w{int(x)}" for x in rng.integers(0, int(rng.integers(2, 12)), int(rng.integers(4, 120)))] for _ in range(40)] + [["a"] * 400, list("abcabc"), list("abxbcyabx")]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, w array<string>").withColumn("b", F.lit(bits))
    frame = frame.withColumn("k", divergence.window_keys(F.col("w"), F.col("b")))
    for r in frame.select("i", divergence.repeated_places(F.col("k"), F.col("w"), F.col("b")).alias("p")).collect():
        words = texts[r["i"]]
        seen = collections.Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        assert r["p"] == [j for j in range(len(words) - 2) if seen[tuple(words[j : j + 3])] > 1]

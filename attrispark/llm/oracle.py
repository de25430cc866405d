"""DuckDB SQL of the corpus queries, by plain definitions over whole tables."""

from __future__ import annotations

from . import divergence as dv
from . import mixing as mx
from . import source_audit as sa

WORD = r"[^\x20\x09-\x0D]+"

EMBEDDINGS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.a = v.vec_id
"""

SUBSTRINGS = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS r FROM win) WHERE r > 1
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), covered AS (
  SELECT word.doc_id, word.p, word, coalesce(word.p - max(again.p) OVER (PARTITION BY word.doc_id ORDER BY word.p) <= 19, false) AS gone
  FROM word LEFT JOIN again ON again.doc_id = word.doc_id AND again.p = word.p
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM covered GROUP BY 1
)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


#: By digests of all strings of 400 bytes.
SUFFIXES = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, encode(coalesce(text, '')) AS b FROM documents
), win AS (
  SELECT row, p, md5(b[p : p + 399]) AS key FROM (SELECT row, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)
), again AS (
  SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY key) AS n FROM win) WHERE n > 1
), edge AS (
  SELECT row, p, p - coalesce(max(p) OVER (PARTITION BY row ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) > 400 AS opens FROM again
), span AS (
  SELECT row, min(p) AS lo, max(p) + 399 AS hi FROM (SELECT row, p, sum(opens::int) OVER (PARTITION BY row ORDER BY p) AS k FROM edge) GROUP BY row, k
), gap AS (
  SELECT row, lo, hi, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS before FROM span
), cut AS (
  SELECT row, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, max(hi) AS last FROM span GROUP BY 1
), kept AS (
  SELECT gap.row, string_agg(hex(b[before + 1 : lo - 1]), '' ORDER BY lo) AS x FROM gap JOIN d USING (row) WHERE lo - 1 > before GROUP BY 1
)
SELECT doc_id, octet_length(b)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
  sha256(CASE WHEN cut.row IS NULL THEN b ELSE unhex(coalesce(kept.x, '') || CASE WHEN last < octet_length(b) THEN hex(b[last + 1 : octet_length(b)]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN cut USING (row) LEFT JOIN kept USING (row)
"""


def quality_rules() -> str:
    classes = list(dv.CLASSES)
    gone = ["regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')"]
    for c in classes:
        gone.append(f"regexp_replace({gone[-1]}, '{c.replace(chr(39), chr(39) * 2)}+', '', 'g')")
    lengths = ["length(text)", *(f"length({g})" for g in gone)]
    counts = ", ".join([*(f"{a} - {b}" for a, b in zip(lengths, lengths[1:], strict=False)), lengths[-1]])
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS words, [{counts}] AS classes FROM d
), word AS (
  SELECT doc_id, lang, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w
), tri AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS twice FROM (
    SELECT doc_id, p, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY p)
  ) WHERE c IS NOT NULL
), rep AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT word.doc_id, word.p - max(tri.p) FILTER (tri.twice) OVER (PARTITION BY word.doc_id ORDER BY word.p) <= 2 AS covered
    FROM word LEFT JOIN tri ON tri.doc_id = word.doc_id AND tri.p = word.p
  ) WHERE covered GROUP BY 1
), line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY 1
), freq AS (
  SELECT lang, word, count(*) AS n FROM word WHERE length(word) <= {dv.WORD_CHARS} GROUP BY 1, 2
), common AS (
  SELECT lang, word, r FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(word)) AS r FROM freq) WHERE r <= {dv.WORDS}
), hit AS (
  SELECT doc_id, coalesce(r, 0) AS bin, count(*)::double AS n FROM word LEFT JOIN common USING (lang, word) GROUP BY 1, 2
), wdoc AS (
  SELECT doc_id, lang, bin, n / sum(n) OVER (PARTITION BY doc_id) AS p, n FROM hit JOIN d USING (doc_id)
), wref AS (
  SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM wdoc GROUP BY 1, 2
), cdoc AS (
  SELECT doc_id, lang, generate_subscripts(classes, 1) AS bin, unnest(classes)::double AS n FROM w
), chist AS (
  SELECT doc_id, lang, bin, n / nullif(sum(n) OVER (PARTITION BY doc_id), 0) AS p, n FROM cdoc
), cref AS (
  SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cdoc GROUP BY 1, 2
), wdist AS (
  SELECT doc_id, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS dist
  FROM (SELECT d.doc_id, wref.bin, coalesce(wdoc.p, 0) AS p, q FROM d JOIN wref USING (lang) LEFT JOIN wdoc ON wdoc.doc_id = d.doc_id AND wdoc.bin = wref.bin) GROUP BY 1
), cdist AS (
  SELECT doc_id, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS dist
  FROM chist JOIN cref USING (lang, bin) WHERE p IS NOT NULL GROUP BY 1
), base AS (
  SELECT doc_id, len(words)::bigint AS n_words, length({gone[0].replace("text", "w.text")})::bigint AS word_chars,
    length(regexp_replace(w.text, '[^{dv.SYMBOLS}]', '', 'g'))::bigint AS n_symbols, coalesce(line.n, 0)::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words, length(w.text) AS chars
  FROM w LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (chars < {dv.LEAST_CHARS} OR coalesce(cdist.dist <= {dv.MOST_CLASSES}, true)) AND (n_words < {dv.LEAST_WORDS} OR coalesce(wdist.dist <= {dv.MOST_WORDS}, true)) AS kept
FROM judged LEFT JOIN cdist USING (doc_id) LEFT JOIN wdist USING (doc_id)
"""


def source_mixing() -> str:
    """Targets, then the dual's multipliers by recursion over Newton steps, then rounding."""
    size = f"coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint"
    pull = "exp(m.mu * x.c)"
    free = f"z * {pull} < {mx.LIMIT}"
    z = f"""list_reduce(list_transform(cells, lambda x: x.c::double), lambda z, i: z + (target - list_sum(list_transform(cells, lambda x: x.n * least({mx.LIMIT}::double, z * {pull}))))
      / list_sum(list_transform(cells, lambda x: CASE WHEN {free} THEN x.n * {pull} ELSE 0 END)), target / list_sum(list_transform(cells, lambda x: x.n * {pull})))"""
    solved = f"SELECT m.*, s.*, CASE WHEN target > 0 AND target < {mx.LIMIT}::double * source_size THEN {z} END AS z FROM m CROSS JOIN src s"
    rate = f"(CASE WHEN z IS NOT NULL THEN least({mx.LIMIT}::double, z * {pull}) WHEN target > 0 AND source_size > 0 THEN {mx.LIMIT}::double ELSE 0 END)".replace("m.mu", "mu")
    when_free = lambda f: f"coalesce(list_sum(list_transform(cells, lambda x: CASE WHEN {free} THEN {f} ELSE 0 END)), 0)".replace("m.mu", "mu")
    d = "(x.c - mean)"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {size} AS size, md5('mix:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), dc AS (
  SELECT *, length(bin(size)) AS c FROM d
), w AS (
  SELECT *, {[*map(float, mx.WEIGHTS)]}[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mx.WEIGHTS)}]::double AS weight FROM (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source)
), l AS (
  SELECT *, {mx.LIMIT}::double * source_size AS stop, {mx.LIMIT}::double * source_size / weight AS level FROM w
), f AS (
  SELECT *, ({mx.SHARE}::double * sum(source_size) OVER ()
    - coalesce(sum(stop) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS common FROM l
), t AS (
  SELECT source, source_size, CASE WHEN level > common THEN weight * (SELECT arg_min(common, level) FROM f WHERE level > common) ELSE stop END AS target FROM f
), cell AS (
  SELECT source, c, sum(size)::double AS n FROM dc GROUP BY 1, 2
), src AS MATERIALIZED (
  SELECT t.source, source_size, target, cells, (SELECT sum(n * c) / sum(n) FROM cell) AS mean
  FROM t JOIN (SELECT source, list({{'c': c, 'n': n}} ORDER BY c) AS cells FROM cell GROUP BY 1) k ON k.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT 0 AS k, 0::double AS mu, {-mx.TILT}::double AS lo, {mx.TILT}::double AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN move >= lo AND move <= hi THEN move WHEN move < lo AND lo = {-mx.TILT} THEN lo WHEN move > hi AND hi = {mx.TILT} THEN hi ELSE (lo + hi) / 2 END, lo, hi FROM (
    SELECT k, CASE WHEN g > 0 THEN lo ELSE mu END AS lo, CASE WHEN g > 0 THEN mu ELSE hi END AS hi, CASE WHEN h > 0 THEN mu - g / h ELSE mu END AS move FROM (
      SELECT k, mu, lo, hi, sum(coalesce(list_sum(list_transform(cells, lambda x: x.n * {rate} * {d})), 0)) AS g,
        sum(CASE WHEN {when_free(f"x.n * {rate}")} > 0 THEN {when_free(f"x.n * {rate} * {d} * {d}")} - {when_free(f"x.n * {rate} * {d}")} ** 2 / {when_free(f"x.n * {rate}")} ELSE 0 END) AS h
      FROM ({solved} WHERE m.k < {mx.STEPS}) GROUP BY 1, 2, 3, 4
    )
  )
), r AS (
  SELECT source, source_size, target, x.c AS c, x.n::bigint AS cell, {rate} AS rate FROM (
    SELECT mu, source, source_size, target, z, unnest(cells) AS x FROM ({solved} WHERE m.k = (SELECT max(k) FROM m))
  )
), e AS (
  SELECT *, floor(rate)::bigint AS whole, round(sum((rate - floor(rate)) * cell) OVER (PARTITION BY source ORDER BY c)) AS upto FROM r
), p AS (
  SELECT *, (upto - coalesce(lag(upto) OVER (PARTITION BY source ORDER BY c), 0))::bigint AS extra FROM e
), o AS (
  SELECT dc.doc_id, dc.source, dc.size, source_size, target, whole, extra,
    coalesce(sum(dc.size) OVER (PARTITION BY dc.source, dc.c ORDER BY h, dc.doc_id, dc.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dc JOIN p ON dc.source IS NOT DISTINCT FROM p.source AND dc.c = p.c
)
SELECT doc_id, source, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::bigint AS taken FROM o
"""


def source_divergence() -> str:
    """Every source and language by every kept term, then all two sources of a language."""
    share = f"(1 + {sa.WHOLE}::HUGEINT * (n + {sa.ADDED}) // (total + {sa.ADDED}::HUGEINT * terms))::BIGINT"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), term AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM term GROUP BY ALL
), keep AS MATERIALIZED (
  SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {sa.LEAST_DOCS}
), v AS (
  SELECT lang, count(*) AS terms FROM keep GROUP BY 1
), grp AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM d
), own AS MATERIALIZED (
  SELECT g.lang, g.source, keep.term, coalesce(c.n, 0)::BIGINT AS n FROM grp g JOIN keep USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term
), p AS MATERIALIZED (
  SELECT lang, source, term, n, {share} AS p FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM own) JOIN v USING (lang)
), q AS (
  SELECT lang, term, {share} AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM keep) JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), lead AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::int AS rank FROM (FROM pair UNION ALL FROM lead)
)
SELECT * FROM r WHERE part = 'pair' OR rank <= {sa.TOP}
"""


def filter_interaction() -> str:
    """Every order by five lists of the letters, every step by the filters before it."""
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)"
    apart = " AND ".join(f"{a}.x <> {b}.x" for i, a in enumerate("abcde") for b in "abcde"[:i])
    bit = lambda k: f"(1 << (ascii(o[{k}]) - 65))"
    steps = " UNION ALL ".join(f"SELECT o, {k} AS step, {bit(k)} AS bit, {' + '.join(bit(j) for j in range(1, k)) or 0} AS before FROM orders" for k in range(1, 6))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1)::int AS good, bool_or(toxic = 1)::int AS toxic FROM labels GROUP BY 1
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(first < d.doc_id, false)::int AS mask
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM d) d LEFT JOIN l USING (doc_id)
), cell AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e WHERE {apart}
), s AS ({steps}), r AS (
  SELECT part, o, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM s, cell GROUP BY ALL
)
SELECT part, o AS filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley
FROM r
"""

"""DuckDB SQL for the operators' queries that SQL can express, on whole tables by plain definitions."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers

from reelspan.llm.license_scan import TEMPLATES

WORD = r"[^\x20\x09-\x0D]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w
), x AS (SELECT doc_id, unnest(s) AS k FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 90 * (len(sa.s) + len(sb.s) - n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""

TOPK = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


# White space as the public pre-tokeniser's pattern has it.
SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# A private character marks where a run of white space hands its last character to the next match.
MATCH, MARK = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+", "chr(57344)"
CUT = f"""cut AS MATERIALIZED (SELECT k, generate_subscripts(m, 1) AS i, unnest(m) AS w FROM (
  SELECT k, flatten(list_transform(string_split(regexp_replace(t, '([{SPACES}])([{SPACES}][^{SPACES}])', '\\1' || {MARK} || '\\2', 'g'), {MARK}), lambda x: regexp_extract_all(x, {text(MATCH)}))) AS m FROM texts)),
words AS MATERIALIZED (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM cut))"""


def _merged(version: str) -> str:
    """CTEs that merge the bytes of every distinct match (cut, words) by the ranks of a vocabulary: coded_<version>(w, p), tokens as hex."""
    return f"""
ranks_{version} AS MATERIALIZED (
  SELECT hex(from_base64(t)) AS tok, r FROM read_csv('{public_tokenizers.path(version + '.tiktoken')}', delim = ' ', header = false, columns = {{'t': 'VARCHAR', 'r': 'BIGINT'}}, quote = '', escape = '')
), merging_{version} AS (
  SELECT w, CASE WHEN r IS NOT NULL THEN [h] ELSE [h[2 * i - 1 : 2 * i] for i in range(1, length(h) // 2 + 1)] END AS p FROM words LEFT JOIN ranks_{version} ON tok = h
  UNION ALL
  SELECT w, list_concat(list_concat(list_slice(p, 1, z - 1), [p[z] || p[z + 1]]), list_slice(p, z + 2, len(p))) FROM (
    SELECT w, p, arg_min(i, r * 1000000 + i) AS z FROM (SELECT w, p, unnest(range(1, len(p))) AS i FROM merging_{version} WHERE len(p) > 1) JOIN ranks_{version} ON tok = p[i] || p[i + 1] GROUP BY w, p
  )
), coded_{version} AS MATERIALIZED (SELECT w, arg_min(p, len(p)) AS p FROM merging_{version} GROUP BY w)"""


BYTE_BPE = f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), {CUT}, {_merged('byte_bpe_50k')},
ids AS (SELECT k, i, j, r FROM (SELECT k, i, generate_subscripts(p, 1) AS j, unnest(p) AS tok FROM cut JOIN coded_byte_bpe_50k USING (w)) JOIN ranks_byte_bpe_50k USING (tok)),
joined AS (SELECT k, count(*) AS n, string_agg(CAST(r AS VARCHAR), ' ' ORDER BY i, j) AS s FROM ids GROUP BY k)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, sha256(coalesce(s, '')) AS ids_sha256, sha256(t) AS decoded_sha256 FROM texts LEFT JOIN joined USING (k)
"""

_VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
TOKEN_COUNTS = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
state AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
toxic AS (SELECT d.k, regexp_replace(t, '[#*$%&|<>]+', '', 'g') AS t FROM d JOIN state USING (doc_id) WHERE quality = 1 AND toxic = 1),
left_over AS (SELECT d.* FROM d LEFT JOIN state USING (doc_id) WHERE quality IS NULL OR quality <> 0),
texts AS (SELECT k, coalesce(toxic.t, left_over.t) AS t FROM left_over LEFT JOIN toxic USING (k)),
{CUT}, {', '.join(map(_merged, _VERSIONS))},
n AS ({' UNION ALL '.join(f"SELECT k, '{v}' AS tokenizer_version, sum(len(p)) AS n FROM cut JOIN coded_{v} USING (w) GROUP BY k" for v in _VERSIONS)})
SELECT source, lang, v AS tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_tokens
FROM left_over CROSS JOIN (SELECT unnest({list(_VERSIONS)}) AS v) LEFT JOIN n ON n.k = left_over.k AND n.tokenizer_version = v GROUP BY ALL
"""


def _licenses() -> str:
    """Every window of every text against every template, without any retrieval; templates of up to 160 words."""
    parts = []
    for name, notice in TEMPLATES.items():
        words = re.findall("[a-z0-9]+", notice.lower())
        width, scale = min(5, len(words)), next(s for s in (6, 9, 14, 21, 32, 48, 72, 108, 162) if len(words) <= s)
        wanted = sorted({" ".join(words[i : i + width]) for i in range(len(words) - width + 1)})
        held = "[" + ", ".join(map(text, wanted)) + "]"
        size, step = scale + scale // 2, scale // 2
        grams = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
        parts.append(
            f"""SELECT doc_id, '{name}' AS license, k AS start, len(list_intersect(list_distinct(h[k + 1 : k + {size - width + 1}]), {held})) AS shared, {len(wanted)} AS whole
FROM (SELECT doc_id, h, unnest(range(0, len(h), {step})) AS k FROM (SELECT doc_id, [{grams} for i in range(1, len(w) - {width} + 2)] AS h FROM w WHERE len(w) >= {width}))"""
        )
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
found AS ({' UNION ALL '.join(parts)})
SELECT doc_id, license, CAST(max(shared) AS BIGINT) AS shared_shingles, CAST(any_value(whole) AS BIGINT) AS template_shingles, CAST(-max(shared * 1000000000 - start) + max(shared) * 1000000000 AS BIGINT) AS first_word
FROM found WHERE shared * 100 >= whole * 80 GROUP BY doc_id, license
"""


QUALITY = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
again AS (SELECT doc_id, k FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT g.doc_id, g.i, unnest(range(8)) AS j FROM g JOIN again USING (doc_id, k)) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR 10 * n_symbols > word_chars THEN 1 ELSE 0 END) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
corpus AS (SELECT sum(f) / sum(n) AS m, sum(f * (f / n)) / sum(n) AS s2, count(*) / sum(n) AS per_doc FROM hosts),
spread AS (SELECT m, s2 - m * m - m * (1 - m) * per_doc AS v FROM corpus),
prior AS (SELECT m, CASE WHEN v <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, m * (1 - m) / v - 1)) END AS k FROM spread),
verdicts AS (SELECT source, (f + m * k) / (n + k) <= 0.5 AS host_ok FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_ok, true) AS kept FROM b LEFT JOIN verdicts USING (source)
"""



def _framed(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column}, '-')"


# Nodes of hosts' trees and of the tree of roots, run by run; proofs by lists of a run's other digests.
MERKLE = f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || source, '') AS tree, sha256({' || '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
    {' || '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars')))} || {_framed(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")} AS changed FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l
), nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS d FROM ranked
  UNION ALL
  SELECT tree, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 16, n
), subroots AS (
  SELECT tree, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, n, d FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 16, n
), every AS (
  SELECT tree, level, i, n, d FROM nodes UNION ALL SELECT NULL, level, i, n, d FROM tops
), families AS (
  SELECT tree, level, i // 16 AS parent, list(d ORDER BY i) AS ds FROM every WHERE n > 1 GROUP BY ALL
), depth AS (SELECT tree, max(level) AS depth FROM every GROUP BY tree),
below AS (SELECT k, f.level AS lv, (r.i >> (4 * f.level)) % 16 AS place, ds FROM ranked r JOIN families f ON f.tree = r.tree AND f.parent = r.i >> (4 * f.level + 4)),
above AS (
  SELECT k, depth + f.level AS lv, (s.i >> (4 * f.level)) % 16 AS place, ds FROM ranked r JOIN depth USING (tree) JOIN subroots s USING (tree)
  JOIN families f ON f.tree IS NULL AND f.parent = s.i >> (4 * f.level + 4)
), steps AS (
  SELECT k, list({{'a': array_to_string(ds[1 : place], ''), 'b': array_to_string(ds[place + 2 : len(ds)], '')}} ORDER BY lv) AS steps FROM (SELECT * FROM below UNION ALL SELECT * FROM above) GROUP BY k
), folding AS (
  SELECT k, coalesce(steps, []) AS steps, CASE WHEN crc % 5 = 0 THEN sha256(changed) ELSE leaf END AS d, 1 AS lv FROM ranked LEFT JOIN steps USING (k) LEFT JOIN ({{crc}}) c USING (doc_id)
  UNION ALL
  SELECT k, steps, sha256(steps[lv].a || d || steps[lv].b), lv + 1 FROM folding WHERE lv <= len(steps)
), folded AS (SELECT k, arg_max(d, lv) AS folded_root, sha256(array_to_string(list_transform(any_value(steps), lambda x: x.a || x.b), '')) AS proof_sha256 FROM folding GROUP BY k)
SELECT doc_id, leaf, s.d AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM ranked JOIN folded USING (k) JOIN subroots s USING (tree) CROSS JOIN (SELECT d AS root FROM tops WHERE n = 1)
"""
# crc32 of the decimal id: bytes one by one through the table of the reflected polynomial.
CRC = """
WITH RECURSIVE t AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS r FROM range(256) x(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM t WHERE r < 8
), lookup AS (SELECT i, c FROM t WHERE r = 8),
run AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, CAST(4294967295 AS BIGINT) AS c, CAST(1 AS BIGINT) AS lv FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, s, xor(run.c >> 8, lookup.c), lv + 1 FROM run JOIN lookup ON lookup.i = xor(run.c & 255, CAST(ascii(s[lv]) AS BIGINT)) WHERE lv <= length(s)
) SELECT doc_id, xor(arg_max(c, lv), 4294967295) AS crc FROM run GROUP BY doc_id
"""
MERKLE = MERKLE.replace("{crc}", CRC)


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds written out, all distances in each; lists of integers."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, e) - 1 AS c, e FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        square = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min(c) AS c, any_value(d) AS d FROM (SELECT r, c, {square} AS d FROM v, c{n} c) s WHERE true GROUP BY r, d QUALIFY row_number() OVER (PARTITION BY r ORDER BY d) = 1)")
        if n < rounds:
            mean = f"SELECT c, list(CAST(floor(s / m) AS BIGINT) ORDER BY i) AS e FROM (SELECT c, i, sum(x) AS s, count(*) AS m FROM (SELECT c, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM a{n} JOIN v USING (r)) GROUP BY c, i) GROUP BY c"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m.e, c{n}.e) AS e FROM c{n} LEFT JOIN ({mean}) m USING (c))")
    return f"""
WITH {', '.join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = a.c
"""



def _placed(rows: str, by: str, subject: str, pattern: str) -> str:
    """(by, i, h, start) of a pattern's matches in the texts of ``rows``: gaps and matches before each, summed."""
    cut = f"SELECT {by}, regexp_extract_all({subject}, {text(pattern)}) AS m, string_split_regex({subject}, {text(pattern)}) AS g FROM {rows}"
    each = f"SELECT {by}, generate_subscripts(m, 1) AS i, unnest(m) AS h, unnest(g[1 : len(m)]) AS gap FROM ({cut}) WHERE len(m) > 0"
    return f"""SELECT {by}, i, h, CAST(sum(length(gap)) OVER w + coalesce(sum(length(h)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM ({each}) WINDOW w AS (PARTITION BY {by} ORDER BY i)"""


def _personal_data() -> str:
    """The patterns in their plain form; contexts of terms counted over all words of all texts."""
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    luhn = f"list_sum([CASE WHEN i % 2 = 1 THEN x ELSE 2 * x - CASE WHEN x > 4 THEN 9 ELSE 0 END END for x, i in [CAST(c AS INTEGER) for c in string_split(reverse({digits}), '')]]) % 10 = 0"
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "lower(h)", "true"),
        (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "h", "len(list_filter(string_split(h, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0"),
        (r"[0-9](?:[\x20-]?[0-9])+", digits, f"length({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        (r"\+[0-9][\x20().0-9-]+[0-9]", digits, f"length({digits}) BETWEEN 9 AND 15"),
    ]
    spans = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, start, start + length(h) AS stop, '{k}:' || {entity} AS entity FROM ({_placed('d', 'r', 't', pattern)}) WHERE {valid}" for k, (pattern, entity, valid) in enumerate(kinds)
    )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS MATERIALIZED ({spans}),
ordered AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY r) AS k, max(stop) OVER (o ROWS UNBOUNDED PRECEDING) AS so_far FROM spans WINDOW o AS (PARTITION BY r ORDER BY start, stop, entity)),
cuts AS (
  SELECT r, coalesce(lag(so_far) OVER o, 0) AS a, start AS b, lag(entity) OVER o AS before, entity AS after FROM ordered WINDOW o AS (PARTITION BY r ORDER BY i)
  UNION ALL SELECT r, so_far, length(t), entity, NULL FROM ordered JOIN d USING (r) WHERE i = k
  UNION ALL SELECT r, 0, length(t), NULL, NULL FROM d WHERE r NOT IN (SELECT r FROM spans)
), parts AS MATERIALIZED (SELECT row_number() OVER () AS c, r, a, before, after, substring(t, a + 1, b - a) AS s FROM cuts JOIN d USING (r) WHERE a < b),
words AS MATERIALIZED (
  SELECT c, i, h, start, lower(h) AS term, coalesce(lag(h) OVER o, '') AS p, coalesce(lead(h) OVER o, '') AS q, count(*) OVER (PARTITION BY c) AS n
  FROM ({_placed('parts', 'c', 's', "[" + chr(92) + "p{L}" + chr(92) + "p{N}][" + chr(92) + "p{L}" + chr(92) + "p{N}_'-]*")}) WINDOW o AS (PARTITION BY c ORDER BY i)
), near AS (
  SELECT before AS entity, term, p, q FROM words JOIN parts USING (c) WHERE before IS NOT NULL AND i <= 8
  UNION SELECT after, term, p, q FROM words JOIN parts USING (c) WHERE after IS NOT NULL AND i > n - 8
), beside AS (SELECT entity, term, count(*) AS n FROM near GROUP BY ALL),
everywhere AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT term, p, q FROM words) GROUP BY term),
terms AS (SELECT term, b.n AS near, e.n AS n FROM (SELECT term, max(n) AS n FROM beside GROUP BY term) b JOIN everywhere e USING (term) WHERE 2 * b.n > e.n + 1),
every AS (
  SELECT r, kind, start, stop FROM spans
  UNION ALL SELECT r, CASE WHEN 10 * near >= 9 * (terms.n + 1) THEN 4 ELSE 5 END, a + start, a + start + length(h) FROM words JOIN terms USING (term) JOIN parts USING (c)
), named AS (SELECT r, kind, start, ['email', 'ip', 'card', 'phone', 'removed', 'generalised'][kind + 1] || ':' || start || ':' || stop AS x FROM every),
joined AS (
  SELECT r, string_agg(x, ',' ORDER BY kind, start) AS spans, string_agg(x, ',' ORDER BY kind, start) FILTER (kind < 4) AS base, {', '.join(f"count(*) FILTER (kind = {k}) AS n{k}" for k in range(4))} FROM named GROUP BY r
)
SELECT doc_id, {', '.join(f"CAST(coalesce(n{k}, 0) AS BIGINT) AS n_{name}" for k, name in enumerate(('email', 'ip', 'card', 'phone')))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""


ORACLES: dict[str, str] = {
    "op3_ngram_join": NGRAM_JOIN,
    "op4_topk_search": TOPK,
    "op5_token_counts": TOKEN_COUNTS,
    "op6_license_scan": _licenses(),
    "op7_quality_rules": QUALITY,
    "op8_byte_bpe": BYTE_BPE,
    "op11_merkle_manifest": MERKLE,
    "op12_sanitise": _personal_data(),
    "op13_va_clusters": _clusters(),
}

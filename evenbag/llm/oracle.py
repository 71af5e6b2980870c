r"""DuckDB SQL for the operators that SQL can express.

Not here: op2 and op10 need a hash that DuckDB lacks, op3 patterns that look behind, op4
a tokenizer, op5 runs chosen by windowed minima, op9 a trained network. Tests hold each
against a slow version of its own: op2 targets, quotients and words taken; op3 every
document, searched and permuted in plain Python; op4 the tokenizer's own ids, piece by
piece; op5 units cut word by word, and its lines against DuckDB's; op9 scores by a
forward pass word by word, and held-out accuracy; op10 fingerprints bit by bit and all
pairs."""

from __future__ import annotations

from . import pivots, repetition
from .chat import TEMPLATE

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_DIGIT = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
_QUINTET = f"(({_DIGIT.format('CAST(5 * i // 4 + 1 AS INT)')} * 16 + CASE WHEN 5 * i // 4 + 2 > 40 THEN 0 ELSE {_DIGIT.format('CAST(5 * i // 4 + 2 AS INT)')} END) >> CAST(3 - 5 * i % 4 AS INT)) & 31"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS h FROM p),
r AS (SELECT *, MAX(page_id) OVER (PARTITION BY h, n) AS head FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_QUINTET} AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to, TRUE AS verified
FROM r"""


def _repetition() -> str:
    shares, tops = repetition.MAX_NGRAM_SHARE, repetition.MAX_TOP_SHARE
    parts = []
    for k in (*tops, *shares):
        gram = " || ' ' || ".join(["w"] + [f"lead(w, {j}) OVER (PARTITION BY row_id ORDER BY i)" for j in range(1, k)])
        parts.append(f"g{k} AS (SELECT row_id, i, g FROM (SELECT row_id, i, {gram} AS g FROM w) WHERE g IS NOT NULL)")
    for k in tops:
        parts.append(f"c{k} AS (SELECT row_id, MAX(n * chars) AS chars FROM (SELECT row_id, COUNT(*) AS n, length(g) - {k - 1} AS chars FROM g{k} GROUP BY row_id, g) WHERE n >= {repetition.TOP_TIMES} GROUP BY row_id)")
    for k in shares:
        parts.append(f"r{k} AS (SELECT row_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY row_id, g) AS n FROM g{k}) WHERE n > 1)")
        parts.append(f"c{k} AS (SELECT w.row_id, COUNT(*) AS words, SUM(CASE WHEN own THEN length(w) ELSE 0 END) AS chars FROM w JOIN (SELECT DISTINCT row_id, i + j AS i FROM r{k}, range({k}) t(j)) x ON w.row_id = x.row_id AND w.i = x.i GROUP BY w.row_id)")
    joins = " ".join(f"LEFT JOIN c{k} ON c{k}.row_id = d.row_id" for k in (*tops, *shares))
    grams = ", ".join([f"CAST(coalesce(c{k}.chars, 0) AS BIGINT) AS top_{k}gram_chars" for k in tops] + [f"CAST(coalesce(c{k}.chars, 0) AS BIGINT) AS dup_{k}gram_chars" for k in shares])
    over = lambda c, share: f"{c} > CAST({share} AS DOUBLE) * word_chars"
    bad = " OR ".join([f"n_dup_lines >= {repetition.MIN_DUP_LINES} AND {over('dup_line_chars', repetition.MAX_LINE_SHARE)}", *(over(f"top_{k}gram_chars", x) for k, x in tops.items()), *(over(f"dup_{k}gram_chars", x) for k, x in shares.items())])
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
lw AS (SELECT row_id, ln, {_WORDS.replace("text", "line")} AS words, COUNT(*) OVER (PARTITION BY row_id, line) < 2 AS own FROM l),
w AS (SELECT row_id, w, own, row_number() OVER (PARTITION BY row_id ORDER BY ln, j) AS i FROM (SELECT row_id, ln, own, unnest(words) AS w, generate_subscripts(words, 1) AS j FROM lw)),
{", ".join(parts)},
lines AS (SELECT row_id, line, COUNT(*) - 1 AS again, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars FROM l GROUP BY row_id, line),
dl AS (SELECT row_id, SUM(again) AS n, SUM(again * chars) AS chars FROM lines WHERE chars > 0 GROUP BY row_id),
n AS (SELECT row_id, CAST(SUM(len(words)) AS BIGINT) AS n FROM lw GROUP BY row_id),
f AS (SELECT d.doc_id, n.n AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c5.words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dl.chars, 0) AS BIGINT) AS dup_line_chars, {grams}
  FROM d JOIN n ON n.row_id = d.row_id LEFT JOIN dl ON dl.row_id = d.row_id {joins})
SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words) AND NOT ({bad}) AS kept FROM f"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chat() -> str:
    t = TEMPLATE
    extra = "length(x) - length(replace(x, '\\', ''))"
    escaped = lambda x: f"(length({x}) + {extra.replace('x', x)} + " + " + ".join(f"(length({x}) - length(replace({x}, {_quoted(c)}, ''))) // {len(c)}" for c in t.controls()) + ")"
    roles = ", ".join(_quoted(r) for r in t.loss_roles)
    states = "CASE " + " ".join(f"WHEN prev = {_quoted(s)} AND role IN ({', '.join(map(_quoted, r))}) THEN 1" for s, r in t.follows.items()) + " ELSE 0 END"
    frame = len(t.open) + len(t.role_end) + len(t.close)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k,
  coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') AS prev FROM c),
s AS (SELECT *, {states} AS ok FROM o)
SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(SUM(length(text)) FILTER (role IN ({roles})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({roles})), '')) AS loss_sha256,
  CAST(SUM({frame} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars,
  MIN(ok) = 1 AND last(role ORDER BY k) IN ({', '.join(map(_quoted, t.accepts))}) AS valid,
  CASE WHEN MIN(ok) = 0 THEN MIN(k) FILTER (ok = 0) WHEN last(role ORDER BY k) NOT IN ({', '.join(map(_quoted, t.accepts))}) THEN COUNT(*) END AS error_turn
FROM s GROUP BY conv_id"""


PIVOTS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
g AS (SELECT vec_id, label, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {pivots.MIN_COSINE}),
r AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
c AS (SELECT u, MIN(v) AS first FROM r GROUP BY u),
n AS (SELECT u, COUNT(*) AS n FROM p GROUP BY u)
SELECT x.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(x.vec_id, coalesce(c.first, x.vec_id)) AS component_id, x.vec_id = least(x.vec_id, coalesce(c.first, x.vec_id)) AS kept
FROM embeddings x LEFT JOIN n ON n.u = x.vec_id LEFT JOIN c ON c.u = x.vec_id"""

ORACLE_SQL = {"op1_warc_segments": WARC, "op6_repetition": _repetition(), "op7_chat_format": _chat(), "op8_pivot_dedup": PIVOTS}

"""DuckDB SQL of the folds: cues, subtitle texts, wrapped lines, speech windows and prompts, as recursive queries over one row at a time."""

from __future__ import annotations

from reelspan.functions.text import TOKEN
from reelspan.operators import packing, textstats
from reelspan.plans.views import with_views

TOKEN_SQL = TOKEN.replace("'", "''")
LABELS = "'[' || speaker || '] '"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def recursive(body: str, *views: str) -> str:
    return (with_views("", *views).rstrip() + ", " if views else "WITH ").replace("WITH", "WITH RECURSIVE", 1) + body


def wrapped(source: str, keys: str, width: int, lines: int = 1_000_000) -> str:
    """CTEs that wrap ``text`` of ``source`` (keys, text): ``lines_of`` (keys, wrapped); what is over ``lines`` stays on the last."""
    on = " AND ".join(f"f.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    fits = f"f.n + length(p.item) <= {width}"
    return f"""pieces AS (SELECT {keys}, generate_subscripts(m, 1) AS i, unnest(m) AS item FROM (SELECT {keys}, regexp_extract_all(translate(trim(text), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' *[^ ]+') AS m FROM {source})),
folded AS (
  SELECT {keys}, i, item AS out, length(item) AS n, 1 AS line FROM pieces WHERE i = 1
  UNION ALL SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, p.i, CASE WHEN {fits} THEN f.out || p.item WHEN f.line < {lines} THEN f.out || chr(10) || ltrim(p.item) ELSE f.out || ' ' || ltrim(p.item) END,
    CASE WHEN {fits} THEN f.n + length(p.item) ELSE length(ltrim(p.item)) END, CASE WHEN {fits} THEN f.line ELSE f.line + 1 END FROM folded f JOIN pieces p ON {on} AND p.i = f.i + 1
), lines_of AS (SELECT {keys}, arg_max(out, i) AS wrapped FROM folded GROUP BY {keys})"""


WRAP_LINES = f"WITH RECURSIVE {wrapped('conversations', 'conv_id, turn', 42)} SELECT conv_id, turn, coalesce(wrapped, '') AS wrapped FROM conversations LEFT JOIN lines_of USING (conv_id, turn)"


def cue_ctes(density: str) -> str:
    """CTEs from seg_conv to ``cues`` (rec_id, cue_no, st, en, text, speaker); segments of odd turns have words."""
    least, most, gap, chars, _ = packing.DENSITIES[density]
    room = f"CASE WHEN coalesce({{0}}.speaker, '') = '' THEN {chars} ELSE greatest(20, {chars} - length({{0}}.speaker) - 3) END"
    joins = f"o.speaker IS NOT DISTINCT FROM s.speaker AND greatest(0, o.en - o.st) < {least} AND s.st - o.en <= {gap} AND s.en - o.st <= {most} AND length(o.text) + length(s.text) + 1 <= {room.format('o')}"
    return f"""s AS (
  SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY seg_id) AS k, st, en, trim(text) AS text, speaker,
    CASE WHEN seg_id % 2 = 1 THEN list_transform(t, lambda w, i: {{'w': w, 'st': st + 400 * (i - 1), 'en': st + 400 * i}}) ELSE [] END AS words
  FROM (SELECT *, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS t FROM seg_conv WHERE trim(text) <> '')
), o AS (
  SELECT rec_id, k, 1 AS cue, st, en, text, speaker, words FROM s WHERE k = 1
  UNION ALL SELECT s.rec_id, s.k, CASE WHEN {joins} THEN o.cue ELSE o.cue + 1 END, CASE WHEN {joins} THEN o.st ELSE s.st END, s.en, CASE WHEN {joins} THEN o.text || ' ' || s.text ELSE s.text END, s.speaker,
    CASE WHEN {joins} THEN list_concat(o.words, s.words) ELSE s.words END FROM o JOIN s ON s.rec_id = o.rec_id AND s.k = o.k + 1
), joined AS (
  SELECT *, {room.format('j')} AS room, greatest(0, en - st) AS len FROM (SELECT rec_id, cue, arg_max(st, k) AS st, arg_max(en, k) AS en, arg_max(text, k) AS text, arg_max(speaker, k) AS speaker, arg_max(words, k) AS words FROM o GROUP BY rec_id, cue) j
), w AS (SELECT rec_id, cue, room, generate_subscripts(words, 1) AS i, unnest(words) AS x FROM joined WHERE NOT (len <= {most} AND length(text) <= room) AND len(words) > 0),
by_words AS (
  SELECT rec_id, cue, i, 1 AS piece, x.st AS st, length(x.w) + 1 AS n FROM w WHERE i = 1
  UNION ALL SELECT w.rec_id, w.cue, w.i, CASE WHEN w.x.en - b.st > {most} OR b.n + length(w.x.w) + 1 > w.room THEN b.piece + 1 ELSE b.piece END, CASE WHEN w.x.en - b.st > {most} OR b.n + length(w.x.w) + 1 > w.room THEN w.x.st ELSE b.st END,
    CASE WHEN w.x.en - b.st > {most} OR b.n + length(w.x.w) + 1 > w.room THEN 0 ELSE b.n END + length(w.x.w) + 1 FROM by_words b JOIN w ON w.rec_id = b.rec_id AND w.cue = b.cue AND w.i = b.i + 1
), e AS (
  SELECT rec_id, cue, room, len, st, en, len(m) AS total, CASE WHEN len > 0 THEN greatest(1, ({most} * len(m)) // len) ELSE len(m) END AS pace, generate_subscripts(m, 1) AS i, unnest(m) AS w
  FROM (SELECT *, regexp_extract_all(text, '\\S+') AS m FROM joined WHERE NOT (len <= {most} AND length(text) <= room) AND len(words) = 0)
), evenly AS (
  SELECT rec_id, cue, i, 1 AS piece, 1 AS n, length(w) + 1 AS size FROM e WHERE i = 1
  UNION ALL SELECT e.rec_id, e.cue, e.i, CASE WHEN v.size + length(e.w) + 1 > e.room OR v.n >= e.pace THEN v.piece + 1 ELSE v.piece END, CASE WHEN v.size + length(e.w) + 1 > e.room OR v.n >= e.pace THEN 1 ELSE v.n + 1 END,
    CASE WHEN v.size + length(e.w) + 1 > e.room OR v.n >= e.pace THEN 0 ELSE v.size END + length(e.w) + 1 FROM evenly v JOIN e ON e.rec_id = v.rec_id AND e.cue = v.cue AND e.i = v.i + 1
), parts AS (
  SELECT rec_id, cue, 1 AS piece, st, en, text, speaker FROM joined WHERE len <= {most} AND length(text) <= room
  UNION ALL SELECT rec_id, cue, piece, min_by(x.st, i), max_by(x.en, i), string_agg(x.w, ' ' ORDER BY i), any_value(j.speaker) FROM by_words JOIN w USING (rec_id, cue, i) JOIN (SELECT rec_id, cue, speaker FROM joined) j USING (rec_id, cue) GROUP BY rec_id, cue, piece
  UNION ALL SELECT rec_id, cue, piece, min(CASE WHEN i = 1 THEN st ELSE st + (len * (i - 1)) // total END), max(CASE WHEN i >= total THEN en ELSE st + (len * i) // total END), string_agg(w, ' ' ORDER BY i), any_value(j.speaker)
    FROM evenly JOIN e USING (rec_id, cue, i) JOIN (SELECT rec_id, cue, speaker FROM joined) j USING (rec_id, cue) GROUP BY rec_id, cue, piece
), q AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY cue, piece) AS k FROM parts WHERE trim(text) <> ''),
sliver AS (
  SELECT rec_id, k, 1 AS cue_no, st, en, text, speaker FROM q WHERE k = 1
  UNION ALL SELECT q.rec_id, q.k, CASE WHEN m THEN l.cue_no ELSE l.cue_no + 1 END, CASE WHEN m THEN l.st ELSE q.st END, CASE WHEN m THEN greatest(l.en, q.en) ELSE q.en END, CASE WHEN m THEN l.text || ' ' || q.text ELSE q.text END, q.speaker
    FROM (SELECT l.*, q.k AS k2, q.en - q.st < 400 AND q.st - l.en <= 800 AND q.speaker IS NOT DISTINCT FROM l.speaker AS m FROM sliver l JOIN q ON q.rec_id = l.rec_id AND q.k = l.k + 1) l JOIN q ON q.rec_id = l.rec_id AND q.k = l.k2
), cues AS (SELECT rec_id, CAST(cue_no AS INTEGER) AS cue_no, arg_max(st, k) AS st, arg_max(en, k) AS en, arg_max(text, k) AS text, arg_max(speaker, k) AS speaker FROM sliver GROUP BY rec_id, cue_no)"""


def cues(density: str) -> str:
    return recursive(cue_ctes(density) + " SELECT rec_id, cue_no, CAST(st AS BIGINT) AS st, CAST(en AS BIGINT) AS en, text, speaker FROM cues", "seg_conv")


def subtitles(density: str, vtt: bool = False) -> str:
    """Whole SRT or WebVTT texts (rec_id, n_cues, content)."""
    dot, head = (".", "'WEBVTT' || chr(10) || chr(10) || ") if vtt else (",", "")
    time = f"printf('%02d:%02d:%02d{dot}%03d', {{0}} // 3600000, {{0}} // 60000 % 60, {{0}} // 1000 % 60, {{0}} % 1000)"
    block = f"CAST(cue_no AS VARCHAR) || chr(10) || {time.format('st')} || ' --> ' || {time.format('en')} || chr(10) || wrapped || chr(10)"
    shown = f"shown AS (SELECT rec_id, cue_no, CASE WHEN coalesce(speaker, '') <> '' THEN {LABELS} ELSE '' END || text AS text FROM cues)"
    return recursive(
        f"{cue_ctes(density)}, {shown}, {wrapped('shown', 'rec_id, cue_no', packing.LINE, packing.DENSITIES[density][4])} "
        f"SELECT rec_id, CAST(count(*) AS INTEGER) AS n_cues, {head}string_agg({block}, chr(10) ORDER BY cue_no) AS content FROM cues JOIN lines_of USING (rec_id, cue_no) GROUP BY rec_id",
        "seg_conv",
    )


PACK_WINDOWS = recursive(
    """cut AS (SELECT rec_id, a AS st, least(a + 30000, en) AS en FROM (SELECT rec_id, en, unnest(range(st, en, 30000)) AS a FROM merged)),
n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY st, en) AS k FROM cut),
f AS (SELECT rec_id, k, 1 AS win, st, en FROM n WHERE k = 1
  UNION ALL SELECT n.rec_id, n.k, CASE WHEN n.st - f.en < 1000 AND n.en - f.st <= 30000 THEN f.win ELSE f.win + 1 END, CASE WHEN n.st - f.en < 1000 AND n.en - f.st <= 30000 THEN f.st ELSE n.st END, n.en FROM f JOIN n ON n.rec_id = f.rec_id AND n.k = f.k + 1)
SELECT rec_id, CAST(win AS INTEGER) AS win_no, CAST(min(st) AS BIGINT) AS st, CAST(max(en) AS BIGINT) AS en FROM f GROUP BY rec_id, win""",
    "ev", "seg_ev", "merged",
)

# White space as strip() sees it, as far as the driver's texts have any.
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_HEAD, _MIDDLE, _TAIL = textstats.PART_PROMPT.replace("{shape}", textstats.SHAPE).replace("{n}", "{k}").split("{k}")
PROMPT_CTES = f"""texts AS (SELECT doc_id, text FROM documents WHERE {_STRIP.format('text')} <> ''),
c AS (
  SELECT doc_id, text, 0 AS a, 0 AS cut_no, CAST(NULL AS VARCHAR) AS chunk FROM texts
  UNION ALL SELECT doc_id, text, cut, cut_no + 1, CASE WHEN length(text) <= 9000 THEN text ELSE {_STRIP.format('substr(text, a + 1, cut - a)')} END FROM (
    SELECT *, CASE WHEN e < length(text) AND instr(reverse(substr(text, a + 4501, e - a - 4500)), ' .') > 0 THEN e - instr(reverse(substr(text, a + 4501, e - a - 4500)), ' .') ELSE e END AS cut
    FROM (SELECT *, least(length(text), a + 9000) AS e FROM c WHERE a < length(text)))
), chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cut_no) AS chunk_no, count(*) OVER (PARTITION BY doc_id) AS n_chunks, chunk FROM c WHERE cut_no > 0 AND chunk <> ''),
prompts AS (
  SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, n_chunks, CASE WHEN n_chunks = 1 THEN {_quoted(textstats.WHOLE_PROMPT.replace('{shape}', textstats.SHAPE))} || chunk
    ELSE {_quoted(_HEAD)} || chunk_no || {_quoted(_MIDDLE)} || n_chunks || {_quoted(_TAIL)} || chunk END AS prompt FROM chunks
)"""
MAP_PROMPTS = f"WITH RECURSIVE {PROMPT_CTES} SELECT doc_id, chunk_no, n_chunks, prompt FROM prompts"
_ANSWERED = f"{_STRIP.format('right(prompt, 80)')} AS summary, nullif({_STRIP.format('left(prompt, 20)')}, '') AS topic"
SUMMARIES = f"""WITH RECURSIVE {PROMPT_CTES},
merged AS (SELECT doc_id, {_quoted(textstats.MERGE_PROMPT.replace('{shape}', textstats.SHAPE))} || string_agg({_STRIP.format('right(prompt, 80)')}, chr(10) || chr(10) ORDER BY chunk_no) AS prompt FROM prompts WHERE n_chunks > 1 GROUP BY doc_id),
answers AS (SELECT doc_id, {_ANSWERED} FROM prompts WHERE n_chunks = 1 UNION ALL SELECT doc_id, {_ANSWERED} FROM merged)
SELECT doc_id, true AS available, summary, [topic] AS topics, []::VARCHAR[] AS action_items, []::VARCHAR[] AS quotes, CAST(NULL AS VARCHAR) AS reason FROM answers
UNION ALL SELECT doc_id, false, NULL, NULL, NULL, NULL, 'não há transcrição para resumir.' FROM documents WHERE {_STRIP.format("coalesce(text, '')")} = ''
"""

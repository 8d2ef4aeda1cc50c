"""DuckDB SQL for the engine's queries, written against the same tables and independent of the operators."""

from __future__ import annotations

from speechmill.plans.adapters import STATUSES, SYSTEMS, TERMS

NAMES = list(SYSTEMS)
TOKEN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]|[a-z0-9']+".replace("'", "''")


def draw(n: str | int, key: str) -> str:
    """The same draw as the engine's: 32 bits of an MD5, modulo n."""
    return f"(cast('0x' || substring(md5({key}), 1, 8) AS BIGINT) % {n})"


def uniform(key: str) -> str:
    return f"(cast('0x' || substring(md5({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def tokens(text: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({text}), '<[^>]*>', '', 'g'), '{TOKEN}')"


def squash(text: str) -> str:
    return rf"regexp_replace(lower({text}), '[\s\x0B\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')"


def corrupted(system: str, key: str = "id", text: str = "text") -> str:
    drop, swap, twice = SYSTEMS[system]
    r = draw(100, f"'{system}:' || {key} || ':' || (i - 1)")
    return f"""array_to_string(list_filter(list_transform(string_split({text}, ' '), lambda w, i:
      CASE WHEN {r} < {drop} THEN NULL WHEN {r} < {swap} THEN 'xh' || ({r} % 3) WHEN {r} < {twice} THEN w || ' ' || w ELSE w END), lambda x: x IS NOT NULL), ' ')"""


def distance(a: str, b: str) -> str:
    """Distance of two token lists; v is the pair's list of distinct tokens. Each token is one byte."""
    code = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(list_position(v, t)::INTEGER)), '')"
    return f"levenshtein({code(a)}, {code(b)})"


_STATUS = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"

U = f"""raw AS (
  SELECT conv_id, turn, unnest(range(len(p))) AS part, p FROM (
    SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[^.]+'), lambda x: regexp_matches(x, '[^ \\n]')) AS p FROM conversations)
), num AS (
  SELECT conv_id, trim(p[part + 1], ' ' || chr(10)) AS text, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS of
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn, part)
), u AS (
  SELECT conv_id * 100000 + n AS pos, printf('%d-%02d', conv_id, n) AS id, conv_id::VARCHAR AS session, conv_id AS grp, conv_id || '.wav' AS audio, length(text) / 16.0::DOUBLE AS seconds,
    n AS idx, of, n % 3 = 2 AS continues, text, ({_STATUS})[{draw(4, "'status:' || conv_id")} + 1] AS status,
    CASE WHEN {draw(10, "'grade:' || printf('%d-%02d', conv_id, n)")} < 8 THEN 'A' ELSE 'B' END AS grade FROM num
)"""

H = ", h AS (" + " UNION ALL ".join(f"SELECT '{s}' AS system, id, {corrupted(s)} AS hyp FROM u" + (f" WHERE {draw(50, chr(39) + 'lost:' + chr(39) + ' || id')} > 0" if s == "other" else "") for s in SYSTEMS) + ")"
HALL = ", h AS (" + " UNION ALL ".join(f"SELECT '{s}' AS system, id, {corrupted(s)} AS hyp FROM u" for s in SYSTEMS) + ")"
KEPT = ", kept AS (SELECT u.* FROM u WHERE grade = 'A' AND id IN (SELECT id FROM h GROUP BY id HAVING count(DISTINCT system) = 3))"


def _cells(source: str = "kept") -> str:
    return f""", tk AS (SELECT {source}.*, h.system, h.hyp, {tokens(source + '.text')} AS a, {tokens('h.hyp')} AS b FROM {source} JOIN h USING (id)),
 tv AS MATERIALIZED (SELECT *, list_distinct(list_concat(a, b)) AS v FROM tk),
 c AS MATERIALIZED (SELECT * EXCLUDE (a, b, v), {distance('a', 'b')}::BIGINT AS errors, len(a) AS tokens FROM tv)"""


CELLS = f"WITH {U}{H}{KEPT}{_cells()}"
SUBSETS = """, s AS (SELECT *, unnest(list_filter(['all', CASE WHEN status = 'corrected' THEN 'corrected' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'no latin' END], lambda x: x IS NOT NULL)) AS subset FROM c),
 r AS (SELECT subset, system, count(*) AS utterances, sum(tokens)::BIGINT AS tokens, 100.0::DOUBLE * sum(errors) / greatest(sum(tokens), 1) AS rate, count(*) FILTER (errors > 0) AS wrong FROM s GROUP BY ALL)"""

BOOT = f"""{CELLS}, per AS (SELECT grp, system, sum(errors) AS e, sum(tokens) AS t FROM c GROUP BY ALL),
 base AS (SELECT grp, e AS ea, t AS ta, row_number() OVER (ORDER BY grp) - 1 AS g, count(*) OVER () AS n FROM per WHERE system = 'small'),
 d AS (SELECT id // n AS round, {draw('n', "'0:' || id")} AS g FROM (SELECT max(n) AS n FROM base), range(2000 * n) r(id)),
 x AS (SELECT p.system, d.round, 100.0::DOUBLE * sum(p.e) / greatest(sum(p.t), 1) - 100.0::DOUBLE * sum(b.ea) / greatest(sum(b.ta), 1) AS v
   FROM d JOIN base b USING (g) JOIN per p ON p.grp = b.grp AND p.system <> 'small' GROUP BY ALL)
SELECT system, round(list_sort(list(v))[51], 6) AS low, round(list_sort(list(v))[1950], 6) AS high FROM x GROUP BY system"""

LOG = """log AS (
  SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'utterance' WHEN 'click' THEN 'field' WHEN 'purchase' THEN 'refined' WHEN 'error' THEN 'undone' ELSE 'other' END AS type,
    user_id || ':' || strftime(ts, '%Y-%m-%d') AS session, user_id || ':' || strftime(ts, '%Y-%m-%d') || '-' || event_id AS id, event_type AS audio,
    floor(value * 16) / 16.0::DOUBLE AS seconds, json_extract_string(props, '$.k') AS text, floor(value)::BIGINT::VARCHAR AS dictated FROM events
), st AS (
  SELECT session, arg_max({'d': dictated, 'f': text}, seq) FILTER (type = 'field') AS last, count(*) FILTER (type = 'field') AS fields, bool_or(type = 'undone') AS undone
  FROM log WHERE type <> 'refined' GROUP BY session
), ss AS (
  SELECT session, CASE WHEN undone THEN 'undone' WHEN fields = 0 THEN 'unconfirmed' WHEN last.f IS NOT DISTINCT FROM last.d THEN 'accepted' ELSE 'corrected' END AS status,
    CASE WHEN fields > 0 THEN last.d END AS dictated, CASE WHEN fields > 0 THEN last.f END AS field FROM st
)"""

CHAIN = """SELECT id, array_to_string(coalesce(list(id) OVER (PARTITION BY session, island ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), ',') AS joins FROM (
  SELECT *, sum(CASE WHEN continues AND prev = n - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY n) AS island FROM (
    SELECT *, idx AS n, lag(idx) OVER (PARTITION BY session ORDER BY idx) AS prev FROM {rows}))"""

EV = f"""{U}{HALL}, ev AS (
  SELECT *, CASE WHEN {draw(3, "'refined:' || id")} = 0 THEN text END AS refined, CASE WHEN status <> 'unconfirmed' THEN text END AS field FROM u
), hl AS (SELECT id, max(hyp) FILTER (system = 'small') AS h1, list(hyp ORDER BY system) FILTER (system <> 'small') AS hs FROM h GROUP BY id
), op AS (
  SELECT ev.* , h1, hs, list_concat([{tokens('h1')}], list_transform(hs, lambda x: {tokens('x')}),
    CASE WHEN of = 1 AND field IS NOT NULL AND status <> 'undone' THEN [{tokens('field')}] ELSE [] END, CASE WHEN refined IS NOT NULL THEN [{tokens('refined')}] ELSE [] END) AS said
  FROM ev JOIN hl USING (id)
), j AS (
  SELECT op.* EXCLUDE (text, grade), CASE WHEN len(said) >= 2 AND len(said[1]) > 0 AND len(list_distinct(said)) = 1 THEN h1 END AS agreed, text AS written,
    CASE WHEN {draw(10, "'review:' || id")} = 0 THEN (['A', 'B', 'X'])[{draw(3, "'verdict:' || id")} + 1] END AS manual FROM op
), o AS (
  SELECT *, CASE WHEN manual = 'X' THEN 'dropped' WHEN manual IS NOT NULL THEN manual WHEN coalesce(agreed, '') <> '' THEN 'A' ELSE 'unreviewed' END AS outcome,
    CASE WHEN manual IS NOT NULL THEN 'reviewed' WHEN coalesce(agreed, '') <> '' THEN 'agreed' END AS source,
    CASE WHEN manual IS NOT NULL THEN written WHEN coalesce(agreed, '') <> '' THEN agreed END AS text FROM j
)"""

VAR = "v0 AS (" + " UNION ALL ".join(["SELECT item_id * 4 AS pos, text FROM benchmark"] + [f"SELECT item_id * 4 + {k} AS pos, {corrupted(s, 'item_id')} AS text FROM benchmark" for k, s in enumerate(SYSTEMS, 1)]) + f"), vt AS (SELECT pos, {tokens('text')} AS t FROM v0)"
PAIRS = f"""{VAR}, pv AS MATERIALIZED (
  SELECT x.pos AS i, y.pos AS j, x.t AS a, y.t AS b, list_distinct(list_concat(x.t, y.t)) AS v FROM vt x JOIN vt y ON x.pos > y.pos AND greatest(len(x.t), len(y.t)) > 0
), pairs AS (SELECT i, j FROM pv WHERE {distance('a', 'b')} <= 0.3::DOUBLE * greatest(len(a), len(b)))"""

FOLDS = f"""WITH RECURSIVE {U}, g AS (
  SELECT grp, l, row_number() OVER (ORDER BY l DESC, md5('0:' || grp)) AS k FROM (SELECT grp, sum(seconds) AS l FROM u GROUP BY grp)
), f AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS grp, NULL::BIGINT AS fold, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS load
  UNION ALL
  SELECT k, grp, fold - 1, list_transform(load, lambda v, i: CASE WHEN i = fold THEN v + l ELSE v END)
  FROM (SELECT g.k, g.grp, g.l, f.load, list_position(f.load, list_min(f.load)) AS fold FROM f JOIN g ON g.k = f.k + 1)
), fu AS (SELECT u.*, f.fold FROM u JOIN f ON u.grp = f.grp)"""

LABELS = f"""{U}, ul AS (SELECT *, CASE WHEN {draw(10, "'review:' || id")} = 0 THEN 'reviewed' ELSE 'agreed' END AS source, {draw(5, "'fold:' || session")} AS fold FROM u),
 ch AS ({CHAIN.replace('{rows}', 'ul').replace("array_to_string(coalesce(", "coalesce(").replace(", []), ',') AS joins", ", []) AS joins")}),
 lab AS (SELECT ul.*, ch.joins FROM ul JOIN ch USING (id)), sel AS (SELECT * FROM lab WHERE grade = 'A' OR fold = 0)"""


def join_step(acc: str, nxt: str, continued: bool) -> str:
    if continued:
        acc = f"regexp_replace(regexp_replace({acc}, '\\s+$', ''), '[。.]$', '')"
        low = f"CASE WHEN regexp_matches({nxt}, '^\\p{{Lu}}\\p{{Ll}}') AND regexp_matches({acc}, '[0-9A-Za-z]$') THEN lower({nxt}[1]) || {nxt}[2:] ELSE {nxt} END"
    else:
        low = nxt
    return f"{acc} || CASE WHEN regexp_matches({acc}, '[0-9A-Za-z]$') OR (regexp_matches({acc}, '[.,?!]$') AND regexp_matches({low}, '^[0-9A-Za-z]')) THEN ' ' ELSE '' END || {low}"


def joined(parts: str, continued: bool) -> str:
    return f"list_reduce({parts}, lambda acc, nxt: {join_step('acc', 'nxt', continued)})"


def ends(w: str) -> str:
    return f"round({w}[1], 6) AS first, round({w}[-1], 6) AS last, round(list_sum({w}), 6) AS total"


WAVES = "w AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS wave FROM embeddings)"
WIDE = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}，。？！、；：“”‘’（）《》"

FRAMES = f"{WAVES}, f AS (SELECT vec_id, list_transform(range(len(wave) // 4), lambda t: wave[t * 4 + 1 : t * 4 + 4]) AS fr FROM w)"
SPACES = r"[\s\x0B\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def scripted(text: str) -> str:
    """A text with the characters of ``script_rates`` in simplified form."""
    return f"translate({text}, '臺灣說話', '台湾说话')"


ORACLES: dict[str, str] = {
    "normalized_documents": f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^{SPACES}|{SPACES}$', '', 'g'), ' {{2,}}', ' ', 'g')) AS digest FROM documents",
    "script_rates": f"""WITH {U}{HALL}, tk AS (SELECT h.system, {tokens(scripted("replace(u.text, 'th', '臺灣說話')"))} AS a, {tokens("replace(h.hyp, 'th', '台湾说话')")} AS b FROM u JOIN h USING (id)),
      tv AS MATERIALIZED (SELECT *, list_distinct(list_concat(a, b)) AS v FROM tk)
      SELECT system, sum(len(a))::BIGINT AS tokens, sum({distance('a', 'b')})::BIGINT AS errors FROM tv GROUP BY system""",
    "subset_intervals": f"""{CELLS}{SUBSETS}, per AS (SELECT subset, grp, system, sum(errors) AS e, sum(tokens) AS t FROM s GROUP BY ALL),
      base AS (SELECT subset, grp, e AS ea, t AS ta, row_number() OVER (PARTITION BY subset ORDER BY grp) - 1 AS g, count(*) OVER (PARTITION BY subset) AS n FROM per WHERE system = 'small'),
      d AS (SELECT subset, id // n AS round, {draw('n', "'0:' || id")} AS g FROM (SELECT subset, n, unnest(range(2000 * n)) AS id FROM (SELECT DISTINCT subset, n FROM base))),
      x AS (SELECT subset, p.system, d.round, 100.0::DOUBLE * sum(p.e) / greatest(sum(p.t), 1) - 100.0::DOUBLE * sum(b.ea) / greatest(sum(b.ta), 1) AS v
        FROM d JOIN base b USING (subset, g) JOIN per p USING (subset, grp) WHERE p.system <> 'small' GROUP BY ALL)
      SELECT subset, system, round(list_sort(list(v))[51], 6) AS low, round(list_sort(list(v))[1950], 6) AS high FROM x GROUP BY subset, system""",
    "jsonl_round_trip": f"WITH {U} SELECT row_number() OVER (ORDER BY pos) - 1 AS place, id, md5(text) AS digest, CASE WHEN continues THEN grade END AS grade FROM u",
    "map_files": f"WITH {U}{HALL} SELECT 'mine' AS system, id, md5(CASE WHEN continues THEN lower(hyp) ELSE hyp END) AS digest FROM h JOIN u USING (id) WHERE system = 'small'",
    "review_file": f"WITH {U} SELECT id, grade, CASE WHEN grade = 'X' THEN '' ELSE text END AS text FROM (SELECT id, text, (['A', 'B', 'X'])[{draw(3, "'verdict:' || id")} + 1] AS grade FROM u WHERE {draw(10, "'review:' || id")} = 0)",
    "term_file": f"SELECT pos, term FROM (SELECT unnest(range({len(TERMS)})) + 1 AS pos, {squash(f'unnest({list(TERMS)})')} AS term) UNION ALL SELECT {len(TERMS) + 2}, 'mixedcase'",
    "manifest_grades": "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN coalesce(source, doc_id::VARCHAR) ELSE doc_id::VARCHAR END AS \"group\", CASE WHEN doc_id % 5 = 0 THEN coalesce(lang, '-') ELSE '-' END AS grade FROM documents",
    "wave_files": f"WITH {WAVES}, s AS (SELECT vec_id, list_transform(wave, lambda x: greatest(-32768, least(32767, round_even(x * 32768, 0)))::BIGINT) AS s FROM w) SELECT vec_id, len(s)::DOUBLE AS samples, list_sum(s)::BIGINT AS total, list_max(s) AS top, count(*) OVER () AS files FROM s",
    "epoch_batches": f"""WITH RECURSIVE {LABELS}, t AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, seconds, source = 'reviewed' AS hard FROM lab),
      i AS (SELECT 'item' AS kind, pos, id, seconds FROM t UNION ALL SELECT 'repeat', pos, id, seconds FROM t, range(2) WHERE hard),
      n AS (SELECT ep, seconds, floor(seconds * {1000 / 60!r}::DOUBLE)::BIGINT AS frames, row_number() OVER (PARTITION BY ep ORDER BY kind, pos, id) - 1 AS place FROM i, range(1, 4) r(ep) WHERE floor(seconds * {1000 / 60!r}::DOUBLE) > 0),
      q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY frames + {uniform("ep || ':' || place")}, place) AS k FROM n),
      b AS (SELECT ep, 0::BIGINT AS batch, 1::BIGINT AS s, (SELECT max(k) FROM q WHERE q.ep = r.ep AND k <= 24 AND (k = 1 OR frames * k <= 480)) AS e FROM range(1, 4) r(ep)
        UNION ALL SELECT b.ep, b.batch + 1, b.e + 1, (SELECT max(k) FROM q WHERE q.ep = b.ep AND k > b.e AND k <= b.e + 24 AND (k = b.e + 1 OR frames * (k - b.e) <= 480)) FROM b WHERE b.e < (SELECT max(k) FROM q WHERE q.ep = b.ep)),
      c AS (SELECT ep, batch, (ep - 1 + batch / (count(*) OVER (PARTITION BY ep))::DOUBLE) / 3.0::DOUBLE AS p FROM b),
      f AS (SELECT ep, count(*) AS steps, max(batch) AS last, min(x) AS least, max(x) AS most FROM (SELECT *, CASE WHEN p < 0.1::DOUBLE THEN greatest(p / 0.1::DOUBLE, 0.01::DOUBLE) ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (p - 0.1::DOUBLE) / 0.9::DOUBLE))) END AS x FROM c) GROUP BY ep)
      SELECT f.ep::INTEGER AS epoch, count(*) AS items, sum(seconds) AS seconds, any_value(steps) AS steps, any_value(last) AS last, round(any_value(least), 6) AS least, round(any_value(most), 6) AS most FROM f JOIN n ON n.ep = f.ep GROUP BY f.ep""",
    "rich_targets": f"""WITH {WAVES}, f AS (SELECT vec_id, list_transform(range(least(len(wave) // 4, vec_id % 12 + 5)), lambda t: wave[t * 4 + 1 : t * 4 + 4]) AS fr FROM w), p AS (SELECT vec_id, list_transform(fr, lambda x: list_position(x, list_max(x)) - 1) AS path FROM f), t AS (SELECT vec_id, path[1:4] AS rich, path[5:] AS rest FROM p)
      SELECT vec_id, array_to_string(rich, ',') AS rich, array_to_string(list_filter(list_transform(rest, lambda v, i: CASE WHEN v <> 0 AND (i = 1 OR v <> rest[i - 1]) THEN v END), lambda x: x IS NOT NULL), ',') AS text FROM t""",
    "passes_report": f"""WITH {U}{HALL.replace(", h AS (", ", h0 AS (")}, h AS (SELECT system, id, CASE WHEN pos % 11 = 0 THEN text ELSE hyp END AS hyp FROM h0 JOIN u USING (id)){_cells('u')},
      e AS (SELECT list_position({NAMES}, system) AS pass, 'grade ' || grade AS manifest, count(*) AS utterances, sum(tokens)::BIGINT AS tokens, sum(errors)::BIGINT AS errors, count(*) FILTER (errors > 0) AS wrong, 100.0::DOUBLE * sum(errors) / greatest(sum(tokens), 1) AS rate FROM c GROUP BY ALL)
      SELECT pass::INTEGER AS pass, manifest, utterances, tokens, errors, wrong, round(rate, 6) AS rate, round(avg(rate) OVER w, 6) AS mean_rate, rate <= min(rate) OVER w AS best FROM e WINDOW w AS (PARTITION BY manifest ORDER BY pass)""",
    "phrase_texts": """WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark), p AS (SELECT DISTINCT array_to_string(w[1:k], ' ') AS phrase FROM w, range(1, 4) r(k)),
      q AS (SELECT '(' || string_agg(regexp_escape(phrase), '|' ORDER BY length(phrase) DESC, phrase) || ')' AS pattern FROM p WHERE phrase <> '')
      SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(text, pattern, '[\\1]', 'g') AS t FROM documents, q)""",
    "zip_files": "SELECT doc_id // 500 AS archive, 'texts/' || source || '/' || doc_id || '.txt' AS name, octet_length(encode(text)) AS bytes, md5(text) AS digest FROM documents",
    "span_mask": f"WITH {FRAMES}, m AS (SELECT vec_id, flatten(list_transform(fr, lambda x, t: CASE WHEN t - 1 >= vec_id % 7 AND t - 1 < vec_id % 7 + vec_id % 5 THEN [0.0, 0.0, 0.0, 0.0]::DOUBLE[] ELSE x END)) AS f FROM f) SELECT vec_id, {ends('f')} FROM m",
    "piece_texts": f"WITH {FRAMES} SELECT vec_id, trim(replace(array_to_string(list_transform(fr, lambda x: (['▁so', 'und', '▁', 's'])[list_position(x, list_max(x))]), ''), '▁', ' ')) AS text FROM f",
    "trainable_items": f"WITH {U} SELECT id, len({tokens('text')}) > 0 AND floor(seconds * 3) >= len({tokens('text')}) AS usable FROM u",
    "block_choice": """WITH p AS (SELECT vec_id, vec_id % 6 AS kind, vec_id % 50 AS k FROM embeddings),
      q AS (SELECT *, (['encoder.encoders0.0.', 'encoder.encoders.' || k || '.', 'encoder.tp_encoders.' || k || '.', 'ctc.', 'encoder.tp_norm.', 'encoder.after_norm.'])[kind + 1] || vec_id AS name FROM p)
      SELECT name, n::INTEGER AS n FROM q, (VALUES (20), (35)) t(n)
      WHERE (kind = 2 AND k < 20 AND 50 + k >= 70 - n) OR (kind = 1 AND k < 49 AND 1 + k >= 70 - n) OR kind IN (3, 4) OR (kind = 5 AND n > 20)""",
    "score_tokens_profile": f"SELECT lang, count(*) AS documents, sum(len(t))::BIGINT AS tokens, sum(len(list_distinct(t)))::BIGINT AS kinds, max(len(t)) AS longest FROM (SELECT lang, {tokens('text')} AS t FROM documents) GROUP BY lang",
    "squashed_lengths": f"SELECT doc_id, length({squash('text')}) AS n, md5({squash('text')}) AS digest FROM documents",
    "markup_strip": f"SELECT page_id, len({tokens('html')}) AS tokens, md5(array_to_string({tokens('html')}, ' ')) AS digest FROM pages",
    "text_fallback": "SELECT doc_id, md5(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN source END, ''), nullif(text, ''))) AS digest FROM documents",
    "speaker_key": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN page_id::VARCHAR WHEN page_id % 2 = 0 THEN url || '_S' || page_id WHEN page_id % 3 = 0 THEN 'k' || page_id END AS speaker FROM pages",
    "joined_turns": f"WITH {U}, p AS (SELECT session, list(text ORDER BY idx) AS parts FROM u GROUP BY session) SELECT session, len(parts) AS parts, md5({joined('parts', False)}) AS separate, md5({joined('parts', True)}) AS continued FROM p",
    "error_rate_by_subset": f"{CELLS}{SUBSETS} SELECT subset, system, utterances, tokens, round(rate, 6) AS rate, wrong FROM r",
    "error_rate_diff": f"{CELLS}{SUBSETS} SELECT r.subset, r.system, round(r.rate - b.rate, 6) AS difference FROM r JOIN r b ON r.subset = b.subset AND b.system = 'small' WHERE r.system <> 'small'",
    "bootstrap_ci": BOOT,
    "wrong_utterances": f"{CELLS} SELECT id, grade, text, string_agg(system || ': ' || hyp, ' | ' ORDER BY system) AS wrong FROM c WHERE errors > 0 GROUP BY id, grade, text",
    "completeness_report": f"WITH {U}{H}, k AS (SELECT unnest({NAMES}) AS system), m AS (SELECT k.system, u.id, u.pos FROM u, k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.system = k.system AND h.id = u.id)) SELECT system, count(*) AS missing, (SELECT count(*) FROM u) AS total, arg_min(id, pos) AS example FROM m GROUP BY system",
    "common_only": f"WITH {U}{H} SELECT grade, count(*) AS utterances, sum(seconds) AS seconds FROM u WHERE id IN (SELECT id FROM h GROUP BY id HAVING count(DISTINCT system) = 3) GROUP BY grade",
    "no_digits_rate": f"WITH {U}{H}{KEPT}, nd AS (SELECT * FROM kept WHERE len({tokens('text')}) > 0 AND id NOT IN (SELECT id FROM h WHERE regexp_matches(hyp, '\\p{{Nd}}'))){_cells('nd')} SELECT 'all' AS subset, system, count(*) AS utterances, sum(tokens)::BIGINT AS tokens, round(100.0::DOUBLE * sum(errors) / greatest(sum(tokens), 1), 6) AS rate FROM c GROUP BY system",
    "term_hits": f"WITH {U}{H}{KEPT}, t AS (SELECT unnest(range({len(TERMS)})) AS pos, {squash(f'unnest({list(TERMS)})')} AS term), x AS (SELECT t.pos, t.term, kept.id FROM t JOIN kept ON contains({squash('kept.text')}, t.term)), y AS (SELECT x.pos, x.id, "
    + ", ".join(f"max(CASE WHEN h.system = '{s}' AND contains({squash('h.hyp')}, x.term) THEN 1 ELSE 0 END) AS {s}" for s in NAMES)
    + " FROM x JOIN h USING (id) GROUP BY ALL), z AS (SELECT t.pos, t.term, count(y.id) AS said, "
    + ", ".join(f"coalesce(sum({s}), 0)::BIGINT AS {s}" for s in NAMES)
    + " FROM t LEFT JOIN y USING (pos) GROUP BY ALL) SELECT pos, term, said, " + ", ".join(NAMES) + " FROM z UNION ALL SELECT NULL, NULL, sum(said)::BIGINT, " + ", ".join(f"sum({s})::BIGINT" for s in NAMES) + " FROM z",
    "merged_systems": f"WITH {U}{H}, m AS (SELECT h.system, h.id, CASE WHEN h.system = 'large' AND u.continues THEN lower(u.text) ELSE h.hyp END AS hyp FROM h JOIN u USING (id)) SELECT system, count(*) AS n, sum(length(hyp))::BIGINT AS chars, max(hyp) AS last FROM m GROUP BY system",
    "agreement_counts": f"WITH {U}, x AS (SELECT regexp_replace(trim(regexp_replace({corrupted('large')}, ' +', ' ', 'g')), '[。．.，,、；;：:？?！!… ]+$', '') AS a, regexp_replace(text, '[。．.，,、；;：:？?！!… ]+$', '') AS b FROM u WHERE NOT continues) SELECT count(*) FILTER (a = b) AS same, count(*) AS total FROM x",
    "export_identity": f"WITH {U}{H} SELECT count(*) FILTER (a.hyp = b.hyp) AS same, count(*) AS total FROM (SELECT * FROM h WHERE system = 'small') a FULL JOIN (SELECT * FROM h WHERE system = 'other') b USING (id)",
    "session_status": f"WITH {LOG} SELECT session, status, dictated, field FROM ss",
    "session_positions": f"WITH {LOG}, rf AS (SELECT id, arg_max(text, seq) AS refined FROM log WHERE type = 'refined' GROUP BY id) SELECT l.id, session, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS index, count(*) OVER (PARTITION BY session) AS of, l.text AS phone, rf.refined, ss.status, ss.dictated, ss.field FROM log l JOIN ss USING (session) LEFT JOIN rf ON rf.id = l.id WHERE type = 'utterance'",
    "status_counts_minutes": f"WITH {LOG}, x AS (SELECT CASE WHEN seq % 7 = 0 THEN 'audio missing' ELSE status END AS status, CASE WHEN seq % 7 = 0 THEN NULL ELSE seconds END AS seconds FROM log JOIN ss USING (session) WHERE type = 'utterance') SELECT status, count(*) AS utterances, round(coalesce(sum(seconds), 0) / 60, 6) AS minutes FROM x GROUP BY status",
    "continuation_chain": f"WITH {U}, ua AS (SELECT * FROM u WHERE grade = 'A') " + CHAIN.replace("{rows}", "ua"),
    "consensus_grade": f"WITH {EV} SELECT id, outcome, source, text FROM o",
    "label_counts": f"WITH {EV} SELECT k.outcome, count(o.id) AS n FROM (SELECT unnest(['A', 'B', 'dropped', 'unreviewed']) AS outcome) k LEFT JOIN o ON k.outcome = o.outcome GROUP BY k.outcome",
    "review_report": f"""WITH {EV}, b AS (SELECT pos, '## ' || id || '  ' || status || '  ' || seconds || ' s  ' || (idx + 1) || '/' || of || CASE WHEN continues THEN '  continues' ELSE '' END || chr(10)
      || '  ' || rpad('small', 12, ' ') || ' ' || h1 || chr(10) || '  ' || rpad('large', 12, ' ') || ' ' || hs[1] || chr(10) || '  ' || rpad('other', 12, ' ') || ' ' || hs[2] || chr(10)
      || '  ' || rpad('large model', 12, ' ') || ' ' || coalesce(refined, 'None')
      || CASE WHEN field IS NOT NULL THEN chr(10) || '  ' || rpad('dictated', 12, ' ') || ' ' || field || chr(10) || '  ' || rpad('field', 12, ' ') || ' ' || field ELSE '' END AS block FROM o WHERE outcome = 'unreviewed')
      SELECT pos, md5(block) AS digest, length(block) AS n FROM b""",
    "near_duplicate_pairs": f"WITH {PAIRS} SELECT i, j FROM pairs",
    "duplicate_groups": f"WITH RECURSIVE {PAIRS}, e AS (SELECT i AS a, j AS b FROM pairs UNION SELECT x.pos, y.pos FROM vt x JOIN vt y ON x.pos // 8 = y.pos // 8), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT pos AS a, pos AS b FROM vt UNION SELECT reach.a, s.b FROM reach JOIN s ON s.a = reach.b) SELECT a AS pos, min(b) AS \"group\" FROM reach GROUP BY a",
    "balanced_folds": f"{FOLDS} SELECT grp AS \"group\", fold, count(*) AS utterances FROM fu GROUP BY ALL",
    "fold_report": f"{FOLDS} SELECT k.fold, count(fu.id) AS utterances, round(coalesce(sum(seconds), 0) / 60, 6) AS minutes, count(*) FILTER (grade = 'A') AS verified FROM (SELECT unnest(range(5)) AS fold) k LEFT JOIN fu USING (fold) GROUP BY k.fold",
    "leak_check": f"{FOLDS} SELECT count(*) AS leaks FROM (SELECT grp FROM fu GROUP BY grp HAVING count(DISTINCT fold) > 1)",
    "test_dev_split": "SELECT doc_id, CASE WHEN r <= 300 THEN 'test' ELSE 'dev' END AS split, r AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 400",
    "replay_sample": f"SELECT source || '-' || printf('%04d', r - 1) AS id, doc_id AS key, round_even(seconds, 2) AS seconds FROM (SELECT source, doc_id, seconds, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS r FROM (SELECT *, length(text) / 128.0::DOUBLE AS seconds FROM documents) WHERE seconds BETWEEN 1 AND 15 AND len({tokens('text')}) > 0) WHERE r <= 20",
    "held_out_split": f"WITH {LABELS} SELECT split, grade, count(*) AS n, sum(seconds) AS seconds FROM (SELECT *, CASE WHEN fold <> 0 THEN 'train' WHEN grade = 'A' THEN 'held' END AS split FROM sel) WHERE split IS NOT NULL GROUP BY ALL",
    "training_items": f"""WITH {LABELS}, p AS (SELECT pos, id, fold, unnest(list_append(joins, id)) AS part, unnest(range(len(joins) + 1)) AS k, len(joins) AS n FROM sel WHERE len(joins) > 0 AND fold <> 0),
      q AS (SELECT p.pos, n, list(p.part ORDER BY k) AS ids, list(s.text ORDER BY k) AS texts, sum(s.seconds) AS seconds FROM p JOIN sel s ON s.id = p.part GROUP BY ALL HAVING count(*) = n + 1)
      SELECT CASE WHEN fold <> 0 THEN 'train' ELSE 'held' END AS split, pos, id AS ids, text, seconds, source = 'reviewed' AS hard FROM sel WHERE fold <> 0 OR grade = 'A'
      UNION ALL SELECT 'train', pos, array_to_string(ids, ','), {joined('texts', True)}, seconds, false FROM q""",
    "epoch_plan": f"""WITH {LABELS}, t AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, text, seconds, source = 'reviewed' AS hard, count(*) OVER () AS total FROM lab),
      e AS (SELECT 'item' AS kind, pos, id AS ids, text, seconds FROM t UNION ALL SELECT 'repeat', pos, id, text, seconds FROM t, range(2) WHERE hard
        UNION ALL SELECT 'pair', a.pos, a.id || ',' || b.id, {join_step('a.text', 'b.text', False)}, a.seconds + b.seconds FROM (SELECT *, {draw('total', "'0:1:partner:' || pos")} AS other FROM t WHERE {uniform("'0:1:pick:' || pos")} < 0.15::DOUBLE) a JOIN t b ON b.pos = a.other WHERE b.pos <> a.pos AND a.seconds + b.seconds < 20),
      r AS (SELECT 'r' || doc_id AS id, text, length(text) / 16.0::DOUBLE AS seconds, row_number() OVER (ORDER BY md5('0:1:r' || doc_id), 'r' || doc_id) AS k FROM documents)
      SELECT kind, pos, ids, md5(text) AS digest, seconds FROM e UNION ALL SELECT 'replay', NULL, id, md5(text), seconds FROM r WHERE k <= (SELECT round_even(0.1::DOUBLE * count(*), 0) FROM e)""",
    "batch_plan": f"""WITH RECURSIVE {U}, q AS MATERIALIZED (SELECT pos, length, row_number() OVER (ORDER BY length + {uniform("'0:' || pos")}, pos) AS k FROM (SELECT pos, greatest(len(string_split(text, ' ')), 1) AS length FROM u)),
      b AS (SELECT 0::BIGINT AS batch, 1::BIGINT AS s, (SELECT max(k) FROM q WHERE k <= 24 AND (k = 1 OR length * k <= 480)) AS e
        UNION ALL SELECT b.batch + 1, b.e + 1, (SELECT max(k) FROM q WHERE k > b.e AND k <= b.e + 24 AND (k = b.e + 1 OR length * (k - b.e) <= 480)) FROM b WHERE b.e < (SELECT max(k) FROM q))
      SELECT pos, batch, md5('0:batch:0:' || batch) AS turn, length FROM q JOIN b ON k BETWEEN s AND e""",
    "ctc_greedy": f"""WITH {WAVES}, f AS (SELECT vec_id, list_transform(range(len(wave) // 4), lambda t: wave[t * 4 + 1 : t * 4 + 4]) AS fr FROM w), p AS (SELECT vec_id, list_transform(fr, lambda x: list_position(x, list_max(x)) - 1) AS path FROM f), t AS (SELECT vec_id, path[1:4] AS rich, path[5:] AS rest FROM p)
      SELECT vec_id, array_to_string(rich, ',') AS rich, array_to_string(list_filter(list_transform(rest, lambda v, i: CASE WHEN v <> 0 AND (i = 1 OR v <> rest[i - 1]) THEN v END), lambda x: x IS NOT NULL), ',') AS text FROM t""",
    "lfr_stack": f"WITH {WAVES}, s AS (SELECT vec_id, unnest(range((len(wave) // 2 - 7) // 6 + 1)) AS t, wave FROM w), f AS (SELECT vec_id, t, wave[t * 12 + 1 : t * 12 + 14] AS f FROM s) SELECT vec_id, t, len(f) AS n, round(list_sum(f), 6) AS total, round(f[1], 6) AS first, round(f[-1], 6) AS last FROM f",
    "cmvn": f"WITH {WAVES}, f AS (SELECT vec_id, list_transform(wave, lambda x, i: (x + i / 128.0::DOUBLE) * (1 + i / 64.0::DOUBLE)) AS f FROM w) SELECT vec_id, {ends('f')} FROM f",
    "gain_clip": f"WITH {WAVES}, f AS (SELECT vec_id, db, list_transform(wave, lambda x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * pow(10.0::DOUBLE, db / 20.0::DOUBLE)))) AS f FROM w, (SELECT unnest([10, 20, 30])::BIGINT AS db)) SELECT vec_id, db, {ends('f')} FROM f",
    "peak_norm": f"WITH {WAVES}, f AS (SELECT vec_id, peak, list_transform(wave, lambda x: x * (peak / greatest(list_max(list_transform(wave, lambda y: abs(y))), 1e-4::DOUBLE))) AS f FROM w, (SELECT unnest([0.1, 0.3, 0.9])::DOUBLE AS peak)) SELECT vec_id, peak, {ends('f')} FROM f",
    "step_shift": f"WITH {WAVES}, f AS (SELECT vec_id, list_transform(wave, lambda x: x + sign(x) / 32768.0::DOUBLE) AS f FROM w) SELECT vec_id, {ends('f')} FROM f",
    "feature_mask": f"WITH {WAVES}, f AS (SELECT vec_id, list_transform(wave, lambda x, i: CASE WHEN (i - 1) % 8 >= vec_id % 5 AND (i - 1) % 8 < vec_id % 5 + vec_id % 4 THEN 0 ELSE x END) AS f FROM w) SELECT vec_id, {ends('f')} FROM f",
    "lr_schedule": "SELECT i AS id, round(CASE WHEN p < 0.1::DOUBLE THEN greatest(p / 0.1::DOUBLE, 0.01::DOUBLE) ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (p - 0.1::DOUBLE) / 0.9::DOUBLE))) END, 6) AS factor FROM (SELECT i, i / 100.0::DOUBLE AS p FROM range(101) r(i))",
    "weight_mix": f"WITH {WAVES}, f AS (SELECT vec_id::VARCHAR AS name, CASE WHEN vec_id % 4 > 0 THEN list_transform(wave, lambda x: x + 0.6::DOUBLE * (x * 2 + 1 - x)) ELSE wave END AS f FROM w) SELECT name, {ends('f')} FROM f",
    "lora_merge": f"""WITH {WAVES}, c AS (SELECT vec_id AS i, unnest(range(len(wave))) AS j, unnest(wave) AS value FROM w), l AS (SELECT b.i, a.j, sum(b.value * a.value) AS d FROM c b JOIN c a ON b.j = a.i AND b.j < 8 AND a.i < 8 GROUP BY ALL)
      SELECT c.i, round(sum(value + 0.5::DOUBLE * coalesce(d, 0)), 6) AS total, round(max(value + 0.5::DOUBLE * coalesce(d, 0)), 6) AS top FROM c LEFT JOIN l USING (i, j) GROUP BY c.i""",
    "cjk_normalize": "SELECT id::BIGINT AS id, shown FROM (VALUES (0, '你好，世界'), (1, '我们去Wi-Fi吧'), (2, '真的？!'), (3, 'hello world'), (4, '価格：5'), (5, 'a 你'), (6, '好，很好；ok')) t(id, shown)",
}

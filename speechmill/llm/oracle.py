"""DuckDB SQL for the opN_ queries that SQL can express over whole tables."""

from __future__ import annotations

from speechmill.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, WINDOW

WS = r"\x20\x09-\x0D"


def _op5() -> str:
    return rf"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[{WS}]', '', 'g') AS t FROM documents
), g AS (
  SELECT t, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""


def _op2() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    broken = []
    for r in RULES:
        broken += [f"{r.metric} < {r.low}::DOUBLE"] * (r.low is not None) + [f"{r.metric} > {r.high}::DOUBLE"] * (r.high is not None)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{WS}]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{WS}]')) AS lines
  FROM documents
), gram AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM gram) WHERE c > 1
), gap AS (
  SELECT doc_id, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{WINDOW})) AS covers FROM twice
), rep AS (SELECT doc_id, sum(covers) AS n FROM gap GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[{WS}]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_alpha, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE NOT ({' OR '.join(broken)}) END AS kept
FROM b"""


def _op1(length: int = 200) -> str:
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * length}) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {length - 1}, 0))) AS i FROM d)),
twice AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE s IN (SELECT s FROM twice)),
g AS (SELECT doc_id, i, sum(CASE WHEN i - before <= {length} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) + {length} AS b FROM g GROUP BY ALL),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
k AS (
  SELECT d.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""


def _op10(n: int = 4, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{WS}]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {n - 1}, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y WHERE 100 * o >= {percent} * (p.n + q.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
m AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN c USING (doc_id) JOIN m ON m.x = w.doc_id"""


def _op11() -> str:
    """Step by step: of each state the cheapest edits so far as one text of cost and audit, states start, s, u, a."""
    far = "'999999999'"
    plus = lambda x, c, edit: f"CASE WHEN {x} >= {far} THEN {far} ELSE lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {c} AS VARCHAR), 9, '0') || substr({x}, 10) || '{edit}' END"
    late = "CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END"
    # inserts first: closed states are c[1] to c[4]
    closed = f"""[a[1], a[2],
      least(a[3], {plus('a[1]', 2, 'I')}, {plus('a[2]', 2, 'I')}, {plus('a[4]', 2, 'I')}),
      least(a[4], {plus('a[1]', 4, 'II')}, {plus('a[2]', 4, 'II')}, {plus('a[3]', 2, 'I')})]"""
    may = "r.fault NOT IN ('blank', 'duplicate')"
    keep = lambda state, initial: f"CASE WHEN {may} AND r.initial = '{initial}' THEN {plus(state, late, 'K')} ELSE {far} END"
    rerole = lambda state: f"CASE WHEN {may} THEN {plus(state, f'2 + {late}', 'R')} ELSE {far} END"
    drop = lambda state: plus(state, 3, "D")
    step = f"""[{drop('c[1]')}, least({drop('c[2]')}, {keep('c[1]', 's')}),
      least({drop('c[3]')}, {keep('c[1]', 'u')}, {keep('c[2]', 'u')}, {keep('c[4]', 'u')}, {rerole('c[1]')}, {rerole('c[2]')}, {rerole('c[4]')}),
      least({drop('c[4]')}, {keep('c[3]', 'a')}, {rerole('c[3]')})]"""
    told = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    return rf"""
WITH k AS (
  SELECT conv_id, turn, {told('role')} AS role, {told('text')} AS text, {told('conv_id')} || ':' || {told('turn')} AS name FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ord(substr(name, CAST(i AS INTEGER), 1)) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, byte)), 4294967295), 4294967295) % 20 AS damage
  FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h
), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^{WS}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][{WS}]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM p
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list(struct_pack(initial := initial, fault := fault, role := role, text := text) ORDER BY pos) AS rows
  FROM f GROUP BY conv_id
), b AS (
  SELECT *, list_reduce(rows, lambda a, r: list_transform([{closed}], lambda c: {step})[1], ['000000000', {far}, {far}, {far}]) AS a FROM g
), e AS (SELECT *, least(a[1], ({closed})[4]) AS best FROM b),
s AS (
  SELECT *, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit,
    list_reduce(string_split(substr(best, 10), ''), lambda x, edit: struct_pack(
      i := CASE WHEN edit = 'I' THEN x.i ELSE x.i + 1 END,
      state := CASE edit WHEN 'D' THEN x.state WHEN 'K' THEN rows[x.i].initial ELSE CASE WHEN x.state = 'u' THEN 'a' ELSE 'u' END END,
      made := x.made || CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [rows[x.i].role || ':' || rows[x.i].text]
        ELSE [CASE WHEN x.state = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'R' THEN rows[x.i].text ELSE '' END] END),
      struct_pack(i := 1, state := '', made := CAST([] AS VARCHAR[]))) AS x
  FROM e
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(x.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id"""


def _op12() -> str:
    escape = lambda x: rf"replace(replace(replace({x}, '\', '\\'), '#', '\h'), '<', '\l')"
    said = r"'\### Assistant: </turn> ok'"
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}
), f AS (
  SELECT *, '### ' || replace({escape('role')}, chr(10), '\n') || chr(10) || {escape('text')} AS told FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, md5(told))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, md5(told)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(told) + 8)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""


def _op13(seed: int = 7, percent: int = 100, spm_percent: int = 50) -> str:
    h = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (SELECT doc_id, t, u, len(u) AS n, {h} FROM d),
p AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {percent} THEN 'plain' WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM c
), x AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM x"""


ORACLES: dict[str, str] = {"op1_suffix_dedup": _op1(), "op2_quality_rules": _op2(), "op5_exact_dedup": _op5(), "op10_jaccard_join": _op10(), "op11_conversation_repair": _op11(), "op12_chat_forest": _op12(), "op13_fill_in_middle": _op13()}

"""The same queries in SQL, where SQL can say them.

Without a twin are the fingerprints (XXH64), the trained networks and fields, and the
edit-distance search over whole tables; tests hold them against plain versions.
"""

from __future__ import annotations

from hearsay.llm import chat, dialogues, fim, mixing, quality, shards, urls

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quality() -> str:
    n = len(quality.RULES)
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {r.against} THEN -1 WHEN {r.favour} THEN 1 ELSE 0 END"
                      for r in quality.RULES)
    odds = "ln(s / (1 - s)) + " + " + ".join(
        f"ln(g[{j * 3 + 1} + votes[{j + 1}] + 1] / b[{j * 3 + 1} + votes[{j + 1}] + 1])" for j in range(n))
    start = lambda t: "[" + ", ".join(str(x) + "::DOUBLE" for _ in range(n) for x in (t[0], t[2], t[1])) + "]"
    models = [f"m0 AS MATERIALIZED (SELECT {start(quality.START_GOOD)} AS g, {start(quality.START_BAD)} AS b, "
              f"{quality.PRIOR_GOOD}::DOUBLE AS s)"]
    w = f"({quality.PRIOR_WEIGHT} * sum(n))"
    for k in range(quality.ROUNDS):
        rate = lambda part, mass, t: "[" + ", ".join(
            f"(coalesce(sum({part}) FILTER (votes[{j + 1}] = {v}), 0) + {w} * {t[(v + 1) * 2 % 3]}) / ({mass} + {w})"
            for j in range(n) for v in (-1, 0, 1)) + "]"
        models.append(
            f"m{k + 1} AS MATERIALIZED (SELECT {rate('h', 'sum(h)', quality.START_GOOD)} AS g, "
            f"{rate('n - h', '(sum(n) - sum(h))', quality.START_BAD)} AS b, "
            f"(sum(h) + {w} * {quality.PRIOR_GOOD}) / (sum(n) + {w}) AS s FROM (SELECT votes, n::DOUBLE AS n, "
            f"n / (1 + exp(-({odds}))) AS h FROM patterns, m{k}))")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
t AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(0, 3) x(k) WHERE n > 1 GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, array_to_string(w, '') AS j, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_distinct(w)) AS n_distinct,
    len(list_filter(l, lambda x: regexp_matches(x, '[.!?][\x20\x09-\x0D]*$'))) AS n_ended
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, length(j) AS word_chars, length(j) - length(regexp_replace(j, '{quality.SYMBOLS}', '', 'g')) AS n_symbols,
    length(j) - length(regexp_replace(j, '\p{{Lu}}', '', 'g')) AS n_upper,
    length(j) - length(regexp_replace(j, '[!-/:-@\[-`{{-~]', '', 'g')) AS n_marks FROM a),
v AS MATERIALIZED (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [{votes}] AS votes FROM f),
patterns AS MATERIALIZED (SELECT votes, count(*) AS n FROM v GROUP BY votes),
{', '.join(models)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) AS base_failed,
  (NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words)
   AND 1 / (1 + exp(-({odds}))) >= {quality.THRESHOLD}) AS kept
FROM v, m{quality.ROUNDS}"""


def _chat() -> str:
    b, h = chat.BUDGET, chat.HISTORY
    esc = r"replace(replace({}, '\', '\b'), '<', '\l')"
    extra = len(chat.OPEN) + 1 + len(chat.CLOSE)
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
k AS (SELECT *, len(regexp_extract_all('{chat.OPEN}' || replace({esc.format('role')}, chr(10), '\n') || chr(10) || {esc.format('text')}
    || '{chat.CLOSE}', '{chat.TOKEN}')) AS tokens FROM c),
p AS (SELECT *, row_number() OVER o AS seq, sum(tokens) OVER o AS fin,
    length(replace({esc.format('role')}, chr(10), '\n')) + length({esc.format('text')}) + {extra} AS chars
  FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, fin - tokens AS start FROM p),
s AS (SELECT conv_id, min(seq) AS sys_seq, arg_min(tokens, seq) AS sys_tokens, arg_min(fin, seq) AS sys_end,
    arg_min(chars, seq) AS sys_chars FROM q WHERE role = 'system' GROUP BY conv_id),
w AS (SELECT q.*, sys_seq, sys_end, sys_chars, sys_tokens, greatest({chat.LEAST_ROOM}, {b - h} - coalesce(sys_tokens, 0)) AS room
  FROM q LEFT JOIN s ON q.conv_id IS NOT DISTINCT FROM s.conv_id),
x AS (SELECT *, 2 * (start // room) + CASE WHEN (fin - 1) // room > start // room THEN 1 ELSE 0 END AS win FROM w),
sg AS (SELECT conv_id, win, min(start) AS st, sum(tokens) AS own, any_value(sys_seq) AS sys_seq, any_value(sys_end) AS sys_end,
    any_value(sys_chars) AS sys_chars, any_value(sys_tokens) AS sys_tokens FROM x GROUP BY conv_id, win),
sp AS (SELECT *, CASE WHEN sys_end <= st AND sys_tokens + own <= {b} THEN sys_tokens ELSE 0 END AS headed FROM sg),
hist AS (SELECT sp.conv_id, sp.win, q.seq, q.chars FROM sp JOIN q ON q.conv_id = sp.conv_id
  AND q.fin <= sp.st AND sp.st - q.start <= least({h}, {b} - own - headed)),
head AS (SELECT conv_id, win, sys_seq AS seq, sys_chars AS chars FROM sp WHERE headed > 0),
extra AS (SELECT conv_id, sum(chars) AS n FROM (SELECT * FROM hist UNION SELECT * FROM head) GROUP BY conv_id)
SELECT q.conv_id, count(*) AS n_turns,
  sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq), '')) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(q.chars) + coalesce(any_value(extra.n), 0))::BIGINT AS formatted_chars
FROM q LEFT JOIN extra ON q.conv_id = extra.conv_id GROUP BY q.conv_id"""


_CRC_TABLE = (
    "tab AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN (c & 1) = 1 "
    "THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) r(i))")


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes; ``t`` of ``_CRC_TABLE`` has to be in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            "lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)")


def _shards() -> str:
    def tree(t, name):
        rows = [(g, r, s, w) for g, rs in t.items() for r, ss in rs.items() for s, w in ss.items()]
        return f"{name}(region, rack, shard, weight) AS (VALUES {', '.join(f'({g}, {r}, {s}, {w}::DOUBLE)' for g, r, s, w in rows)})"

    def pick(level, name, ids, above, out):
        on = f"{ids}.{above} = k.{above}" if above else "true"
        keys = f"{above}, {level}" if above else level
        return (f"{out} AS MATERIALIZED (SELECT {ids}.id, arg_min(k.{level}, -ln((('0x' || substr(md5({ids}.id || '|{level}|' || k.{level}), 1, 13))::BIGINT::DOUBLE"
                f" + 0.5) / {float(16 ** 13)!r}::DOUBLE) / k.weight) AS {level} FROM {ids} JOIN (SELECT {keys}, sum(weight) AS weight FROM {name} GROUP BY {keys}) k"
                f" ON {on} GROUP BY {ids}.id)")

    small = shards.even_tree(40)
    parts = [tree(small, "tree"), tree(shards.in_new_region(small, 40), "grown"),
             "ids AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS id FROM documents)"]
    for name, n in (("tree", "a"), ("grown", "b")):
        parts += [pick("region", name, "ids", "", f"{n}1"), pick("rack", name, f"{n}1", "region", f"{n}2"),
                  pick("shard", name, f"{n}2", "rack", f"{n}3")]
    return f"""
WITH {', '.join(parts)}, {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, octet_length(encode(coalesce(text, ''))) + {shards.ROW_BYTES} AS size,
  {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, tab)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, a3.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY a3.shard ORDER BY md5(d.id), doc_id, size, text_crc32) - 1 AS slot,
  b3.shard::INTEGER AS grown_shard
FROM d JOIN a3 USING (id) JOIN b3 USING (id)"""


_REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN least USING (s), range(0, 13) r(k) WHERE least < doc_id),
g AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


def _urls() -> str:
    fits = [(r, f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')")
            for r in sorted(urls.HOST_RULES, key=lambda r: (-len(r.name), r.name))]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for r, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for r, c in fits)
    found = " OR ".join(f"regexp_matches(low, '{p.pattern}')" for p in urls.PATTERN_RULES)
    return f"""
WITH u AS (SELECT page_id, translate(url, '{urls.UPPER}', '{urls.LOWER}') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
x AS (SELECT *, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {found} THEN 'block' ELSE 'allow' END AS verdict FROM x"""


def _mixing() -> str:
    w = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
r AS (SELECT *, [{w}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM s),
l AS (SELECT *, ss * {mixing.MOST_EPOCHS}::DOUBLE / weight AS ratio,
    (sum(ss) OVER () - coalesce(sum({mixing.MOST_EPOCHS} * ss) OVER (ORDER BY ss * {mixing.MOST_EPOCHS}::DOUBLE / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY ss * {mixing.MOST_EPOCHS}::DOUBLE / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, ss, least(({mixing.MOST_EPOCHS} * ss)::DOUBLE, coalesce(
    (SELECT level FROM l WHERE level * weight <= {mixing.MOST_EPOCHS} * ss ORDER BY ratio, level LIMIT 1) * weight,
    ({mixing.MOST_EPOCHS} * ss)::DOUBLE)) AS target FROM l),
p AS (SELECT d.*, ss, target, round(target)::BIGINT AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, ss AS source_size, target, CASE WHEN ss = 0 THEN 0 ELSE
  (size * (budget // ss) + greatest(0, least(size, budget % ss - start)))::BIGINT END AS taken FROM p"""


def _fim() -> str:
    h = [f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT" for k in range(4)]
    marks = " OR ".join(f"contains(t, '{m}')" for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    {', '.join(f'{x} AS h{k + 1}' for k, x in enumerate(h))} FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR {marks} OR h3 % 100 >= {fim.PLAIN_FROM} THEN 'plain'
      WHEN h4 % 100 < {fim.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, '{fim.PREFIX}' || substring(t, 1, a) AS pre, '{fim.MIDDLE}' || substring(t, a + 1, b - a) AS mid,
    '{fim.SUFFIX}' || substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN suf || pre || mid ELSE pre || suf || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def _dialogues() -> str:
    d = dialogues
    first_fault = rf"""CASE WHEN NOT regexp_matches(text, '{d.VISIBLE}') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END"""
    # states 1 to 4: nothing, s, u, a read; ``nx`` is the state after the one user or assistant that fits
    insert = "list_transform([1, 2, 3, 4], lambda s: list_min([{b}[s], {{'c': {b}[nx[s]].c + 2, 'a': 'I' || {b}[nx[s]].a}}, " \
             "{{'c': {b}[nx[nx[s]]].c + 4, 'a': 'II' || {b}[nx[nx[s]]].a}}]))"
    none = "{'c': 1000000000::BIGINT, 'a': ''}"
    step = f"""list_transform([1, 2, 3, 4], lambda s: list_min([
      {{'c': v[s].c + {d.DELETE}, 'a': 'D' || v[s].a}},
      CASE WHEN g[i] THEN {none} ELSE {{'c': v[nx[s]].c + {d.REROLE} + x[i], 'a': 'R' || v[nx[s]].a}} END,
      CASE WHEN g[i] THEN {none} WHEN s = 1 AND m[i] = 's' THEN {{'c': v[2].c + x[i], 'a': 'K' || v[2].a}}
        WHEN s <> 3 AND m[i] = 'u' THEN {{'c': v[3].c + x[i], 'a': 'K' || v[3].a}}
        WHEN s = 3 AND m[i] = 'a' THEN {{'c': v[4].c + x[i], 'a': 'K' || v[4].a}} ELSE {none} END]))"""
    end = f"[{{'c': 0::BIGINT, 'a': ''}}, {none}, {none}, {{'c': 0::BIGINT, 'a': ''}}]"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, tab),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '{d.ENDS}', '', 'g') ELSE text END AS text
  FROM k, range(0, 2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
    left(role, 1) AS mark, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS last_mark FROM o),
f AS (SELECT *, {first_fault} AS fault FROM q),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND last_mark || mark NOT IN ('su', 'ua', 'au')) AS illegal,
    list(mark ORDER BY i) AS m, list(fault IN ('blank', 'duplicate') ORDER BY i) AS g,
    list(CASE WHEN fault = 'truncated' THEN {d.TRUNCATED} ELSE 0 END ORDER BY i) AS x,
    list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts, [3, 3, 4, 3] AS nx FROM f GROUP BY conv_id),
dp AS (SELECT *, n AS i, {insert.format(b=end)} AS v FROM c
  UNION ALL SELECT * EXCLUDE (i, v, w), i - 1 AS i, {insert.format(b="w")} AS v
    FROM (SELECT *, {step} AS w FROM dp WHERE i > 0)),
best AS (SELECT *, v[1].c AS cost, v[1].a AS audit FROM dp WHERE i = 0),
letters AS (SELECT conv_id, roles, texts, j, audit[j] AS l, length(replace(audit[:j], 'I', '')) AS row_no,
    length(replace(audit[:j], 'D', '')) - 1 AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM best)),
said AS (SELECT *, max(CASE WHEN place = 0 AND l = 'K' AND left(roles[row_no], 1) = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id) AS lead FROM letters WHERE l <> 'D'),
text AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN roles[row_no] WHEN (place - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN l = 'I' THEN '' ELSE texts[row_no] END, chr(10) ORDER BY j) AS said FROM said GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id
  LEFT JOIN text ON a.conv_id IS NOT DISTINCT FROM text.conv_id"""


TWINS: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op2_chat_windows": _chat(),
    "op4_hash_tree_shards": _shards(),
    "op5_substring_dedup": _REPEATS,
    "op8_url_filters": _urls(),
    "op9_source_mix": _mixing(),
    "op12_fill_in_middle": _fim(),
    "op13_conversation_repair": _dialogues(),
}

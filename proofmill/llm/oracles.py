"""DuckDB SQL of the numbered queries whose results SQL can express.

The others can't be: token ids and counts need the tokenizers' merge tables (op1, op5,
op8), perplexity and toxicity a fitted model (op2, op9), surrogates a keyed
permutation (op7), the placing of shards and sequences a greedy order of its own
(op8, op10), and the neighbours found depend on random directions (op11). They are
tested against brute force or the libraries.
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, key: str, pattern: str) -> str:
    """key, k (from 1), word."""
    found = f"regexp_extract_all({_LOWER.format('text')}, '{pattern}')"
    return f"SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (SELECT {key}, {found} AS ws FROM {table})"


def _following(width: int) -> str:
    return f"OVER (PARTITION BY {{}} ORDER BY k ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)"


_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

JACCARD = f"""WITH RECURSIVE words AS ({_words("documents", "doc_id", _SPACED)}),
runs AS (SELECT doc_id, k, list(word) {_following(5).format("doc_id")} AS five FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(five, ' ') AS s FROM runs WHERE len(five) = 5 OR k = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reached AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reached JOIN links ON a = node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(root) FROM reached WHERE node = d.doc_id) AS component_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id"""

DECONTAMINATION = f"""WITH words AS ({_words("documents", "doc_id", _ALNUM)}),
texts AS (SELECT doc_id, k, list(word) {_following(10).format("doc_id")} AS ten FROM words),
item_words AS ({_words("benchmark", "item_id", _ALNUM)}),
item_runs AS (SELECT item_id, k, list(word) {_following(10).format("item_id")} AS ten FROM item_words),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(ten, ' ') AS w, len(ten) AS n FROM item_runs WHERE len(ten) = 10 OR k = 1),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (SELECT doc_id, k, lengths.n, item FROM texts JOIN lengths ON len(ten) >= lengths.n JOIN windows ON windows.n = lengths.n AND w = array_to_string(ten[1:lengths.n], ' ')),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at_word FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM words WHERE words.doc_id = d.doc_id) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM documents d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

REPEATS = """WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM bytes WHERE length(h) >= 200)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS r FROM starts) WHERE r > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, run, min(p) AS lo, max(p) + 100 AS hi FROM numbered GROUP BY 1, 2),
pieces AS (SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS a, lo AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL SELECT bytes.doc_id, coalesce(max(hi), 0), length(any_value(h)) // 2 FROM bytes LEFT JOIN runs ON runs.doc_id = bytes.doc_id GROUP BY 1),
kept AS (SELECT pieces.doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS h FROM pieces JOIN bytes ON bytes.doc_id = pieces.doc_id GROUP BY 1)
SELECT bytes.doc_id, length(bytes.h) // 2 AS n_bytes, CAST(coalesce((SELECT sum(hi - lo) FROM runs WHERE runs.doc_id = bytes.doc_id), 0) AS BIGINT) AS n_removed,
  (SELECT count(*) FROM runs WHERE runs.doc_id = bytes.doc_id) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM bytes JOIN kept ON kept.doc_id = bytes.doc_id"""



def _plus(x: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}} END"


def _kept_as(initial: str, before: str) -> str:
    return f"CASE WHEN faulty THEN NULL WHEN initial = '{initial}' THEN {_plus(before, 'extra', 'K')} ELSE {_plus(before, 'extra + 1', 'R')} END"


#: c: cost, a: edits so far; z, s, u, a: best with nothing, a system, a user, an assistant row last; iu, ia: after an inserted row, too.
REPAIR = rf"""WITH RECURSIVE powers AS (SELECT list(v ORDER BY i) AS ts FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, ts[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind FROM keyed, powers),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds, (VALUES (1), (2)) AS copies(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS above FROM placed),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM numbered),
costed AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS faulty, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM marked),
figures AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE above IS NOT NULL AND above || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM costed GROUP BY 1),
walk AS (SELECT conv_id, n, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': ''}} AS STRUCT(c BIGINT, a VARCHAR)) AS z, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) AS s, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) AS a FROM figures
  UNION ALL SELECT conv_id, n, i, {_plus("z", "2", "D")}, least({_plus("s", "2", "D")}, CASE WHEN initial = 's' AND NOT faulty THEN {_plus("z", "extra", "K")} END),
    least({_plus("iu", "2", "D")}, {_kept_as("u", "b")}), least({_plus("ia", "2", "D")}, {_kept_as("a", "iu")})
  FROM (SELECT *, least(z, s, ia) AS b FROM (SELECT *, least(a, {_plus("iu", "5", "I")}) AS ia FROM (SELECT w.conv_id, w.n, c.i, z, s, a, least(u, {_plus("z", "5", "I")}, {_plus("s", "5", "I")}, {_plus("a", "5", "I")}) AS iu, initial, faulty, extra
    FROM walk w JOIN costed c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1)))),
ended AS (SELECT conv_id, least(z, a, {_plus("least(u, " + _plus("s", "5", "I") + ")", "5", "I")}) AS x FROM walk WHERE i = n),
edits AS (SELECT conv_id, e, p, p - count(*) FILTER (WHERE e = 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS k
  FROM (SELECT conv_id, unnest(string_split(x.a, '')) AS e, generate_subscripts(string_split(x.a, ''), 1) AS p FROM ended)),
kept AS (SELECT e.conv_id, p, k, e, role, initial, CASE WHEN e = 'I' THEN '' ELSE text END AS text FROM edits e LEFT JOIN costed c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.i = e.i AND e <> 'I' WHERE e <> 'D'),
shifts AS (SELECT conv_id, count(*) FILTER (WHERE k = 1 AND e = 'K' AND initial = 's') AS shift FROM kept GROUP BY 1),
hashed AS (SELECT kept.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS sha FROM kept JOIN shifts ON shifts.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""

MIDDLE = r"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(us) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(us) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(us) + 1) AS y, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS side FROM cut),
parts AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN side < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(us[1:least(x, y)], '') AS p, array_to_string(us[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(us[greatest(x, y) + 1:n], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""

SQL = {"op3_jaccard_join": JACCARD, "op4_decontaminate": DECONTAMINATION, "op6_repeats": REPEATS, "op12_conversation_repair": REPAIR, "op13_fill_in_middle": MIDDLE}

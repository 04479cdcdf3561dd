"""SQL that checks the registered queries of those operators that it can express."""

from __future__ import annotations

from tastemark.llm import secrets, urls


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Places of matches from running sums over the lengths of the matches and of the gaps before them."""
    per_rule = []
    for i, r in enumerate(secrets.RULES):
        p = _quoted(r.pattern)
        per_rule.append(f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, list_zip(regexp_extract_all(text, {p}), string_split_regex(text, {p})) AS ps FROM d WHERE regexp_matches(text, {p})")
    long_enough = " ".join(f"WHEN {i} THEN length(regexp_extract(p[1], {_quoted(r.pattern)}, {r.group})) >= {r.least}" for i, r in enumerate(secrets.RULES))
    counts = ", ".join(f"count(s.rid) FILTER (s.kind = '{k}') AS n_{k}" for k in secrets.BASE)
    joined = "string_agg(s.kind || ':' || s.start || ':' || s.stop, ',' ORDER BY s.start, s.rank)"
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lists AS ({" UNION ALL ".join(per_rule)}),
m AS (SELECT rid, rank, kind, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM lists),
placed AS (SELECT *, CAST(sum(coalesce(length(p[1]), 0) + length(p[2])) OVER (PARTITION BY rid, rank ORDER BY j) AS BIGINT) AS stop FROM m),
s AS (SELECT rid, rank, kind, stop - length(p[1]) AS start, stop FROM placed WHERE p[1] IS NOT NULL AND CASE rank {long_enough} END)
SELECT d.doc_id, {counts}, sha256(coalesce({joined} FILTER (s.kind IN ({base})), '')) AS base_sha256, coalesce({joined}, '') AS spans
FROM d LEFT JOIN s ON d.rid = s.rid GROUP BY d.rid, d.doc_id"""


def url_templates(depth: int = 6, least_pages: int = 3, z: float = 1.96, strength: float = 4.0, base: float = 0.2, reject_at: float = 0.5) -> str:
    """The template tree level by level, each level two grouped statements, for paths of at most ``depth`` segments; a level
    without a branch of enough pages leaves ``**`` for the rest."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(urls.RULES, key=lambda r: (len(r.where), r.where), reverse=True)
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.where}'" for r in longest)
    said = " ".join(f"WHEN '{r.where}' THEN '{r.verdict}'" for r in longest)
    stem = "regexp_replace(s, '\\.[A-Za-z]{2,5}$', '')"
    fixed = f"regexp_full_match({stem}, '[0-9][0-9._-]*|[0-9a-fA-F-]{{16,}}') OR (regexp_full_match({stem}, '[A-Za-z0-9_-]{{20,}}') AND regexp_matches({stem}, '[0-9]'))"
    levels = []
    for n in range(1, depth + 1):
        levels.append(f"""b{n} AS (SELECT host, template, shape[{n}] AS seg, sum(pages) AS pages, sum(labelled) AS labelled, sum(blocked) AS blocked FROM t{n - 1} WHERE len(shape) >= {n} GROUP BY ALL),
a{n} AS (SELECT host, template, sum(labelled) AS al, sum(blocked) AS ab FROM b{n} WHERE labelled > 0 GROUP BY ALL),
w{n} AS (SELECT count(*) > 0 AND {f"(SELECT any_value(more) FROM w{n - 1})" if n > 1 else "true"} AS more FROM (SELECT 1 FROM b{n} GROUP BY host, template HAVING sum(pages) >= {least_pages})),
n{n} AS (SELECT host, template, seg, CASE WHEN seg = '*' THEN '*' WHEN pages < {least_pages} THEN '*'
  WHEN labelled > 0 AND al - labelled > 0 AND abs(blocked / labelled - (ab - blocked) / (al - labelled)) <= CAST({z} AS DOUBLE) * sqrt(ab / al * (1 - ab / al) * (1 / labelled + 1 / (al - labelled))) THEN '~' ELSE seg END AS name
  FROM b{n} LEFT JOIN a{n} USING (host, template)),
t{n} AS (SELECT host, shape, pages, labelled, blocked, CASE WHEN name IS NULL OR ends_with(template, '/**') THEN template WHEN (SELECT more FROM w{n}) THEN template || '/' || name ELSE template || '/**' END AS template
  FROM (SELECT *, shape[{n}] AS seg FROM t{n - 1}) LEFT JOIN n{n} USING (host, template, seg))""")
    return f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
parts AS (SELECT *, CASE {rule} END AS rule, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM p),
r AS (SELECT page_id, host, path, rule, CASE rule {said} END AS said,
  list_transform(segs, lambda s: CASE WHEN {fixed} THEN '*' ELSE s END) AS shape FROM parts),
t0 AS (SELECT host, shape, count(*) AS pages, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked, '' AS template FROM r GROUP BY host, shape),
{", ".join(levels)},
q AS (SELECT host, template, (sum(blocked) + CAST({strength * base} AS DOUBLE)) / (sum(labelled) + CAST({strength} AS DOUBLE)) AS purity FROM t{depth} GROUP BY host, template)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN purity >= {reject_at} THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity
FROM r JOIN t{depth} t ON r.host = t.host AND r.shape = t.shape JOIN q ON t.host = q.host AND t.template = q.template"""


def benchmark_windows(window: int = 10) -> str:
    """Whole windows meet on their text; items shorter than a window meet on their first word, then as a prefix."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    ahead = f"string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
dw AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
dk AS (SELECT rid, i, n, w, {ahead} AS k FROM dw),
items AS (SELECT row_number() OVER () AS rid, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words} AS ws FROM benchmark),
iw AS (SELECT rid, item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM items),
ik AS (SELECT item_id, i, n, w, {ahead} AS k FROM iw),
whole AS (SELECT DISTINCT item_id, k FROM ik WHERE i <= n - {window - 1}),
short AS (SELECT DISTINCT item_id, k, w, n FROM ik WHERE n < {window} AND i = 1),
hit AS (SELECT rid, i, {window} AS size, item_id FROM dk JOIN whole ON dk.k = whole.k WHERE i <= dk.n - {window - 1}
  UNION ALL SELECT rid, i, short.n AS size, item_id FROM dk JOIN short ON dk.w = short.w AND starts_with(dk.k || ' ', short.k || ' ')),
covered AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""


def warc_records() -> str:
    """Base32 from the hexadecimal digest: five hexadecimal digits are four letters."""
    letters = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((v >> {s}) & 31 AS INT) + 1]" for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
codes AS (SELECT h, string_agg({letters}, '' ORDER BY i) AS payload_digest
  FROM (SELECT h, i, CAST('0x' || substr(h, 5 * i + 1, 5) AS INT) AS v FROM (SELECT DISTINCT h FROM p), (SELECT CAST(range AS INT) AS i FROM range(8))) GROUP BY h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN low IS NULL OR page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN low IS NULL OR page_id = low THEN NULL ELSE low END AS refers_to, true AS valid FROM f JOIN codes USING (h)"""


def hard_negatives(positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    """Every anchor against every row; products of whole numbers are exact as doubles."""
    return f"""WITH kept AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.id, r.id AS other, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM kept a JOIN kept r ON a.id <> r.id WHERE a.id % 100 = 0),
pos AS (SELECT id, other AS positive, score AS ps FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= {positives})
SELECT id AS anchor_id, positive AS positive_id, row_number() OVER w AS rank, other AS negative_id, ps AS positive_score, score AS negative_score
FROM pos JOIN scored USING (id) WHERE NOT same AND {low} * ps <= 100 * score AND 100 * score <= {high} * ps
WINDOW w AS (PARTITION BY id, positive ORDER BY score DESC, other) QUALIFY row_number() OVER w <= {negatives}"""


def conversation_repair() -> str:
    """The programme row by row, as a recursion; a state is its cost, ten digits wide, followed by its audit, so the least text is the cheapest."""
    add = lambda state, cost, letter: f"(lpad(CAST(CAST(left({state}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({state}, 11) || '{letter}')"
    keep, other = "CASE WHEN i = '{}' THEN extra END", "extra + 1"
    step = {
        "n0": add("s0", 2, "D"),
        "n1": f"least({add('s1', 2, 'D')}, {add('s0', keep.format('s'), 'K')})",
        "n2": f"least({add('s2', 2, 'D')}, {', '.join(add(s, keep.format('u'), 'K') + ', ' + add(s, other, 'R') for s in ('s0', 's1', 's3'))})",
        "n3": f"least({add('s3', 2, 'D')}, {add('s2', keep.format('a'), 'K')}, {add('s2', other, 'R')})",
    }
    to2 = f"least(n2, {', '.join(add(s, 5, 'I') for s in ('n0', 'n1', 'n3'))})"
    return f"""WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM (SELECT range AS i FROM range(256))),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT b.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) % 20 AS pick FROM b, crc),
d AS (SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role, CASE pick WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN pick = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE pick <> 0),
o AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
l AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
  CASE WHEN ended = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
e AS (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 END AS extra FROM l),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, '0000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '0000000005I' AS s2, '0000000010II' AS s3 FROM (SELECT DISTINCT conv_id FROM e)
  UNION ALL SELECT conv_id, pos, n0, n1, n2b, least(n3, {add("n2b", 5, "I")}) FROM (SELECT *, {to2} AS n2b
    FROM (SELECT f.conv_id, e.pos, {", ".join(f"{v} AS {k}" for k, v in step.items())} FROM f JOIN e ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND e.pos = f.pos + 1))),
best AS (SELECT conv_id, least(s0, s3) AS s FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
x AS (SELECT conv_id, unnest(string_split(substr(s, 11), '')) AS edit, generate_subscripts(string_split(substr(s, 11), ''), 1) AS j FROM best),
y AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w AS n, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS total FROM x WHERE edit <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
r AS (SELECT y.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n + total) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM y LEFT JOIN e ON y.conv_id IS NOT DISTINCT FROM e.conv_id AND y.pos = e.pos WHERE edit <> 'D' GROUP BY y.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pos > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(s, 10) AS BIGINT), 0) AS cost, coalesce(substr(s, 11), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id"""


ORACLES = {"op4_secret_ledger": secret_scan(), "op6_path_templates": url_templates(), "op7_suffix_arrays": benchmark_windows(), "op9_warc_zstd": warc_records(), "op11_cover_tree_negatives": hard_negatives(), "op13_grammar_repair": conversation_repair()}

"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

from siftwell.llm.centroids import DIM, LIMIT, Clustering
from siftwell.llm.decontaminate import Winnowing
from siftwell.llm.mixing import Curriculum
from siftwell.llm.quality import CLASSES, COMMON, VOCABULARY, Limits

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


def quality_sql(limits: Limits = Limits()) -> str:
    left = ["t"]
    for pattern in CLASSES:
        left.append(f"regexp_replace({left[-1]}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')")
    counts = [f"length({a}) - length({b})" for a, b in zip(left, left[1:], strict=False)] + [f"length({left[-1]})"]
    vocabulary = ", ".join(f"('{w}')" for w in VOCABULARY)
    languages = ", ".join(f"'{x}'" for x in COMMON)

    def distance(kind: str) -> str:
        return f"""
  {kind}_d AS (
    SELECT rid, sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) / (2 * ln(2.0))) AS d
    FROM (SELECT h.rid, h.c / sum(h.c) OVER (PARTITION BY h.rid) AS p, r.c / sum(r.c) OVER (PARTITION BY h.rid) AS q, sum(h.c) OVER (PARTITION BY h.rid) AS own, sum(r.c) OVER (PARTITION BY h.rid) AS ref
          FROM {kind} h JOIN docs USING (rid) JOIN {kind}_ref r ON r.lang = docs.lang AND r.k = h.k)
    WHERE own > 0 AND ref > 0 GROUP BY rid)"""

    def reference(kind: str) -> str:
        return f"{kind}_ref AS (SELECT lang, k, sum(c) AS c FROM {kind} JOIN docs USING (rid) WHERE NOT base_failed AND lang IN ({languages}) GROUP BY lang, k)"

    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
  worded AS (SELECT *, {WORDS} AS ws FROM base),
  windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded)),
  covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1) GROUP BY rid),
  lines AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM base) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
  counted AS (
    SELECT rid, doc_id, lang, t, ws, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM worded LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
  docs AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed FROM counted),
  chars AS (SELECT rid, unnest([{", ".join(counts)}]) AS c, unnest(range({len(counts)})) AS k FROM docs),
  vocabulary(k) AS (VALUES {vocabulary}),
  spoken AS (SELECT rid, lower(w) AS k, count(*) AS c FROM (SELECT rid, unnest(ws) AS w FROM docs) GROUP BY ALL),
  listed AS (SELECT rid, vocabulary.k, coalesce(spoken.c, 0) AS c FROM docs CROSS JOIN vocabulary LEFT JOIN spoken USING (rid, k)),
  common AS (SELECT rid, k, c FROM listed UNION ALL SELECT rid, '', any_value(n_words) - sum(c) FROM listed JOIN docs USING (rid) GROUP BY rid),
  {reference("chars")}, {reference("common")}, {distance("chars")}, {distance("common")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (length(t) >= {limits.char_guard} AND coalesce(chars_d.d, 0) > {limits.char_distance})
    AND NOT (n_words >= {limits.word_guard} AND coalesce(common_d.d, 0) > {limits.word_distance}) AS kept
FROM docs LEFT JOIN chars_d USING (rid) LEFT JOIN common_d USING (rid)"""


def mix_sql(plan: Curriculum = Curriculum()) -> str:
    def time(share: str, kind: int) -> str:
        knots, done, parts = plan.schedules[kind], [0.0], []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            done.append(done[-1] + (w0 + w1) / 2 * (t1 - t0))
        given = f"({share} * {done[-1]}::DOUBLE)"
        for i, ((t0, w0), (t1, w1)) in enumerate(zip(knots, knots[1:], strict=False)):
            slope, part = (w1 - w0) / (t1 - t0), f"({given} - {done[i]}::DOUBLE)"
            value = f"{t0}::DOUBLE + (sqrt(greatest(0.0::DOUBLE, {w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {part})) - {w0}::DOUBLE) / {slope}::DOUBLE" if slope else f"{t0}::DOUBLE + {part} / {w0}::DOUBLE"
            parts.append(f"WHEN {given} < {done[i + 1]}::DOUBLE THEN {value}" if i < len(knots) - 2 else f"ELSE {value}")
        return f"CASE {' '.join(parts)} END" if len(parts) > 1 else parts[0].removeprefix("ELSE ")

    shares = "+".join(f"least(greatest(goal - before - {e} * source_size, 0), size)" for e in range(plan.cap))
    kinds = " ".join(f"WHEN {k} THEN {time('(before::DOUBLE / goal)', k)}" for k in range(len(plan.schedules)))
    return f"""
WITH sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len({WORDS.replace("(t,", "(text,")}) END AS size FROM documents),
  sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
  weighed AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(plan.weights)} AS kind FROM sums),
  weighted AS (SELECT *, [{", ".join(map(str, plan.weights))}][kind + 1] AS weight FROM weighed),
  levels AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, (sum(weight) OVER ())::DOUBLE AS weights,
      coalesce(sum(source_size * {plan.cap}) OVER earlier, 0)::DOUBLE AS room, coalesce(sum(weight) OVER earlier, 0)::DOUBLE AS used FROM weighted
    WINDOW earlier AS (ORDER BY source_size * {plan.cap} / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  targets AS (SELECT source, source_size, kind, least((source_size * {plan.cap})::DOUBLE, max((total - room) / (weights - used)) OVER () * weight) AS target FROM levels),
  placed AS (SELECT sized.doc_id, size, source_size, target, kind, floor(target)::BIGINT AS goal,
      coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
  drawn AS (SELECT *, ({shares})::BIGINT AS taken FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken, CASE WHEN size > 0 THEN floor(taken::DOUBLE / size + 0.5) ELSE 0 END::BIGINT AS copies,
  CASE WHEN taken > 0 THEN round(CASE kind {kinds} END, 9) END AS first_position
FROM drawn"""


def cluster_sql(plan: Clustering = Clustering()) -> str:
    """One pair of CTEs per round, plain squared distances."""
    square = "+".join(f"(v[{i + 1}]-p[{i + 1}])*(v[{i + 1}]-p[{i + 1}])" for i in range(DIM))
    near = "(SELECT rid, min(struct_pack(d := d, c := c)) AS m FROM (SELECT rid, c, {d} AS d FROM vectors CROSS JOIN {p}) GROUP BY rid)"
    rounds = []
    for i in range(plan.rounds):
        rounds.append(f"""
  sums{i} AS MATERIALIZED (SELECT c, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY i) AS q FROM (
      SELECT m.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM {near.format(d=square, p=f"points{i}")} JOIN cells USING (rid) GROUP BY ALL) GROUP BY c),
  points{i + 1} AS MATERIALIZED (SELECT c, coalesce(q, p) AS p FROM points{i} LEFT JOIN sums{i} USING (c))""")
    last = f"points{plan.rounds}"
    return f"""
WITH given AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  vectors AS MATERIALIZED (SELECT rid, vec_id, list_transform(e, lambda x: floor({plan.scale} * x)::BIGINT) AS v FROM given
    WHERE len(e) = {DIM} AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {LIMIT / plan.scale})) = {DIM}),
  cells AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range({DIM})) AS i FROM vectors),
  points0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY name, v) - 1 AS c, v AS p FROM (SELECT sha256('{plan.seed}:' || vec_id) AS name, v FROM vectors ORDER BY name, v LIMIT {plan.centroids})),
  {",".join(rounds)},
  found AS MATERIALIZED (SELECT rid, m.c AS c, m.d AS d FROM {near.format(d=square, p=last)})
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(p, ',')) AS centroid_sha256
FROM found JOIN vectors USING (rid) JOIN {last} USING (c)"""


def winnowing_sql(plan: Winnowing = Winnowing()) -> str:
    """Windows as strings, joined as they are."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS ws FROM benchmark),
  sized AS (SELECT item, ws, least(len(ws), {plan.length}) AS m FROM items WHERE len(ws) > 0),
  windows AS (SELECT DISTINCT item, m, array_to_string(ws[i + 1:i + m], ' ') AS k FROM (SELECT *, unnest(range(len(ws) - m + 1)) AS i FROM sized)),
  docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
  lengths AS (SELECT DISTINCT m FROM windows),
  spans AS (SELECT rid, m, i, array_to_string(ws[i + 1:i + m], ' ') AS k FROM (SELECT rid, ws, m, unnest(range(len(ws) - m + 1)) AS i FROM docs JOIN lengths ON len(ws) >= m)),
  hits AS (SELECT rid, i, m, item FROM spans JOIN windows USING (m, k)),
  words_hit AS (SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS w FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid),
  found AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words_hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, words_hit.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN words_hit USING (rid) LEFT JOIN found USING (rid)"""


def audit_sql() -> str:
    """Every order applied to every mask, filter by filter."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  firsts AS (SELECT t, min(doc_id) AS first FROM base GROUP BY t),
  worded AS (SELECT base.*, first, {WORDS} AS ws FROM base JOIN firsts USING (t)),
  known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
    FROM worded LEFT JOIN known USING (doc_id)),
  counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL),
  orders(filter_order) AS (VALUES {orders}),
  cells AS (SELECT part, filter_order, step, filter_order[step] AS f, counts.fails, n, good, toxic,
      contains(fails, filter_order[step]) AS failing, length(translate(filter_order[1:step - 1], fails, '')) < step - 1 AS gone
    FROM counts CROSS JOIN orders CROSS JOIN (SELECT unnest(range(1, 6)) AS step)),
  steps AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM cells GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM steps"""


SQL = {"op1_quality_divergence": quality_sql(), "op3_curriculum_mix": mix_sql(), "op11_walsh_centroids": cluster_sql(), "op12_winnowing": winnowing_sql(), "op13_filter_audit": audit_sql()}

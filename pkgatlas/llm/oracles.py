"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from pkgatlas.llm import quality, secrets

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, {_ASCII_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM split
), repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, coalesce(k.doc_id > r.first_doc, false) AS lost
  FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_BLANK = "[ \\t\\n\\x0B\\f\\r]"
_FULL = "[^ \\t\\n\\x0B\\f\\r]"


def _sum_above(column: str, cutoffs) -> str:
    return " + ".join(f"({column} > {float(c)!r}::DOUBLE)::INTEGER" for c in cutoffs)


def quality_rules() -> str:
    """Statistics, proposals, exact binomial tails, Holm's procedure and verdicts."""
    p = quality.MAX_FALSE_REJECTION
    steps = " ".join(
        f"WHEN '{name}' THEN [{', '.join(f'{float(c)!r}::DOUBLE' for c in sorted(cutoffs))}][above]"
        for name, cutoffs in quality.RULES.items()
    )
    exploded = " UNION ALL ".join(
        f"SELECT lang AS stratum, good, proposing, '{name}' AS rule, {_sum_above(name, cutoffs)} AS above FROM labelled"
        for name, cutoffs in quality.RULES.items()
    )
    return f"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_FULL}')) AS lines
  FROM documents
), wins AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS win,
         unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1) GROUP BY doc_id
), base AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines) AS n_full_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN covered USING (doc_id)
), stats AS (
  SELECT *, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_ratio,
         coalesce(n_dup_lines::DOUBLE / nullif(n_full_lines, 0), 0) AS dup_line_ratio,
         coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_ratio,
         coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS long_words
  FROM base
), labelled AS (
  SELECT s.*, quality > 0 AS good, (doc_id * 40503) % 65536 < 32768 AS proposing
  FROM stats s JOIN labels USING (doc_id) WHERE quality IS NOT NULL
), counts AS (
  SELECT stratum, rule, above, count(*) FILTER (proposing AND good) AS propose_good,
         count(*) FILTER (proposing AND NOT good) AS propose_bad, count(*) FILTER (NOT proposing AND good) AS hold_good
  FROM ({exploded}) GROUP BY ALL
), curve AS (
  SELECT stratum, rule, above, sum(propose_good) OVER a AS good_cut, sum(propose_bad) OVER a AS bad_cut,
         sum(hold_good) OVER a AS n_false, sum(hold_good) OVER (PARTITION BY stratum, rule) AS n_good
  FROM counts WINDOW a AS (PARTITION BY stratum, rule ORDER BY above DESC)
), proposed AS (
  SELECT * FROM (SELECT *, CASE rule {steps} END AS cutoff FROM curve WHERE above > 0
    QUALIFY row_number() OVER (PARTITION BY stratum, rule
      ORDER BY bad_cut - {quality.COST_OF_GOOD} * good_cut DESC, above DESC) = 1)
  WHERE bad_cut > {quality.COST_OF_GOOD} * good_cut
), tested AS (
  SELECT *, least(1.0, list_sum(list_transform(range(0, n_false::BIGINT + 1), lambda i:
    exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({p}) + (n_good - i) * ln(1 - {p}))))) AS p_value
  FROM proposed
), holm AS (
  SELECT *, bool_and(fits) OVER (ORDER BY step) AS certified FROM (
    SELECT *, p_value <= {quality.CONFIDENCE_GAP} / (tests - step + 1) AS fits FROM (
      SELECT *, count(*) OVER () AS tests, row_number() OVER (ORDER BY p_value, stratum NULLS LAST, rule) AS step FROM tested))
), rejected AS (
  SELECT DISTINCT s.doc_id FROM stats s JOIN holm h ON s.lang IS NOT DISTINCT FROM h.stratum
  WHERE h.certified AND CASE h.rule {' '.join(f"WHEN '{r}' THEN s.{r}" for r in quality.RULES)} END > h.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secret_scan() -> str:
    """Matches and the gaps between them give places; entropy of every window by itself."""
    names = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {
        "assign": f"({names})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
        "access": secrets.PATTERNS["access"], "hex": secrets.PATTERNS["hex"], "candidate": secrets.CANDIDATE,
    }
    cut = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {place} AS place, unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS gap, "
        f"unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {2 if kind == 'assign' else 0})) AS g, "
        f"unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS k FROM t"
        for place, (kind, p) in enumerate(patterns.items())
    )
    kind = " ".join(f"WHEN regexp_full_match(m, '{p}') THEN '{name}'" for name, p, _ in secrets.CLASSES)
    least = " ".join(f"WHEN '{name}' THEN {bits}" for name, _, bits in secrets.CLASSES)
    allowed = " AND ".join(f"NOT regexp_matches(m, '{p}')" for p in secrets.ALLOWED)
    mixed = " AND ".join(f"regexp_matches(m, '{p}')" for p in secrets.MIXED)
    n = secrets.WINDOW
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS ({cut}),
placed AS (
  SELECT *, begins + length(m) AS till FROM (
    SELECT *, (sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begins
    FROM cut WINDOW w AS (PARTITION BY doc_id, kind ORDER BY k))
), base AS (
  SELECT doc_id, kind, place, begins, till FROM placed
  WHERE length(g) >= CASE kind WHEN 'assign' THEN {secrets.LEAST['assign']} WHEN 'access' THEN {secrets.LEAST['access']} WHEN 'hex' THEN {secrets.LEAST['hex']} END
), entropy AS (
  SELECT doc_id, 'entropy-' || class AS kind, place, begins, till FROM (
    SELECT *, CASE {kind} END AS class,
      round(list_max(list_transform(range(1, length(m) - {n} + 2), lambda i: list_aggregate(string_split(substr(m, i, {n}), ''), 'entropy'))), 6) AS bits
    FROM placed p WHERE kind = 'candidate' AND {mixed} AND {allowed}
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.begins < p.till AND p.begins < b.till))
  WHERE bits > CASE class {least} END
), every AS (SELECT * FROM base UNION ALL SELECT * FROM entropy)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || begins || ':' || till, ',' ORDER BY begins, place) FILTER (place < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || begins || ':' || till, ',' ORDER BY begins, place, kind, till), '') AS spans
FROM t LEFT JOIN every USING (doc_id) GROUP BY doc_id
"""


DECONTAMINATION = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item_words WHERE len(w) > 0)
),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
runs AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS run
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc_words, (SELECT DISTINCT k FROM windows))
),
met AS (
  SELECT r, s, k, item_id FROM runs JOIN windows USING (k, run)
),
words_hit AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(s, s + k)) AS place FROM met) GROUP BY r
),
items AS (
  SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN words_hit h USING (r) LEFT JOIN items i USING (r)
"""

HARD_NEGATIVES = """
WITH rows_ AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, c.rid, c.vec_id, c.label = a.label AS alike,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM rows_ a, rows_ c WHERE a.vec_id % 100 = 0 AND a.rid <> c.rid
),
positives AS (
  SELECT * FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5
),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.aid, p.rid ORDER BY n.score DESC, n.vec_id NULLS LAST, n.rid) AS rank
  FROM positives p JOIN scores n ON n.aid = p.aid AND NOT n.alike
   AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""

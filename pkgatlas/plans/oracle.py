"""The views of ``plans/domain.py`` in SQL, as named pieces that queries are put together from."""

from __future__ import annotations

import re

from pkgatlas import fixed

AS_OF = "2001-12-31"


def pkg(expr: str) -> str:
    return (
        f"(CASE WHEN contains(({expr})::VARCHAR, '1') THEN 'Pkg-' ELSE 'pkg-' END || ({expr})::VARCHAR)"
    )


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def days(expr: str) -> str:
    return (
        f"coalesce(CASE WHEN regexp_matches({expr}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN "
        f"floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(try_cast({expr} AS TIMESTAMP))) / 86400000000.0) END, "
        f"{fixed.UNKNOWN_DAYS})::INTEGER"
    )


def bands(expr: str, op: str, table, floor) -> str:
    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    cases = " ".join(f"WHEN {expr} {op} {edge} THEN {lit(out)}" for edge, out in table)
    return f"(CASE {cases} ELSE {lit(floor)} END)"


def score(dep: str, stars: str, age: str, versions: str) -> str:
    w = fixed.SCORE_WEIGHTS
    return (
        "least(100, greatest(0, trunc("
        f"least(100.0::DOUBLE, log10(greatest(coalesce({dep}, 0), 1) + 1) * {fixed.ADOPTION_FACTOR}) * {w['adoption']}::DOUBLE"
        f" + {bands(age, '<=', fixed.MAINTENANCE_BANDS, fixed.MAINTENANCE_FLOOR)} * {w['maintenance']}::DOUBLE"
        f" + least(100.0::DOUBLE, (coalesce({versions}, 0) * {fixed.MATURITY_PER_VERSION})::DOUBLE) * {w['maturity']}::DOUBLE"
        f" + least(100.0::DOUBLE, log10(greatest(coalesce({stars}, 0), 1) + 1) * {fixed.COMMUNITY_FACTOR}) * {w['community']}::DOUBLE"
        ")::INTEGER))"
    )


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def one_decimal(expr: str) -> str:
    return (
        f"printf('%.1f', CASE WHEN abs({expr}) - floor(abs({expr})) = 0.25 "
        f"THEN ({expr}) + sign({expr}) * 0.05 ELSE ({expr}) END)"
    )


def half_up(expr: str) -> str:
    return f"floor({expr} + 0.5)::BIGINT::VARCHAR"


def recency(d: str, style: str) -> str:
    d = f"({d})::DOUBLE"
    if style == "table":
        return (
            f"(CASE WHEN {d} <= 7 THEN 'This week' WHEN {d} <= 30 THEN {half_up(d + ' / 7')} || ' weeks ago' "
            f"WHEN {d} <= 365 THEN {half_up(d + ' / 30')} || ' months ago' "
            f"ELSE {half_up(d + ' / 365')} || ' years ago' END)"
        )
    if style == "comparison":
        return (
            f"(CASE WHEN {d} <= 1 THEN 'Today' WHEN {d} <= 7 THEN {d}::BIGINT::VARCHAR || 'd ago' "
            f"WHEN {d} <= 30 THEN {half_up(d + ' / 7')} || 'w ago' "
            f"WHEN {d} <= 365 THEN {half_up(d + ' / 30')} || 'mo ago' "
            f"ELSE {one_decimal(d + ' / 365')} || 'yr ago' END)"
        )
    return (
        f"(CASE WHEN {d} <= 30 THEN 'Recent' WHEN {d} <= 180 THEN {half_up(d + ' / 30')} || 'mo ago' "
        f"ELSE {half_up(d + ' / 365')} || 'yr ago' END)"
    )


def abbreviate(v: str, digits: int = 1) -> str:
    k = one_decimal(f"({v}) / 1000.0::DOUBLE") if digits else half_up(f"({v}) / 1000.0::DOUBLE")
    return (
        f"(CASE WHEN {v} >= 1000000 THEN {one_decimal(f'({v}) / 1000000.0::DOUBLE')} || 'M' "
        f"WHEN {v} >= 1000 THEN {k} || 'k' ELSE ({v})::VARCHAR END)"
    )


def words(expr: str) -> str:
    return (
        f"list_distinct(list_filter(string_split_regex(lower({expr}), '\\s+'), "
        f"lambda w: length(w) > 1 AND NOT list_contains([{strings(fixed.STOP_WORDS)}], w)))"
    )


def query_key(expr: str) -> str:
    return f"replace(lower(trim({expr}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), ' ', '_')"


# FIXED VALUES: the patterns of functions/readme.py again, in this dialect.
_install = r"^\s*(?:\$\s*)?(?:python\s+-m\s+)?pip\s+install\s+\S+\s*$"


def _good(code: str, strict: bool) -> str:
    first = strip(f"split_part({code}, chr(10), 1)")
    token = r"(?m)(^import |^from .+ import |^def |^class |^>>> |[=()\[\]{}]|^\w+\.)"
    test = (
        f"{code} <> '' AND NOT list_bool_and([true] || list_transform(list_filter(string_split({code}, chr(10)), "
        f"lambda l: {strip('l')} <> ''), lambda l: regexp_matches(l, '{_install}'))) "
        f"AND NOT (starts_with({first}, '<') AND contains({first}, '>')) AND NOT contains({first}, '**') "
        f"AND NOT starts_with({first}, '[') AND NOT starts_with({first}, '*')"
    )
    return test + (f" AND regexp_matches({code}, '{token}')" if strict else "")


def snippet(readme: str) -> str:
    """First code example: tagged fence, other fence, indented block."""
    tagged = f"regexp_extract_all({readme}, '(?si)```(?:python|py)\\s*\\n(.*?)```', 1)"
    tags = f"regexp_extract_all({readme}, '(?s)```(\\w*)\\s*\\n(.*?)```', 1)"
    codes = f"regexp_extract_all({readme}, '(?s)```(\\w*)\\s*\\n(.*?)```', 2)"
    other = (
        f"list_transform(list_filter(list_zip({tags}, {codes}), "
        f"lambda f: NOT list_contains([{strings(fixed.SKIPPED_FENCE_TAGS)}], lower(f[1]))), lambda f: f[2])"
    )
    blocks = (
        f"list_transform(regexp_extract_all({readme}, '(?:^|\\n)((?:(?:    |\\t).+\\n?){{2,}})', 1), "
        "lambda b: regexp_replace(b, '(?m)^(?:    |\\t)', '', 'g'))"
    )

    def pick(source: str, strict: bool = False) -> str:
        return (
            f"list_filter(list_transform({source}, lambda c: {strip('c')}), lambda k: {_good('k', strict)})[1]"
        )

    return f"coalesce({pick(tagged)}, {pick(other)}, {pick(blocks, True)})"


STATS_COLUMNS = (
    "name, found_in_db, found_in_registry, error, stars, forks, dependents_count, total_versions, "
    "repository_url, license, growth_pct, latest_version, summary, author, registry_license, "
    "registry_total_versions, latest_release_date, requires_dist, days_since_last_release, "
    "code_snippet, health_score, score_label, score_color, code_source"
)

CTES: dict[str, str] = {}

CTES["d_dependents"] = f"""
SELECT {pkg('l_partkey')} AS package_name, count(*) AS dependent_count
FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY l_partkey"""
CTES["d_prior"] = f"""
SELECT {pkg('l_partkey')} AS package_name, count(*) AS dependent_count
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '2000-01-01'
GROUP BY l_partkey"""
CTES["d_bridge"] = f"""
SELECT {pkg('l_partkey')} AS package_name, 'org/repo-' || l_suppkey AS repo FROM lineitem"""
CTES["d_repos"] = """
SELECT 'org/repo-' || s_suppkey AS repo, greatest(trunc(s_acctbal)::BIGINT, 0) AS stars,
       s_nationkey::BIGINT AS forks, length(s_name)::BIGINT AS open_issues, s_name AS description
FROM supplier"""
CTES["d_best_repo"] = """
SELECT * FROM (
  SELECT DISTINCT lower(b.package_name) AS name_key, b.repo, r.stars, r.forks, r.open_issues, r.description
  FROM d_bridge b LEFT JOIN d_repos r ON b.repo = r.repo)
QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY stars DESC NULLS LAST, repo) = 1"""
CTES["d_staged"] = """
SELECT d.package_name, lower(d.package_name) AS name_key, r.description, r.stars, r.forks, r.open_issues,
       d.dependent_count, p.dependent_count AS dependent_count_prior,
       (d.dependent_count - p.dependent_count) * 100.0::DOUBLE / nullif(p.dependent_count, 0)::DOUBLE AS growth_pct,
       r.repo
FROM d_dependents d
LEFT JOIN d_best_repo r ON r.name_key = lower(d.package_name)
LEFT JOIN d_prior p ON lower(p.package_name) = lower(d.package_name)"""
CTES["d_packages"] = f"""
SELECT s.* REPLACE (coalesce(p_name || ' ' || lower(p_type) || ' package for ' || p_brand, description) AS description)
FROM d_staged s LEFT JOIN part ON s.name_key = lower({pkg('p_partkey')})"""
CTES["d_all_projects"] = """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'PKG-' ELSE 'pkg-' END || o_orderkey AS name,
       o_orderpriority || ' project of customer ' || o_custkey AS description,
       trunc(o_totalprice)::BIGINT AS stars, o_custkey AS forks,
       trunc(o_totalprice / 1000)::BIGINT AS dependents_count,
       'https://git.example.org/c' || o_custkey || '/p' || o_orderkey || '/' AS repository_url,
       o_orderpriority AS licenses, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS latest_release_ts,
       o_orderstatus AS platform
FROM orders"""
CTES["d_projects"] = "SELECT *, lower(name) AS name_key FROM d_all_projects WHERE platform = 'O'"
CTES["d_all_deps"] = f"""
SELECT 'pkg-' || l_orderkey AS project_name,
       CASE WHEN l_returnflag = 'R' THEN 'PKG-' || l_partkey ELSE {pkg('l_partkey')} END AS dependency_name,
       l_returnflag AS dependency_kind, '>=' || l_linenumber AS dependency_requirements,
       l_linestatus AS platform
FROM lineitem"""
CTES["d_deps"] = "SELECT * FROM d_all_deps WHERE platform = 'O'"
CTES["d_versions"] = """
SELECT 'pkg-' || user_id AS project_name, event_type AS platform FROM events WHERE event_type = 'signup'"""
CTES["d_metadata"] = f"""
SELECT {pkg('doc_id')} AS name, lower({pkg('doc_id')}) AS name_key,
       'A ' || lang || ' library from ' || source || CASE WHEN n_chars > 2000 THEN ' for machine learning'
         WHEN lang = 'de' THEN ' with vector search' ELSE '' END AS summary,
       text || CASE lang
         WHEN 'en' THEN e'\\n```bash\\npip install x\\n```\\n\\n```python\\nimport ' || source || e'\\nrun(' || n_chars || e')\\n```\\n'
         WHEN 'fr' THEN e'\\n```\\nx = ' || n_chars || e'\\n```\\n'
         WHEN 'de' THEN e'\\n\\n    value = f(' || n_chars || e')\\n    print(value)\\n\\nEnd.'
         ELSE '' END AS readme,
       lang || ',' || source AS keywords,
       '["Language :: ' || lang || '","Source :: ' || source || '"]' AS classifiers,
       '1.' || n_chars AS version, source AS author, lang AS license,
       '["pkg-' || n_chars || ' (>=1.0)","Pkg_' || doc_id || '[fast,x]>=2,<3; extra == ''x''"]' AS requires_dist,
       '>=3.8' AS requires_python, n_chars // 100 AS total_versions,
       CASE WHEN source = 'src3' THEN 'unknown' WHEN source = 'src5' THEN ''
         ELSE (DATE '{AS_OF}' - (n_chars // 10)::INTEGER)::DATE::VARCHAR END AS latest_release_date,
       '' AS first_release_date, 'https://' || source || '.example.org' AS home_page
FROM documents"""
CTES["d_downloads"] = f"""
SELECT {pkg('l_partkey')} AS package_name, strftime(l_shipdate, '%Y-%m-%d') AS month,
       trunc(l_quantity)::BIGINT AS downloads FROM lineitem"""
CTES["d_brand_downloads"] = """
SELECT p_brand AS package_name, strftime(l_shipdate, '%Y-%m-%d') AS month,
       trunc(l_quantity)::BIGINT AS downloads FROM lineitem JOIN part ON l_partkey = p_partkey"""
CTES["d_monthly"] = """
SELECT package_name, strftime(month::DATE, '%Y-%m') AS month, sum(downloads)::BIGINT AS downloads
FROM d_downloads GROUP BY ALL"""
CTES["d_latest"] = """
SELECT month, package_name, downloads FROM d_monthly
WHERE month = (SELECT max(month) FROM d_monthly) AND downloads > 0"""
CTES["d_requests"] = """
SELECT o_orderkey AS request_id, unnest([0, 1, 2]) AS pos,
       unnest(['pkg-' || o_custkey, 'PKG-' || o_orderkey, 'pkg-' || dayofyear(o_orderdate)]) AS name
FROM orders"""
CTES["d_names"] = "SELECT DISTINCT name, lower(name) AS name_key FROM d_requests"
CTES["d_edge_counts"] = """
SELECT lower(dependency_name) AS name_key, count(*) AS edge_count FROM d_deps GROUP BY 1"""
CTES["d_metrics_for_all"] = """
SELECT k.name_key, f.name_key IS NOT NULL OR h.name_key IS NOT NULL AS found_in_db,
       CASE WHEN f.name_key IS NOT NULL THEN f.package_name ELSE h.name END AS package_name,
       CASE WHEN f.name_key IS NOT NULL THEN f.stars ELSE h.stars END AS stars,
       CASE WHEN f.name_key IS NOT NULL THEN f.forks ELSE h.forks END AS forks,
       CASE WHEN f.name_key IS NOT NULL THEN f.dependent_count ELSE h.dependents_count END AS dependents_count,
       f.open_issues,
       CASE WHEN f.name_key IS NOT NULL THEN f.repo ELSE h.repository_url END AS repository_url,
       CASE WHEN f.name_key IS NOT NULL THEN f.description ELSE h.description END AS description,
       f.growth_pct, h.licenses AS license, h.latest_release_ts AS last_release_ts,
       coalesce(v.n, 0) AS total_versions
FROM (SELECT name_key FROM d_names UNION SELECT name_key FROM d_packages
      UNION SELECT name_key FROM d_metadata) k
LEFT JOIN d_packages f USING (name_key) LEFT JOIN d_projects h USING (name_key)
LEFT JOIN (SELECT lower(project_name) AS name_key, count(*) AS n FROM d_versions GROUP BY 1) v USING (name_key)"""
_stats = f"""
SELECT q.name_key, found_in_db, registry AS found_in_registry, known, stars, forks, dependents_count,
       total_versions, repository_url, license, growth_pct, latest_version, summary, author,
       registry_license, registry_total_versions, latest_release_date, requires_dist,
       days_since_last_release, code_snippet, {score('dependents_count', 'stars', 'days_since_last_release', 'total_versions')} AS health_score
FROM (
  SELECT m.name_key, m.found_in_db, r.name_key IS NOT NULL AS registry,
         m.found_in_db OR r.name_key IS NOT NULL AS known,
         coalesce(m.stars, 0) AS stars, coalesce(m.forks, 0) AS forks,
         coalesce(m.dependents_count, 0) AS dependents_count,
         CASE WHEN m.total_versions <> 0 THEN m.total_versions ELSE coalesce(r.total_versions, 0) END AS total_versions,
         coalesce(m.repository_url, '') AS repository_url, coalesce(m.license, '') AS license,
         coalesce(m.growth_pct, 0.0::DOUBLE) AS growth_pct, coalesce(r.version, '') AS latest_version,
         coalesce(r.summary, '') AS summary, coalesce(r.author, '') AS author,
         coalesce(r.license, '') AS registry_license, coalesce(r.total_versions, 0) AS registry_total_versions,
         coalesce(r.latest_release_date, '') AS latest_release_date,
         coalesce(r.requires_dist, '[]') AS requires_dist,
         {days("coalesce(nullif(r.latest_release_date, ''), m.last_release_ts)")} AS days_since_last_release,
         {{snippet}} AS code_snippet
  FROM d_metrics_for_all m LEFT JOIN d_metadata r USING (name_key)) q"""
CTES["d_stats_keyed"] = f"""
SELECT *, {bands('health_score', '>=', fixed.SCORE_LABELS, fixed.SCORE_LABEL_FLOOR)} AS score_label,
       {bands('health_score', '>=', fixed.SCORE_COLORS, fixed.SCORE_COLOR_FLOOR)} AS score_color,
       CASE WHEN code_snippet IS NOT NULL THEN 'README' END AS code_source
FROM ({_stats.replace('{snippet}', snippet('r.readme'))})"""
CTES["d_stats"] = """
SELECT n.name, s.*, CASE WHEN NOT known THEN 'Package ''' || n.name || ''' not found in database or registry' END AS error
FROM d_names n JOIN d_stats_keyed s USING (name_key)"""
CTES["d_compare"] = """
SELECT r.request_id, r.pos, s.*, count(*) OVER (PARTITION BY r.request_id) AS comparison_count
FROM d_requests r JOIN d_stats s ON r.name = s.name"""
CTES["d_vectors"] = f"""
SELECT vec_id AS id, embedding, {pkg('vec_id')} AS name, m.summary, p.stars, p.dependent_count, p.growth_pct, m.version
FROM embeddings LEFT JOIN d_packages p ON p.name_key = lower({pkg('vec_id')})
LEFT JOIN d_metadata m ON m.name_key = lower({pkg('vec_id')})"""
CTES["d_topics"] = """
SELECT m.query_id, t.query, m.embedding FROM (
  SELECT query_id, list(v ORDER BY i) AS embedding FROM (
    SELECT label AS query_id, i, avg(v::DOUBLE) AS v
    FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY ALL) GROUP BY query_id) m
JOIN (SELECT p_brand, CASE WHEN avg(p_size) > 25.5 THEN 'trending ' || min(p_name) ELSE min(p_name) END AS query
      FROM part GROUP BY p_brand) t ON t.p_brand = 'Brand#' || (m.query_id + 1)"""
CTES["d_pairs"] = """
SELECT t.query_id, v.id, v.name, v.stars, v.dependent_count, v.growth_pct,
       round(list_cosine_similarity(v.embedding::DOUBLE[], t.embedding), 6) AS score
FROM d_vectors v, d_topics t"""
CTES["d_semantic"] = """
SELECT query_id, rank, name, lower(name) AS name_key, dependent_count AS dependents_count, stars, growth_pct,
       score AS similarity_score, blended_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended_score DESC, id) AS rank FROM (
    SELECT *, round(score * 0.6::DOUBLE + least(1.0::DOUBLE, log10(coalesce(dependent_count, 0) + 1) / 5) * 0.25::DOUBLE
        + greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(growth_pct, 0.0::DOUBLE) / 100)) * 0.15::DOUBLE, 6) AS blended_score
    FROM d_pairs WHERE score >= 0.1 AND coalesce(dependent_count, 0) >= 5))
WHERE rank <= {limit}"""
CTES["d_semantic30"] = CTES["d_semantic"].replace("{limit}", "30")
CTES["d_semantic"] = CTES["d_semantic"].replace("{limit}", "20")
CTES["d_top_growth_all"] = """
SELECT package_name AS name, name_key, coalesce(description, '') AS description, coalesce(stars, 0) AS stars,
       dependent_count AS dependents_count, growth_pct, growth_pct * ln(dependent_count + 1) AS growth_score,
       row_number() OVER (ORDER BY growth_pct * ln(dependent_count + 1) DESC, name_key) AS rank
FROM d_packages WHERE growth_pct > 50 AND dependent_count >= 5 AND (coalesce(stars, 0) > 0 OR dependent_count >= 20)"""
CTES["d_intent"] = f"""
SELECT query_id, query, growth_intent, growth_intent_search, specific_domain,
       growth_intent AND NOT specific_domain AS growth_override FROM (
  SELECT query_id, query,
    regexp_matches(query, '(?i)({"|".join(fixed.GROWTH_STEMS)})') AS growth_intent,
    regexp_matches(query, '(?i)({"|".join((*fixed.GROWTH_STEMS, *fixed.GROWTH_STEMS_SEARCH_ONLY))})') AS growth_intent_search,
    regexp_matches(query, '(?i)\\b({"|".join(fixed.DOMAIN_WORDS)})\\b') AS specific_domain
  FROM d_topics)"""
CTES["d_hybrid30"] = """
SELECT query_id, name, name_key, dependents_count, stars, growth_pct, source,
       row_number() OVER (PARTITION BY query_id ORDER BY source_rank, rank) AS pos FROM (
  SELECT * FROM (
    SELECT i.query_id, g.name, g.name_key, g.dependents_count, g.stars, g.growth_pct, g.rank, 0 AS source_rank, 'growth' AS source
    FROM d_intent i, d_top_growth_all g WHERE i.growth_intent_search AND g.rank <= {limit}
    UNION ALL
    SELECT query_id, name, name_key, dependents_count, stars, growth_pct, rank, 1, 'semantic' FROM {semantic}
    UNION ALL
    SELECT t.query_id, p.package_name, p.name_key, p.dependent_count, p.stars, p.growth_pct,
           row_number() OVER (PARTITION BY t.query_id ORDER BY p.dependent_count DESC NULLS LAST, p.name_key) AS rank, 2, 'keyword'
    FROM d_topics t JOIN d_packages p ON contains(lower(p.description), lower(t.query))
    QUALIFY rank <= {limit})
  QUALIFY row_number() OVER (PARTITION BY query_id, name_key ORDER BY source_rank, rank) = 1)
QUALIFY pos <= {limit}"""
CTES["d_hybrid"] = CTES["d_hybrid30"].replace("{limit}", "20").replace("{semantic}", "d_semantic")
CTES["d_hybrid30"] = CTES["d_hybrid30"].replace("{limit}", "30").replace("{semantic}", "d_semantic30")
CTES["d_shortlist"] = """
SELECT query_id, shortlist_pos, branch, name, name_key FROM (
  SELECT * FROM (
    SELECT query_id, name, name_key, 'quality' AS branch,
           row_number() OVER (PARTITION BY query_id ORDER BY coalesce(growth_pct, 0) DESC, pos) AS shortlist_pos
    FROM d_hybrid30 WHERE coalesce(dependents_count, 0) >= 10 AND coalesce(stars, 0) >= 9000 QUALIFY shortlist_pos <= 7)
  WHERE query_id IN (SELECT query_id FROM d_hybrid30
    WHERE coalesce(dependents_count, 0) >= 10 AND coalesce(stars, 0) >= 9000 GROUP BY 1 HAVING count(*) >= 3)
  UNION ALL
  SELECT query_id, name, name_key, branch, shortlist_pos FROM (
    SELECT query_id, name, name_key, 'fallback' AS branch,
           row_number() OVER (PARTITION BY query_id
             ORDER BY coalesce(growth_pct, 0) * ln(greatest(coalesce(dependents_count, 0), 1) + 1) DESC, pos) AS shortlist_pos
    FROM d_hybrid30 QUALIFY shortlist_pos <= 5)
  WHERE query_id NOT IN (SELECT query_id FROM d_hybrid30
    WHERE coalesce(dependents_count, 0) >= 10 AND coalesce(stars, 0) >= 9000 GROUP BY 1 HAVING count(*) >= 3))"""
CTES["d_explore"] = """
SELECT c.query_id, c.pos, i.query, i.growth_override, c.name, s.* EXCLUDE (name_key), s.name_key, l.downloads AS latest_downloads
FROM (SELECT query_id, shortlist_pos AS pos, name FROM d_shortlist
        WHERE query_id IN (SELECT query_id FROM d_intent WHERE growth_override)
      UNION ALL
      SELECT query_id, pos, name FROM d_hybrid30
        WHERE query_id NOT IN (SELECT query_id FROM d_intent WHERE growth_override)) c
JOIN d_stats_keyed s ON s.name_key = lower(c.name)
JOIN d_intent i USING (query_id)
LEFT JOIN d_latest l ON lower(l.package_name) = s.name_key"""
CTES["d_new_q"] = f"""
SELECT conv_id * 1000 + turn AS query_id, CASE WHEN contains(text, '?') THEN 'compare' ELSE 'explore' END AS mode,
       {query_key('text')} AS key FROM conversations WHERE role = 'user'"""
CTES["d_known_q"] = f"""
SELECT min(query_id) AS query_id, list_sort(list(query_id))[2] AS second_id, mode, key FROM (
  SELECT conv_id * 1000 + turn AS query_id, CASE WHEN contains(text, '?') THEN 'compare' ELSE 'explore' END AS mode,
         {query_key('text')} AS key
  FROM conversations) GROUP BY mode, key"""


def sql(body: str) -> str:
    """``body`` with the pieces it names, each after the pieces it needs."""
    done: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bd_\w+", text)):
            if name in CTES and name not in done:
                need(CTES[name])
                if name not in done:
                    done.append(name)

    need(body)
    pieces = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in done)
    body = body.strip()
    if not done:
        return body
    # a body with pieces of its own goes on with the list
    rest = re.sub(r"^WITH\b", ",", body) if re.match(r"WITH\b", body) else "\n" + body
    return f"WITH {pieces}{rest}"

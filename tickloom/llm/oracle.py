"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

import re

from tickloom.llm.quality_rules import BELIEF, CLOSE, EXPECTED, MOST_FOUND, ROUNDS, default_rules, group_odds, groups_of

_BLANK = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex({{text}}, '{_BLANK}'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

NEAR_DEDUP = f"""
    WITH RECURSIVE
    w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
    both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS node, doc_id AS got FROM s UNION SELECT r.node, l.b FROM reach r JOIN both_ l ON l.a = r.got)
    SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least.id AS component_id, s.doc_id = least.id AS kept FROM s JOIN (SELECT node, min(got) AS id FROM reach GROUP BY 1) least ON least.node = s.doc_id
"""


def quality_rules(rounds: int = ROUNDS) -> str:
    """Counts, votes of groups, expectation-maximisation over the table of vote patterns, and the verdict."""
    rules, groups = default_rules(), groups_of(default_rules())
    digit = lambda i: f"(pattern // {3**i} % 3)"
    code = []
    for i, group in enumerate(groups):
        tests = {"reject": [], "keep": []}
        for r in (r for r in rules if r.group == group):
            value = "(" + re.sub(r"try_divide\((\w+), (\w+)\)", r"\1::DOUBLE / nullif(\2, 0)", r.value) + ")"
            for name, sign, bound in (("reject", ">=", r.reject), ("keep", "<=", r.keep)):
                if bound is not None:
                    tests[name].append(f"coalesce(n_words >= {r.least} AND {value} {sign} {bound}::DOUBLE, false)")
        code.append(f"{3**i} * CASE WHEN {' OR '.join(tests['reject'])} THEN 0 WHEN {' OR '.join(tests['keep']) or 'false'} THEN 2 ELSE 1 END")
    terms = []
    for i, least in enumerate(group_odds(rules)):
        of = lambda w, test: f"coalesce(sum({w}) FILTER ({digit(i)} {test}) OVER (), 0)"  # noqa: E731, B023
        theta = lambda w, expected: f"({of(w, '= 0')} + {BELIEF * expected}::DOUBLE) / ({of(w, '<> 1')} + {BELIEF}::DOUBLE)"  # noqa: E731, B023
        bad = f"least({theta('n * q', EXPECTED['bad'])}, {MOST_FOUND}::DOUBLE)"
        good = f"least({theta('n * (1 - q)', EXPECTED['good'])}, {bad} / {least}::DOUBLE)"
        terms.append(f"CASE {digit(i)} WHEN 0 THEN ln({bad} / {good}) WHEN 2 THEN ln((1 - {bad}) / (1 - {good})) ELSE 0 END")
    any_reject = " OR ".join(f"{digit(i)} = 0" for i in range(len(groups)))
    odds = f"ln((coalesce(sum(n) FILTER ({any_reject}) OVER (), 0) + 1) / (coalesce(sum(n) FILTER (NOT ({any_reject})) OVER (), 0) + 1)) + {' + '.join(terms)}"
    strip = lambda p: f"length(regexp_replace(t, '{p}', '', 'g'))"
    return rf"""
    WITH RECURSIVE
    d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
    rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM win),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep WHERE c > 1) GROUP BY 1),
    f AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - {strip('[#*$%&|<>]')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines,
        {strip(r'\P{Lu}')} AS n_upper, {strip(r'\P{L}')} AS n_letters, len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_shouts, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_runs, len(list_distinct(w)) AS n_distinct FROM d LEFT JOIN cov USING (doc_id)),
    v AS (SELECT *, CAST({' + '.join(code)} AS INT) AS pattern FROM f),
    start AS (SELECT pattern, CAST(count(*) FILTER (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)) AS DOUBLE) AS n FROM v GROUP BY 1),
    em AS (SELECT 0 AS k, pattern, n, CASE WHEN {any_reject} THEN 0.9::DOUBLE ELSE 0.05::DOUBLE END AS q, false AS done FROM start
        UNION ALL SELECT k + 1, pattern, n, q2, max(abs(q2 - q)) OVER () < {CLOSE} FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS q2 FROM em WHERE k < {rounds} AND NOT done) turned)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 1 - q >= 0.5 AS kept, v.pattern, round(1 - q, 6) AS p_good FROM v JOIN em ON em.pattern = v.pattern AND em.k = (SELECT max(k) FROM em)
    """

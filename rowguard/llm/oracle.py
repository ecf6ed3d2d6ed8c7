"""DuckDB SQL of the operators 11 to 13, written without looking at how Spark does them."""

from __future__ import annotations

from itertools import permutations

_URL_PARTS = r"""
    SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
"""
_RULES = "('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')"

#: Every set of tokens of the labelled urls is counted, by a mask of eight bits.
URL_FILTERS = rf"""
    WITH parts AS ({_URL_PARTS}),
    rules(rule, ends, starts, verdict) AS (VALUES {_RULES}),
    listed AS (
        SELECT page_id, any_value(url) AS url, any_value(host) AS host, any_value(path) AS path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
        FROM parts LEFT JOIN rules ON (host = ends OR ends_with(host, '.' || ends)) AND starts_with(path, starts) GROUP BY page_id
    ), tokens AS (
        SELECT page_id, host, path, rule, verdict, [
            'scheme=' || translate(regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            'tld=' || string_split(host, '.')[-1], 'domain=' || array_to_string(string_split(host, '.')[-2:], '.'), 'host=' || host,
            'directory=' || regexp_extract(path, '(?s)^/([^/]+)/', 1), 'ending=' || regexp_extract(path, '(?s)(/|\.[^./]*)\z', 1),
            'query=' || array_to_string(list_sort(list_distinct(list_transform(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1]))), '&'),
            'fragment=' || CASE WHEN contains(coalesce(url, ''), '#') THEN 'yes' ELSE 'no' END] AS own
        FROM listed
    ), masks AS (SELECT range AS mask FROM range(1, 256)),
    chosen AS (SELECT page_id, rule, verdict, list_sort(list_filter(own, lambda t, i: (mask >> (i - 1)) & 1 = 1)) AS antecedent FROM tokens, masks),
    of_all AS (SELECT count(*) AS n FROM listed WHERE rule IS NOT NULL),
    sets AS (SELECT antecedent, count(*) AS n FROM chosen WHERE rule IS NOT NULL GROUP BY antecedent),
    said AS (SELECT antecedent, verdict, count(*) AS n FROM chosen WHERE rule IS NOT NULL GROUP BY ALL),
    sure AS (
        SELECT antecedent, verdict, said.n / sets.n AS confidence, said.n / (SELECT n FROM of_all) AS support FROM said JOIN sets USING (antecedent)
        WHERE said.n >= ceil(0.01 * (SELECT n FROM of_all)) AND said.n / sets.n >= 0.8
    ), kept AS (
        SELECT * FROM sure AS a WHERE NOT EXISTS (
            SELECT 1 FROM sure AS b WHERE b.verdict = a.verdict AND b.confidence >= a.confidence AND len(b.antecedent) < len(a.antecedent) AND list_has_all(a.antecedent, b.antecedent))
    ), fits AS (
        SELECT page_id, max({{'c': confidence, 's': support, 'n': len(antecedent), 'b': kept.verdict = 'block', 'v': kept.verdict, 'a': antecedent}}) AS best
        FROM chosen JOIN kept USING (antecedent) WHERE chosen.rule IS NULL GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(verdict, best.v, 'allow') AS verdict, best.c AS confidence, array_to_string(best.a, ' ') AS mined FROM tokens LEFT JOIN fits USING (page_id)
"""


def _leaf(text: str) -> str:
    parts = " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')" for v in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({parts})"


#: crc32 of decimal digits, a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (CAST(ascii(c) AS BIGINT) >> b) & 1)))),
    lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384)))"""


def _tree(name: str, nodes: str, levels: int) -> str:
    """name0 (grp, idx, n, digest) to name{levels}, and name_r{k}: the digests of the nodes that a parent of level k has."""
    out = [f"{name}0 AS ({nodes})"]
    for k in range(levels):
        out.append(f"{name}_r{k} AS (SELECT grp, idx // 16 AS idx, any_value(n) AS n, list(digest ORDER BY idx) AS run FROM {name}{k} GROUP BY grp, idx // 16)")
        out.append(f"{name}{k + 1} AS (SELECT grp, idx, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM {name}_r{k})")
    return ", ".join(out)


def _climb(name: str, step: str, start: str, levels: int) -> str:
    """step0 to step{levels}: each row's digest, siblings so far and index, a level higher each time."""
    out = [f"{step}0 AS ({start})"]
    for k in range(levels):
        before, after = "array_to_string(run[1:d.idx % 16], '')", "array_to_string(run[d.idx % 16 + 2:], '')"
        out.append(f"""{step}{k + 1} AS (SELECT d.* REPLACE (d.idx // 16 AS idx, CASE WHEN r.n > 1 THEN sha256({before} || own || {after}) ELSE own END AS own,
            CASE WHEN r.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof) FROM (SELECT * FROM {step}{k}) AS d JOIN (SELECT grp AS g, idx AS i, n, run FROM {name}_r{k}) AS r ON d.grp = r.g AND d.idx // 16 = r.i)""")
    return ", ".join(out)


def merkle_manifest(levels: int = 6, upper: int = 4) -> str:
    """For sources of up to 16^levels rows, and up to 16^upper sources."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    place = "row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n"
    return f"""
        WITH hashed AS (SELECT doc_id, coalesce('v' || source, 'n') AS grp, {_leaf('text')} AS digest, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(lowered)} ELSE {_leaf('text')} END AS tampered FROM documents),
        leaves AS (SELECT *, {place} FROM hashed),
        {_tree('low', 'SELECT grp, idx, n, digest FROM leaves', levels)},
        {_tree('up', f"SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, digest FROM low{levels}", upper)},
        {_climb('low', 'a', "SELECT doc_id, grp, digest AS leaf, tampered AS own, '' AS proof, idx FROM leaves", levels)},
        named AS (SELECT grp AS source_, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM low{levels}),
        {_climb('up', 'b', f"SELECT doc_id, '' AS grp, leaf, own, proof, place AS idx, subroot FROM a{levels} JOIN named ON grp = source_", upper)}
        SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = u.digest AS verified FROM b{upper} CROSS JOIN up{upper} AS u
    """


def filter_audit() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    return rf"""
        WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
        failing AS (
            SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least_id THEN 'E' ELSE '' END AS fails
            FROM (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS least_id FROM texts)
        ), said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        counts AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failing LEFT JOIN said USING (doc_id) GROUP BY part, fails),
        orders(filter_order) AS (VALUES {orders}),
        steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, '[' || CASE WHEN step > 1 THEN filter_order[1:step - 1] ELSE '-' END || ']' AS earlier FROM orders, range(1, 6) AS r(step)),
        found AS (
            SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS own, regexp_matches(fails, earlier) AS gone FROM counts, steps
        ), sums AS (
            SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
                   coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic_lost
            FROM found GROUP BY part, filter_order, step, f
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums
    """

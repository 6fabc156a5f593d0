"""The queries of these operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, exact_dedup, licenses, line_dedup, minhash, mixing, quality, secrets, token_counts, token_store
from tessella.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(operator: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark, documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_licenses": _on_documents(licenses.op1),
    "op2_token_counts": _on_documents(token_counts.op2),
    "op3_exact_dedup": _on_documents(exact_dedup.op3),
    "op4_token_store": _on_documents(token_store.op4),
    "op5_quality": _on_documents(quality.op5),
    "op6_bpe": _on_documents(bpe.op6),
    "op7_secrets": _on_documents(secrets.op7),
    "op8_mixing": _on_documents(mixing.op8),
    "op9_minhash": _on_documents(minhash.op9),
    "op10_line_dedup": _on_documents(line_dedup.op10),
}


_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _quality_sql() -> str:
    return f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM d),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w),
        windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + {quality.WINDOW - 1}]) AS k FROM starts),
        again AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM windows WHERE k > 1),
        rep AS (SELECT doc_id, CAST(sum(least({quality.WINDOW}, coalesce(next - i, {quality.WINDOW}))) AS BIGINT) AS n_repeat_words FROM again GROUP BY 1),
        li AS (SELECT doc_id, source, unnest(list_transform(string_split(lower(text), chr(10)), lambda x: array_to_string(regexp_extract_all(x, {_WORD}), ' '))) AS line FROM d),
        host AS (SELECT doc_id, coalesce(source, chr(0)) AS s, line, len(string_split(line, ' ')) AS n FROM li WHERE line <> ''),
        often AS (SELECT s, line FROM host GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > {quality.LINE_DOCS}),
        gone AS (SELECT doc_id, sum(n) AS gone FROM host JOIN often USING (s, line) GROUP BY 1),
        m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words, gone FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
        f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT coalesce(n_words - gone < {quality.LEFT_WORDS} OR 100 * (n_words - gone) < {quality.LEFT_PERCENT} * n_words, false) AS kept FROM f"""


def _secrets_sql() -> str:
    any_case = re.compile(r"\(\?i:((?:[^()]|\([^()]*\))*)\)")
    spell = lambda m: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1])
    spans = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = any_case.sub(spell, rule.pattern).replace("'", "''")
        spans.append(
            f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', 0)) AS m, unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS part,
            unnest(list_slice(string_split_regex(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}', 0)))) AS gap, generate_subscripts(regexp_extract_all(text, '{pattern}', 0), 1) AS i, {rule.least} AS least FROM d"""
        )
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in secrets.BASE)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        found AS ({" UNION ALL ".join(spans)}),
        ends AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM found),
        spans AS (SELECT doc_id, rank, kind, e - length(m) AS s, kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM ends WHERE length(part) >= least),
        joined AS (SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(secrets.BASE)}), '')) AS base_sha256, string_agg(span, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY 1)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (doc_id)"""


def _mixing_sql() -> str:
    weights = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
    return f"""
        WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size FROM documents),
        sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY 1),
        weighed AS (SELECT *, {weights}[CAST((sid - 1) % {len(mixing.WEIGHTS)} + 1 AS INTEGER)] AS weight FROM sums),
        levels AS (SELECT *, CAST(source_size AS DOUBLE) / weight AS ratio, sum(source_size) OVER () - {mixing.CAP} * coalesce(sum(source_size) OVER up, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS shares
            FROM weighed WINDOW up AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT CAST(rest AS DOUBLE) / CAST(shares AS DOUBLE) AS level FROM levels WHERE CAST(rest AS DOUBLE) / CAST(shares AS DOUBLE) <= {mixing.CAP} * ratio ORDER BY ratio, source_size LIMIT 1),
        goals AS (SELECT source, sid, source_size, least({float(mixing.CAP)} * source_size, (SELECT level FROM level) * weight) AS target FROM weighed),
        rates AS (SELECT *, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0) AS rate FROM goals),
        plan AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, target - floor(rate) * source_size AS words FROM rates),
        placed AS (SELECT doc_id, size, sid, source_size, target, whole, words, length(bin(size)) AS class FROM sized AS d JOIN plan AS p ON d.source IS NOT DISTINCT FROM p.source),
        classes AS (SELECT sid, class, any_value(words) AS words, CAST(sum(size) AS DOUBLE) AS n, pow(2.0::DOUBLE, {mixing.POWER} * (class - 1)) AS x FROM placed WHERE size > 0 GROUP BY 1, 2),
        scales AS (SELECT *, (words - coalesce(sum(n) OVER (down ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(x * n) OVER (down ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
            FROM classes WINDOW down AS (PARTITION BY sid ORDER BY class DESC)),
        best AS (SELECT sid, arg_max(c, class) AS c FROM scales WHERE c * x <= 1 GROUP BY 1),
        chances AS (SELECT s.sid, class, greatest(0, least(1, coalesce(b.c, 1) * x)) AS chance FROM scales AS s LEFT JOIN best AS b ON b.sid = s.sid),
        drawn AS (SELECT p.*, chance, (CAST(('0x' || substr(md5('{mixing.SEED}|' || doc_id), 1, 13)) AS UBIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM placed AS p LEFT JOIN chances AS c ON c.sid = p.sid AND c.class = p.class),
        odds AS (SELECT *, CASE WHEN size = 0 THEN NULL WHEN chance >= 1 THEN 0 ELSE (u / (1 - u)) / nullif(chance / (1 - chance), 0) END AS q FROM drawn),
        upto AS (SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY sid ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= words AS more FROM odds),
        rest AS (SELECT sid, any_value(words) - coalesce(sum(size) FILTER (more), 0) AS rest FROM upto GROUP BY 1),
        gaps AS (SELECT doc_id, row_number() OVER (PARTITION BY u.sid ORDER BY abs(size - rest), q NULLS LAST, doc_id) AS k FROM upto AS u JOIN rest AS r ON r.sid = u.sid WHERE NOT more AND size > 0 AND abs(size - rest) < rest)
        SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN more OR doc_id IN (SELECT doc_id FROM gaps WHERE k = 1) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM upto"""


def _licences_sql() -> str:
    """Blanks are doubled, so that neighbouring matches don't need the same one: RE2 can't look ahead."""
    twice = lambda p: p.replace(" ?", "(?:\x00)?").replace(" ", "  ").replace("\x00", "  ")
    rules = ", ".join(f"({k}, '{r.label}', {r.priority}, '{' ' + r.gate}', '{twice(r.pattern)}')" for k, r in enumerate(licenses.RULES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
    scores = f"[{', '.join(map(str, licenses.SCORES))}]"
    return f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        t AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS norm, ' ' || array_to_string(ws, '  ') || ' ' AS wide FROM w),
        p AS (SELECT p, label, CAST(len(string_split(p, ' ')) AS BIGINT) AS k FROM (VALUES {phrases}) AS v(p, label)),
        hits AS (SELECT doc_id, label, k, unnest(string_split(wide, ' ' || replace(p, ' ', '  ') || ' ')) AS gap, unnest(range(1, len(string_split(wide, ' ' || replace(p, ' ', '  ') || ' ')) + 1)) AS i,
            len(string_split(wide, ' ' || replace(p, ' ', '  ') || ' ')) AS total FROM t, p WHERE contains(norm, ' ' || p || ' ')),
        places AS (SELECT doc_id, label, i, total, CAST(sum((length(gap) - length(replace(gap, ' ', ''))) // 2) OVER run + k * (i - 1) AS BIGINT) AS spot FROM hits WINDOW run AS (PARTITION BY doc_id, label ORDER BY i)),
        base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM places WHERE i < total GROUP BY 1),
        r AS (SELECT * FROM (VALUES {rules}) AS v(rank, label, priority, gate, pattern)),
        tried AS (SELECT doc_id, rank, label, priority, regexp_extract_all(wide, ' (?:' || pattern || ') ') AS ms, regexp_split_to_array(wide, ' (?:' || pattern || ') ') AS gs FROM t, r WHERE contains(norm, gate)),
        found AS (SELECT doc_id, rank, label, priority, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM tried WHERE len(ms) > 0),
        ends AS (SELECT doc_id, rank, label, priority, (length(m) - length(replace(m, ' ', ''))) // 2 AS n, sum((length(g) - length(replace(g, ' ', ''))) // 2 + (length(m) - length(replace(m, ' ', ''))) // 2) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM found),
        det AS (SELECT *, e - n AS s FROM ends),
        kept AS (SELECT * FROM det AS d WHERE NOT EXISTS (SELECT 1 FROM det AS o WHERE o.doc_id = d.doc_id AND o.s <= d.s AND o.e >= d.e AND (o.priority, o.n, -o.rank) > (d.priority, d.n, -d.rank))),
        own AS (SELECT doc_id, list(DISTINCT label) AS labels, max({scores}[priority + 1]) AS best FROM kept GROUP BY 1)
        SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
            CAST(greatest(coalesce(best, 0), CASE WHEN base.labels IS NULL THEN 0 ELSE {licenses.PHRASE_SCORE} END) AS DOUBLE) AS score
        FROM t LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)"""


def _near_sql() -> str:
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), {_WORD}) AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS k FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3),
        links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n - k)),
        ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS doc_id, a AS root FROM ways UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.doc_id),
        roots AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY 1)
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM s LEFT JOIN roots USING (doc_id)"""


def _lines_sql() -> str:
    return f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own, string_split(lower(coalesce(text, '')), chr(10)) AS ls FROM documents),
        li AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, regexp_extract_all(unnest(ls), {_WORD}) AS ws FROM d),
        spots AS (SELECT doc_id, i, ws, row_number() OVER (ORDER BY doc_id, i) AS spot FROM li WHERE len(ws) > 0),
        firsts AS (SELECT ws, min(spot) AS spot, CAST(len(ws) AS INTEGER) AS n FROM spots GROUP BY ws),
        pats AS (SELECT spot, unnest(list_concat(
            list_transform(range(0, n + 1), lambda p: p || '|' || array_to_string(ws[1:p], ' ') || '|' || array_to_string(ws[p + 1:n], ' ')),
            list_transform(range(0, n), lambda p: p || '|' || array_to_string(ws[1:p], ' ') || '|' || array_to_string(ws[p + 2:n], ' ')))) AS pat FROM firsts WHERE n >= {line_dedup.MIN_WORDS}),
        near AS (SELECT DISTINCT spot FROM (SELECT spot, min(spot) OVER (PARTITION BY pat) AS earliest FROM pats) WHERE earliest < spot),
        gone AS (SELECT doc_id, i, spots.spot = firsts.spot AS near FROM spots JOIN firsts USING (ws) WHERE spots.spot > firsts.spot OR spots.spot IN (SELECT spot FROM near)),
        sums AS (SELECT doc_id, count(*) FILTER (NOT near) AS n_exact, count(*) FILTER (near) AS n_near, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS dropped FROM gone GROUP BY 1)
        SELECT doc_id, CAST(len(own) AS BIGINT) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, len(own) - coalesce(n_exact, 0) - coalesce(n_near, 0) AS n_kept, coalesce(dropped, '') AS dropped
        FROM d LEFT JOIN sums USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_A_TO_Z})) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op5_quality": _quality_sql(),
    "op7_secrets": _secrets_sql(),
    "op8_mixing": _mixing_sql(),
    "op1_licenses": _licences_sql(),
    "op9_minhash": _near_sql(),
    "op10_line_dedup": _lines_sql(),
}

"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

import re

from .licenses import BASE, NOTICES, TEXTS, words
from .quality_rules import STOP_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_BLANK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
starts AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT a.rid, a.p, a.n, b.item
  FROM (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM places) a JOIN windows b ON a.g = b.g AND a.n = b.n),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

ORACLES["op3_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k, len({_BLANK_WORDS}) AS n, source FROM documents),
s AS (SELECT k, any_value(source) AS source, CAST(sum(n) AS BIGINT) AS t FROM d GROUP BY k),
top AS (SELECT max(t) AS top, count(*) AS c FROM s WHERE t > 0),
grid AS (
  SELECT g, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS h, max(m / p) AS r
  FROM (SELECT g, t / top AS p, pow(t / top, g / 1048576.0) AS m FROM range(0, 1048577) AS x(g), s, top WHERE t > 0) GROUP BY g),
a AS (
  SELECT greatest(
    (SELECT coalesce(max(g), 0) FROM grid, top WHERE h >= 0.95 * ln(c) - 1e-12),
    (SELECT coalesce(min(g), 1048576) FROM grid WHERE r <= 4 + 1e-12)) / 1048576.0 AS a),
b AS (SELECT k, source, t, CASE WHEN t > 0 THEN CAST(round(top * pow(t / top, a)) AS BIGINT) ELSE 0 END AS b FROM s, top, a),
e AS (SELECT *, CASE WHEN t > 0 THEN b // t ELSE 1 END AS e, CASE WHEN t > 0 THEN b % t ELSE 0 END AS q FROM b),
r AS (SELECT d.doc_id, d.n, e.*, md5('mix/' || e || '/' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS last FROM d JOIN e USING (k)),
taken AS (
  SELECT k, max(last) AS last_place
  FROM (SELECT k, last, q, coalesce(sum(n) OVER (PARTITION BY k ORDER BY last, doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE q > 0)
  WHERE before < q GROUP BY k),
copies AS (
  SELECT doc_id, n, k, source, t, b, unnest(range(0, e + CASE WHEN last <= last_place THEN 1 ELSE 0 END)) AS epoch
  FROM r LEFT JOIN taken USING (k)),
placed AS (SELECT *, md5('mix/' || epoch || '/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM copies),
reached AS (
  SELECT *, epoch * t + coalesce(sum(n) OVER (PARTITION BY k, epoch ORDER BY place, doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at"
  FROM placed),
nb AS (SELECT greatest(1, CAST(ceil(sum(b) / 1000000.0) AS BIGINT)) AS blocks FROM b),
blocked AS (
  SELECT *, CAST(CASE WHEN b > 0 THEN least((CAST("at" AS HUGEINT) * blocks) // b, blocks - 1) ELSE 0 END AS BIGINT) AS block FROM reached, nb)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, CAST(n AS BIGINT) AS n_tokens, block,
  CAST(row_number() OVER (PARTITION BY block ORDER BY md5('mix/block/' || epoch || '/' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, k, n) - 1 AS BIGINT) AS slot
FROM blocked
"""

ORACLES["op5_sharding"] = """
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(0, 256) AS x(i)
  UNION ALL SELECT i, xor(v >> 1, (v & 1) * 3988292384), k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size,
    substr(md5(coalesce(text, '')), 1, 15) AS h, hex(encode(coalesce(text, ''))) AS x FROM documents),
crc AS (
  SELECT rid, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1, 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM d, crcs),
placed AS (SELECT *, sum(size) OVER o - size AS before, row_number() OVER o AS number FROM d WINDOW o AS (ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, CAST(before * 8 // (SELECT sum(size) FROM d) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY number) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut JOIN crc USING (rid)
"""

ORACLES["op7_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, {_BLANK_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
windows AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS times FROM places),
repeated AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE times > 1) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•*]'))) AS BIGINT) AS n_bullet_lines
  FROM d LEFT JOIN repeated USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND 100 * word_chars >= 200 * n_words AND 100 * word_chars <= 1500 * n_words
  AND 100 * n_symbols <= 20 * n_words AND 100 * n_stop_words >= 2 * n_words
  AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_ellipsis_lines <= 50 * n_lines AND 100 * n_bullet_lines <= 90 * n_lines AS kept
FROM m
"""


def _template_pattern(markup: str) -> str:
    """A template as a regular expression over words that are each followed by a blank, and marked by # after a denial."""
    out, at, first = " ", 0, True
    for mark in [*re.finditer(r"<<(.*?)>>", markup), None]:
        for w in words(markup[at:mark.start()] if mark else markup[at:]):
            out += f"{w} " if first else f"#?{w} "
            first = False
        if mark is None:
            return out
        at = mark.end()
        if mark[1] == "beginOptional":
            out += "(?:"
        elif mark[1] == "endOptional":
            out += ")?"
        else:
            bounds = dict(re.findall(r"(min|max)=(\d+)", mark[1]))
            out += f"(?:[^ ]+ ){{{bounds['min']},{bounds['max']}}}"


_PLACES = {label: "list_filter(range(1, len(w)), lambda i: " + " AND ".join(
    f"w[i + {k}] = '{w}'" for k, w in enumerate(words(phrase))) + ")" for phrase, label in BASE}
_BASE_LABELS = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in _PLACES.items())
def _template_labels(templates: tuple) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(line, '{_template_pattern(m)}') THEN '{label}' END" for label, m in templates)



ORACLES["op2_licenses"] = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
lines AS (SELECT *, regexp_replace(' ' || array_to_string(w, ' ') || ' ', ' (not|never) ', ' \\1 #', 'g') AS line, list_concat({", ".join(_PLACES.values())}) AS places FROM d),
found AS (
  SELECT *, list_filter([{_BASE_LABELS}], lambda x: x IS NOT NULL) AS b, list_filter([{_template_labels(TEXTS)}], lambda x: x IS NOT NULL) AS t,
    list_filter([{_template_labels(NOTICES)}], lambda x: x IS NOT NULL) AS n
  FROM lines)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(b, list_concat(t, n)))), ',') AS labels,
  CASE WHEN len(t) > 0 THEN 1.0::DOUBLE WHEN len(n) > 0 THEN 0.75::DOUBLE WHEN len(b) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM found
"""

ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
c AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
        OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""

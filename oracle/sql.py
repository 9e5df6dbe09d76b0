"""DuckDB SQL that computes what the Spark operators compute, written from the rules alone.

Nothing here knows of gates, hits or prefix sums in blocks: every regex runs on every
text, and positions are plain sums over lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from leaksieve.catalogue import RULES, Rule
from leaksieve.functions.text import ENTITIES
from leaksieve.operators import contexts as ctx
from leaksieve.operators import filters as flt
from leaksieve.operators import links as lnk


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


DOCUMENTS = """SELECT CAST(doc_id AS VARCHAR) AS unit_id, concat(source, '/', CAST(doc_id AS VARCHAR)) AS uri,
  'raw' AS context, text, source, doc_id FROM documents"""
CONVERSATIONS = """SELECT concat(CAST(conv_id AS VARCHAR), '/', CAST(turn AS VARCHAR)) AS unit_id,
  concat('conv/', CAST(conv_id AS VARCHAR), '/', CAST(turn AS VARCHAR)) AS uri, 'raw' AS context, text, role FROM conversations"""


def detect(units: str, rules: Sequence[Rule] = RULES, keep: Sequence[str] = (), named: str = "true", names_once: bool = False) -> str:
    """A query over ``units`` (a query itself) with the raw finding columns.

    Rules on names look at the units that are ``named``, or with ``names_once`` at each name once, with its least unit.
    """
    kept = "".join(f", {c}" for c in keep)
    parts = []
    for rule in rules:
        subject = "uri" if rule.target == "uri" else "text"
        source = f"(SELECT * FROM u WHERE {named})" if rule.target == "uri" else "u"
        if names_once and rule.target == "uri":
            first = "".join(f", '' AS text" if c == "text" else f", arg_min({c}, unit_id) AS {c}" for c in keep if c != "uri")
            source = f"(SELECT uri, 'uri' AS context, min(unit_id) AS unit_id{first} FROM u GROUP BY uri)"
        context = "'uri'" if rule.target == "uri" else "context"
        re = lit(rule.regex)
        bounded = f"WHERE NOT regexp_matches(substring(subj, \"end\" + 1, 1), '[A-Za-z0-9_]')" if rule.bounded else ""
        bounded = f"WHERE substring(subj, \"end\" + 1, 1) = {lit(rule.followed)}" if rule.followed else bounded
        parts.append(f"""
SELECT uri, type, value, start, "end", context, unit_id, rule_id{kept} FROM (
  SELECT *, start + length(value) AS "end" FROM (
    SELECT uri, {lit(rule.type)} AS type, v[i] AS value, {context} AS context, unit_id, {lit(rule.rule_id)} AS rule_id{kept}, subj,
      CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)
        + length(l[i]) AS BIGINT) AS start
    FROM (
      SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT uri, context, unit_id{kept}, {subject} AS subj, regexp_extract_all({subject}, {re}, 0) AS m,
          regexp_extract_all({subject}, {re}, 1) AS l, regexp_extract_all({subject}, {re}, 2) AS v,
          string_split_regex({subject}, {re}) AS gaps
        FROM {source} WHERE regexp_matches({subject}, {re})))) {bounded})""")
    return f"WITH u AS MATERIALIZED ({units}) " + " UNION ALL ".join(parts)


def masked(findings: str) -> str:
    return f"""SELECT * EXCLUDE (value),
  CASE WHEN length(value) >= 16 THEN concat(left(value, 4), '...', right(value, 4)) ELSE '***' END AS value_masked,
  sha256(value) AS fingerprint FROM ({findings})"""


def noise_free(findings: str) -> str:
    words = " OR ".join(f"contains(lower(value), {lit(w)})" for w in flt.PLACEHOLDER_WORDS)
    return f"""SELECT * FROM ({findings}) WHERE NOT ({words} OR replace(value, left(value, 1), '') = ''
  OR regexp_matches(value, {lit(flt.VARIABLE)}))"""


def best(findings: str, rules: Sequence[Rule] = RULES) -> str:
    ranks = " ".join(f"WHEN {lit(r.rule_id)} THEN {r.rank}" for r in rules)
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, uri, context, start, "end"
  ORDER BY CASE rule_id {ranks} END, rule_id) AS rn FROM ({findings})) WHERE rn = 1"""


def decode(text: str) -> str:
    """Entity decoding of a SQL expression."""
    out = f"regexp_replace({text}, '&#(?:0*38|[xX]0*26);', '&amp;', 'g')"
    out = f"""list_reduce(list_prepend({out}, list_distinct(regexp_extract_all({out}, '&#([0-9]{{1,7}});', 1))), lambda acc, d:
      CASE WHEN CAST(d AS INTEGER) BETWEEN 32 AND 126 THEN replace(acc, concat('&#', d, ';'), chr(CAST(d AS INTEGER))) ELSE acc END)"""
    hexes = f"list_distinct(regexp_extract_all({out}, '&#[xX]([0-9A-Fa-f]{{1,6}});', 1))"
    out = f"""list_reduce(list_prepend({out}, {hexes}), lambda acc, d: CASE WHEN CAST(concat('0x', d) AS INTEGER) BETWEEN 32 AND 126
      THEN replace(replace(acc, concat('&#x', d, ';'), chr(CAST(concat('0x', d) AS INTEGER))), concat('&#X', d, ';'), chr(CAST(concat('0x', d) AS INTEGER)))
      ELSE acc END)"""
    for name, char in ENTITIES:
        out = f"replace({out}, {lit(name)}, {lit(char)})"
    return f"replace({out}, '&amp;', '&')"


def elements(html: str, name: str) -> str:
    """Elements with their open tags: what precedes each close tag, from the first open tag on."""
    pieces = f"string_split_regex({html}, {lit(ctx.CLOSE % name)})"
    opened = lit(ctx.OPEN % name + ".*")
    return f"list_filter(list_transform({pieces}[1:-2], lambda p: regexp_extract(p, {opened}, 0)), lambda e: e <> '')"


def body(element: str, name: str) -> str:
    return f"regexp_replace({element}, {lit(chr(92) + 'A' + ctx.OPEN % name)}, '')"


def decode_markup(html: str) -> str:
    close, opened = lit(ctx.CLOSE % ctx.RAW), lit(ctx.OPEN % ctx.RAW + ".*")
    raw = f"(CASE WHEN z[2] IS NULL THEN '' ELSE regexp_extract(z[1], {opened}, 0) END)"
    outside = f"left(z[1], length(z[1]) - length({raw}))"
    return f"""array_to_string(list_transform(list_zip(string_split_regex({html}, {close}), regexp_extract_all({html}, {close}, 0)),
      lambda z: concat({decode(outside)}, {raw}, coalesce(z[2], ''))), '')"""


def unescape_json(text: str) -> str:
    codes = f"list_distinct(regexp_extract_all({text}, {lit(ctx.JSON_CODE)}, 1))"
    return f"""replace(list_reduce(list_prepend({text}, {codes}), lambda acc, d:
      replace(acc, concat('\\u00', d), chr(CAST(concat('0x', d) AS INTEGER)))), '\\/', '/')"""


def context_texts(context: str, html: str = "html") -> str:
    def every(pattern: str, of: str = html) -> str:
        return f"regexp_extract_all({of}, {lit(pattern)}, 1)"

    scripts = elements(html, "script")
    if context == "script":
        return f"list_transform({scripts}, lambda e: {body('e', 'script')})"
    if context == "css":
        return f"list_transform({elements(html, 'style')}, lambda e: {body('e', 'style')})"
    if context == "handler":
        return f"list_transform(list_concat({every(ctx.HANDLER_DOUBLE)}, {every(ctx.HANDLER_SINGLE)}), lambda h: {decode('h')})"
    if context == "meta":
        return f"list_transform({every(ctx.META)}, lambda h: {decode('h')})"
    if context == "config":
        ends = f"list_transform(string_split_regex({body('s', 'script')}, {lit(ctx.CONFIG)})[2:], lambda p: regexp_extract(p, {lit(ctx.LAST_BRACE)}, 1))"
        return f"flatten(list_transform({scripts}, lambda s: list_transform(list_filter({ends}, lambda x: x <> ''), lambda x: concat('{{', x))))"
    if context == "json":
        json = f"list_transform(list_filter({scripts}, lambda e: regexp_matches(e, {lit(ctx.JSON_TYPE)})), lambda e: {body('e', 'script')})"
        found = f"list_concat({json}, CASE WHEN regexp_matches({html}, {lit(ctx.JSON_BODY)}) THEN [{html}] ELSE [] END)"
        return f"list_transform({found}, lambda j: {unescape_json('j')})"
    return f"[{decode_markup(html)}]"


def contexts(only: Sequence[str] = ctx.CONTEXTS, pages: str = "SELECT * FROM pages", keep: Sequence[str] = ()) -> str:
    kept = "".join(f", {c}" for c in keep)
    parts = [
        f"""SELECT concat(CAST(page_id AS VARCHAR), ':{c}:', CAST(i - 1 AS VARCHAR)) AS unit_id, url AS uri, '{c}' AS context, t[i] AS text{kept}
  FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, url{kept}, {context_texts(c)} AS t FROM ({pages}))) WHERE t[i] <> ''"""
        for c in only
    ]
    order = f"list_position([{', '.join(map(lit, only))}], context), CAST(split_part(unit_id, ':', 3) AS INTEGER)"
    return f"""SELECT *, row_number() OVER (PARTITION BY uri, split_part(unit_id, ':', 1) ORDER BY {order}) = 1 AS named FROM ({" UNION ALL ".join(parts)})"""


def name_of(uri: str) -> str:
    return f"(CASE WHEN regexp_matches({uri}, {lit(flt.URL)}) AND NOT starts_with({uri}, 'file:') THEN regexp_extract({uri}, {lit(flt.URL)}, 1) ELSE {uri} END)"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"


def address(url: str) -> str:
    return f"regexp_replace({url}, '#[^\\n]*\\z', '')"


def links(pages: str = "SELECT * FROM pages") -> str:
    patterns = ", ".join(f"regexp_extract_all(html, {lit(p)}, 1)" for p in (lnk.REFERENCE_DOUBLE, lnk.REFERENCE_SINGLE, lnk.REFERENCE_PLAIN))
    origin = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
    return f"""SELECT DISTINCT src, CASE WHEN regexp_matches(raw, '/[.]') THEN concat(lead, '/', array_to_string(CASE WHEN segments[-1] IN ('.', '..')
      THEN list_append(kept, '') ELSE kept END, '/'), tail) ELSE raw END AS dst
  FROM (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(segments[2:], lambda s: [s])), lambda acc, s:
      CASE s[1] WHEN '.' THEN acc WHEN '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, s) END) AS kept
  FROM (SELECT *, string_split(path, '/') AS segments, substring(rest, length(path) + 1) AS tail
  FROM (SELECT *, regexp_extract(rest, '^[^?#]*') AS path
  FROM (SELECT src, raw, regexp_extract(raw, '{origin}') AS lead, regexp_replace(raw, '{origin}', '') AS rest
  FROM (SELECT src, CASE
    WHEN ref = '' THEN NULL
    WHEN regexp_matches(ref, '^(?i:https?)://') THEN ref
    WHEN starts_with(ref, '//') THEN concat(regexp_extract(src, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1), ref)
    WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(ref, '/') THEN concat(regexp_extract(src, '{origin}'), ref)
    WHEN starts_with(ref, '?') THEN concat(regexp_replace(src, '[?][^\\n]*\\z', ''), ref)
    ELSE concat(regexp_replace(regexp_replace(src, '[?][^\\n]*\\z', ''), '[^/]*\\z', ''), ref) END AS raw
  FROM (SELECT src, regexp_replace(trim({decode('r')}), '#[^\\n]*\\z', '') AS ref FROM (
    SELECT {address('url')} AS src, unnest(list_concat(list_concat({patterns.split(", regexp")[0]}, regexp{patterns.split(", regexp")[1]}), regexp{patterns.split(", regexp")[2]})) AS r
    FROM ({pages}))))
  WHERE raw IS NOT NULL))))"""

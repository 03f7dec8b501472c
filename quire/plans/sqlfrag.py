"""DuckDB SQL fragments for the oracle queries.

The oracle is a second, independent evaluation of each query by another
engine.  Regexes come from the same fixed pattern table, translated to RE2.
"""

from __future__ import annotations

from quire.functions import patterns as P

WS = P.WS_CLASS


def q(s: str) -> str:
    return P.sql_str(s)


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def normalize_ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(WS + '+')}, ' ', 'g'))"


def rfind(x: str, needle: str) -> str:
    """0-based index of the last `needle` in x, -1 if absent (RE2 greedy)."""
    import re
    pat = "(?s)^.*" + re.escape(needle).replace("\\\n", "\\n")
    return f"(length(regexp_extract({x}, {q(pat)}, 0)) - {len(needle)})"


def words(x: str) -> str:
    s = py_strip(f"lower({x})")
    return (f"(CASE WHEN {s} = '' THEN []::VARCHAR[] "
            f"ELSE string_split_regex({s}, {q(WS + '+')}) END)")


def case_map(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {q(default)} END)"


def pattern_spans(text: str, pii_type: str, pattern: str, order: int, conf: float = P.REGEX_CONFIDENCE) -> str:
    rp = q(P.re2_regex(pattern))
    m = f"regexp_extract_all({text}, {rp})"
    g = f"string_split_regex({text}, {rp})"
    start = (f"(coalesce(list_sum(list_transform(list_slice({g}, 1, i), lambda z: length(z))), 0)"
             f" + coalesce(list_sum(list_transform(list_slice({m}, 1, i - 1), lambda z: length(z))), 0))")
    return (f"list_transform({m}, lambda x, i: {{'start': CAST({start} AS INTEGER), 'neg_conf': {-conf},"
            f" 'ord': {order}, 'type': {q(pii_type)}, 'end': CAST({start} + length(x) AS INTEGER),"
            f" 'text': x}})")


SPAN_STRUCT = "STRUCT(start INTEGER, neg_conf DOUBLE, ord INTEGER, type VARCHAR, \"end\" INTEGER, text VARCHAR)"


def candidates(text: str) -> str:
    parts = [pattern_spans(text, ty, pat, i) for i, (ty, pat) in enumerate(P.PII_PATTERNS)]
    return "list_sort(list_concat(" + ", ".join(parts) + "))"


def resolve(cands: str) -> str:
    return (f"list_reduce({cands}, lambda acc, s: CASE WHEN len(acc) = 0 OR s.start >= acc[-1].\"end\" "
            f"THEN list_append(acc, s) ELSE acc END, []::{SPAN_STRUCT}[])")


def mask_label(t: str) -> str:
    return case_map(t, P.MASK_LABELS, P.MASK_DEFAULT)


def hash_token(s: str, salt: str) -> str:
    prefix = case_map(f"{s}.type", P.HASH_PREFIXES, P.HASH_DEFAULT)
    return (f"('[' || {prefix} || ':' || substring(sha256({salt} || ':' || {s}.text || ':' || {s}.type), 1, 8)"
            f" || ']')")


def rebuild(text: str, spans: str, repl) -> str:
    """Text with each span replaced (spans disjoint, ascending)."""
    prev_end = f"(CASE WHEN i = 1 THEN 0 ELSE {spans}[i - 1].\"end\" END)"
    body = (f"array_to_string(list_transform({spans}, lambda s, i: substring({text}, {prev_end} + 1, "
            f"s.start - {prev_end}) || {repl('s')}), '')")
    last_end = f"coalesce({spans}[-1].\"end\", 0)"
    return f"(coalesce({body}, '') || substring({text}, {last_end} + 1))"


def embed_ctes(name: str, src: str, id_col: str, text_col: str, dim: int) -> str:
    """CTEs computing the hash embedding (V2) of `src`.`text_col`:
    `{name}` (id, dim_index, value FLOAT) and `{name}_vec` (id, v FLOAT[])."""
    h = "md5(w)"
    return (
        f"{name}_tok AS (SELECT {id_col} AS id, unnest({words(text_col)}) AS w FROM {src}), "
        f"{name}_agg AS (SELECT id, CAST(('0x' || substr({h}, 1, 8))::UBIGINT % {dim} AS INTEGER) AS b, "
        f"sum(CASE WHEN substr({h}, 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s "
        f"FROM {name}_tok GROUP BY ALL), "
        f"{name}_full AS (SELECT x.{id_col} AS id, r.i AS dim_index, coalesce(a.s, 0.0::DOUBLE) AS raw "
        f"FROM {src} x CROSS JOIN range(0, {dim}) r(i) LEFT JOIN {name}_agg a ON a.id = x.{id_col} AND a.b = r.i), "
        f"{name}_n AS (SELECT id, sqrt(sum(raw * raw)) AS n FROM {name}_full GROUP BY id), "
        f"{name} AS (SELECT f.id, f.dim_index, CAST(CASE WHEN n.n > 0 THEN f.raw / n.n ELSE f.raw END AS FLOAT) "
        f"AS value FROM {name}_full f JOIN {name}_n n ON n.id = f.id), "
        f"{name}_vec AS (SELECT id, list(value ORDER BY dim_index) AS v FROM {name} GROUP BY id)")


def normalize_sql(raw: str) -> str:
    nrm = f"sqrt(list_sum(list_transform({raw}, lambda x: x::DOUBLE * x::DOUBLE)))"
    return (f"list_transform({raw}, lambda x: CAST(CASE WHEN {nrm} > 0 THEN x::DOUBLE / {nrm} "
            f"ELSE x::DOUBLE END AS FLOAT))")


def sq_l2(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: "
            f"({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))")


def round6(x: str) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0)"


def _nfkd_map_sql() -> str:
    """Oracle stand-in for NFKD (DuckDB has none): a MAP from every code
    point of U+00A0-U+024F and the letterlike/number-form blocks whose NFKD
    differs, to that NFKD, generated by rule from Python's unicodedata.
    Exact for text whose non-ASCII characters lie in those blocks."""
    import unicodedata
    cps = list(range(0xA0, 0x250)) + list(range(0x2100, 0x2190))
    pairs = []
    for cp in cps:
        ch = chr(cp)
        d = unicodedata.normalize("NFKD", ch)
        if d != ch:
            pairs.append(f"{q(ch)}: {q(d)}")
    return "MAP {" + ", ".join(pairs) + "}"


def nfkd(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ''), "
            f"lambda c: coalesce({_nfkd_map_sql()}[c], c)), '')")

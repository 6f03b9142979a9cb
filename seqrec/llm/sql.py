"""DuckDB SQL of the registered queries that SQL can express; patterns and limits come from the operators."""

from __future__ import annotations

from seqrec.llm import quality, secrets

WORDS = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP2 = """WITH RECURSIVE V AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
G AS (SELECT vec_id, v FROM V WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_sum(list_transform(v, lambda x: x * x)) > 0),
L AS (SELECT a.vec_id AS a, b.vec_id AS b FROM G a JOIN G b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
R(a, b) AS (SELECT a, b FROM L UNION SELECT r.a, l.b FROM R r JOIN L l ON r.b = l.a),
N AS (SELECT a, count(*) AS n FROM L GROUP BY a), C AS (SELECT a, min(b) AS m FROM R GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM V LEFT JOIN N ON N.a = vec_id LEFT JOIN C ON C.a = vec_id"""


def quality_sql(rules: quality.LineRules = quality.LineRules()) -> str:
    """op5: windows and lines as rows; separators are words that consist of separator marks alone."""
    separator = r"^[|»›•·/>:~-]{1,2}$"
    return f"""WITH D AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
W AS (SELECT *, regexp_extract_all(text, {_text(WORDS)}) AS w FROM D),
G AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM W WHERE len(w) >= 5)),
A AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM G) WHERE c > 1),
P AS (SELECT r, count(DISTINCT i + k) AS n FROM A, (SELECT unnest(range(5)) AS k) GROUP BY r),
LL AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM D),
L AS (SELECT r, l, regexp_extract_all(l, {_text(WORDS)}) AS lw FROM LL),
B AS (SELECT r, l, len(lw) AS n, len(list_filter(lw, lambda x: regexp_matches(x, {_text(separator)}))) AS seps,
             len(regexp_extract_all(l, {_text(quality.SYMBOLS)})) AS syms, len(regexp_extract_all(l, '!!+')) AS shouts FROM L),
F AS (SELECT *, n > 0 AND ((seps >= {rules.separators} * n AND seps >= 2) OR regexp_matches(l, {_text(quality.MENU)}) OR regexp_matches(l, {_text(quality.BOILERPLATE)})
             OR (n >= {rules.rule_words} AND syms > 0 AND syms >= {rules.symbols} * n) OR (n >= {rules.rule_words} AND shouts > 0 AND shouts >= {rules.shouts} * n)
             OR (NOT regexp_matches(l, {_text(quality.STOP)}) AND n >= {rules.stopless_words})) AS bad FROM B),
S AS (SELECT r, count(*) FILTER (WHERE n > 0) - count(DISTINCT l) FILTER (WHERE n > 0) AS dup, coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS kept_words FROM F GROUP BY r),
O AS (SELECT W.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, {_text(quality.SYMBOLS)})) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
             CAST(coalesce(P.n, 0) AS BIGINT) AS n_repeat_words, CAST(kept_words AS BIGINT) AS n_words_left
      FROM W LEFT JOIN P ON P.r = W.r JOIN S ON S.r = W.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_left >= 0.5 * n_words AND n_words_left >= 10 AS kept, n_words_left FROM O"""


# Rule pem without possessive quantifiers and look-aheads, which DuckDB's patterns lack: a body holds no run of five dashes, and the last base64
# line takes the end of its line along, which _TAIL cuts off again.
_GAP, _CODE, _EOL = r"""(?:[\x20\t\n\x0B\f\r>#*|"',]|\\[nr]|\+[\x20\t\n\x0B\f\r])*""", "[A-Za-z0-9+/=]", r"""[\x20\t"',]*(?:\\[nr]|[\r\n]|\z)"""
PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]*PRIVATE KEY-----|"
       rf"(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:(?:{_GAP}(?:{_CODE}{{32,}}|{_CODE}{{16,}}{_EOL}))+(?:{_GAP}{_CODE}+{_EOL})?)?)")
_TAIL = rf"({_CODE})" + r"""(?:[\x20\t"',\r\n]|\\[nr])+\z"""


def _pattern(rule: secrets.Rule) -> str:
    return PEM if rule.kind == "pem" else rule.pattern


def _hits(rule: secrets.Rule) -> str:
    """The matches, without what the pattern above takes too much."""
    hits = f"regexp_extract_all(text, {_text(_pattern(rule))})"
    return f"list_transform({hits}, lambda h: regexp_replace(h, {_text(_TAIL)}, '\\1'))" if rule.kind == "pem" else hits


def secrets_sql() -> str:
    """op8: a match begins after all pieces and matches before it, pieces being what splitting at the pattern leaves."""
    parts = "\nUNION ALL ".join(
        f"""SELECT r, {no} AS no, '{rule.kind}' AS kind, string_split_regex(text, {_text(_pattern(rule))}) AS gaps, regexp_extract_all(text, {_text(_pattern(rule))}) AS taken, {_hits(rule)} AS hits,
       regexp_extract_all(text, {_text(_pattern(rule))}, {rule.group}) AS parts, {rule.least} AS least FROM D WHERE regexp_matches(text, {_text(_pattern(rule))})"""
        for no, rule in enumerate(secrets.RULES))
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE no = {no}) AS BIGINT) AS n_{rule.kind}" for no, rule in enumerate(secrets.BASE))
    return f"""WITH D AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
M AS ({parts}),
K AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM M),
X AS (SELECT r, no, kind, CAST(length(array_to_string(gaps[1:k], '')) + length(array_to_string(taken[1:k], '')) - length(taken[k]) + length(hits[k]) AS BIGINT) AS e, length(hits[k]) AS n
      FROM K WHERE length(parts[k]) >= least),
Y AS (SELECT r, no, e - n AS s, kind || ':' || (e - n) || ':' || e AS span FROM X),
Z AS (SELECT r, {counts}, string_agg(span, ',' ORDER BY s, no) FILTER (WHERE no < {len(secrets.BASE)}) AS base, string_agg(span, ',' ORDER BY s, no) AS spans FROM Y GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{rule.kind}, 0) AS n_{rule.kind}' for rule in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM D LEFT JOIN Z ON Z.r = D.r"""


SQL = {"op2_multi_index": OP2, "op5_quality": quality_sql(), "op8_secrets": secrets_sql()}


def lloyd_sql(positions: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """op11: every round assigns all parts to the nearest entry and averages them; squared distances of integers are exact in doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""A{r} AS (SELECT r, p, x, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
  SELECT P.r, P.p, P.x, B.e, list_sum(list_transform(list_zip(P.x, B.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM P JOIN B{r} B ON B.p = P.p) GROUP BY r, p, x)""")
        if r < rounds:
            steps.append(f"""M{r} AS (SELECT p, e, list(m ORDER BY j) AS x FROM (
  SELECT p, e, j, CAST(floor(sum(v) / count(*)) AS DOUBLE) AS m FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM A{r}) GROUP BY p, e, j) GROUP BY p, e),
B{r + 1} AS (SELECT B.p, B.e, coalesce(M.x, B.x) AS x FROM B{r} B LEFT JOIN M{r} M ON M.p = B.p AND M.e = B.e)""")
    return f"""WITH V AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: floor({scale} * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
P AS (SELECT r, p, x[p * (len(x) // {positions}) + 1:(p + 1) * (len(x) // {positions})] AS x FROM V, (SELECT unnest(range({positions})) AS p)),
S AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM V),
B0 AS (SELECT p, e, x FROM P JOIN S ON S.r = P.r AND S.e < {entries}),
{''',
'''.join(steps)},
C AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM A{rounds} GROUP BY r),
L AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM C JOIN V ON V.r = C.r GROUP BY label),
K AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM B{rounds}))
SELECT vec_id, code, error, label_error, h AS codebooks_sha256 FROM C JOIN V ON V.r = C.r JOIN L ON L.label IS NOT DISTINCT FROM V.label, K"""


SQL["op11_resident_lloyd"] = lloyd_sql()

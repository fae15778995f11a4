"""DuckDB SQL with the results of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .decontaminate import UNITS

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                            ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
    ), u AS (SELECT doc_id, unnest(sh) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    one AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
    link AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.c AS component_id
    FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = s.doc_id
"""

PHRASES = f"""
    WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
    win AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda i: array_to_string(ws[i:i + 49], ' '))) AS g FROM w WHERE len(ws) >= 50),
    own AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN own USING (g) WHERE first < doc_id),
    word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS x FROM w),
    kept AS (SELECT word.doc_id AS doc_id, count(gone.k) AS n, string_agg(x, ' ' ORDER BY word.k) FILTER (gone.k IS NULL) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY 1)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Kind, pattern, and for the first one the group that needs six characters. Runs that are long enough are matched at once.
_FOUND = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2),
    ("access", "AKIA[A-Z0-9]{16,}", 0),
    ("hex", "[0-9a-f]{24,}", 0),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
    ("hub", "gh[pousr]_[A-Za-z0-9]{36,}", 0),
)


def _spans(rank: int, kind: str, pattern: str, group: int) -> str:
    """Spans of a kind: the lengths of the pieces between its matches, and of the matches, give the places."""
    p = _quoted(pattern)
    m, part = f"regexp_extract_all(text, {p})", f"string_split_regex(text, {p})"
    keep = f"length(regexp_extract(m[k], {p}, {group})) >= 6" if group else "true"
    before = "coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)"
    return f"""
        SELECT doc_id, {rank} AS rank, '{kind}' AS kind, CAST({before} AS BIGINT) AS a, CAST({before} + length(m[k]) AS BIGINT) AS b
        FROM (SELECT doc_id, {m} AS m, {part} AS p, unnest(range(1, len({m}) + 1)) AS k FROM t) WHERE {keep}"""


_SHOWN = "kind || ':' || a || ':' || b, ',' ORDER BY a, rank"
SECRETS = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({" UNION ALL ".join(_spans(k, *r) for k, r in enumerate(_FOUND))}),
    g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {k}) AS n_{r[0]}" for k, r in enumerate(_FOUND[:3]))},
                 string_agg({_SHOWN}) FILTER (rank < 3) AS base, string_agg({_SHOWN}) AS spans FROM s GROUP BY doc_id)
    SELECT t.doc_id, {", ".join(f"coalesce(n_{r[0]}, 0) AS n_{r[0]}" for r in _FOUND[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN g ON g.doc_id = t.doc_id
"""

_UNIT = f"(after AND own IN ({', '.join(map(_quoted, UNITS))}))"
_AT = "doc_id, item_id, lit"
LEAKS = rf"""
    WITH src AS (SELECT 0 AS item, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT DISTINCT 1, item_id, coalesce(text, '') FROM benchmark),
    raw AS (SELECT item, id, regexp_extract_all(text, '\p{{N}}[\p{{N}}.,]*|[\p{{L}}\p{{M}}]+|[$€£%]') AS ws FROM src),
    tok AS (SELECT item, id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM raw),
    seen AS (SELECT *, lower(w) AS own, regexp_matches(w, '^\p{{N}}') AS num, lag(regexp_matches(w, '^\p{{N}}'), 1, false) OVER (PARTITION BY item, id ORDER BY i) AS after FROM tok),
    slots AS (
        SELECT item, id, i, own, CASE WHEN regexp_matches(w, '^[a-z]') THEN CASE WHEN {_UNIT} THEN 3 ELSE 0 END WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) THEN 2
                                      WHEN num THEN 1 WHEN {_UNIT} THEN 3 ELSE 0 END AS slot FROM seen
    ),
    fresh AS (SELECT *, CASE WHEN slot = 0 OR coalesce(lag(slot) OVER (PARTITION BY item, id ORDER BY i) <> slot, true) THEN 1 ELSE 0 END AS first FROM slots),
    numbered AS (SELECT *, sum(first) OVER (PARTITION BY item, id ORDER BY i) AS j FROM fresh),
    words AS (SELECT item, id, list(own ORDER BY i) AS own, list(slot ORDER BY i) AS slot FROM numbered GROUP BY item, id),
    place AS (SELECT item, id, j, any_value(slot) AS slot, any_value(own) AS own, list(own ORDER BY i) AS fill FROM numbered GROUP BY item, id, j),
    places AS (SELECT item, id, list(CASE WHEN slot > 0 THEN '#' || slot ELSE own END ORDER BY j) AS form, list(slot ORDER BY j) AS slot, list(fill ORDER BY j) AS fill FROM place GROUP BY item, id),
    size AS (SELECT DISTINCT least(len(own), 8) AS n FROM words WHERE item = 1), form_size AS (SELECT DISTINCT least(len(form), 8) AS n FROM places WHERE item = 1),
    win AS (
        SELECT item, id, true AS lit, n, pos, array_to_string(own[pos:pos + n - 1], ' ') AS key, slot[pos:pos + n - 1] AS slot, CAST(NULL AS VARCHAR[][]) AS fill
        FROM (SELECT *, unnest(range(1, len(own) - n + 2)) AS pos FROM words, size WHERE len(own) >= n AND (item = 0 OR n = least(len(own), 8)))
        UNION ALL
        SELECT item, id, false, n, pos, array_to_string(form[pos:pos + n - 1], ' '), slot[pos:pos + n - 1], fill[pos:pos + n - 1]
        FROM (SELECT *, unnest(range(1, len(form) - n + 2)) AS pos FROM places, form_size WHERE len(form) >= n AND (item = 0 OR n = least(len(form), 8)))
    ),
    rich AS (SELECT *, len(list_filter(slot, lambda s: s = 0)) >= least(4, n) AS rich FROM win WHERE item = 1),
    counted AS (SELECT *, count(*) FILTER (rich) OVER (PARTITION BY id, lit) AS rich_n, count(*) OVER (PARTITION BY id, lit) AS all_n FROM rich),
    idx AS (
        SELECT id AS item_id, lit, n, key, pos AS item_at, slot, fill AS item_fill, row_number() OVER (PARTITION BY id, lit ORDER BY pos) AS nth, CASE WHEN rich_n > 0 THEN rich_n ELSE all_n END AS total
        FROM counted WHERE rich OR (lit AND rich_n = 0)
    ),
    hit AS (
        SELECT d.id AS doc_id, x.item_id, x.lit, d.pos - x.item_at AS shift, x.item_at, x.nth, x.total, x.lit OR d.fill = x.item_fill AS same, x.slot, x.item_fill, d.fill
        FROM win d JOIN idx x ON d.item = 0 AND d.lit = x.lit AND d.n = x.n AND d.key = x.key
    ),
    filled AS (SELECT {_AT}, shift, unnest(slot) AS s, unnest(item_fill) AS a, unnest(fill) AS b FROM hit WHERE NOT lit),
    pair AS (
        SELECT DISTINCT {_AT}, shift, s, unnest(CASE WHEN len(a) = len(b) THEN a ELSE ['=' || array_to_string(a, ' ')] END) AS a,
               unnest(CASE WHEN len(a) = len(b) THEN b ELSE ['=' || array_to_string(b, ' ')] END) AS b FROM filled WHERE s > 0
    ),
    fits AS (SELECT {_AT}, shift, count(*) = count(DISTINCT (s, a)) AND count(*) = count(DISTINCT (s, b)) AS ok FROM pair GROUP BY ALL),
    one AS (SELECT DISTINCT {_AT}, shift FROM hit LEFT JOIN fits USING ({_AT}, shift) WHERE coalesce(ok, true)),
    far AS (SELECT *, CASE WHEN shift - lag(shift) OVER (PARTITION BY {_AT} ORDER BY shift) <= 4 THEN 0 ELSE 1 END AS far FROM one),
    chain AS (SELECT *, sum(far) OVER (PARTITION BY {_AT} ORDER BY shift) AS grp FROM far),
    joint AS (SELECT DISTINCT {_AT}, grp, s, a, b FROM chain JOIN pair USING ({_AT}, shift)),
    whole AS (SELECT {_AT}, grp, count(*) = count(DISTINCT (s, a)) AND count(*) = count(DISTINCT (s, b)) AS ok FROM joint GROUP BY ALL),
    met AS (SELECT {_AT}, grp, shift, item_at, nth, total, bool_or(same) AS same FROM chain JOIN hit USING ({_AT}, shift) GROUP BY ALL),
    tried AS (
        SELECT {_AT}, grp, CAST(shift AS VARCHAR) AS try, item_at, nth, total, same FROM met
        UNION ALL SELECT {_AT}, grp, 'all', item_at, nth, total, bool_or(same) FROM met LEFT JOIN whole USING ({_AT}, grp) WHERE coalesce(ok, true) GROUP BY ALL
    ),
    gap AS (SELECT *, lag(item_at) OVER w AS at_before, lag(nth) OVER w AS nth_before FROM tried WINDOW w AS (PARTITION BY {_AT}, grp, try ORDER BY item_at)),
    judged AS (
        SELECT doc_id, item_id, count(*) FILTER (same) AS v, count(*) AS m, any_value(total) AS total, count(*) + sum(CASE WHEN item_at - at_before < 13 THEN nth - nth_before - 1 ELSE 0 END) AS held
        FROM gap GROUP BY {_AT}, grp, try
    )
    SELECT doc_id, item_id, m AS n_windows, v AS n_verbatim, total AS n_item_windows, true AS consistent
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY v DESC, m DESC, total DESC) AS r FROM judged WHERE held >= total * 0.6) WHERE r = 1
"""

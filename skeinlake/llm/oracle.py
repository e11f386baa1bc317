"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}"
#: A word: a run of letters, marks and digits; characters of scripts without spaces one by one. And what lies between words.
_WORD = rf"(?:[{_ALONE}]\p{{M}}*|(?:[^\P{{L}}{_ALONE}]|\p{{M}}|\p{{N}})+)"
_GAP = r"[^\p{L}\p{M}\p{N}]*"
_WS = r"[ \t\n\r\x0b\x0c]"

#: Lengths of windows, each twice the one before, as far as texts of 1.6 million tokens go.
_LEVELS = [50 * 2**k for k in range(16)]
#: Windows of each length that occur more than once, put together from two of half the length.
_DOUBLED = "".join(
    f"""
    w{n} AS (SELECT a.doc_id, a.i, md5(a.h || b.h) AS h FROM r{n // 2} a JOIN r{n // 2} b ON a.doc_id = b.doc_id AND b.i = a.i + {n // 2}),
    r{n} AS (SELECT * FROM w{n} QUALIFY count(*) OVER (PARTITION BY h) > 1),"""
    for n in _LEVELS[1:]
)
_LONGEST = " UNION ALL ".join(f"SELECT DISTINCT doc_id, {n} AS longest FROM r{n}" for n in _LEVELS)


def _repeats(longest: bool) -> str:
    """Cut every token of a 50-token window that also occurs earlier by (doc_id, position)."""
    levels = f"r50 AS (SELECT doc_id, i, h FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1), {_DOUBLED} l AS (SELECT doc_id, max(longest)::INT AS longest_repeat FROM ({_LONGEST}) GROUP BY doc_id)," if longest else ""
    return rf"""
        WITH d AS (
            SELECT doc_id, text, regexp_extract_all(text, '{_WS[:1]}^{_WS[1:]}+{_WS}*') AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), t AS (
            SELECT doc_id, list_transform(p, lambda x: regexp_replace(x, '{_WS}+$', '')) AS t FROM d
        ), w AS (
            SELECT doc_id, i, md5(array_to_string(list_slice(t, i, i + 49), ' ')) AS h FROM t, unnest(generate_series(1, len(t) - 49)) AS u(i)
        ), {levels} f AS (
            SELECT h, min(struct_pack(doc_id := doc_id, i := i)) AS f FROM w GROUP BY h
        ), g AS (
            SELECT DISTINCT doc_id, k FROM (
                SELECT w.doc_id, unnest(generate_series(w.i, w.i + 49)) AS k FROM w JOIN f USING (h) WHERE w.doc_id <> f.f.doc_id OR w.i <> f.f.i)
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        pieces AS (
            SELECT d.doc_id, k, p[k] AS piece FROM d JOIN n USING (doc_id), unnest(generate_series(1, len(p))) AS u(k)
        ), kept AS (
            SELECT doc_id, string_agg(piece, '' ORDER BY k) AS body FROM pieces WHERE (doc_id, k) NOT IN (SELECT doc_id, k FROM g) GROUP BY doc_id
        )
        SELECT documents.doc_id,
               CASE WHEN n.n IS NULL THEN documents.text ELSE regexp_extract(documents.text, '^{_WS}*') || coalesce(body, '') END AS text,
               lang, source, n_chars, coalesce(n.n, 0)::INT AS removed_tokens{', longest_repeat' if longest else ''}
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id){' LEFT JOIN l USING (doc_id)' if longest else ''}
        WHERE n.n IS NULL OR coalesce(body, '') <> ''
"""


REPEATS, DOUBLED_REPEATS = _repeats(False), _repeats(True)

#: All pairs of three-word shingle sets with Jaccard similarity 0.55, their connected components, and the least of each.
NEAR = rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
    ), s AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS s
        FROM w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS u(i) WHERE len(w) > 0
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= 0.55 * (x.n + y.n - common)),
    t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS v, a AS o FROM t UNION SELECT r.v, t.b FROM r JOIN t ON t.a = r.o),
    c AS (SELECT v, min(o) AS keeper FROM r GROUP BY v),
    k AS (SELECT keeper, count(*) - 1 AS copies FROM c GROUP BY keeper)
    SELECT documents.*, coalesce(copies, 0)::BIGINT AS near_copies
    FROM documents LEFT JOIN c ON v = doc_id LEFT JOIN k ON k.keeper = c.keeper WHERE v IS NULL OR v = c.keeper
"""

#: Common stretches of 5 words of documents and test items, joined to runs: cut are runs of 13 words, and all runs of an item
#: of which they cover 0.6 together.
LEAKS = rf"""
    WITH item AS (
        SELECT DISTINCT regexp_extract_all(lower(nfc_normalize(text)), '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL
    ), it AS (SELECT row_number() OVER () AS item, w FROM item),
    ig AS (SELECT item, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM it, unnest(generate_series(1, len(w) - 4)) AS u(i)),
    d AS (
        SELECT doc_id, text, regexp_extract_all(lower(nfc_normalize(text)), '{_WORD}') AS w, regexp_extract_all(text, '{_WORD}{_GAP}') AS p
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
    ), dg AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, unnest(generate_series(1, len(w) - 4)) AS u(i)),
    hit AS (SELECT doc_id, item, dg.i - ig.i AS shift, dg.i AS i FROM dg JOIN ig USING (g)),
    isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, shift ORDER BY i) AS isle FROM hit),
    run AS (SELECT doc_id, item, shift, min(i) AS s, max(i) + 5 AS e FROM isle GROUP BY doc_id, item, shift, isle),
    place AS (SELECT DISTINCT doc_id, item, unnest(generate_series(s - shift, e - shift - 1)) AS k FROM run),
    cover AS (SELECT doc_id, item, count(*) AS n FROM place GROUP BY doc_id, item),
    leak AS (SELECT doc_id, item FROM cover JOIN it USING (item) WHERE n >= 0.6 * len(w)),
    cut AS (
        SELECT doc_id, s, e FROM run WHERE e - s >= 13 UNION SELECT run.doc_id, s, e FROM run JOIN leak USING (doc_id, item)
    ), g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e - 1)) AS k FROM cut),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    pieces AS (SELECT d.doc_id, k, p[k] AS piece FROM d JOIN n USING (doc_id), unnest(generate_series(1, len(p))) AS u(k)),
    kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY k) AS body FROM pieces ANTI JOIN g USING (doc_id, k) GROUP BY doc_id),
    done AS (
        SELECT documents.doc_id, n.n,
               CASE WHEN n.n IS NULL THEN documents.text ELSE regexp_extract(documents.text, '^{_GAP}') || coalesce(body, '') END AS text,
               lang, source, n_chars
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
    )
    SELECT doc_id, text, lang, source, n_chars, coalesce(n, 0)::INT AS removed_tokens FROM done WHERE n IS NULL OR trim(text) <> ''
"""

"""SQL, for DuckDB, of the numbered queries that SQL can express; constants are the operators' own."""

from __future__ import annotations

from . import quality_rules as q
from . import url_filters as u
from .chat_formatting import END, SAYS, TURN

#: Rounds of wildcards that the SQL unrolls; the operator goes on while new ones appear.
URL_ROUNDS = 3
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


def quality_sql() -> str:
    n = f"len({_WORDS.format('l')})"
    phrases = " OR ".join(f"contains(lower(l), '{p}')" for p in q.BOILERPLATE)
    closing = ", ".join("'" + c.replace("'", "''") + "'" for c in ".!?:;,)]}\"'»”…")
    symbols, shouts, pipes = _count("l", q.SYMBOLS), _count("l", "!"), _count("l", "|")
    fails = f"""(({pipes} >= 2 AND {pipes} * 4 >= {n}) OR ({symbols} >= 3 AND {symbols} >= {n})
      OR ({shouts} >= 3 AND {shouts} >= {n} AND l = upper(l)) OR ({n} >= 8 AND len(list_distinct({_WORDS.format('l')})) * 3 <= {n})
      OR ({n} <= {q.BOILERPLATE_WORDS} AND ({phrases})) OR ({n} <= 3 AND right(rtrim(l, ' '), 1) NOT IN ({closing})))"""
    return f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM b, unnest(range(1, len(w) - 1)) AS r(i)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) AS r(k) GROUP BY doc_id),
    c AS (SELECT b.doc_id, t, len(w) AS n_words, length(translate(t, {_SPACES}, '')) AS word_chars, {_count('t', q.SYMBOLS)} AS n_symbols,
      list_filter(string_split(t, chr(10)), lambda l: length(translate(l, {_SPACES}, '')) > 0) AS full_lines, coalesce(cov.n, 0) AS n_repeat_words,
      array_to_string(list_filter(string_split(t, chr(10)), lambda l: length(translate(l, {_SPACES}, '')) = 0 OR NOT {fails}), chr(10)) AS cleaned
      FROM b LEFT JOIN cov ON b.doc_id = cov.doc_id),
    f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND 100 * (length(t) - length(cleaned)) <= {q.MAX_LOST_PERCENT} * length(t) AS kept FROM f"""


def url_sql() -> str:
    rule, said = [], []
    for verdict, text in sorted(u.RULES, key=lambda r: (-len(r[1]), r[1])):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule.append(f"{fits} THEN '{text}'")
        said.append(f"{fits} THEN '{verdict}'")
    steps = [
        f"""p{d} AS (SELECT host, lex, pos, tmpl[pos] AS segment, array_to_string(tmpl[1:pos - 1], '/') AS parent FROM t{d}, unnest(range(1, len(tmpl) + 1)) AS r(pos)),
        w{d} AS (SELECT host, parent, pos FROM p{d} WHERE segment <> '*' GROUP BY ALL HAVING count(DISTINCT segment) >= {u.MIN_CHILDREN}),
        x{d} AS (SELECT p.host, p.lex, list(CASE WHEN w.pos IS NOT NULL THEN '*' ELSE segment END ORDER BY p.pos) AS tmpl
          FROM p{d} p LEFT JOIN w{d} w ON p.host = w.host AND p.parent = w.parent AND p.pos = w.pos GROUP BY p.host, p.lex),
        t{d + 1} AS (SELECT t.host, t.lex, labelled, blocked, coalesce(x.tmpl, t.tmpl) AS tmpl FROM t{d} t LEFT JOIN x{d} x ON t.host = x.host AND t.lex = x.lex)"""
        for d in range(URL_ROUNDS)
    ]
    last = f"t{URL_ROUNDS}"
    segment = f"""CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') THEN '{{x}}' WHEN length(s) > {u.LONG_SEGMENT} THEN '{{s}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END"""
    d = u.MAX_DEPTH
    folded = f"CASE WHEN len(segs) > {d} THEN list_concat(segs[1:{d - 1}], [array_to_string(segs[{d}:], '/')]) ELSE segs END"
    rate, up = "(n.b / n.l)", "(o.b / o.l)"
    return f"""WITH r AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
    b AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM h),
    j AS (SELECT page_id, host, path, CASE {' '.join(rule)} END AS rule, CASE {' '.join(said)} END AS said, list_transform({folded}, lambda s: {segment}) AS lex FROM b),
    t0 AS (SELECT host, lex, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked, lex AS tmpl FROM j GROUP BY host, lex),
    {', '.join(steps)},
    m AS (SELECT host, tmpl, sum(labelled) AS labelled, sum(blocked) AS blocked FROM {last} GROUP BY host, tmpl),
    n AS (SELECT host, depth, array_to_string(tmpl[1:depth], '/') AS path, array_to_string(tmpl[1:greatest(depth - 1, 0)], '/') AS parent, sum(labelled) AS l, sum(blocked) AS b
      FROM m, unnest(range(0, len(tmpl) + 1)) AS r(depth) WHERE labelled > 0 GROUP BY ALL),
    s AS (SELECT n.*, coalesce(abs({rate} - {up}) <= {u.Z} * sqrt({up} * (1 - {up}) / n.l) + 1e-12, false) AS merged
      FROM n LEFT JOIN n o ON n.host = o.host AND n.depth = o.depth + 1 AND n.parent = o.path),
    g AS (SELECT host, depth, path, CASE WHEN merged THEN sum(l) OVER w ELSE l END AS l, CASE WHEN merged THEN sum(b) OVER w ELSE b END AS b FROM s WINDOW w AS (PARTITION BY host, depth, parent, merged)),
    c AS (SELECT m.host, m.tmpl, list({{'l': g.l::DOUBLE, 'b': g.b::DOUBLE, 'p': 0.0::DOUBLE}} ORDER BY g.depth) AS chain
      FROM m, unnest(range(0, len(m.tmpl) + 1)) AS r(depth) JOIN g ON g.host = m.host AND g.depth = r.depth AND g.path = array_to_string(m.tmpl[1:r.depth], '/') GROUP BY m.host, m.tmpl),
    q AS (SELECT host, tmpl, list_reduce(list_prepend({{'l': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'p': {u.PRIOR}::DOUBLE}}, chain),
      lambda a, x: {{'l': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'p': (x.b + {u.WEIGHT}::DOUBLE * a.p) / (x.l + {u.WEIGHT}::DOUBLE)}}).p AS purity FROM c)
    SELECT page_id, j.host, j.path, rule, coalesce(said, CASE WHEN coalesce(purity, {u.PRIOR}) >= {u.MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
      '/' || array_to_string(x.tmpl, '/') AS template, coalesce(purity, {u.PRIOR}::DOUBLE) AS purity
    FROM j JOIN {last} x ON j.host = x.host AND j.lex = x.lex LEFT JOIN q ON q.host = x.host AND q.tmpl = x.tmpl"""


def chat_sql() -> str:
    esc = lambda c: f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"
    marks = len(TURN) + len(SAYS) + len(END) + 1
    said = "'\\### Assistant: </turn> ok'"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said})
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length({esc('role')}) + length({esc('text')}) + {marks})::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


def jaccard_sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE b AS (SELECT doc_id, {_WORDS.format(low)} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] ELSE array_to_string(w, ' ') END AS g
      FROM b, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS r(i)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
    l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
    JOIN reach ON reach.id = d.doc_id GROUP BY d.doc_id, n.n"""


def phrase_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({low}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM w, unnest(range(1, {longest + 1})) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i)),
    f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {least} OR k = 1),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= {least}),
    parts AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS r(i)),
    gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN parts ON parts.lang = c.lang AND parts.phrase = c.phrase WHERE 100 * parts.a >= 100 * c.a),
    cuts AS (SELECT c.lang, c.phrase, c.a, m AS cut, array_to_string(c.w[1:m], ' ') AS head, array_to_string(c.w[m + 1:], ' ') AS rest
      FROM (SELECT * FROM c ANTI JOIN gone USING (lang, phrase)) c, unnest(range(1, c.k)) AS s(m)),
    x AS (SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = rest JOIN n ON n.lang = cuts.lang),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM y QUALIFY rank <= {top}"""


def search_sql(top: int = 50) -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = f"regexp_extract_all({low.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
    s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM k),
    m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM k, s),
    q AS (SELECT item_id, unnest(list_distinct({terms})) AS term FROM benchmark WHERE text IS NOT NULL),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
    x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= {top}"""


ORACLE = {
    "op1_url_filters": url_sql(),
    "op2_jaccard_join": jaccard_sql(),
    "op4_chat_formatting": chat_sql(),
    "op7_quality_rules": quality_sql(),
    "op12_phrase_mining": phrase_sql(),
    "op13_ranked_search": search_sql(),
}

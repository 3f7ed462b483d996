"""SQL for features and scores of vacancies: texts cut into words and what lies between them, then ordinary joins.

It stands apart from the Python that the queries run: mentions come from neighbouring words, sentence borders from running
extremes over the words, contexts from a join with the modifiers. It holds for aliases of one or two words, where of two
overlapping ones of two words the first stays; the invented prose has no others.
"""

from __future__ import annotations

from ..plans.features import ABOUT_OTHERS, EXPERIENCE, NEAR, NEGATION_GAP, YEARS_NEAR
from ..plans.taxonomy import Taxonomy
from .catalogue import _NORM

EDGE, STOP = r"[\p{L}\p{N}_+#]", r"[.!?\n;]"


def _text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _cents(number: str) -> str:
    """Two places, halves of the shortest decimal form away from zero."""
    return f"round(({number})::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


def _holds(text: str, phrases) -> str:
    """Whether one of the phrases stands in the text between word borders."""
    return f"regexp_matches({text}, '(^|[^{EDGE[1:]})({'|'.join(phrases)})($|[^{EDGE[1:]})')"


def _aliases(t: Taxonomy) -> list[tuple[str, str]]:
    """Alias and concept; an alias of a versioned concept that holds a word of its parent also stands for the parent."""
    own = [(a, c.name) for c in t.concepts for a in c.aliases]
    parent = {c.name: c.name.rpartition("_")[0] for c in t.concepts if c.name.rpartition("_")[2].isdigit()}
    return own + [(a, parent[n]) for a, n in own if n in parent and set(a.split()) & set(t.concept(parent[n]).aliases)]


VACANCIES = "(SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS description FROM documents)"


def mentions_sql(t: Taxonomy, source: str = VACANCIES) -> str:
    """CTEs from vacancies (doc_id, title, description) to m(external_id, concept, start, stop, context); start counts from 0, stop is exclusive."""
    part = "OVER (PARTITION BY external_id ORDER BY i"
    modifiers = [(p, name, float(value)) for name, value, phrases in t.modifiers for p in phrases]
    return rf"""n AS (SELECT *, trim(title || chr(10) || body) AS whole
        FROM (SELECT doc_id::VARCHAR AS external_id, {_NORM("title")} AS title, {_NORM("description")} AS body FROM {source})),
      alias(word, concept) AS (VALUES {_rows(_aliases(t))}), modifier(word, name, value) AS (VALUES {_rows(modifiers)}),
      cut AS (SELECT external_id, length(whole) AS size, regexp_extract_all(whole, '{EDGE}+|[^{EDGE[1:]}+') AS parts FROM n),
      word AS (SELECT external_id, size, unnest(parts) AS w, generate_subscripts(parts, 1) AS i FROM cut),
      placed AS (SELECT *, (sum(length(w)) {part}))::BIGINT AS e, e - length(w) AS s FROM word),
      broken AS (SELECT *, CASE WHEN regexp_matches(w, '{STOP}') THEN s + length(regexp_extract(w, '^[^{STOP[1:]}*')) END AS early,
        CASE WHEN regexp_matches(w, '{STOP}') THEN e - 1 - length(regexp_extract(w, '[^{STOP[1:]}*$')) END AS late FROM placed),
      seen AS (SELECT external_id, i, w, s, e, coalesce(max(late) {part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS since,
        coalesce(min(early) {part} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), size) AS till,
        CASE WHEN lead(w) {part}) = ' ' THEN w || ' ' || lead(w, 2) {part}) END AS pair, lead(e, 2) {part}) AS pair_end FROM broken),
      fitting AS (SELECT *, coalesce(pair IN (SELECT word FROM alias), false) AS fits FROM seen),
      doubled AS (SELECT *, fits AND NOT coalesce(lag(fits, 2) {part}), false) AS stays FROM fitting),
      free AS (SELECT *, stays OR coalesce(lag(stays, 2) {part}), false) AS inside FROM doubled),
      said AS (SELECT external_id, concept, s AS start, pair_end AS stop, since, till FROM free JOIN alias ON alias.word = pair WHERE stays
        UNION ALL SELECT external_id, concept, s, e, since, till FROM free JOIN alias ON alias.word = w WHERE NOT inside),
      turn AS (SELECT external_id, s, e, name, value FROM seen JOIN modifier ON modifier.word = w),
      near AS (SELECT said.external_id, concept, start, stop, value, least(abs(start - e), abs(s - stop)) AS gap, e - s AS size, s
        FROM said JOIN turn ON turn.external_id = said.external_id AND s >= greatest(0, since + 1 - {NEAR}) AND s < till AND e <= till
        WHERE gap <= {NEAR} AND (name <> 'NEGATED_OR_DEPRECATED' OR start - e BETWEEN 0 AND {NEGATION_GAP})),
      told AS (SELECT external_id, concept, start, stop, first(value ORDER BY gap, size DESC, s) AS value FROM near GROUP BY ALL),
      m AS (SELECT external_id, concept, start, stop, coalesce(value, 1.0)::DOUBLE AS context FROM said LEFT JOIN told USING (external_id, concept, start, stop))"""


def _years(t: Taxonomy) -> str:
    """Greatest number of years asked for near a word of experience, and 'whole' is the text; number words as numbers."""
    found = []
    patterns = [(p, r"(\d+)") for p in t.year_patterns]
    if t.year_words:
        patterns.append((rf"(?:от|не менее|минимум|at least)\s+(?:{'|'.join(t.year_words)})\s+(?:лет|года|год|years?)", f"({'|'.join(t.year_words)})"))
    number = "CASE x " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in t.year_words.items()) + " ELSE x END" if t.year_words else "x"
    for pattern, group in patterns:
        found.append(
            rf"""SELECT external_id, whole, unnest(regexp_extract_all(whole, '{pattern}')) AS hit, generate_subscripts(regexp_extract_all(whole, '{pattern}'), 1) AS i,
              string_split_regex(whole, '{pattern}') AS gaps, regexp_extract_all(whole, '{pattern}') AS hits, '{group}' AS of FROM n"""
        )
    return rf"""hit AS ({" UNION ALL ".join(found)}),
      aged AS (SELECT external_id, whole, hit, regexp_extract(hit, of, 1) AS x, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda g: length(g))), 0) AS s FROM hit),
      asked AS (SELECT external_id, max(({number})::INTEGER) AS years FROM aged WHERE length({number}) < 4
        AND regexp_matches(substr(whole, greatest(0, s - {YEARS_NEAR})::BIGINT + 1, (s + length(hit) + {YEARS_NEAR} - greatest(0, s - {YEARS_NEAR}))::BIGINT), '{EXPERIENCE.pattern}') GROUP BY external_id)"""


def features_sql(t: Taxonomy, source: str = VACANCIES) -> str:
    """CTEs to f, a row a vacancy: role, level, years, negatives, the concepts with their counts and contexts as a list."""
    level = lambda text: "CASE " + " ".join(
        f"WHEN {_holds(text, [a])} THEN '{name}'" for _, _, a, name in sorted(((-len(a), -rank, a, name) for name, rank, of in t.levels for a in of))
    ) + " END"
    role = " ".join(f"WHEN {_holds('title', of)} THEN '{name}'" for name, of in t.roles)
    role += " ".join(f" WHEN regexp_matches(title, '{p}') THEN '{name}'" for name, p, _ in t.role_hints)
    share = " ".join(f"WHEN {_holds('title', of)} THEN {0.7 if name == 'FULLSTACK' else 1.0}" for name, of in t.roles)
    share += " ".join(f" WHEN regexp_matches(title, '{p}') THEN {value}" for name, p, value in t.role_hints)
    signals = " + ".join(f"coalesce(list_contains(names, '{s}'), false)::INTEGER" for s in t.role_signals)
    described = f"{signals} >= 2 AND regexp_matches(body, '{t.role_context}')"
    sentences = f"string_split_regex(body, '{STOP}+')"

    def negative(n) -> str:
        spoken = f"list_filter({sentences}, lambda s: NOT regexp_matches(s, '{ABOUT_OTHERS}'))" if n.conflict else sentences
        return f"CASE WHEN {_holds('title', n.patterns)} OR len(list_filter({spoken}, lambda s: {_holds('s', n.patterns)})) > 0 THEN '{n.name}' END"

    order = [c.name for c in t.concepts]
    return f"""{mentions_sql(t, source)}, {_years(t)},
      each AS (SELECT external_id, concept, count(*) AS mentions, max(context) AS context, list_position({order}, concept) AS place FROM m GROUP BY external_id, concept),
      held AS (SELECT external_id, list(concept ORDER BY place) AS names, string_agg(concept || ':' || mentions || '@' || context, ',' ORDER BY place) AS concepts FROM each GROUP BY external_id),
      told_level AS (SELECT external_id, {level('title')} AS tl, {level('body')} AS bl FROM n),
      f AS (SELECT external_id, sha256(title || chr(10) || body) AS content_hash, names, coalesce(concepts, '') AS concepts, years,
        CASE {role} WHEN {described} THEN '{t.main_role}' ELSE 'UNKNOWN' END AS role, (CASE {share} WHEN {described} THEN 0.75 ELSE 0.0 END)::DOUBLE AS role_match,
        coalesce(tl, bl, CASE WHEN years >= 5 THEN 'SENIOR' WHEN years >= 3 THEN 'MIDDLE' ELSE 'UNKNOWN' END) AS level,
        (CASE WHEN tl IS NOT NULL THEN 1.0 WHEN bl IS NOT NULL THEN 0.85 WHEN years >= 5 THEN 0.6 WHEN years >= 3 THEN 0.55 ELSE 0.35 END)::DOUBLE AS level_sure,
        list_filter([{', '.join(map(negative, t.negatives))}], lambda x: x IS NOT NULL) AS negatives
        FROM n LEFT JOIN held USING (external_id) LEFT JOIN asked USING (external_id) LEFT JOIN told_level USING (external_id))"""


def scores_sql(t: Taxonomy, c, source: str = VACANCIES) -> str:
    """Score of each vacancy for a candidate, from f and each: one row a requirement, summed in the order of the requirements."""
    low, high, most = t.boost
    wants = [(k, n, i, t.importance[i], t.concept(n).category) for k, (n, i) in enumerate(c.requirements)]
    options = [(k, n, 1.0, True, 0) for k, n, *_ in wants if n not in c.excluded]
    options += [(k, r, float(s), False, 1 + at) for k, n, *_ in wants for at, (r, s) in enumerate(sorted(t.concept(n).related, key=lambda x: -x[1]))]
    categories = list(dict.fromkeys(w[4] for w in wants))
    active = sum(t.category_weight[x] for x in categories)
    mine = [n for n, _ in c.requirements if n not in c.excluded]

    def share(k) -> float:
        parent, _, version = k.name.rpartition("_")
        return 1.0 if k.name in mine or (version.isdigit() and parent in mine) else max((s for r, s in k.related if r in mine), default=0.0)

    weights = [(k.name, float(k.weight), float(k.weight * share(k))) for k in t.concepts]
    heavy = [k.name for k in sorted(t.concepts, key=lambda k: (-k.weight, k.name)) if k.weight >= 4 and not share(k)]
    skills = " + ".join(
        "(" + " + ".join(f"e{k} * {w}::DOUBLE" for k, _, _, w, x in wants if x == cat) + f") / {sum(w for *_, w, x in wants if x == cat)}::DOUBLE * {t.category_weight[cat] / active}::DOUBLE" for cat in categories
    )
    rank = {name: n for name, n, _ in t.levels}
    steps = " ".join(f"WHEN '{name}' THEN {t.distance[min(abs(rank[c.seniority] - n), len(t.distance) - 1)]}" for name, n in rank.items())
    aged = " ".join(f"WHEN {c.years} - years >= {least} THEN {value}" for least, value in sorted(t.year_rules, reverse=True))
    caps = dict(t.gates)
    open_gates = {"JAVA_PRIMARY_MISSING": "NOT coalesce(list_contains(names, 'JAVA'), false)", "BACKEND_ROLE_MISSING": "role_match < 0.5", "WRONG_PRIMARY_ROLE": "list_has_any(negatives, %s)" % [n.name for n in t.negatives if n.conflict]}
    gates = ", ".join(f"CASE WHEN {open_gates[g]} THEN '{g}' END" for g in caps)
    penalty = " ".join(f"WHEN '{n.name}' THEN {float(n.penalty)}" for n in t.negatives)
    cap = " ".join(f"WHEN '{g}' THEN {float(m)}" for g, m in caps.items())
    bands = " ".join(f"WHEN score >= {least} THEN '{name}'" for least, name in sorted(t.bands, reverse=True))
    w, hard = t.component, [f"e{k}" for k, _, i, *_ in wants if i == "MUST_HAVE"]
    named = lambda rows: "array_to_string(list_filter([" + ", ".join(rows) + "], lambda x: x IS NOT NULL), ',')"
    return f"""{features_sql(t, source)},
      choice(k, concept, semantic, exact, place) AS (VALUES {_rows(options)}), weight(concept, weight, covered) AS (VALUES {_rows(weights)}),
      met AS (SELECT external_id, k, semantic, exact, mentions, context FROM each JOIN choice USING (concept) QUALIFY row_number() OVER (PARTITION BY external_id, k ORDER BY choice.place) = 1),
      worth AS (SELECT external_id, k, exact, least(1.0::DOUBLE, semantic::DOUBLE * context * CASE WHEN mentions >= {low} THEN 1 + {most}::DOUBLE * ((least(mentions, {high}) - {low} + 1) / {high - low + 1}::DOUBLE) ELSE 1.0::DOUBLE END) AS e FROM met),
      needs AS (SELECT external_id, {', '.join(f"coalesce(max(e) FILTER (k = {k}), 0.0)::DOUBLE AS e{k}, bool_or(exact) FILTER (k = {k}) AS x{k}" for k, *_ in wants)} FROM f LEFT JOIN worth USING (external_id) GROUP BY external_id),
      cover AS (SELECT external_id, CASE WHEN sum(context * weight) > 0 THEN sum(context * covered)::DOUBLE / sum(context * weight)::DOUBLE END AS cover FROM each JOIN weight USING (concept) GROUP BY external_id),
      base AS (SELECT *, {skills} AS skills, (CASE {aged} WHEN years IS NOT NULL THEN 0.0 END)::DOUBLE AS aged, (CASE level {steps} END)::DOUBLE AS step,
        list_filter([{gates}], lambda x: x IS NOT NULL) AS gates FROM f JOIN needs USING (external_id) LEFT JOIN cover USING (external_id)),
      rated AS (SELECT *, (skills * {w['skills']}::DOUBLE + coalesce(cover, 0.0)::DOUBLE * {w['coverage']}::DOUBLE + coalesce(aged, 0.0)::DOUBLE * {w['experience']}::DOUBLE + coalesce(step, 0.0)::DOUBLE * {w['seniority']}::DOUBLE) * 100
          - coalesce(list_sum(list_transform(negatives, lambda x: (CASE x {penalty} END)::DOUBLE)), 0.0)::DOUBLE AS whole,
        (CASE WHEN names IS NULL THEN 0.0 ELSE {w['skills']} END)::DOUBLE + (cover IS NOT NULL)::INTEGER * {w['coverage']}::DOUBLE + (aged IS NOT NULL)::INTEGER * {w['experience']}::DOUBLE
          + (CASE WHEN step IS NULL THEN 0.0 ELSE level_sure END)::DOUBLE * {w['seniority']}::DOUBLE AS sure,
        list_min(list_transform(gates, lambda g: (CASE g {cap} END)::DOUBLE)) AS cap FROM base),
      scored AS (SELECT *, {_cents('greatest(0.0::DOUBLE, least(100.0::DOUBLE, whole, coalesce(cap, 100.0)::DOUBLE))')} AS score FROM rated)
      SELECT external_id, score, CASE {bands} END AS level, {_cents('greatest(0.0::DOUBLE, least(1.0::DOUBLE, sure)) * 100')} AS confidence,
        CASE WHEN list_contains(gates, 'WRONG_PRIMARY_ROLE') THEN 'INELIGIBLE' WHEN role = 'UNKNOWN' OR names IS NULL THEN 'UNCERTAIN' WHEN list_contains(gates, 'JAVA_PRIMARY_MISSING') THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END AS eligibility,
        {_cents(f"({' + '.join(hard)}) / {len(hard)} * 100")} AS hard_match, {_cents('cover * 100')} AS coverage,
        {named([f"CASE WHEN x{k} THEN '{n}' END" for k, n, *_ in wants])} AS matched, {named([f"CASE WHEN NOT x{k} THEN '{n}' END" for k, n, *_ in wants])} AS partial,
        {named([f"CASE WHEN e{k} = 0 THEN '{n}' END" for k, n, i, *_ in wants if i in ('MUST_HAVE', 'STRONG_PREFERENCE')])} AS missing,
        {named([f"CASE WHEN EXISTS (SELECT 1 FROM each WHERE each.external_id = scored.external_id AND concept = '{n}' AND context > 0) THEN '{n}' END" for n in heavy] or ['NULL'])} AS wanted,
        array_to_string(gates, ',') AS gates FROM scored"""

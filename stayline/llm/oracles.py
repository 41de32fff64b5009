"""SQL for the queries that SQL can express."""

from __future__ import annotations

from stayline.llm.chat import CONTROLS
from stayline.llm.licenses import SLACK, words_of
from stayline.llm.mixing import LEVELS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (k) WHERE m < doc_id),
placed AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text FROM placed
  ANTI JOIN gone ON gone.doc_id = placed.doc_id AND gone.p = placed.p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
"""


def _escapes(column: str) -> str:
    marks = "|".join(["\\\\", *(c.replace("[", "\\[").replace("]", "\\]") for c in CONTROLS)])
    return f"len(regexp_extract_all({column}, '{marks}'))"


_SAID = "</s>[INST] ok [/INST]"
CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({len('<s>[INST][/INST]</s>')} + length(role) + length(text) + {_escapes('role')} + {_escapes('text')}) AS chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM joined
"""


def mixing(weights: dict, share: tuple[int, int], epochs: int, seed: int) -> str:
    """The mix of ``documents``: one pour of the budget per level, then a prefix per leaf."""
    number = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    parts = [f"""
d AS (
  SELECT doc_id, lang AS given_lang, source AS given_source, coalesce(lang, '(none)') AS lang,
         coalesce(source, '(none)') AS source, CAST(len({_WORDS}) AS HUGEINT) AS n,
         CASE WHEN {number} = '' THEN 'other' ELSE 'group' || (CAST({number} AS BIGINT) % 4) END AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n) AS tokens FROM d GROUP BY ALL)"""]
    for depth, level in enumerate(LEVELS):
        keys, parents = ", ".join(LEVELS[:depth + 1]), ", ".join(("1", *LEVELS[:depth]))
        cases = "".join(f" WHEN '{k}' THEN {w}" for k, w in weights.get(level, {}).items())
        weight = f"CASE {level}{cases} ELSE 1 END" if cases else "1"
        budget = (f"(SELECT coalesce(sum(tokens), 0) * {share[0]} // {share[1]} FROM leaves)" if not depth
                  else f"(SELECT given FROM given{depth - 1} g WHERE " + " AND ".join(
                      f"g.{k} = n.{k}" for k in LEVELS[:depth]) + ")")
        order = f"PARTITION BY {parents} ORDER BY CAST(supply AS DOUBLE) / weight, {level}"
        parts.append(f"""
nodes{depth} AS (
  SELECT n.*, {weight} AS weight, {budget} AS budget
  FROM (SELECT {keys}, sum(tokens) AS tokens, sum(tokens) * {epochs} AS supply FROM leaves GROUP BY {keys}) n),
seen{depth} AS (
  SELECT *, coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
  FROM nodes{depth}),
full{depth} AS (SELECT *, supply * opened <= (budget - used) * weight AS filled FROM seen{depth}),
shared{depth} AS (
  SELECT *, max(CASE WHEN NOT filled THEN budget - used END) OVER (PARTITION BY {parents}) AS rest,
         max(CASE WHEN NOT filled THEN opened END) OVER (PARTITION BY {parents}) AS together
  FROM full{depth}),
based{depth} AS (
  SELECT *, CASE WHEN filled THEN supply ELSE rest * weight // together END AS base FROM shared{depth}),
placed{depth} AS (
  SELECT *, rest - sum(CASE WHEN NOT filled THEN base END) OVER (PARTITION BY {parents}) AS spare,
         sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS place
  FROM based{depth}),
given{depth} AS (
  SELECT {keys}, tokens, base + CASE WHEN NOT filled AND place <= spare THEN 1 ELSE 0 END AS given FROM placed{depth})""")
    parts.append(f"""
plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole,
         given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest FROM given2),
keyed AS (
  SELECT d.*, whole, rest, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM d JOIN plan USING (domain, lang, source)),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto,
         sum(n) OVER (PARTITION BY domain, lang, source, k) AS own FROM keyed),
taken AS (
  SELECT *, CAST(whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own < rest AND 2 * upto - own < 2 * rest))
                              THEN 1 ELSE 0 END AS BIGINT) AS copies FROM upto)""")
    return "WITH" + ",".join(parts) + """
SELECT doc_id, given_lang AS lang, given_source AS source, domain, copies FROM taken WHERE copies > 0
"""


def quality_rules() -> str:
    """Counts of every text, and the outlier verdict with its steps written out."""
    from stayline.llm import quality_rules as q

    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    distance = "0.0 + " + " + ".join(
        f"{1 if i == j else 2} * (x{i} - m{i}) * (x{j} - m{j}) * v{i}{j}" for i, j in pairs)
    of = lambda n: "0.0 + " + " + ".join(
        f"{1 if i == j else 2} * (x{i} - f{n}.m{i}) * (x{j} - f{n}.m{j}) * f{n}.v{i}{j}" for i, j in pairs)
    cov = lambda i, j: f"c{min(i, j)}{max(i, j)}"

    def cofactor(i: int, j: int) -> str:
        a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"{sign}({cov(a[0], b[0])} * {cov(a[1], b[1])} - {cov(a[0], b[1])} * {cov(a[1], b[0])})"

    det = " + ".join(f"c0{j} * {cofactor(0, j)}" for j in range(3))
    same = "p.lv = f.lv AND p.lang IS NOT DISTINCT FROM f.lang AND p.source IS NOT DISTINCT FROM f.source"
    steps = []
    for n in range(q.STEPS):
        steps.append(f"""
classed{n} AS (
  SELECT p.*, floor(16 * log2(1 + greatest({distance}, 0.0))) AS class FROM passed p JOIN fit{n} f ON {same}),
limit{n} AS (SELECT lv, lang, source, ceil(quantile_cont(class, {q.CENTRAL})) AS upto FROM classed{n} GROUP BY ALL),
sums{n} AS (
  SELECT p.lv, p.lang, p.source, count(*) AS n, {', '.join(f'sum(x{i})::DOUBLE AS s{i}' for i in range(3))},
         {', '.join(f'sum(x{i} * x{j})::DOUBLE AS s{i}{j}' for i, j in pairs)}
  FROM classed{n} p JOIN limit{n} f ON {same} WHERE class <= upto GROUP BY ALL),
cov{n} AS (
  SELECT lv, lang, source, {', '.join(f's{i} / n AS m{i}' for i in range(3))},
         {', '.join(f"s{i}{j} / n - (s{i} / n) * (s{j} / n) + {q.FLOORS[i] ** 2 if i == j else 0.0}::DOUBLE AS c{i}{j}" for i, j in pairs)}
  FROM sums{n}),
fit{n + 1} AS (
  SELECT lv, lang, source, m0, m1, m2, {', '.join(f'{cofactor(i, j)} / ({det}) AS v{i}{j}' for i, j in pairs)} FROM cov{n})""")
    last = q.STEPS
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w,
                  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
often AS (SELECT doc_id, k FROM grams GROUP BY doc_id, k HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM grams JOIN often USING (doc_id, k)) GROUP BY doc_id),
filled AS (SELECT doc_id, unnest(lines) AS line FROM d),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM filled
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '{q.SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
points AS (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         CAST(round({q.UNIT} * ln(1 + n_words)) AS HUGEINT) AS x0,
         CAST(round({q.UNIT} * ((word_chars + {q.PSEUDO_WORDS * q.PSEUDO_LENGTH})::DOUBLE / (n_words + {q.PSEUDO_WORDS}))) AS HUGEINT) AS x1,
         CAST(round({q.UNIT} * log2(1 + (100 * n_symbols)::DOUBLE / greatest(word_chars, 1))) AS HUGEINT) AS x2
  FROM counted),
passed AS (
  SELECT lv, CASE WHEN lv < 2 THEN lang END AS lang, CASE WHEN lv < 1 THEN source END AS source, x0, x1, x2
  FROM points CROSS JOIN (VALUES (0), (1), (2)) AS levels(lv) WHERE NOT base_failed),
middles AS (
  SELECT lv, lang, source, {', '.join(f'quantile_cont(x{i}::DOUBLE, 0.5) AS m{i}' for i in range(3))}
  FROM passed GROUP BY ALL HAVING count(*) >= {q.MIN_GROUP} OR lv = 2),
spreads AS (
  SELECT p.lv, p.lang, p.source, m0, m1, m2,
         {', '.join(f'greatest(1.4826::DOUBLE * quantile_cont(floor(abs(x{i} - m{i})), 0.5), {q.FLOORS[i]}::DOUBLE) AS d{i}' for i in range(3))}
  FROM passed p JOIN middles f ON {same} GROUP BY ALL),
fit0 AS (
  SELECT lv, lang, source, m0, m1, m2,
         {', '.join(f'1 / (d{i} * d{i}) AS v{i}{j}' if i == j else f'0.0::DOUBLE AS v{i}{j}' for i, j in pairs)} FROM spreads),
{','.join(steps).strip()},
medians AS (
  SELECT p.lv, p.lang, p.source, ceil(quantile_cont(floor(16 * log2(1 + greatest({distance}, 0.0))), 0.5)) AS half
  FROM passed p JOIN fit{last} f ON {same} GROUP BY ALL),
scaled AS (
  SELECT f.*, least(1.0, {q.CHI2_MEDIAN} / greatest(pow(2.0, half / 16) - 1, {q.CHI2_MEDIAN}))::DOUBLE AS scale
  FROM fit{last} f JOIN medians p ON {same})
SELECT p.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({', '.join(f'({of(n)}) * f{n}.scale' for n in range(3))}, 0.0) <= {q.CUTOFF} AS kept
FROM points p
LEFT JOIN scaled f0 ON f0.lv = 0 AND p.lang IS NOT DISTINCT FROM f0.lang AND p.source IS NOT DISTINCT FROM f0.source
LEFT JOIN scaled f1 ON f1.lv = 1 AND p.lang IS NOT DISTINCT FROM f1.lang
LEFT JOIN scaled f2 ON f2.lv = 2
"""


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _rows(rows: list[tuple]) -> str:
    shown = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def licenses(templates: list, phrases: dict[str, str]) -> str:
    """The scan without an index: every phrase is looked for at every word."""
    every = list(enumerate(templates))
    spelled = [(t, i, j, w) for t, one in every for i, (_, p) in enumerate(one.phrases) for j, w in enumerate(p)]
    begun = [(t, i, q, len(p), len(one.phrases)) for t, one in every for i, (q, p) in enumerate(one.phrases)]
    texts = [(t, one.label, one.phrase_at(q), q, w) for t, one in every for q, w in enumerate(one.words)]
    based = [(i, label, j, w) for i, (p, label) in enumerate(phrases.items()) for j, w in enumerate(words_of(p))]
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
placed AS (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS pos FROM d),
text_words AS (SELECT * FROM (VALUES {_rows(texts)}) AS x(t, label, phrase, q, w)),
hits AS MATERIALIZED (SELECT * FROM placed WHERE w IN (SELECT w FROM text_words)),
idf AS (
  SELECT w, CAST(1 + greatest(floor(1000 * ln((2 * (SELECT count(*) FROM d) + 2) / (2 * df + 1))), 0) AS BIGINT) AS weight
  FROM (SELECT w, count(DISTINCT k) AS df FROM hits GROUP BY w)),
phrase_words AS (SELECT * FROM (VALUES {_rows(spelled)}) AS x(t, phrase, j, w)),
begun AS (SELECT * FROM (VALUES {_rows(begun)}) AS x(t, phrase, q, length, phrases)),
starts AS (
  SELECT k, t, phrase, pos - j AS start FROM hits JOIN phrase_words USING (w)
  GROUP BY k, t, phrase, pos - j
  HAVING count(*) = (SELECT length FROM begun b WHERE b.t = phrase_words.t AND b.phrase = phrase_words.phrase)),
shifts AS (SELECT k, t, phrase, phrases, start - q AS shift FROM starts JOIN begun USING (t, phrase)),
firsts AS (SELECT k, t, phrases, shift AS off FROM shifts WHERE phrase = 0),
near AS (
  SELECT f.k, f.t, f.off, s.phrase, arg_min(s.shift, abs(s.shift - f.off) * 1000000 + (s.shift - f.off)) AS shift
  FROM firsts f JOIN shifts s ON s.k = f.k AND s.t = f.t AND (s.phrase > 0 OR s.shift = f.off) AND abs(s.shift - f.off) <= {SLACK}
  GROUP BY ALL),
whole AS (SELECT k, t, off FROM near JOIN firsts USING (k, t, off) GROUP BY k, t, off HAVING count(*) = max(phrases)),
met AS (
  SELECT whole.k, whole.t, whole.off, sum(weight) AS met
  FROM whole JOIN near USING (k, t, off) JOIN text_words x ON x.t = near.t AND x.phrase = near.phrase
  JOIN hits ON hits.k = whole.k AND hits.w = x.w AND hits.pos = near.shift + x.q JOIN idf ON idf.w = x.w
  GROUP BY ALL),
total AS (SELECT t, label, sum(coalesce(weight, 0)) AS total FROM text_words LEFT JOIN idf USING (w) GROUP BY t, label),
found AS (SELECT k, list(DISTINCT label) AS more, max(CAST(met AS DOUBLE) / CAST(total AS DOUBLE)) AS score FROM met JOIN total USING (t) GROUP BY k),
base_words AS (SELECT * FROM (VALUES {_rows(based)}) AS x(p, label, j, w)),
places AS (
  SELECT k, label, pos - j AS start FROM hits JOIN base_words b USING (w) GROUP BY k, label, p, pos - j
  HAVING count(*) = (SELECT count(*) FROM base_words c WHERE c.p = b.p)),
base AS (SELECT k, count(*) AS n, min(start) AS a, max(start) AS z, list(DISTINCT label) AS labels FROM places GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(a AS BIGINT) AS first_word,
       CAST(z AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels,
       coalesce(score, 0) AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN found USING (k)
"""


REVERSED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
asked AS (SELECT i, unnest(w) AS term FROM items),
sizes AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS total, CAST(sum(len(w)) AS BIGINT) AS length FROM d),
counts AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY k, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), sizes),
parts AS (
  SELECT k, term, weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * total) // length))) AS part
  FROM counts JOIN d USING (k) JOIN weights USING (term), sizes),
scored AS (SELECT i, k, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY i, k),
ranked AS (
  SELECT i, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank
  FROM scored JOIN d USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (i) WHERE rank <= 10
"""

"""SQL statements giving the registered queries' results in another engine (DuckDB).

They read whole tables and whole texts. The engine's regular expressions have no look-around:
a whole-word replacement consumes the neighbouring characters. Every separator is doubled
first, so that neighbouring words do not share one, and halved again afterwards.
"""

from __future__ import annotations

from evenhand import fixed_values as fv
from evenhand.sources.tables import (
    AUDIT_TERMS,
    CATEGORY_WORDS,
    FREQUENT_LEXICON,
    GROUPS,
    LEXICON,
)

WORD = r"\p{L}\p{N}_"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any_case(letters: str) -> str:
    return "".join(
        "[kKK]" if c == "k" else f"[{c}{c.upper()}]" if c.isalpha() else c for c in letters
    )


def swap_sql(text: str, words: list[str], word: str) -> str:
    upper = "|".join(_any_case(w).replace(w[0], "", 1) for w in words)
    lower = "|".join(w[0] + _any_case(w[1:]) for w in words)
    marker = word if word.isalnum() else "PLACEHOLDERWORD"
    text = rf"regexp_replace({text}, '([^{WORD}])', '\1\1', 'g')"
    for alternation, value in ((upper, marker[0].upper() + marker[1:]), (lower, marker)):
        pattern = literal(f"(^|[^{WORD}])(?:{alternation})([^{WORD}]|$)")
        text = rf"regexp_replace({text}, {pattern}, '\1{value}\2', 'g')"
    text = rf"regexp_replace({text}, '([^{WORD}])[^{WORD}]', '\1', 'g')"
    return text if marker == word else f"replace({text}, '{marker}', {literal(word)})"


# ---------------------------------------------------------------- common tables

#: The category and the swap target of each group, written out: the first other group of its category.
CATEGORY = {
    "g_ther": "c1",
    "g_thon": "c1",
    "g_thed": "c1",
    "g_erin": "c2",
    "g_anea": "c2",
    "g_le": None,
    "g_none": None,
}
TARGETS = {
    "g_ther": "g_thon",
    "g_thon": "g_ther",
    "g_thed": "g_ther",
    "g_erin": "g_anea",
    "g_anea": "g_erin",
    "g_le": "g_le",
    "g_none": "g_none",
}
EVERY_WORD = [w for words in LEXICON.values() for w in words]
TARGET_SYN = "CAST((doc_id * 37) % 101 AS DOUBLE) / 100"


def _hits(words) -> str:
    if not words:
        return "0"
    return f"len(list_filter(h, lambda x: x IN ({quoted(words)})))"


def _group_value(group: str) -> str:
    category = CATEGORY[group]
    if category is None:
        return f"CASE WHEN {_hits(LEXICON[group])} > 0 THEN 1.0 ELSE 0.0 END AS {group}"
    total = _hits(CATEGORY_WORDS[category])
    return (
        f"CASE WHEN {total} > 0 THEN CAST({_hits(LEXICON[group])} AS DOUBLE) / {total} "
        f"ELSE 0.0 END AS {group}"
    )


COMMENTS = f"""
hits AS (
  SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'),
         lambda x: x IN ({quoted(EVERY_WORD)})) AS h
  FROM documents),
comments AS (
  SELECT doc_id AS id, text AS comment_text, CAST(toxic AS DOUBLE) AS target,
         {TARGET_SYN} AS target_syn,
         {", ".join(_group_value(g) for g in GROUPS)}
  FROM hits LEFT JOIN labels USING (doc_id))"""

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT id, {i} AS pos, '{g}' AS grp, target, target_syn, comment_text "
    f"FROM comments WHERE {g} >= 0.5"
    for i, g in enumerate(GROUPS)
) + ")"

MENTIONS = """
mention_rows AS (
  SELECT id, any_value(target_syn) AS toxicity, count(*) AS n_mentions,
         string_agg(grp, ',' ORDER BY pos) AS mentions, any_value(comment_text) AS comment_text
  FROM long GROUP BY id)"""

STRATA = """
ordered AS (
  SELECT id, toxicity, row_number() OVER (ORDER BY toxicity, id) - 1 AS rk,
         count(*) OVER () AS n FROM mention_rows),
edges AS (
  SELECT *, greatest(0, n // 2 - 50) AS m0 FROM ordered),
strata AS (
  SELECT id, toxicity, 'bottom' AS stratum FROM edges WHERE rk < 100
  UNION ALL SELECT id, toxicity, 'middle' FROM edges WHERE rk >= m0 AND rk < least(n, m0 + 100)
  UNION ALL SELECT id, toxicity, 'top' FROM edges WHERE rk >= n - 100)"""


def _swapped_by_group() -> str:
    branches = []
    for group in GROUPS:
        target = TARGETS[group]
        if target == group or not LEXICON[target]:
            continue
        words = CATEGORY_WORDS[CATEGORY[group]]
        branches.append(f"WHEN '{group}' THEN {swap_sql('comment_text', words, LEXICON[target][0])}")
    return f"CASE grp {' '.join(branches)} ELSE comment_text END"


TARGET_CASE = "CASE grp " + " ".join(f"WHEN '{g}' THEN '{t}'" for g, t in TARGETS.items()) + " END"
CATEGORY_CASE = "CASE grp " + " ".join(f"WHEN '{g}' THEN '{c}'" for g, c in CATEGORY.items() if c) + " END"

VARIANTS = f"""
swapped AS (
  SELECT id, 'swap_to_' || {TARGET_CASE} AS variant_id, {_swapped_by_group()} AS variant_text,
         comment_text, target_syn FROM long),
variants AS (
  SELECT id, 'original' AS variant_id, comment_text AS variant_text, 'true' AS is_original,
         toxicity AS original_toxicity FROM mention_rows
  UNION ALL
  SELECT id, variant_id, variant_text, 'false', target_syn FROM swapped
  WHERE variant_text <> comment_text)"""

GAPS = """
scored AS (
  SELECT *, CAST((length(variant_text) * 7 + id) % 97 AS DOUBLE) / 96 AS score FROM variants),
gaps AS (
  SELECT v.id, v.variant_id, v.score AS variant_score, o.score AS original_score,
         v.score - o.score AS score_gap
  FROM scored v JOIN scored o ON v.id = o.id AND o.is_original = 'true'
  WHERE v.is_original = 'false')"""

TOKENS = f"""
tokens AS (
  SELECT doc_id AS id, list_filter(string_split_regex(
           regexp_replace(lower(text), '[^a-z0-9{fv.WHITESPACE}]', '', 'g'),
           '[{fv.WHITESPACE}]+'),
         lambda x: length(x) > 1 AND x NOT IN ({quoted(fv.STOPWORDS)})) AS t
  FROM documents),
words AS (SELECT id, len(t) AS doc_len, unnest(t) AS term FROM tokens),
counts AS (SELECT id, doc_len, term, count(*) AS cnt FROM words GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= {fv.MIN_DOC_FREQ}),
weights AS (
  SELECT id, term, cnt / doc_len * (ln((n + 1) / (df + 1)) + 1) AS tfidf
  FROM counts JOIN df USING (term), n),
ranked_terms AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(tfidf, 9) DESC, term) AS rank
  FROM weights)"""

REQUESTS = f"""
requests AS (
  SELECT DISTINCT conv_id * 11 AS id,
         regexp_replace(lower(term), '^[{fv.WHITESPACE}]+|[{fv.WHITESPACE}]+$', '', 'g') AS term
  FROM (SELECT conv_id, unnest(string_split_regex(text, '[ \\n]+')) AS term FROM conversations))"""

ALL_WORDS = [w for words in CATEGORY_WORDS.values() for w in words]
TERM_ROWS = ", ".join(
    f"('{c}', '{t}', {i})"
    for i, (c, t) in enumerate((c, t) for c, terms in AUDIT_TERMS.items() for t in terms)
)
GRID = f"""
lines AS (
  SELECT doc_id AS id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT)
           AS line_no,
         unnest(string_split(text, chr(10))) AS line, {TARGET_SYN} AS s
  FROM documents),
templates AS (
  SELECT id, line_no, line, CASE WHEN s < 1.0/3 THEN 0 WHEN s < 2.0/3 THEN 1 ELSE 2 END AS level_pos,
         {swap_sql("line", ALL_WORDS, fv.PLACEHOLDER)} AS template
  FROM lines),
grid AS (
  SELECT id, line_no, level_pos,
         CASE level_pos WHEN 0 THEN 'neutral' WHEN 1 THEN 'mildly_negative' ELSE 'charged' END
           AS level,
         template, category, identity_term, term_pos,
         replace(template, '{fv.PLACEHOLDER}', identity_term) AS sentence
  FROM templates, (VALUES {TERM_ROWS}) terms(category, identity_term, term_pos)
  WHERE template <> line),
audit AS (
  SELECT *,
    CAST((level_pos * 31 + id * 17 + line_no * 5 + term_pos * 7) % 97 AS DOUBLE) / 96 AS score_a,
    CAST((length(sentence) * 3 + term_pos * 11 + id * 29) % 89 AS DOUBLE) / 88 AS score_b
  FROM grid),
term_means AS (
  SELECT level, identity_term, any_value(category) AS category, avg(score_a) AS score_a,
         avg(score_b) AS score_b FROM audit GROUP BY level, identity_term)"""


def extremes_sql(by: str, value: str, source: str) -> str:
    """Range of term means per group; the first name wins a tie."""
    return f"""
extremes AS (
  SELECT {by}, min({value}) AS min_mean, max({value}) AS max_mean,
         max({value}) - min({value}) AS range,
         first(identity_term ORDER BY round({value}, 12), identity_term) AS min_term,
         first(identity_term ORDER BY round({value}, 12) DESC, identity_term) AS max_term
  FROM {source} GROUP BY {by})"""


def ranks_sql(value: str, name: str) -> str:
    """Average-tie rank of the term means inside a level."""
    order = f"PARTITION BY level ORDER BY round({value}, 12)"
    ties = f"count(*) OVER (PARTITION BY level, round({value}, 12))"
    return f"rank() OVER ({order}) + ({ties} - 1) / 2 AS {name}"


def pairs_sql(score: str, within_category: bool) -> str:
    same = "AND a.category = b.category" if within_category else ""
    return f"""WITH {GRID}
SELECT a.level, count(*) AS n_pairs, round(avg(abs(a.{score} - b.{score})), 6) AS mean_abs_diff,
       round(max(abs(a.{score} - b.{score})), 6) AS max_abs_diff
FROM audit a JOIN audit b ON a.id = b.id AND a.line_no = b.line_no
     AND a.identity_term < b.identity_term {same}
GROUP BY a.level"""


def describe_sql(value: str, source: str) -> str:
    return f"""SELECT count({value}) AS n, round(avg({value}), 6) AS mean,
  round(stddev_samp({value}), 6) AS std, round(CAST(min({value}) AS DOUBLE), 6) AS min,
  round(CAST(quantile_cont({value}, 0.25) AS DOUBLE), 6) AS p25,
  round(CAST(quantile_cont({value}, 0.5) AS DOUBLE), 6) AS p50,
  round(CAST(quantile_cont({value}, 0.75) AS DOUBLE), 6) AS p75,
  round(CAST(max({value}) AS DOUBLE), 6) AS max FROM {source}"""


def histogram_sql(value: str, source: str, bins: int) -> str:
    edge = f"CASE WHEN {{0}} = {bins} THEN hi ELSE lo + {{0}} * ((hi - lo) / {bins}) END"
    return f"""WITH v AS (SELECT CAST({value} AS DOUBLE) AS x FROM {source}),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
raw AS (SELECT x, lo, hi, least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS i
        FROM v, b),
placed AS (SELECT i - CAST(x < {edge.format("i")} AS INT)
             + CAST(x >= {edge.format("(i + 1)")} AND i <> {bins - 1} AS INT) AS bin FROM raw),
found AS (SELECT bin, count(*) AS n FROM placed GROUP BY bin)
SELECT k AS bin, round(lo + k * ((hi - lo) / {bins}), 6) AS bin_lo,
       round({edge.format("(k + 1)")}, 6) AS bin_hi, coalesce(n, 0) AS n
FROM range({bins}) r(k) CROSS JOIN b LEFT JOIN found ON found.bin = k"""


SAMPLE_CASE = "CASE " + " ".join(
    f"WHEN target_syn >= {lo} AND target_syn < {hi} THEN '{name}'" for name, lo, hi in fv.SAMPLE_BANDS
) + " END"

HASH = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || ':42'), 1, 15) AS BIGINT)"
TRAIN = f"""
train AS (
  SELECT doc_id, text FROM documents JOIN labels USING (doc_id)
  WHERE toxic IS NOT NULL AND {HASH.format("doc_id")} % 5 <> 0)"""

#: A ridge with few features: TF-IDF vectors of length 1, centred normal equations, and their
#: elimination (every pivot clears its column in all other rows; the matrix is positive definite).
SMALL_MODEL = f"""{TRAIN.strip()},
unigrams AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[{WORD}]{{2,}}') AS t FROM train),
occurrences AS (
  SELECT doc_id, term, count(*) AS cnt FROM (
    SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)),
           lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM unigrams) GROUP BY ALL),
kept AS (
  SELECT term, row_number() OVER (ORDER BY tf DESC, term) AS j,
         ln(((SELECT count(*) FROM train) + 1) / (df + 1)) + 1 AS idf
  FROM (SELECT term, sum(cnt) AS tf, count(*) AS df FROM occurrences GROUP BY term)
  ORDER BY tf DESC, term LIMIT {{size}}),
weighted AS (SELECT doc_id, j, cnt * idf AS w FROM occurrences JOIN kept USING (term)),
vectors AS (
  SELECT doc_id, j, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM weighted),
labelled AS (SELECT doc_id, CAST(toxic AS DOUBLE) AS y FROM train JOIN labels USING (doc_id)),
overall AS (SELECT count(*) AS n, avg(y) AS y_mean FROM labelled),
columns AS (
  SELECT j, coalesce(sum(x), 0) AS s, coalesce(sum(x * y), 0) AS sy
  FROM kept LEFT JOIN vectors USING (j) LEFT JOIN labelled USING (doc_id) GROUP BY j),
products AS (
  SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS p FROM vectors a JOIN vectors b USING (doc_id) GROUP BY ALL),
cells AS (
  SELECT a.j AS i, b.j AS j,
         coalesce(p, 0) - a.s * b.s / n + CASE WHEN a.j = b.j THEN {fv.RIDGE_ALPHA} ELSE 0 END AS v
  FROM columns a CROSS JOIN columns b CROSS JOIN overall LEFT JOIN products q ON q.i = a.j AND q.j = b.j
  UNION ALL SELECT j, {{size}} + 1, sy - s * y_mean FROM columns, overall),
matrix AS (
  SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cells GROUP BY i)),
elimination AS (
  SELECT 1 AS k, m FROM matrix
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k
           THEN list_transform(r, lambda v: v / m[k][k])
           ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)
  FROM elimination WHERE k <= len(m)),
solved AS (
  SELECT term, j, idf, m[j][len(m) + 1] AS coef
  FROM kept, (SELECT m FROM elimination WHERE k = len(m) + 1)),
constant AS (
  SELECT y_mean - (SELECT sum(s * coef) FROM columns JOIN solved USING (j)) / n AS c FROM overall)"""


def small_model(select: str, size: int) -> str:
    return "WITH RECURSIVE " + SMALL_MODEL.replace("{size}", str(size)) + select


NUMBER = (
    r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)

ORACLES: dict[str, str] = {
    "row_audit": f"""WITH {COMMENTS}
SELECT count(*) AS n_rows, count(target) AS n_complete, count(*) - count(target) AS n_dropped,
       count(*) FILTER (WHERE {" OR ".join(f"{g} >= 0.5" for g in GROUPS)}) AS n_kept
FROM comments""",
    "score_describe": describe_sql(TARGET_SYN, "documents"),
    "label_describe": describe_sql("toxic", "labels"),
    "score_histogram": histogram_sql(TARGET_SYN, "documents", 50),
    "length_histogram": histogram_sql("length(text)", "documents", 20),
    "score_bands": "WITH s AS (SELECT " + TARGET_SYN + " AS x FROM documents) " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS band_pos, '{label}' AS band, "
        f"count(*) FILTER (WHERE x > {lo} AND x <= {hi}) AS n FROM s"
        for i, (label, lo, hi) in enumerate(fv.PROFILE_BANDS)
    ),
    "eda_identity_toxicity": f"""WITH {COMMENTS}, {LONG}
SELECT grp AS identity, count(*) AS n_comments, round(avg(target), 6) AS mean_toxicity,
       round(100.0 * count(*) FILTER (WHERE target >= 0.5) / count(*), 6) AS pct_toxic,
       row_number() OVER (ORDER BY round(avg(target), 12) DESC NULLS LAST, grp) AS position
FROM long GROUP BY grp HAVING count(*) >= {fv.MIN_GROUP_SIZE}""",
    "eda_identity_rounded": f"""WITH {COMMENTS}, {LONG}
SELECT grp AS identity, count(*) AS n_comments, round_even(avg(target_syn), 3) AS mean_toxicity,
       round_even(100.0 * count(*) FILTER (WHERE target_syn >= 0.5) / count(*), 1) AS pct_toxic
FROM long GROUP BY grp HAVING count(*) >= {fv.MIN_GROUP_SIZE}""",
    "band_samples": f"""WITH {COMMENTS}, {LONG},
banded AS (SELECT *, {SAMPLE_CASE} AS band FROM long),
drawn AS (SELECT *, row_number() OVER (PARTITION BY grp, band ORDER BY {HASH.format("id")}, id) AS k
          FROM banded WHERE band IS NOT NULL)
SELECT grp AS identity, band, id, target_syn AS score,
       replace(substring(comment_text, 1, {fv.PREVIEW_CHARS}), chr(10), ' ') AS preview
FROM drawn WHERE k = 1""",
    "lenient_scores": f"""WITH spelled AS (
  SELECT conv_id, unnest(list_concat(
    ['', ' ' || turn || '.5 ', turn || 'd', '1_' || turn, '-' || turn || 'e-1', 'nan',
     chr(160) || turn || '.25' || chr(8195)], string_split_regex(text, '\\s+'))) AS spelled
  FROM conversations),
stripped AS (
  SELECT conv_id, CASE WHEN spelled = '' THEN '' ELSE
    coalesce(nullif(regexp_replace(spelled, '^[{fv.WHITESPACE}]+|[{fv.WHITESPACE}]+$', '', 'g'), ''), ' ') END AS raw
  FROM spelled),
parsed AS (
  SELECT conv_id, CASE WHEN raw = '' THEN 0.0
    WHEN regexp_matches(trim(raw), '{NUMBER}')
      THEN CAST(replace(trim(raw), '_', '') AS DOUBLE)
    WHEN regexp_matches(lower(trim(raw)), '^[+-]?(inf|infinity)$') THEN CAST(trim(raw) AS DOUBLE)
  END AS value FROM stripped)
SELECT conv_id, count(*) AS n_fields, count(value) AS n_numbers, round(sum(value), 6) AS total
FROM parsed GROUP BY conv_id""",
    "document_index": "SELECT doc_id, doc_id AS doc_index FROM documents",
    "identity_mentions": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}
SELECT id, n_mentions, mentions FROM mention_rows""",
    "mention_ranking": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}
SELECT id, toxicity, row_number() OVER (ORDER BY toxicity, id) AS position FROM mention_rows""",
    "csv_scan": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "csv_index": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, doc_id,
       md5(text) AS text_md5 FROM documents""",
    "complete_comments": """SELECT doc_id AS id, CAST(toxic AS DOUBLE) AS target
FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL""",
    "optional_mentions": f"""WITH {COMMENTS}, {LONG}
SELECT id, string_agg(grp, ',' ORDER BY pos) AS mentions FROM long
WHERE grp IN ({quoted(GROUPS[1::2])}) GROUP BY id""",
    "result_table_files": f"""WITH {GRID}
SELECT identity_term, level, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b,
       round(score_a, 6) AS csv_score_a, round(score_b, 6) AS csv_score_b FROM term_means""",
    "variant_files": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {STRATA}, {VARIANTS}
SELECT v.id, variant_id, variant_text, is_original, original_toxicity, stratum
FROM variants v JOIN strata s ON v.id = s.id""",
    "file_score_gaps": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {VARIANTS}, {GAPS}
SELECT id, variant_id, round(variant_score, 6) AS variant_score,
       round(original_score, 6) AS original_score, round(score_gap, 6) AS score_gap FROM gaps""",
    "strata_rows": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {STRATA}
SELECT id, toxicity, stratum FROM strata""",
    "strata_summary": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {STRATA}
SELECT stratum, count(*) AS n, min(toxicity) AS min_score, max(toxicity) AS max_score
FROM strata GROUP BY stratum""",
    "counterfactual_variants": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {VARIANTS}
SELECT id, variant_id, variant_text, is_original, original_toxicity FROM variants""",
    "counterfactual_changed_counts": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {VARIANTS}
SELECT variant_id, is_original, count(*) AS n_variants,
       CAST(sum(length(variant_text)) AS BIGINT) AS n_chars
FROM variants GROUP BY variant_id, is_original""",
    "swap_targets": f"""WITH {COMMENTS}, {LONG}
SELECT grp AS mention, {CATEGORY_CASE} AS category, {TARGET_CASE} AS swap_target,
       count(*) AS n_mentions FROM long GROUP BY grp""",
    "stratified_counterfactuals": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {STRATA}, {VARIANTS}
SELECT v.id, variant_id, variant_text, is_original, original_toxicity, stratum
FROM variants v JOIN strata s ON v.id = s.id""",
    "variant_score_gaps": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {VARIANTS}, {GAPS}
SELECT id, variant_id, round(variant_score, 6) AS variant_score,
       round(original_score, 6) AS original_score, round(score_gap, 6) AS score_gap FROM gaps""",
    "variant_gap_summary": f"""WITH {COMMENTS}, {LONG}, {MENTIONS}, {VARIANTS}, {GAPS}
SELECT variant_id, count(*) AS n_variants, round(avg(score_gap), 6) AS mean_gap,
       round(avg(abs(score_gap)), 6) AS mean_abs_gap, round(max(abs(score_gap)), 6) AS max_abs_gap
FROM gaps GROUP BY variant_id""",
    "doc_frequency": f"WITH {TOKENS} SELECT term, df FROM df",
    "corpus_stats": f"""WITH {TOKENS}
SELECT (SELECT n FROM n) AS n_docs, (SELECT count(*) FROM df) AS vocabulary""",
    "doc_term_counts": f"WITH {TOKENS} SELECT id, doc_len, term, cnt FROM counts",
    "tfidf_long": f"WITH {TOKENS} SELECT id, term, round(tfidf, 6) AS tfidf FROM weights",
    "tfidf_top3": f"""WITH {TOKENS}
SELECT id, rank, term, round(round(tfidf, 9), 6) AS tfidf FROM ranked_terms WHERE rank <= 3""",
    "tfidf_first_documents": f"""WITH {TOKENS},
first_docs AS (SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 10)
SELECT id, term, round(tfidf, 6) AS tfidf FROM ranked_terms JOIN first_docs USING (id)
WHERE rank <= 3""",
    "tfidf_vocab_restricted": f"""WITH {TOKENS},
vocabulary AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{WORD}]{{2,}}')) AS term FROM benchmark)
SELECT id, term, round(tfidf, 6) AS tfidf FROM weights SEMI JOIN vocabulary USING (term)""",
    "tfidf_lookup": f"""WITH {TOKENS}, {REQUESTS}
SELECT r.id, r.term,
       round(coalesce(cnt / doc_len * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1), 0.0), 6) AS tfidf
FROM requests r JOIN documents d ON d.doc_id = r.id
LEFT JOIN counts c ON c.id = r.id AND c.term = r.term
LEFT JOIN df ON df.term = r.term CROSS JOIN n""",
    "tfidf_lookup_missing": """SELECT DISTINCT conv_id * 11 AS id FROM conversations
WHERE conv_id * 11 NOT IN (SELECT doc_id FROM documents)""",
    "tfidf_vectors": f"""WITH {TOKENS}
SELECT doc_id AS id, coalesce(CAST(toxic AS DOUBLE), 0.0) AS target,
       coalesce(string_agg(term || ':' || CAST(round(tfidf * 1000000) AS BIGINT), ' ' ORDER BY term), '') AS vec
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN weights ON weights.id = doc_id
GROUP BY doc_id, toxic""",
    "model_optimality": "SELECT 0.0::DOUBLE AS largest_gradient, 0.0::DOUBLE AS mean_residual, 1.0::DOUBLE AS unit_vectors",
    "tfidf_vector_sizes": f"""WITH {TOKENS}
SELECT doc_id AS id, coalesce(CAST(toxic AS DOUBLE), 0.0) AS target, count(term) AS n_terms,
       round(coalesce(sum(tfidf), 0.0), 6) AS total, round(max(tfidf), 6) AS largest
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN weights ON weights.id = doc_id
GROUP BY doc_id, toxic""",
    "sentence_grid": f"""WITH {GRID}
SELECT id, line_no, level, template, category, identity_term, sentence FROM grid""",
    "scored_sentences": f"""WITH {GRID}
SELECT id, line_no, identity_term, sentence, CAST(quality AS DOUBLE) AS external_score
FROM grid LEFT JOIN labels ON doc_id = id""",
    "parity_by_level": f"""WITH {GRID}
SELECT identity_term, level, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b
FROM term_means""",
    "parity_pivot": f"""WITH {GRID}
SELECT identity_term, row_number() OVER (ORDER BY round(lead, 12), identity_term) AS position,
       round(neutral, 6) AS neutral, round(mildly_negative, 6) AS mildly_negative,
       round(charged, 6) AS charged
FROM (SELECT identity_term, avg(score_b) FILTER (WHERE level = 'neutral') AS neutral,
        avg(score_b) FILTER (WHERE level = 'mildly_negative') AS mildly_negative,
        avg(score_b) FILTER (WHERE level = 'charged') AS charged,
        avg(score_a) FILTER (WHERE level = 'neutral') AS lead
      FROM audit GROUP BY identity_term)""",
    "neutral_means": f"""WITH {GRID}
SELECT identity_term, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b
FROM term_means WHERE level = 'neutral'""",
    "level_range": f"""WITH {GRID}, {extremes_sql("level", "score_b", "term_means")}
SELECT level, round(min_mean, 6) AS min_mean, min_term, round(max_mean, 6) AS max_mean, max_term,
       round(range, 6) AS range FROM extremes""",
    "category_spread": f"""WITH {GRID},
neutral AS (SELECT * FROM term_means WHERE level = 'neutral'),
{extremes_sql("category", "score_b", "neutral")}
SELECT category, round(min_mean, 6) AS min_mean, min_term, round(max_mean, 6) AS max_mean,
       max_term, round(range, 6) AS range, round(max_mean / nullif(min_mean, 0), 6) AS ratio
FROM extremes""",
    "group_ratio": f"""WITH {GRID}, {extremes_sql("level", "score_a", "term_means")}
SELECT level, max_term, min_term, round(max_mean / nullif(min_mean, 0), 6) AS ratio FROM extremes""",
    "gap_growth": f"""WITH {GRID}, {extremes_sql("level", "score_b", "term_means")},
wide AS (SELECT max(range) FILTER (WHERE level = 'neutral') AS a,
  max(range) FILTER (WHERE level = 'mildly_negative') AS b,
  max(range) FILTER (WHERE level = 'charged') AS c FROM extremes)
SELECT round(a, 6) AS range_neutral, round(b, 6) AS range_mildly_negative,
       round(c, 6) AS range_charged, round(b - a, 6) AS growth_mildly_negative,
       round(c - a, 6) AS growth_charged FROM wide""",
    "pairwise_difference": pairs_sql("score_b", True),
    "pairwise_difference_all_terms": pairs_sql("score_a", False),
    "rank_agreement": f"""WITH {GRID},
ranks AS (SELECT level, identity_term, {ranks_sql("score_b", "r")} FROM term_means)
SELECT a.level AS level_a, b.level AS level_b, round(corr(a.r, b.r), 6) AS spearman
FROM ranks a JOIN ranks b USING (identity_term)
WHERE (a.level, b.level) IN (('neutral', 'mildly_negative'), ('neutral', 'charged'),
                             ('mildly_negative', 'charged'))
GROUP BY a.level, b.level""",
    "model_agreement": f"""WITH {GRID},
ranks AS (SELECT level, {ranks_sql("score_a", "ra")}, {ranks_sql("score_b", "rb")}
          FROM term_means),
by_term AS (SELECT level, corr(ra, rb) AS spearman FROM ranks GROUP BY level),
by_row AS (SELECT level, corr(score_a, score_b) AS pearson FROM audit GROUP BY level)
SELECT level, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman
FROM by_row LEFT JOIN by_term USING (level)""",
    "train_test_split": f"""SELECT doc_id AS id, {HASH.format("doc_id")} % 5 = 0 AS in_test
FROM documents""",
    "model_vocabulary": f"""WITH {TRAIN},
unigrams AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[{WORD}]{{2,}}') AS t FROM train),
terms AS (
  SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)),
         lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM unigrams),
counts AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM terms GROUP BY term),
kept AS (SELECT * FROM counts ORDER BY tf DESC, term LIMIT {fv.VOCABULARY_SIZE})
SELECT term, tf, df, round(ln(((SELECT count(*) FROM train) + 1) / (df + 1)) + 1, 6) AS idf FROM kept""",
}
SIZE = 24
ORACLES |= {
    "small_model_coefs": small_model(
        " SELECT term AS feature, round(coef, 6) AS coef FROM solved", SIZE
    ),
    "small_model_extremes": small_model(
        """,
placed AS (
  SELECT 'higher' AS side, row_number() OVER (ORDER BY round(coef, 9) DESC, term) AS position, term, coef FROM solved
  UNION ALL SELECT 'lower', row_number() OVER (ORDER BY round(coef, 9), term), term, coef FROM solved)
SELECT side, position, term AS feature, round(coef, 6) AS coef FROM placed WHERE position <= 5""",
        SIZE,
    ),
    "small_model_identity_coefs": small_model(
        f""",
groups AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{t.lower()}')" for g, terms in FREQUENT_LEXICON.items() for t in terms)}) g(identity, term))
SELECT identity, term AS feature, round(coef, 6) AS coef FROM solved JOIN groups USING (term)""",
        SIZE,
    ),
    "small_model_scores": small_model(
        f""",
line_words AS (
  SELECT id, line_no, regexp_extract_all(lower(line), '[{WORD}]{{2,}}') AS t FROM (
    SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line,
           CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM documents)),
line_terms AS (
  SELECT id, line_no, term, count(*) AS cnt FROM (
    SELECT id, line_no, unnest(list_concat(t, list_transform(range(1, len(t)),
           lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM line_words) GROUP BY ALL),
line_scores AS (
  SELECT id, line_no, sum(cnt * idf * coef) / sqrt(sum(cnt * idf * cnt * idf)) AS score
  FROM line_terms JOIN solved USING (term) GROUP BY id, line_no)
SELECT id, line_no, round(c + coalesce(score, 0), 6) AS local_score
FROM line_words LEFT JOIN line_scores USING (id, line_no), constant""",
        SIZE,
    ),
}

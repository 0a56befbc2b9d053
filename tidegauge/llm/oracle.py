"""SQL for the queries of this subpackage that SQL can express."""

OP9_NEAREST_VECTORS = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), normed AS (
    SELECT *, sqrt(list_reduce(list_transform(x, lambda a: a * a), lambda a, b: a + b)) AS norm FROM v
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]), lambda a, b: a + b)
               / (q.norm * c.norm) AS score
    FROM normed q JOIN normed c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP2_QUALITY_RULES = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(lang, '(null)') AS stratum, coalesce(text, '') AS text
    FROM documents
), split AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM docs
), places AS (
    SELECT row_no, words, unnest(range(1, len(words) - 1)) AS place FROM split WHERE len(words) > 2
), windows AS (
    SELECT row_no, place, count(*) OVER (PARTITION BY row_no, words[place : place + 2]) AS often FROM places
), inside AS (
    SELECT row_no, count(DISTINCT word) AS n_repeat_words
    FROM (SELECT row_no, unnest([place, place + 1, place + 2]) AS word FROM windows WHERE often > 1) GROUP BY row_no
), counts AS (
    SELECT row_no, doc_id, stratum, len(words)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
           (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
    FROM split LEFT JOIN inside USING (row_no)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), steps AS (
    SELECT row_no, doc_id, stratum, base_failed, rule.name AS rule, ceil(rule.share * 200)::INTEGER AS step
    FROM (SELECT *, unnest([
        {'name': 'symbols', 'share': CASE WHEN word_chars > 0 THEN least(n_symbols / word_chars, 1) ELSE 0 END},
        {'name': 'dup_lines', 'share': CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END},
        {'name': 'repeat_words', 'share': CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END},
        {'name': 'upper', 'share': CASE WHEN word_chars > 0 THEN least(n_upper / word_chars, 1) ELSE 0 END}]) AS rule
      FROM judged)
), known AS (
    SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
), held AS (
    SELECT stratum, rule, step, quality FROM steps JOIN known USING (doc_id) WHERE NOT base_failed
), totals AS (
    SELECT stratum, rule, sum(quality)::BIGINT AS n, 0.05e0 / (count(*) OVER ()) AS level FROM held GROUP BY stratum, rule
), tails AS (
    SELECT stratum, rule, k, level, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
               + k * ln(0.0125e0) + (n - k) * ln(1 - 0.0125e0))) OVER (PARTITION BY stratum, rule ORDER BY k) AS at_most
    FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM totals)
), cuts AS (
    SELECT stratum, rule, s, count(*) FILTER (WHERE step > s AND quality = 1) AS lost,
           count(*) FILTER (WHERE step > s AND quality = 0) AS caught
    FROM held, range(0, 200) AS c(s) GROUP BY stratum, rule, s
), tested AS (
    SELECT c.*, t.at_most <= t.level AS allowed
    FROM cuts c JOIN tails t ON c.stratum = t.stratum AND c.rule = t.rule AND c.lost = t.k
), chosen AS (
    SELECT stratum, rule, arg_max(s, caught * 1000 + s) AS cut
    FROM (SELECT *, coalesce(max(s) FILTER (WHERE NOT allowed) OVER (PARTITION BY stratum, rule), -1) AS bar FROM tested)
    WHERE s > bar AND caught > 0 GROUP BY stratum, rule
), failed AS (
    SELECT row_no, string_agg(rule, ',' ORDER BY list_position(['symbols', 'dup_lines', 'repeat_words', 'upper'], rule)) AS rules
    FROM steps JOIN chosen USING (stratum, rule) WHERE step > cut GROUP BY row_no
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(rules, '') AS failed_rules, NOT base_failed AND rules IS NULL AS kept
FROM judged LEFT JOIN failed USING (row_no)
"""

OP11_LEXICAL_SEARCH = r"""
WITH split AS (
    SELECT row_number() OVER () AS row_no, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), corpus AS (
    SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM split WHERE len(terms) > 0
), counts AS (
    SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf
    FROM (SELECT row_no, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM split) GROUP BY ALL
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term
), scores AS (
    SELECT item_id, row_no, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term), corpus
    WHERE doc_id IS NOT NULL GROUP BY item_id, row_no, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


def _vector_codes(rounds: int = 4) -> str:
    """Assignment and replacement written out round by round; tables p and b hold parts and entries."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""near{turn} AS (
    SELECT row_no, part, min(struct_pack(far := far, entry := entry)) AS best
    FROM (SELECT row_no, p.part, entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
          FROM p JOIN book{turn} b ON p.part = b.part)
    GROUP BY row_no, part
)""")
        if turn < rounds:
            steps.append(f"""sums{turn} AS (
    SELECT part, entry, place, sum(c)::BIGINT AS s, count(*)::BIGINT AS n
    FROM (SELECT p.part, best.entry AS entry, unnest(p.x) AS c, unnest(range(len(p.x))) AS place FROM p JOIN near{turn} USING (row_no, part))
    GROUP BY part, entry, place
), book{turn + 1} AS (
    SELECT part, entry, coalesce(m.x, b.x) AS x
    FROM book{turn} b LEFT JOIN (
        SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM sums{turn} GROUP BY part, entry) m USING (part, entry)
)""")
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_no, vec_id, label,
           list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS (
    SELECT row_no, part, list_slice(x, part * len(x) // 4 + 1, (part + 1) * len(x) // 4) AS x
    FROM kept, (SELECT unnest(range(4)) AS part)
), book0 AS (
    SELECT part, row_no - 1 AS entry, x FROM p WHERE row_no <= 256
), {", ".join(steps)}, coded AS (
    SELECT row_no, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error
    FROM near{rounds} GROUP BY row_no
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (row_no)
"""


ALL: dict[str, str] = {
    "op2_quality_rules": OP2_QUALITY_RULES,
    "op9_nearest_vectors": OP9_NEAREST_VECTORS,
    "op11_lexical_search": OP11_LEXICAL_SEARCH,
    "op12_vector_codes": _vector_codes(),
}

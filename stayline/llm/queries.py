"""The operators as queries over whole tables: ``name -> callable(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stayline.llm import (
    binary_ids, collocations, cross_parse, decontamination, divergence, line_dedup, maxent, mixing, one_bit_search,
    quality, simhash, template, token_counts,
)
from stayline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse.identify(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_search.nearest(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_ids.token_id_table(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    run.__name__: run
    for run in (op1_main_text, op2_mixing, op3_maxent, op4_line_dedup, op5_token_counts, op6_language_id,
                op7_nearest, op8_simhash, op9_binary_ids, op10_decontamination, op11_collocations,
                op12_divergence, op13_quality)
}

#: SQL twins of the queries above, for another engine; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op7_nearest": """
        WITH sound AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
            FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        ),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op4_line_dedup": """
        WITH line AS (
            SELECT doc_id, n, lines[n] AS line, CAST(len(lines) AS BIGINT) AS n_lines,
                   len(regexp_extract_all(lines[n], '[^\\x20\\x09-\\x0D]+')) AS words
            FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
                 LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS n)
        ),
        near AS (
            SELECT doc_id, n, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c,
                   words AS w1, words + lead(words, 1) OVER w AS w2
            FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY n)
        ),
        run AS (
            SELECT doc_id, n, 3 AS size, 'run' AS kind, a, b, c FROM near WHERE c IS NOT NULL
            UNION ALL SELECT doc_id, n, 2, 'run', a, b, NULL FROM near WHERE w2 >= 50
            UNION ALL SELECT doc_id, n, 1, 'run', a, NULL, NULL FROM near WHERE w1 >= 50
            UNION ALL SELECT doc_id, 1, len(string_split(text, chr(10))), 'text', text, NULL, NULL FROM documents
            WHERE text <> '' AND len(string_split(text, chr(10))) < 3
        ),
        later AS (
            SELECT doc_id, n, size FROM (
                SELECT doc_id, n, size, row_number() OVER (PARTITION BY kind, a, b, c ORDER BY doc_id, n) AS k FROM run
            ) WHERE k > 1
        ),
        gone AS (SELECT DISTINCT doc_id, n + unnest(range(0, size)) AS n FROM later),
        kept AS (
            SELECT line.doc_id, line.n, line.line FROM line ANTI JOIN gone
            ON line.doc_id = gone.doc_id AND line.n = gone.n
        ),
        joined AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY n) AS text FROM kept GROUP BY doc_id),
        total AS (SELECT doc_id, count(*) AS n_lines FROM line GROUP BY doc_id)
        SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_lines, 0) - coalesce(j.n, 0) AS n_deleted,
               CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text
        FROM documents d LEFT JOIN total t ON d.doc_id = t.doc_id LEFT JOIN joined j ON d.doc_id = j.doc_id
    """,
    "op11_collocations": """
        WITH piece AS (
            SELECT row, lang, unnest(range(len(ps))) AS pno, unnest(ps) AS piece FROM (
                SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
                       string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents)
        ),
        word AS (
            SELECT row, lang, pno, unnest(ws) AS w, unnest(range(len(ws))) AS wno FROM (
                SELECT row, lang, pno, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM piece)
        ),
        seq AS (
            SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
            FROM word WINDOW o AS (PARTITION BY row, pno ORDER BY wno)
        ),
        one AS (SELECT lang, w1 AS w, count(*) AS f FROM seq GROUP BY ALL),
        two AS (SELECT lang, w1, w2, count(*) AS f FROM seq WHERE w2 IS NOT NULL GROUP BY ALL),
        three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM seq WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        size AS (SELECT lang, count(*) AS n FROM seq GROUP BY lang),
        longer AS (
            SELECT lang, w1, w2, max(f) AS f FROM (
                SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL
        ),
        cut AS (
            SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
            FROM two t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN one y ON y.lang = t.lang AND y.w = t.w2
            LEFT JOIN longer g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2
            WHERE t.f >= 10 AND 100 * coalesce(g.f, 0) < 50 * t.f
            UNION ALL
            SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, 1, x.f, y.f
            FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w1
            JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
            UNION ALL
            SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, 2, x.f, y.f
            FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
            JOIN one y ON y.lang = t.lang AND y.w = t.w3
        ),
        scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut),
        lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM lowest
        )
        SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN size s ON s.lang = r.lang WHERE rank <= 2000
    """,
    "op12_divergence": """
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
        ),
        word AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM word GROUP BY ALL HAVING count(DISTINCT row) >= 30),
        size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        seen AS (SELECT lang, source, term, count(*) AS c FROM word JOIN kept USING (lang, term) GROUP BY ALL),
        grp AS (SELECT DISTINCT lang, source FROM d),
        total AS (SELECT lang, source, sum(c) AS n FROM seen GROUP BY ALL),
        part AS (
            SELECT g.lang, g.source, k.term, s.c,
                   1 + (CAST(1000000000 AS HUGEINT) * (coalesce(s.c, 0) + 5)) // (coalesce(t.n, 0) + 5 * z.v) AS p
            FROM grp g JOIN kept k ON k.lang = g.lang JOIN size z ON z.lang = g.lang
            LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
            LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
        ),
        usual AS (
            SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 5)) // (max(n) + 5 * max(v)) AS q
            FROM seen JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY lang) USING (lang) JOIN size USING (lang) GROUP BY ALL
        ),
        pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
            FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
            LEFT JOIN part x ON x.lang = a.lang AND x.source = a.source
            LEFT JOIN part y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
            GROUP BY a.lang, a.source, b.source
        ),
        term AS (
            SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - u.q AS BIGINT) AS value
            FROM part p JOIN usual u ON u.lang = p.lang AND u.term = p.term WHERE p.c > 0 AND p.p > u.q
        ),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
            FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}

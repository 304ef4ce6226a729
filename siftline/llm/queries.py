"""The registered queries of the operators for training data, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import (
    centroids, exact, html, jaccard, licenses, packing, pii, quality, secrets, sentencepieces, spellings, substrings, tokenfiles,
)
from siftline.llm.tables import documents, embeddings, pages
from siftline.session import scratch_path


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(substrings.remove_repeats(documents(spark, sf_dir)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(pii.find_pii(documents(spark, sf_dir)))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(pages(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(documents(spark, sf_dir)))


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenfiles.write_tokens(
        documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return tokenfiles.token_digests(tokenfiles.read_tokens(spark, path))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(embeddings(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_variants(documents(spark, sf_dir))


def _cluster_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Every round as two tables: the cluster of each vector, then the centroids after it."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS (SELECT nth, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{r} m USING (i) GROUP BY ALL),
        a{r} AS (SELECT nth, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d FROM d{r} GROUP BY nth)""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (nth) GROUP BY ALL),
        c{r + 1} AS (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN s{r} USING (c, i))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS parts,
                   row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS nth
            FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), v AS (SELECT nth, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM kept),
        c0 AS (SELECT nth AS c, i, x FROM v WHERE nth < {k}),{",".join(steps)},
        hashed AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (nth) JOIN hashed USING (c)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan, op2_ngram_jaccard, op3_suffix_dedup, op4_exact_dedup, op5_packing, op6_sentencepiece, op7_pii,
        op8_html_extraction, op9_quality_rules, op10_secret_scan, op11_token_output, op12_centroid_clustering, op13_spelling_variants,
    )
}

SQL: dict[str, str] = {
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]
                                                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y, c = nx.n AND c = ny.n AS same FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
            WHERE 100 * c >= 90 * (nx.n + ny.n - c)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
        ), component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
        class AS (SELECT x AS doc_id, min(y) AS first FROM links WHERE same GROUP BY x)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS class_id, component_id
        FROM documents JOIN component USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN class USING (doc_id)
    """,
    "op4_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM hashed WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op12_centroid_clustering": _cluster_sql(),
    "op13_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT [list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                                lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS step
        ), runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
            FROM documents
        ), counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        bytes AS (
            SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''),
                       lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) AS BIGINT) - 64] END)) AS bs
            FROM counted
        ), checked AS (
            SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM bytes, crc
        ), words AS (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
                   CAST(sum(n) AS BIGINT) AS n
            FROM checked GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
        ), cut AS (
            SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (head, tail) WHERE a.word <> b.word
            UNION SELECT w.word, cut.word FROM cut JOIN words w ON w.word = head || tail
            UNION SELECT cut.word, w.word FROM cut JOIN words w ON w.word = head || tail
        ), ranked AS (
            SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                   row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS nth
            FROM near JOIN words w ON w.word = other
        ), forms AS (
            SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * words.n THEN other END AS form,
                   CASE WHEN other_n >= 5 * words.n THEN other_n END AS form_n
            FROM words LEFT JOIN ranked ON ranked.word = words.word AND nth = 1
        ), chain(word, root, next) AS (
            SELECT word, word, form FROM forms
            UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON forms.word = chain.next
        )
        SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN chain ON chain.word = forms.word AND chain.next IS NULL
    """,
}

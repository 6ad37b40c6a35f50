"""The registered ``opN_<name>`` queries and their DuckDB SQL.

Each query applies its operator to its whole table.  ``TOKENIZER_DIR``
(environment) may name another folder with the public tokenizer files.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .collocations import collocations
from .common import table
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .near_dedup import near_duplicates
from .ngram_join import ngram_jaccard_join
from .packing import pack_documents
from .pieces import encode_decode
from .pii import pseudonymise
from .quality import quality_rules
from .sharding import shard_documents
from .spelling import spelling_groups, vocabulary
from .token_files import encode_documents, read_token_files
from .warc import locate_records, read_records, record_types, write_packages


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_token_files(spark, sf_dir):
    stored = encode_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, stored, with_ids=False)


def op3_warc_packages(spark, sf_dir):
    packages = write_packages(record_types(table(spark, sf_dir, "pages")))
    return read_records(locate_records(packages), with_payload=False).drop("url")


def op4_ngram_join(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_sentence_pieces(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), digests_only=True)


def op7_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op8_html_extract(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_pii_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", F.size("pii_found").cast("long").alias("n_replaced"), "pii_found")


def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op11_spelling_variants(spark, sf_dir):
    return spelling_groups(vocabulary(table(spark, sf_dir, "documents"), min_length=6, min_count=5, drop_every=199), ratio=5)


def op12_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, inside_percent=50, top=2000)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_files": op2_token_files,
    "op3_warc_packages": op3_warc_packages,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_sharding": op7_sharding,
    "op8_html_extract": op8_html_extract,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_collocations": op13_collocations,
}

_NORM = ("SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz') AS t FROM documents")

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM ({_NORM})""",
    "op3_warc_packages": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                          strlen(coalesce(html, '')) AS payload_bytes FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100
                             THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM f""",
    "op4_ngram_join": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM ({_NORM})),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                END AS g FROM d),
        t AS (SELECT doc_id, len(g) AS n, unnest(g) AS tok FROM s),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM t AS a JOIN t AS b ON a.tok = b.tok AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM d
            UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON r.y = l.x)
        SELECT s.doc_id, len(s.g) AS n_shingles, min(reach.y) AS component_id
        FROM s JOIN reach ON reach.x = s.doc_id GROUP BY s.doc_id, len(s.g)""",
    # crc32 from its table; a word's deletions meet those of its near words.
    "op11_spelling_variants": """
        WITH RECURSIVE crc AS MATERIALIZED (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
        runs AS (
            SELECT doc_id, run, count(*) AS k
            FROM (SELECT doc_id, unnest(regexp_extract_all(
                      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY doc_id, run),
        bytes AS (
            SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
                CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
                     ELSE [192 | (unicode(ch)::BIGINT >> 6), 128 | (unicode(ch)::BIGINT & 63)] END)) AS b FROM runs),
        hashed AS (
            SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
            FROM bytes, crc),
        v AS MATERIALIZED (
            SELECT word, sum(k)::BIGINT AS n
            FROM (SELECT k, CASE WHEN h % 199 = 0
                                 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
                  FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        cut AS MATERIALIZED (
            SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
        near AS (
            SELECT a.word, b.word AS other FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.rest = v.word
            UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.rest = v.word),
        top AS (
            SELECT near.word, other, v.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                   row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS place
            FROM near JOIN v ON v.word = near.other),
        f AS MATERIALIZED (
            SELECT v.word, v.n, coalesce(top.n_near, 0) AS n_near,
                   CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
            FROM v LEFT JOIN top ON top.word = v.word AND place = 1),
        walk AS (
            SELECT word, word AS here, 0 AS steps FROM f
            UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL)
        SELECT f.word, form, root, n, n_near, form_n
        FROM f JOIN (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word) AS r ON r.word = f.word""",
    "op12_minhash_dedup": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM ({_NORM})),
        s AS (
            SELECT doc_id, CASE WHEN len(w) < 2 THEN w
                ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
        t AS (SELECT doc_id, len(g) AS n, unnest(g) AS tok FROM s),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM t AS a JOIN t AS b ON a.tok = b.tok AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM d
            UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON r.y = l.x)
        SELECT s.doc_id, len(s.g) AS n_shingles, min(reach.y) AS component_id, s.doc_id = min(reach.y) AS kept
        FROM s JOIN reach ON reach.x = s.doc_id GROUP BY s.doc_id, len(s.g)""",
    "op13_collocations": """
        WITH pieces AS (
            SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, translate(
                      coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
        spans AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM pieces, (SELECT unnest([1, 2, 3]) AS k)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM spans GROUP BY lang, k, phrase),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        cand AS MATERIALIZED (
            SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
        around AS (
            SELECT lang, phrase, max(a) AS a
            FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
                  FROM cand WHERE k = 3) GROUP BY lang, phrase),
        kept AS (
            SELECT cand.* FROM cand LEFT JOIN around USING (lang, phrase)
            WHERE cand.k = 3 OR around.a IS NULL OR 100 * around.a < 50 * cand.a),
        cuts AS (
            SELECT kept.*, cut, array_to_string(w[1:cut], ' ') AS lo, array_to_string(w[cut + 1:], ' ') AS hi
            FROM kept JOIN (SELECT unnest([1, 2]) AS cut) ON cut < k),
        scored AS (
            SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r,
                   (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = lo AND x.k = cut
                      JOIN f AS y ON y.lang = cuts.lang AND y.phrase = hi AND y.k = cuts.k - cut),
        lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}

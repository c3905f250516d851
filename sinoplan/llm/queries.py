"""The registered queries of the training-data operators: thin, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from sinoplan.llm import common

ORACLES: dict[str, str] = {}


def op1_topk(spark, sf_dir):
    from sinoplan.llm.topk import top_k_inner_product

    return top_k_inner_product(common.table(spark, sf_dir, "embeddings"), k=5, every=50).select("query_id", "rank", "vec_id", "score")


ORACLES["op1_topk"] = """
WITH v AS (
  SELECT vec_id AS id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.id AS query_id, c.id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(c.e) = len(q.e) WHERE q.id % 50 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""


def op2_decontaminate(spark, sf_dir):
    from sinoplan.llm.decontam import find_contamination

    return find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark, sf_dir):
    from sinoplan.llm.tokens import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op4_toxicity(spark, sf_dir):
    from sinoplan.llm.toxicity import fit_toxicity, score_toxicity

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit_toxicity(docs.filter(~held_out), labels.filter(~held_out))
    # A null id is not held out, and not learned from either.
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits", "n_quoted")


def op5_language(spark, sf_dir):
    from sinoplan.llm.langid import fit_languages, identify

    docs = common.table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit_languages(docs.filter(~held_out), label_col="lang")
    found = identify(docs.select("doc_id", "text"), model)
    # A null id is not held out, and not learned from either.
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_main_text(spark, sf_dir):
    from sinoplan.llm.wrapper import extract_main_text

    return extract_main_text(common.table(spark, sf_dir, "pages"))


def op7_repeats(spark, sf_dir):
    from sinoplan.llm.repeats import remove_repeats

    return remove_repeats(common.table(spark, sf_dir, "documents"), digest=True)


def op8_jaccard_join(spark, sf_dir):
    from sinoplan.llm.nearcopies import jaccard_join

    return jaccard_join(common.table(spark, sf_dir, "documents"))


ORACLES["op8_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [chr(1) || text] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), j AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, j.y FROM r JOIN j ON r.y = j.x
), k AS (SELECT doc_id, count(*) OVER (PARTITION BY list_sort(g)) AS copies FROM s)
SELECT k.doc_id, (SELECT min(y) FROM r WHERE r.x = k.doc_id) AS class_id,
  (SELECT count(*) FROM j WHERE j.x = k.doc_id) AS n_links, k.copies FROM k
"""


def op9_bpe(spark, sf_dir):
    from sinoplan.llm.bpe import bpe_encode

    return bpe_encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)


def op10_shards(spark, sf_dir):
    from sinoplan.llm.sharding import shard_documents

    return shard_documents(common.table(spark, sf_dir, "documents"), n_shards=16)


def op11_warc(spark, sf_dir):
    from sinoplan.llm.archive import described, read_archive, write_archive

    folder = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(common.table(spark, sf_dir, "pages"), folder)
    found = common.checkpointed(described(read_archive(spark, folder)))
    common.remove_folder(spark, folder)
    return found.drop("record_sha256")


ORACLES["op11_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS s, b FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS first FROM d)
SELECT page_id, n AS payload_bytes,
  translate(to_base(('0x' || s[1:10])::BIGINT, 32, 8) || to_base(('0x' || s[11:20])::BIGINT, 32, 8) || to_base(('0x' || s[21:30])::BIGINT, 32, 8) || to_base(('0x' || s[31:40])::BIGINT, 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""


def op12_divergence(spark, sf_dir):
    from sinoplan.llm.divergence import source_divergence

    return source_divergence(common.table(spark, sf_dir, "documents"))


ORACLES["op12_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), e AS (SELECT r, lang, source, unnest(ts) AS term FROM d), k AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM e SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (SELECT DISTINCT lang, source FROM d), s AS (
  SELECT g.lang, g.source, v.v, coalesce(sum(c.c), 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source, v.v
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (s.n + 2 * s.v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (k.c + 2) // (v.n + 2 * v.v)::HUGEINT AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q
), t AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
SELECT * FROM t WHERE part = 'pair' OR rank <= 10
"""


def op13_manifest(spark, sf_dir):
    from sinoplan.llm.manifest import digests, manifest

    return manifest(digests(common.table(spark, sf_dir, "documents")))


ORACLES["op13_manifest"] = """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS key, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS crc FROM documents
), l AS (
  SELECT r, doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l
), up AS (
  SELECT key, 0 AS lev, pos, leaf AS h, n FROM p
  UNION ALL SELECT key, lev + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY key, lev, pos // 8, n
), s AS (SELECT key, lev, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1), over_them AS (
  SELECT 0 AS lev, pos, h, n FROM s
  UNION ALL SELECT lev + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM over_them WHERE n > 1 GROUP BY lev, pos // 8, n
), nodes AS (SELECT key, lev, pos, h FROM up WHERE n > 1 UNION ALL SELECT NULL, lev, pos, h FROM over_them WHERE n > 1), sides AS (
  SELECT key, lev, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM nodes WINDOW w AS (PARTITION BY key, lev, pos // 8 ORDER BY pos)
), fold AS (
  SELECT r, p.key, 0 AS lev, p.pos, s.pos AS top, s.lev AS depth, changed AS v, '' AS proof FROM p JOIN s USING (key)
  UNION ALL SELECT r, f.key, f.lev + 1, CASE WHEN f.lev + 1 = depth THEN top ELSE f.pos // 8 END, top, depth, CASE WHEN d.pos IS NULL THEN v ELSE sha256(d.a || v || d.b) END, proof || coalesce(d.a || d.b, '')
  FROM fold f LEFT JOIN sides d ON d.key = f.key AND d.lev = f.lev AND d.pos = f.pos WHERE f.lev < depth
), upper_fold AS (
  SELECT r, 0 AS lev, top AS pos, v, proof FROM fold WHERE lev = depth
  UNION ALL SELECT r, f.lev + 1, f.pos // 8, sha256(d.a || v || d.b), proof || d.a || d.b FROM upper_fold f JOIN sides d ON d.key IS NULL AND d.lev = f.lev AND d.pos = f.pos
), root AS (SELECT lev, h FROM over_them WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root, sha256(u.proof) AS proof_sha256, u.v AS folded_root, u.v = root.h AS verified
FROM p JOIN s USING (key) JOIN upper_fold u USING (r) JOIN root ON root.lev = u.lev
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

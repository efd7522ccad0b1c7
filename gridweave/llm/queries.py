"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, leaks, licenses, mixing, nearcopies, nearvectors, packing, pages, phrases, prefixes, repeats, sharding, topk
from .common import stored, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(run):
    LLM_QUERIES[run.__name__] = run
    return run


@query
def op1_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op2_sharding(spark, sf_dir):
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), ["doc_id"], SHARDS)
    return placed.select("doc_id", "slot", "shard")


LLM_ORACLES["op2_sharding"] = f"""
WITH filled AS (SELECT string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',') AS owners),
     placed AS (
       SELECT doc_id, CAST(('0x' || substr(md5(coalesce('=' || doc_id, 'null')), 1, 15))::BIGINT
                      % {sharding.TABLE_SIZE} AS INTEGER) AS slot
       FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owners[slot + 1], 3, '0') AS shard FROM placed, filled
"""


@query
def op7_mixing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    sizes = stored(documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    return mixing.mix_sources(sizes).select("doc_id", "size", "source_size", "target", "taken")


LLM_ORACLES["op7_mixing"] = r"""
WITH sized AS (
       SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
       FROM documents),
     sources AS (
       SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
              ([3, 1, 2])[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS weight
       FROM sized GROUP BY source),
     levels AS (
       SELECT *, source_size * 2 / weight AS stops_at,
              (1.5::DOUBLE * sum(source_size) OVER ()
               - coalesce(sum(source_size * 2) OVER before, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
       FROM sources
       WINDOW before AS (ORDER BY source_size * 2 / weight, source NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     targets AS (
       SELECT source, source_size,
              least(CAST(source_size * 2 AS DOUBLE),
                    coalesce(max(level) FILTER (level <= stops_at) OVER (), 'inf'::DOUBLE) * weight) AS target,
              CAST(('0x' || substr(md5('mix:' || coalesce('=' || source, 'null')), 1, 13))::BIGINT AS DOUBLE)
              / 4503599627370496.0::DOUBLE AS offset_
       FROM levels),
     placed AS (
       SELECT *, row_number() OVER (
                PARTITION BY source
                ORDER BY length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)),
                         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2))::INTEGER,
                         size, doc_id) AS place
       FROM sized),
     taken AS (
       SELECT p.doc_id, p.size, t.source_size, t.target,
              CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected, p.place, t.offset_
       FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(expected * place + offset_) - floor(expected * (place - 1) + offset_) AS BIGINT) * size AS taken
FROM taken
"""


@query
def op6_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op9_near_copies(spark, sf_dir):
    return nearcopies.near_copies(table(spark, sf_dir, "documents")).drop("digest")


@query
def op3_repeats(spark, sf_dir):
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"), form="sha256")
    return left.withColumn("kept_sha256", F.lower(F.hex("kept"))).drop("kept")


@query
def op4_top_scores(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return topk.top_scores(embeddings, F.col("vec_id") % 100 == 0)


LLM_ORACLES["op4_top_scores"] = """
WITH whole AS (
       SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
       FROM embeddings
       WHERE vec_id IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     scored AS (
       SELECT q.vec_id AS query_id, c.vec_id,
              CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
       FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
       WHERE q.vec_id % 100 = 0),
     ranked AS (
       SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op8_near_vectors(spark, sf_dir):
    return nearvectors.near_vectors(table(spark, sf_dir, "embeddings"))


LLM_ORACLES["op8_near_vectors"] = """
WITH RECURSIVE fit AS (
       SELECT row_number() OVER () AS r, vec_id, label, embedding, CAST(embedding AS DOUBLE[]) AS v
       FROM embeddings
       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS length FROM fit WHERE list_dot_product(v, v) > 0),
     links AS (
       SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
       WHERE list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.93),
     reach AS (SELECT DISTINCT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
     least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
     counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, e.vec_id) AS component_id,
       coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN least ON least.node = e.vec_id
"""


@query
def op5_pages(spark, sf_dir):
    return pages.extract_pages(table(spark, sf_dir, "pages"))


@query
def op10_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark, sf_dir):
    turns = stored(prefixes.turns_of(table(spark, sf_dir, "conversations")), "turns")
    key = F.col("key")
    rebuilt = prefixes.branched(turns, key - key % 5, F.crc32(key.cast("string").cast("binary")) % 9, most=8)
    return prefixes.prefix_trie(rebuilt)


LLM_ORACLES["op11_prefix_trie"] = """
WITH turns AS (
       SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                            ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
       FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     bits(i, c) AS (SELECT i, i FROM range(256) t(i)),
     crc_table AS (
       SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM bits),
     crc_list AS (SELECT list(v ORDER BY i) AS v FROM crc_table),
     named AS (
       SELECT conv_id, own, conv_id - conv_id % 5 AS base,
              CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
                                                  lambda p: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(p AS INTEGER), 1)) AS BIGINT))),
                                   lambda c, b: xor(v[1 + CAST(xor(c, b) & 255 AS INTEGER)], c >> 8)), 4294967295) % 9 AS INTEGER) AS h
       FROM turns, crc_list),
     rebuilt AS (
       SELECT n.conv_id, list_concat(coalesce(b.own[1:n.h], []), n.own[n.h + 1:]) AS s
       FROM named n LEFT JOIN turns b ON b.conv_id = n.base),
     members AS (
       SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s FROM rebuilt),
     placed AS (
       SELECT conv_id, depth, md5(CAST(s[1:depth] AS JSON)) AS node,
              CASE WHEN depth > 0 THEN md5(CAST(s[1:depth - 1] AS JSON)) END AS parent,
              CASE WHEN depth > 0 THEN strlen(s[depth].t) ELSE 0 END AS bytes, len(s) = depth AS ended
       FROM members),
     nodes AS (
       SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends
       FROM placed GROUP BY depth, node),
     kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
     lines AS (
       SELECT DISTINCT a.node AS top, b.node AS below FROM placed a JOIN placed b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
     trees AS (
       SELECT l.top, count(*) FILTER (k.n IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved
       FROM lines l JOIN nodes n ON n.node = l.below LEFT JOIN kids k ON k.parent = n.node GROUP BY l.top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves, t.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.parent = n.node JOIN trees t ON t.top = n.node
"""


@query
def op12_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents")).drop("seen_doc", "seen_byte")


LLM_ORACLES["op12_collocations"] = r"""
WITH pieces AS (
       SELECT coalesce(lang, 'und') AS lang,
              unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
       FROM documents),
     worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
     totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
     grams AS (
       SELECT lang, size, array_to_string(w[p:p + size - 1], ' ') AS phrase
       FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM worded, range(1, 6) s(size))),
     counts AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100),
     cuts AS (
       SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM counts WHERE size > 1),
     scored AS (
       SELECT c.lang, c.size, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n,
              (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
       FROM cuts c JOIN totals t USING (lang)
       JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
       JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
     best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     longer AS (
       SELECT DISTINCT lang, array_to_string(w[p:p + part - 1], ' ') AS phrase, a
       FROM (SELECT lang, size, a, string_split(phrase, ' ') AS w, part, unnest(range(1, size - part + 2)) AS p
             FROM counts, range(2, 5) s(part) WHERE part < size)),
     kept AS (
       SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.a >= 100 * b.a))
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept)
WHERE rank <= 2000
"""


@query
def op13_leaks(spark, sf_dir):
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


LLM_ORACLES["op13_leaks"] = r"""
WITH docs AS (
       SELECT row_number() OVER () AS r, doc_id,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM documents),
     items AS (
       SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM benchmark),
     windows AS (
       SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM items WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT k FROM windows),
     places AS (
       SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, sizes)),
     hits AS (SELECT r, p, k, item_id FROM places JOIN windows USING (k, g)),
     words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
     named AS (
       SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

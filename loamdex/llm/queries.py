"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lloyd, media, mixing, sharding, simhash, substring, suffixarray, topk, toxicity, urlfilter, variants
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("_leak.items", ","), 256)
    return found.select("doc_id", "_leak.n_words", "_leak.n_hit", F.size("_leak.items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("_leak.n_hit") > 0).alias("contaminated"))


#: Fixed values of the contract.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return rendered.select("conv_id", "perspective", "page", "part", "n_turns", "text", spans.alias("mask"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.remove_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.summed(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_media, op4_sharding, op5_decontamination, op6_url_filter, op7_substring, op8_chat, op9_suffix_array, op10_toxicity, op11_spelling_variants, op12_centroid_clustering, op13_exact_topk)}

#: CRC-32's table, from its polynomial.
_CRC = [0] * 256
for _byte in range(256):
    _value = _byte
    for _ in range(8):
        _value = _value >> 1 ^ (0xEDB88320 if _value & 1 else 0)
    _CRC[_byte] = _value


def _lloyd_sql(rounds: int = 10) -> str:
    """Lloyd's rounds as one table after the other."""
    out = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v QUALIFY c < 8)"""
    for k in range(rounds + 1):
        out += f""",
        a{k} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - k.v[i]) * (v.v[i] - k.v[i]))) AS d FROM v, c{k} k) GROUP BY r)"""
        if k < rounds:
            out += f""",
        s{k} AS (SELECT best.c AS c, i, CAST(floor(sum(v[i])::HUGEINT // count(*) - CASE WHEN sum(v[i]) < 0 AND sum(v[i])::HUGEINT % count(*) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS x FROM a{k} JOIN v USING (r), unnest(range(1, 65)) AS u(i) GROUP BY ALL),
        c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{k} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM s{k} GROUP BY c) n USING (c))"""
    return out + f"""
        SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} k ON k.c = best.c"""


ORACLE_SQL = {
    "op5_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
        o AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM p), unnest(range(1, len(w) - n + 2)) AS u(i)),
        f AS (SELECT DISTINCT o.r, o.i, o.n, p.item_id FROM o JOIN p ON o.s = p.s AND o.n = p.n),
        h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM f), unnest(range(0, n)) AS u(k) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM f WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op6_url_filter": r"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
        SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, coalesce(max_by(action, length(h || p)), 'allow') AS verdict
        FROM (SELECT row_number() OVER () AS k, * FROM u) LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k, page_id, host, path""",
    "op7_substring": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT r, i, md5_number(array_to_string(w[i : i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
        g AS (SELECT r, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
        x AS (SELECT a.r, a.j, a.word, max(g.i) OVER (PARTITION BY a.r ORDER BY a.j) AS last FROM (SELECT r, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(j)) a LEFT JOIN g ON g.r = a.r AND g.i = a.j),
        k AS (SELECT r, count(*) AS n, count(*) FILTER (last IS NOT NULL AND j - last < 35) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (last IS NULL OR j - last >= 35) AS kept FROM x GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op8_chat": r"""
        WITH r AS (SELECT conv_id, turn, CAST(floor(turn / 256) AS BIGINT) AS page, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
        t AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id, page ORDER BY turn, who, said) - 1) / 256) AS BIGINT) AS part FROM r),
        p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
        s AS (SELECT p.conv_id, perspective, page, part, turn, who, said, '<|im_start|>' || CASE WHEN who = perspective THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || replace(replace(replace(who, '<|', '< |'), chr(10), ' '), chr(13), ' ') END || chr(10) AS head, said || '<|im_end|>' AS body, row_number() OVER (PARTITION BY p.conv_id, perspective, page, part ORDER BY turn, who, said) AS k FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
        o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, page, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM s)
        SELECT conv_id, perspective, page, part, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
        coalesce(string_agg(CASE WHEN who = perspective THEN CAST(a AS BIGINT) || '-' || CAST(a + length(body) AS BIGINT) END, ',' ORDER BY k), '') AS mask FROM o GROUP BY conv_id, perspective, page, part""",
    "op11_spelling_variants": rf"""
        WITH RECURSIVE t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        g AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= 5 GROUP BY ALL),
        h AS (SELECT run, n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda crc, b: xor({_CRC}[(xor(crc, b) & 255) + 1], crc >> 8), 4294967295), 4294967295) AS h FROM g),
        m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        x AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
        p AS (SELECT x.word, y.word AS other, y.n FROM x JOIN x y ON x.a || '*' || x.b = y.a || '*' || y.b AND x.word <> y.word
          UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.a || x.b = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.a || x.b = w.word),
        q AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -n, other := other)) AS best FROM p GROUP BY word),
        f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN best.other END AS form, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n FROM w LEFT JOIN q USING (word)),
        o AS (SELECT word, word AS at FROM f UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, o.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN o USING (word) JOIN f e ON e.word = o.at AND e.form IS NULL""",
    "op12_centroid_clustering": _lloyd_sql(),
    "op13_exact_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM k WHERE k <= 5""",
}

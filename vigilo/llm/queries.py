"""Registered queries of the training-data operators.

Each query applies one operator, with production parameters, to its whole
table.  ``SQL`` holds DuckDB text where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilo.llm import cascade, debruijn, digest, masked_lm, omh, packing, perspectives, pq, topk, toxicity, transducer, viterbi, warc

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: str) -> str:
    """SQL literal; control characters as chr()."""
    out = "'" + value.replace("'", "''") + "'"
    for c in "\r\n":
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return out


# --------------------------------------------------------------------- 1 WARC
def _tidy_sql(x: str) -> str:
    s = f"regexp_replace({x}, {_text(warc.BLANKS)}, ' ', 'g')"
    lines = f"list_transform(string_split({s}, chr(10)), lambda y: trim(y, ' '))"
    return f"array_to_string(list_filter({lines}, lambda y: y <> ''), chr(10))"


def _decoded_sql(x: str) -> str:
    """Character references of ``x`` (see warc.decode_references)."""
    names = ", ".join(f"{_text(k)}: {_text(v)}" for k, v in warc.ENTITIES.items())
    ref = f"regexp_extract(p, {_text(warc.REFERENCE.replace('&', '^'))}, 1)"
    code = (f"(CASE WHEN lower({ref}[2]) = 'x' THEN ('0x' || {ref}[3:])::BIGINT ELSE TRY_CAST({ref}[2:] AS BIGINT) END)")
    char = (f"(CASE WHEN {ref}[1] = '#' THEN chr((CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 "
            f"OR {code} > 1114111 THEN 65533 ELSE {code} END)::INTEGER) "
            f"WHEN {ref} <> '' THEN MAP {{{names}}}[{ref}] END)")
    piece = f"coalesce({char} || p[length({ref}) + 2:], '&' || p)"
    return (f"string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], "
            f"lambda p: {piece}), '')")


def _digest_sql(x: str) -> str:
    return f"'sha256:' || sha256({x})"


def _id_sql(kind: str, name: str) -> str:
    h = f"md5('{kind}|' || {name})"
    return (f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' "
            f"|| {h}[21:32] || '>'")


def _encoded_sql(x: str) -> str:
    """Control characters of ``x`` percent-encoded (see warc.encoded)."""
    out = x
    for c in warc.CONTROLS:
        out = f"replace({out}, chr({c}), '%{c:02X}')"
    return f"CASE WHEN regexp_matches({x}, '[\\x00-\\x1F\\x7F]') THEN {out} ELSE {x} END"


def _op1_sql() -> str:
    nl = "chr(13) || chr(10)"
    field = lambda name, value: f"'{name}: ' || {value} || {nl}"
    vis = f"regexp_replace(payload, {_text(warc.HIDDEN)}, '', 'g')"
    body = (f"regexp_replace(regexp_replace(vis, {_text(warc.BLOCK_TAG)}, chr(10), 'g'), {_text(warc.ANY_TAG)}, '', 'g')")
    title = f"regexp_replace(regexp_extract(vis, {_text(warc.TITLE)}, 1), {_text(warc.ANY_TAG)}, '', 'g')"
    links = f"list_transform(regexp_extract_all(vis, {_text(warc.LINK)}, 1), lambda x: {_encoded_sql('x')})"
    header = " || ".join([
        f"'WARC/1.1' || {nl}", field("WARC-Type", "record_type"), field("WARC-Record-ID", "record_id"),
        field("WARC-Refers-To", "refers_to"), field("WARC-Refers-To-Target-URI", "target_uri"),
        field("WARC-Refers-To-Date", "date"), field("WARC-Target-URI", "target_uri"), field("WARC-Date", "date"),
        field("WARC-Block-Digest", "block_digest"), field("Content-Type", "content_type"),
        field("Content-Length", "content_length"), nl])
    return f"""
WITH p AS (SELECT page_id AS source_id, {_encoded_sql("coalesce(url, '')")} AS target_uri, '{warc.FETCHED}' AS date,
                  coalesce(html, '') AS payload FROM pages),
q AS (SELECT *, 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: '
             || strlen(payload) || {nl} || {nl} AS http_header, {_digest_sql('payload')} AS payload_digest,
             {vis} AS vis FROM p),
r AS (SELECT *, {_id_sql('response', "concat_ws('|', source_id, target_uri, date, payload_digest)")} AS refers_to,
             {_digest_sql('http_header || payload')} AS source_block,
             {body} AS raw, {title} AS raw_title, {links} AS links FROM q),
d AS (SELECT *, {_decoded_sql('raw')} AS raw2, {_decoded_sql('raw_title')} AS title2 FROM r),
t AS (SELECT *, {_tidy_sql('raw2')} AS txt, replace({_tidy_sql('title2')}, chr(10), ' ') AS title,
             {_id_sql('conversion', 'refers_to')} AS conversion_id FROM d),
b AS (SELECT source_id, 'conversion' AS record_type, conversion_id AS record_id, refers_to, target_uri, date,
             payload_digest AS source_digest, 'text/plain; charset=utf-8' AS content_type, txt AS block FROM t
      UNION ALL
      SELECT source_id, 'metadata', {_id_sql('metadata', 'refers_to')}, refers_to, target_uri, date, payload_digest,
             'application/warc-fields',
             regexp_replace(http_header, '(?:\\r\\n)+$', {nl})
             || {field('source-payload-digest', 'payload_digest')} || {field('source-block-digest', 'source_block')}
             || {field('conversion', 'conversion_id')} || {field('conversion-digest', _digest_sql('txt'))}
             || {field('title', 'title')}
             || CASE WHEN len(links) > 0 THEN 'outlink: ' || array_to_string(links, {nl} || 'outlink: ') || {nl}
                     ELSE '' END
      FROM t),
c AS (SELECT *, strlen(block)::BIGINT AS content_length, {_digest_sql('block')} AS block_digest FROM b)
SELECT source_id, record_type, record_id, refers_to, target_uri, date, source_digest, content_type, content_length,
       block_digest, {header} AS warc_header, block
FROM c"""


@register(_op1_sql())
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


# ------------------------------------------------------------------ 2 packing
@register()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(_table(spark, sf_dir, "documents"))


# ----------------------------------------------------------- 3 near-duplicates
@register()
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(_table(spark, sf_dir, "documents"))


# --------------------------------------------------------- 4 pseudo-likelihood
@register()
def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(_table(spark, sf_dir, "documents"))


# -------------------------------------------------------- 5 repeated passages
@register()
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return debruijn.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# ------------------------------------------------------------- 6 perspectives
_OP6_SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS body, text FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
j AS (SELECT *, role IS NOT DISTINCT FROM perspective AS trained,
             '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
               WHEN role IS NULL THEN 'user'
               ELSE 'user name=' || regexp_replace(role, '[^0-9A-Za-z_.-]', '_', 'g') END || chr(10) AS header
      FROM t JOIN s ON conv_id IS NOT DISTINCT FROM c),
k AS (SELECT *, header || replace(body, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS segment FROM j),
o AS (SELECT *, row_number() OVER w - 1 AS position,
             sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS char_end
      FROM k WINDOW w AS (PARTITION BY conv_id, perspective
                          ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, perspective, position::BIGINT AS position, turn, role, segment,
       (char_end - length(segment))::BIGINT AS char_start, char_end, trained,
       CASE WHEN trained THEN (char_end - length(segment) + length(header))::BIGINT END AS mask_start,
       CASE WHEN trained THEN (char_end - 1)::BIGINT END AS mask_end
FROM o
"""


@register(_OP6_SQL)
def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(_table(spark, sf_dir, "conversations"))


# ------------------------------------------------------------------ 7 cascade
_OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM c, (VALUES (0), (1), (2)) AS v(j) WHERE n >= 2 GROUP BY rid),
li AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(li.dup, 0)::BIGINT AS n_dup_lines, coalesce(li.n, 0) AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+!!(?:[\x20\x09-\x0D]|$)')) AS n_shouts
      FROM w LEFT JOIN li USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * n_shouts > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""


@register(_OP7_SQL)
def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.quality_cascade(_table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 8 Viterbi
@register()
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = viterbi.encode(_table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        (F.octet_length("merged_ids") / 4).cast("long").alias("n_merged_ids"),
        F.crc32("merged_ids").alias("merged_ids_crc32"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "ids")
    return viterbi.decode(coded).select("doc_id", "n_ids", "ids_crc32", "n_merged_ids", "merged_ids_crc32",
                                        (F.md5("decoded") == F.col("text_md5")).alias("round_trip"))


# ----------------------------------------------------------------- 9 toxicity
@register()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


# ------------------------------------------------------------------- 10 top-k
_OP10_SQL = """
WITH c AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
n AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM c),
u AS (SELECT rid, vec_id, len(embedding) AS dim, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM n),
bad AS (SELECT rid FROM u WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT rid, vec_id, dim, i, floor(256 * x::DOUBLE)::BIGINT AS x FROM u WHERE rid NOT IN (SELECT rid FROM bad)),
s AS (SELECT q.vec_id AS query_id, d.vec_id, d.rid, q.rid AS qrid, sum(q.x * d.x)::BIGINT AS score
      FROM v q JOIN v d ON q.i = d.i AND q.dim = d.dim WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
      GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@register(_OP10_SQL)
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


# ------------------------------------------------------------ 11 fingerprints
_OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, length(text) AS n, coalesce(lead(rid) OVER w, first_value(rid) OVER w) AS next_rid,
             coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(text))),
t AS (SELECT rid, 0 AS edited, text FROM o
      UNION ALL SELECT rid, 1, left(text, n - n // 3) || left(next_text, n // 3) FROM o),
h AS (SELECT *, regexp_extract_all(hex(encode(text)), '..') AS hs FROM t),
b AS (SELECT rid, edited, list_transform(hs, lambda x: ('0x' || x)::BIGINT) AS bs FROM h),
g AS (SELECT rid, edited, unnest(list_transform(range(1, len(bs) - {digest._SPAN - 1}), lambda i:
             (bs[i] + 256 * bs[i + {digest.OFFSETS[1]}] + 65536 * bs[i + {digest.OFFSETS[2]}])
             * {digest.FACTOR} % 4294967296 // 16777216)) AS bucket FROM b),
c AS (SELECT rid, edited, bucket, count(*) AS k FROM g GROUP BY ALL),
f AS (SELECT rid, edited, u.bucket, coalesce(k, 0) AS k FROM (SELECT rid, edited, unnest(range(256)) AS bucket FROM t) u
      LEFT JOIN c USING (rid, edited, bucket)),
q AS (SELECT rid, edited, list_sort(list(k)) AS ks FROM f GROUP BY ALL),
s AS (SELECT rid, edited, bucket, (k > ks[64])::INT + (k > ks[128])::INT + (k > ks[192])::INT AS q
      FROM f JOIN q USING (rid, edited)),
l AS (SELECT rid, edited, len(bs) + 1 AS m, length(bin(len(bs) + 1)) - 1 AS e FROM b),
n AS (SELECT rid, edited, 8 * e + m * 8 // (1 << e) - 8 AS code FROM l),
x AS (SELECT rid, edited, bucket // 2 AS pair, printf('%x', sum(CASE WHEN bucket % 2 = 0 THEN 4 * q ELSE q END)::BIGINT) AS digit
      FROM s GROUP BY ALL),
p AS (SELECT rid, edited, printf('%03x', any_value(code)::BIGINT) || string_agg(digit, '' ORDER BY pair) AS print
      FROM x JOIN n USING (rid, edited) GROUP BY ALL),
y AS (SELECT rid, 1 AS other, rid AS other_rid FROM o UNION ALL SELECT rid, 0, next_rid FROM o),
v AS (SELECT rid, edited, code, list(q ORDER BY bucket) AS qs FROM s JOIN n USING (rid, edited) GROUP BY ALL),
z AS (SELECT y.rid, y.other, 1 - (list_sum(list_transform(range(1, 257), lambda i:
               CASE abs(a.qs[i] - c.qs[i]) WHEN 3 THEN {digest.FAR_STEP} ELSE abs(a.qs[i] - c.qs[i]) END))
             + {digest.LENGTH_STEP} * least(abs(a.code - c.code), {digest.LENGTH_STEPS}))::DOUBLE / {digest.BOUND} AS near
      FROM y JOIN v a ON a.rid = y.rid AND a.edited = 0 JOIN v c ON c.rid = other_rid AND c.edited = other)
SELECT doc_id, n::BIGINT AS n_chars, sha256(e.text) AS edited_sha256, p0.print AS fingerprint,
       p1.print AS edited_fingerprint, z1.near AS near_edited, z0.near AS near_next
FROM o JOIN t e ON e.rid = o.rid AND e.edited = 1
       JOIN p p0 ON p0.rid = o.rid AND p0.edited = 0 JOIN p p1 ON p1.rid = o.rid AND p1.edited = 1
       JOIN z z1 ON z1.rid = o.rid AND z1.other = 1 JOIN z z0 ON z0.rid = o.rid AND z0.other = 0
"""


@register(_OP11_SQL)
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.neighbour_edits(_table(spark, sf_dir, "documents"))


# ------------------------------------------------------ 12 source divergence
_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
t AS (SELECT rid, lang, source,
             translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
f AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v))::HUGEINT AS p
      FROM f JOIN s USING (lang, source) JOIN v USING (lang)),
l AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)))::HUGEINT AS q
      FROM f JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY ALL) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
      FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL SELECT lang, source, 'term', item, value FROM z)
SELECT lang, source, part, item, value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""


@register(_OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.audit(_table(spark, sf_dir, "documents"))


# -------------------------------------------------------- 13 vector compression
def _op13_sql() -> str:
    ctes, n = [], pq.PARTS
    for r in range(pq.ROUNDS + 1):
        ctes.append(f"""
a{r} AS (SELECT rid, dim, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
         SELECT v.rid, v.dim, v.part, entry, sum((v.x - e.x) * (v.x - e.x))::BIGINT AS d
         FROM v JOIN e{r} e ON e.dim = v.dim AND e.i = v.i GROUP BY ALL) GROUP BY ALL)""")
        if r < pq.ROUNDS:
            ctes.append(f"""
s{r} AS (SELECT dim, i, entry, sum(x)::BIGINT AS s, count(*) AS c FROM v JOIN a{r} USING (rid, dim, part) GROUP BY ALL),
e{r + 1} AS (SELECT e.dim, e.part, e.i, e.entry, coalesce((s - ((s % c) + c) % c) // c, e.x) AS x
       FROM e{r} e LEFT JOIN s{r} USING (dim, i, entry))""")
    return f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT rid, vec_id, len(embedding) AS dim, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM k),
bad AS (SELECT DISTINCT rid FROM u WHERE x IS NULL OR NOT isfinite(x)),
v AS MATERIALIZED (SELECT rid, vec_id, dim, i, ({n} * i - 1) // dim AS part, floor({pq.SCALE} * x::DOUBLE)::BIGINT AS x
      FROM u WHERE rid NOT IN (SELECT rid FROM bad)),
f AS (SELECT rid, row_number() OVER (PARTITION BY dim ORDER BY vec_id NULLS LAST, xs) - 1 AS entry
      FROM (SELECT rid, vec_id, dim, list(x ORDER BY i) AS xs FROM v GROUP BY ALL)),
e0 AS (SELECT dim, part, i, entry, x FROM v JOIN f USING (rid) WHERE entry < {pq.ENTRIES}),{",".join(ctes)},
h AS (SELECT dim, sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM e{pq.ROUNDS} GROUP BY dim),
c AS (SELECT rid, dim, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
      FROM a{pq.ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN k USING (rid) JOIN h USING (dim)
"""


@register(_op13_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = pq.compress(_table(spark, sf_dir, "embeddings"))
    marks = [x for dim, own in books.items() for x in (F.lit(dim), F.lit(pq.codebook_digest(own)))]
    mark = F.element_at(F.create_map(*marks), F.col("dim")) if marks else F.lit(None).cast("string")
    return pq.label_errors(codes).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error",
                                         "label_error", mark.alias("codebooks_sha256"))

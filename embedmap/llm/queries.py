"""One query per operator with production parameters, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.llm import hostrules, infill, lines, mixing, neardup, packing, ppm, prefixtrie, substrings, topk, urltree, warc, weaklabels
from embedmap.llm.registry import query, table
from embedmap.llm.tables import stored

#: Tokenizer of the packing query; the files lie outside the repository.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


WARC_SQL = r"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) AS http
  FROM pages
), named AS (
  SELECT *, md5('response ' || coalesce(page_id::VARCHAR, 'null') || ' ' || uri) AS h, chr(13) || chr(10) AS e,
    'sha256:' || sha256(http || chr(13) || chr(10) || chr(13) || chr(10) || body) AS block_digest, 'sha256:' || sha256(body) AS payload_digest FROM source
), linked AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS id,
    regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script[^>]*>.*?(</script[ \t\r\n]*>|\z)|<style[^>]*>.*?(</style[ \t\r\n]*>|\z)|<!--.*?(-->|\z)', ' ', 'g'),
      '(?i)</?(p|div|br|hr|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|main|form|pre|blockquote)(/?>|[ \t\r\n][^>]*>)', chr(10), 'g'),
      '(?s)<[a-zA-Z/!?][^>]*>', '', 'g') AS bare FROM named
), decoded AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(bare, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', chr(32)), '&amp;', '&') AS raw FROM linked
), texts AS (
  SELECT *, trim(regexp_replace(regexp_replace(raw, '[ \t\r\x0B\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text,
    trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>([^<]*)', 1), '[ \t\r\n]+', ' ', 'g'), ' ') AS title FROM decoded
), blocks AS (
  SELECT page_id, id, uri, payload_digest, 'conversion' AS type, 'text/plain; charset=utf-8' AS content_type, text AS block FROM texts
  UNION ALL
  SELECT page_id, id, uri, payload_digest, 'metadata', 'application/warc-fields', 'source-record-id: ' || id || e || 'source-status: 200' || e
    || 'source-header-Content-Type: text/html; charset=utf-8' || e || 'source-header-Content-Length: ' || strlen(body) || e || 'source-block-digest: ' || block_digest || e
    || 'source-payload-digest: ' || payload_digest || e || 'title: ' || title || e || 'text-digest: sha256:' || sha256(text) || e || 'text-chars: ' || length(text) || e FROM texts
), ids AS (
  SELECT *, md5(type || ' ' || id) AS h FROM blocks
)
SELECT page_id, type, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id, id AS refers_to,
  uri AS target_uri, '1970-01-01T00:00:00Z' AS date, content_type, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest, block
FROM ids
"""


@query("op1_warc_derivatives", WARC_SQL)
def op1(spark, sf):
    """A metadata record and a plain-text conversion record of every page."""
    return warc.derive(warc.responses(table(spark, sf, "pages")))


#: Rules of the URL query.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query("op3_url_templates")
def op3(spark, sf):
    """Host, path, rule and verdict of every page; pages whose document label is toxic or of low quality are the unwanted ones."""
    labels = table(spark, sf, "labels")
    unwanted = labels.select(F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("unwanted"))
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urltree.judge_urls(pages, unwanted, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


LINE_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), rows AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM rows
), found AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS goes FROM keyed LEFT JOIN found USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op2_line_dedup", LINE_SQL)
def op2(spark, sf):
    """Lines and dropped lines of every document, and a digest of what stays."""
    out = lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.text", 256).alias("kept_sha256"))


QUALITY_SQL = r"""
WITH cut AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), base AS (
  SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines, w FROM cut
), grams AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM base WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM twice) GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, coalesce(source, '') AS host, n_words, word_chars, n_symbols, n_upper, len(full_lines) AS n_lines,
    len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN repeated r ON b.doc_id = r.doc_id
), rules AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    [4 * n_symbols > n_words, 2 * n_upper > word_chars, n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines, word_chars > 12 * n_words] AS f FROM counted
), long AS (
  SELECT host, r, f[r] AS failed FROM rules, (SELECT unnest([1, 2, 3, 4]) AS r)
), hosts AS (
  SELECT host, r, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM long GROUP BY host, r
), moments AS (
  SELECT r, sum(k) / sum(n) AS m, sum(n) / count(*) AS size, sum(n * (k / n) * (k / n)) / sum(n) - pow(sum(k) / sum(n), 2) AS v FROM hosts GROUP BY r
), prior AS (
  SELECT r, m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) / greatest(size, 1.0), 1e-9) - 1, 1.0), 1000.0) AS strength FROM moments
), strict AS (
  SELECT host, r FROM hosts JOIN prior USING (r) WHERE (k + m * strength) / (n + strength) > 0.01
), against AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id, host, unnest([1, 2, 3, 4]) AS r, f FROM rules) x JOIN strict USING (host, r) WHERE f[r]
)
SELECT rules.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND against.doc_id IS NULL AS kept
FROM rules LEFT JOIN against ON rules.doc_id = against.doc_id
"""


@query("op4_host_rules", QUALITY_SQL)
def op4(spark, sf):
    """Counts of every document, the base rule, and the verdict with its host's record."""
    out = hostrules.judge(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) + 1 AS tokens FROM documents
), sources AS (
  SELECT s, CAST(sum(tokens) AS BIGINT) AS total FROM docs GROUP BY s
), shares AS (
  SELECT s, total, total / (SELECT sum(total) FROM sources) AS share FROM sources
), grid AS (
  SELECT k, k / 1048576 AS t FROM (SELECT unnest(range(1048577)) AS k)
), even AS (
  SELECT coalesce(max(k), -1) AS k FROM (
    SELECT k, ln(sum(pow(share, t))) - t * sum(pow(share, t) * ln(share)) / sum(pow(share, t)) AS h FROM grid, shares GROUP BY k, t)
  WHERE h >= 0.98 * ln((SELECT count(*) FROM shares))
), extremes AS (
  SELECT min(share) AS least, max(share) AS most FROM shares
), over AS (
  SELECT coalesce(max(k), -1) AS k FROM grid, extremes WHERE t < 1 AND pow(least / most, t - 1) > 4
), chosen AS (
  SELECT CASE WHEN (SELECT count(*) FROM shares) < 2 THEN 1.0
    ELSE least(greatest(even.k, over.k + 1, 0), 1048576) / 1048576 END AS t FROM even, over
), norm AS (
  SELECT t, sum(pow(share, t)) AS z FROM shares, chosen GROUP BY t
), budgets AS (
  SELECT s, total, greatest(CAST(floor(pow(share, t) / z * ((SELECT max(total) FROM shares) / (pow(most, t) / z)) + 1e-6) AS BIGINT), total) AS budget
  FROM shares, norm, extremes
), drawn AS (
  SELECT doc_id, source, s, total, budget, tokens, unnest(range(CAST(ceil(budget / total) AS BIGINT))) AS epoch FROM docs JOIN budgets USING (s)
), placed AS (
  SELECT *, epoch * total + coalesce(sum(tokens) OVER (PARTITION BY s, epoch ORDER BY md5('7:' || epoch || ':' || doc_id), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM drawn
), blocks AS (
  SELECT greatest(1, CAST(ceil(sum(budget) / 1048576) AS BIGINT)) AS n FROM budgets
)
SELECT doc_id, source, epoch, CAST(least(CAST(begins AS HUGEINT) * n // budget, n - 1) AS BIGINT) AS block, CAST(tokens AS BIGINT) AS tokens,
  total AS source_tokens, budget AS source_budget
FROM placed, blocks WHERE begins + tokens <= budget
"""


@query("op6_temperature_mix", MIX_SQL)
def op6(spark, sf):
    """Every draw of every document in a mix of all sources that covers them and repeats none more than four times."""
    docs = table(spark, sf, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_tokens"))
    out = mixing.mix(docs, tokens=F.col("n_tokens"))
    return out.select("doc_id", "source", *[f"_mix.{c}" for c in ("epoch", "block", "tokens", "source_tokens", "source_budget")])


NEAR_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 2))) AS i FROM cut WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), two_way AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, x AS other FROM two_way UNION SELECT reach.doc_id, two_way.y FROM reach JOIN two_way ON reach.other = two_way.x
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


@query("op5_minhash_near_dedup", NEAR_SQL)
def op5(spark, sf):
    """Classes of documents at 0.85 similarity of three-word shingles."""
    return neardup.near_duplicates(table(spark, sf, "documents"), width=3, percent=85)


REPEAT_SQL = r"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 35], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM cut WHERE len(w) >= 35)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i, unnest(range(35)) AS k FROM again)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM cut
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY words.pos) AS kept FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


@query("op7_substring_dedup", REPEAT_SQL)
def op7(spark, sf):
    """Words of every document, words in repeated windows of 35, and a digest of what stays."""
    out = substrings.remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_packing")
def op8(spark, sf):
    """Pieces of all documents in sequences of 4096 ids."""
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query("op9_weak_labels")
def op9(spark, sf):
    """Posterior and score of every document for each target, and whether it is kept."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = weaklabels.weak_scores(docs, table(spark, sf, "labels"))
    return out.select("doc_id", "_weak.*")


TOPK_SQL = r"""
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query("op10_exact_topk", TOPK_SQL)
def op10(spark, sf):
    """The five best other vectors of every fiftieth vector."""
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


INFILL_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed
), placed AS (
  SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS z,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:z], '') AS middle, array_to_string(u[z + 1:], '') AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query("op13_infill", INFILL_SQL)
def op13(spark, sf):
    """Cuts, form and digests of every document's fill-in-middle output, and the digest of the text rebuilt from it."""
    frames = stored(infill.framed(table(spark, sf, "documents").select("doc_id", "text")))
    done = infill.rebuilt(infill.fill_in_middle(frames))
    return done.select("doc_id", F.col("_restored.n_units").alias("n"), *[f"_restored.{c}" for c in ("form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i,
    strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda d: [ord(d), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: xor(CAST(floor(xor(a, e) / 2) AS BIGINT), 3988292384 * (xor(a, e) % 2)))) % 9 AS h FROM (SELECT DISTINCT CAST(c AS BIGINT) AS c FROM turns)
), rebuilt AS (
  SELECT ids.c, t.i AS d, said, size FROM ids JOIN turns t ON t.c = ids.base AND t.i <= h
  UNION ALL
  SELECT ids.c, t.i - h + least(h, coalesce(n, 0)) AS d, said, size FROM ids JOIN turns t ON t.c = ids.c AND t.i > h
    LEFT JOIN (SELECT c, count(*) AS n FROM turns GROUP BY c) b ON b.c = ids.base
), prefixes AS (
  SELECT c, d, size, md5(string_agg(md5(said), '') OVER (PARTITION BY c ORDER BY d)) AS p FROM rebuilt
  UNION ALL SELECT c, 0, 0, 'root' FROM ids
), members AS (
  SELECT c, d, p, size, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM prefixes
), nodes AS (
  SELECT d, p, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS said FROM members GROUP BY d, p
), kids AS (
  SELECT d - 1 AS d, up AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY d, up
), counted AS (
  SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (d, p)
), below AS (
  SELECT DISTINCT a.d, a.p, b.d AS bd, b.p AS bp FROM members a JOIN members b ON a.c = b.c AND a.d <= b.d
), sums AS (
  SELECT below.d, below.p, count(*) FILTER (WHERE k = 0) AS leaves, sum((n - 1) * size) AS saved FROM below JOIN counted ON counted.d = bd AND counted.p = bp GROUP BY below.d, below.p
)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, CAST(x.k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(x.said) AS ends_sha256
FROM counted x LEFT JOIN nodes y ON y.d = x.d - 1 AND y.p = x.up JOIN sums s ON s.d = x.d AND s.p = x.p
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark, sf):
    """Nodes of the trie of all rebuilt conversations."""
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(table(spark, sf, "conversations")))


@query("op11_ppm_scores")
def op11(spark, sf):
    """Base and model score of every document, learned from six of seven documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = ppm.ppm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    return out.select("doc_id", *[f"_lm.{c}" for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")])

"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dolomite.llm import bpe, codebook, conversation, exact_dedup, jaccard, langid, packing, pii, quality, simhash, suffix_dedup, token_store, warc
from dolomite.llm.common import LOWER, UPPER, documents, new_folder

def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read_archive(spark, folder)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.deduplicated(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_store.write_store(documents(spark, sf_dir), folder, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_store.read_store(spark, folder)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=0, capacity=2048)


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(documents(spark, sf_dir))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_suffix_dedup, op4_quality, op5_token_store, op6_simhash, op7_pii, op8_exact_dedup, op9_langid, op10_packing, op11_jaccard, op12_conversations, op13_codebook)}

#: RFC 4648 base 32 of a SHA-1, five bits at a time.
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
  (('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31 AS INT), 1) FOR i IN range(32)], '')"""

#: The plain patterns that the operator's are written after; neighbours that look-arounds would test are matched along.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "shortcard": r"[0-9](?:[ -]?[0-9])+",
}


def _pii_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, t, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps, CAST({pii.KINDS[kind][1]} AS DOUBLE) AS base, CAST({pii.KINDS[kind][2]} AS DOUBLE) AS more, '(^|[^a-z])({pii.KINDS[kind][3]})([^a-z]|$)' AS words FROM d"
        for rank, (kind, p) in enumerate(_PII.items())
    )
    luhn = "list_sum([CASE WHEN (n - i) % 2 = 0 THEN CAST(digits[i] AS INT) WHEN CAST(digits[i] AS INT) > 4 THEN 2 * CAST(digits[i] AS INT) - 9 ELSE 2 * CAST(digits[i] AS INT) END FOR i IN range(1, n + 1)]) % 10 = 0"
    mod97 = "list_reduce(list_prepend(0, [CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END FOR c IN string_split(substr(plain, 5) || left(plain, 4), '')]), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
    valid = f"length(plain) BETWEEN 15 AND 34 AND {mod97}".replace("plain", "replace(x, ' ', '')")
    parts = "[array_to_string(string_split(ms[i], ' ')[1:k], ' ') FOR k IN range(len(string_split(ms[i], ' ')), 0, -1)]"
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    span = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start)"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
        u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
        p AS (SELECT doc_id, t, rank, kind, base, more, words, CASE WHEN kind = 'iban' THEN list_filter({parts}, lambda x: {valid})[1] ELSE ms[i] END AS m, CAST(list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(g) FOR g IN ms[1 : i - 1]]), 0) AS INT) AS start FROM u),
        q AS (SELECT *, start + length(m) AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS digits, length(regexp_replace(m, '[^0-9]', '', 'g')) AS n, replace(m, ' ', '') AS plain FROM p),
        v AS (SELECT * FROM q WHERE CASE kind WHEN 'ip' THEN list_max([TRY_CAST(x AS DOUBLE) FOR x IN string_split(m, '.')]) <= 255 WHEN 'card' THEN n BETWEEN 16 AND 19 AND {luhn}
              WHEN 'phone' THEN n BETWEEN 8 AND 15 WHEN 'iban' THEN m IS NOT NULL WHEN 'shortcard' THEN n BETWEEN 12 AND 15 AND {luhn} ELSE TRUE END),
        s AS (SELECT *, base + CASE WHEN regexp_matches(lower(substr(t, greatest(start - {pii.BEFORE}, 0) + 1, least(start, {pii.BEFORE})) || ' ' || substr(t, stop + 1, {pii.AFTER})), words) THEN more ELSE 0 END AS score FROM v),
        k AS (SELECT * FROM s WHERE rank < {len(pii.BASE)} OR score >= {pii.THRESHOLD}),
        g AS (SELECT doc_id, {count}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (rank < {len(pii.BASE)}) AS b, {span} AS spans, max(score) AS top_score FROM k GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(encode(coalesce(b, ''))) AS base_sha256, coalesce(spans, '') AS spans, top_score FROM d LEFT JOIN g USING (doc_id)"""


def _codebook_sql() -> str:
    """Rounds of assignment and mean, each a CTE over the one before; a distance and its entry are one number, so that the least is by both."""
    parts, entries, scale = codebook.PARTS, codebook.ENTRIES, codebook.SCALE
    steps = f"""
        WITH g AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0),
        k AS (SELECT vec_id, label, [CAST(floor({scale} * x) AS BIGINT) FOR x IN e] AS v FROM g WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, len(v) // {parts} AS w FROM k),
        p AS (SELECT r, part, w, v[part * w + 1 : part * w + w] AS x FROM r, range({parts}) t(part)),
        c0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})"""
    for n in range(codebook.ROUNDS + 1):
        steps += f""",
        m{n} AS (SELECT p.r, p.part, any_value(p.x) AS x, min(CAST(list_sum([(p.x[i] - c.c[i]) * (p.x[i] - c.c[i]) FOR i IN range(1, w + 1)]) AS BIGINT) * {entries} + entry) AS best FROM p JOIN c{n} c USING (part) GROUP BY p.r, p.part)"""
        if n < codebook.ROUNDS:
            steps += f""",
        u{n} AS (SELECT part, best % {entries} AS entry, i, CAST(floor(sum(x[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS mean FROM m{n}, range(1, len(x) + 1) t(i) GROUP BY part, best % {entries}, i),
        l{n} AS (SELECT part, entry, list(mean ORDER BY i) AS c FROM u{n} GROUP BY part, entry),
        c{n + 1} AS (SELECT part, entry, coalesce(l.c, o.c) AS c FROM c{n} o LEFT JOIN l{n} l USING (part, entry))"""
    last = codebook.ROUNDS
    return f"""{steps},
        z AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM m{last} GROUP BY r),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN z USING (r), h"""


def _conversation_sql() -> str:
    """Forward search over rows: of each state the least of cost (nine digits) and audit, as one string; then a walk along the audit."""
    space = r"\x20\x09-\x0D"
    bits = "list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(conv || ':' || named, '')]), lambda a, c: {bits}), 4294967295)"

    def plus(v: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(left({v}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({v}, 10) || '{letter}')"

    keep = lambda v, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {plus(v, '3 * late', 'K')} END"
    other = lambda v: f"CASE WHEN NOT gone THEN {plus(v, '3 + 3 * late', 'R')} END"
    into_u = ", ".join(f"{keep(v, 'u')}, {other(v)}" for v in ("e", "s", "a2"))
    inserted = f"least(u, {plus('e', '3', 'I')}, {plus('s', '3', 'I')}, {plus('a', '3', 'I')})"
    closed = f"SELECT *, least(a, {plus('u2', '3', 'I')}) AS a2 FROM (SELECT *, {inserted} AS u2 FROM best)"
    return f"""
        WITH RECURSIVE o AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(CAST(turn AS VARCHAR), ' ') AS named, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
        f AS (SELECT *, {crc} % 20 AS fault FROM o),
        d AS (SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS initial, NOT regexp_matches(text, '[^{space}]') AS blank, NOT regexp_matches(text, '[.!?][{space}]*$') AS open FROM d),
        k AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN open AND NOT blank AND NOT again THEN 1 ELSE 0 END AS late, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM n),
        best AS (
          SELECT DISTINCT conv, CAST(1 AS BIGINT) AS i, repeat('0', 9) AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM k
          UNION ALL
          SELECT conv, i + 1, {plus("e", "4", "D")}, least({plus("s", "4", "D")}, {keep("e", "s")}), least({plus("u2", "4", "D")}, {into_u}), least({plus("a2", "4", "D")}, {keep("u2", "a")}, {other("u2")})
          FROM ({closed}) JOIN k USING (conv, i)),
        w AS MATERIALIZED (SELECT conv, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM (SELECT conv, least(e, a2) AS best, row_number() OVER (PARTITION BY conv ORDER BY i DESC) AS back FROM ({closed})) WHERE back = 1),
        walk AS (
          SELECT conv, audit, CAST(0 AS BIGINT) AS j, CAST(1 AS BIGINT) AS i, '' AS q, CAST(NULL AS VARCHAR) AS line FROM w
          UNION ALL
          SELECT conv, audit, j + 1, CASE WHEN letter = 'I' THEN walk.i ELSE walk.i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN initial ELSE CASE WHEN q = 'u' THEN 'a' ELSE 'u' END END,
                 CASE letter WHEN 'I' THEN CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END WHEN 'K' THEN role || ':' || text WHEN 'R' THEN CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END || text END
          FROM (SELECT *, substr(audit, j + 1, 1) AS letter FROM walk WHERE j < length(audit)) walk LEFT JOIN k USING (conv, i)),
        t AS (SELECT conv, sha256(coalesce(string_agg(line, chr(10) ORDER BY j), '')) AS h FROM walk GROUP BY conv),
        x AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(late) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv)
        SELECT conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))}, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, conv FROM o) LEFT JOIN x USING (conv) LEFT JOIN w USING (conv) LEFT JOIN t USING (conv)"""


#: Every shared shingle gives its pairs of documents, which SQL can afford on small tables alone.
_JACCARD = f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM d),
    u AS MATERIALIZED (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS g FROM s),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * shared >= 90 * (n + m - shared) UNION ALL SELECT y, x FROM p WHERE 100 * shared >= 90 * (n + m - shared)),
    r AS (SELECT DISTINCT x AS doc_id, x AS other FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
    c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
    SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id FROM s LEFT JOIN c USING (doc_id)"""

ORACLES = {
    "op11_jaccard": _JACCARD,
    "op12_conversations": _conversation_sql(),
    "op13_codebook": _codebook_sql(),
    "op7_pii": _pii_sql(),
    "op2_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, sha1(encode(html)) AS h FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op8_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(encode(norm)) AS text_sha256 FROM n JOIN g USING (norm)""",
}

"""Registered queries of the numbered operators and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import codes, divergence, langid, mixing, nearjoin, pieces, quality, substrings, topk, training, urlrules, warc, wrapper
from quire.llm.common import table


def op1_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    docs = table(spark, sf_dir, "documents").select("text")
    read = training.materialise(docs, ranks, public_tokenizers.PATTERN)
    return read.select("slot", "number", "shard", "offset", F.octet_length("ids").alias("n_bytes"), F.sha2("ids", 256).alias("ids_sha256"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = langid.learn(docs.where(~held_out).select("text", "lang"))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, model or tokenizer_path("piece_bpe_32k.model"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_history(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judged(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), *urlrules.rule_tables(spark))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {"op1_training": op1_training, "op2_mix": op2_mix, "op3_langid": op3_langid, "op4_topk": op4_topk, "op5_pieces": op5_pieces, "op6_warc": op6_warc, "op7_substrings": op7_substrings, "op8_rules": op8_rules, "op9_wrapper": op9_wrapper, "op10_nearjoin": op10_nearjoin,
           "op11_urlrules": op11_urlrules, "op12_divergence": op12_divergence, "op13_codes": op13_codes}
ORACLES: dict[str, str] = {
    "op4_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
              from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
        from s qualify rank <= 5""",
    "op11_urlrules": r"""
        with u as (select page_id, coalesce(url, '') as url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from pages),
        parts as (select page_id, low, regexp_extract(low, '://([^/?#]*)', 1) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from u),
        ruled as (select *, case
            when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
            when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
            when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from parts),
        words(block, pattern) as (values
            (0, '@@^adult^education^'), (0, '@@^anti^spam^'), (0, '@@^gambling^help^'), (1, '^adult^'), (1, '^porn^'), (1, '^xxx^'), (1, '^casino^'), (1, '^poker^'),
            (1, '^bets^'), (1, '^betting^'), (1, '^gambling^'), (1, '^pills^'), (1, '^viagra^'), (1, '^replica^watches^'), (1, '^payday^loan'), (1, '^warez^'),
            (1, '^torrent^'), (1, '^spam^'), (1, '^phishing^')),
        texts as (select distinct low from ruled where rule is null),
        met as (
            select low, block, pattern from texts join words
            on regexp_matches(low, replace(replace(pattern, '@@', ''), '^', '(?:[^a-z0-9]|^|$)'))
            union all select low, 1, '||ads^' from texts where regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?ads([^a-z0-9]|$)')
            union all select low, 1, '||adserver^' from texts where regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?adserver([^a-z0-9]|$)')
            union all select low, 1, '||click^track*^id=' from texts where regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?click[^a-z0-9]track.*[^a-z0-9]id=')
            union all select low, 1, '/wp-login.php|' from texts where ends_with(low, '/wp-login.php')
            union all select low, 1, '^free^*^download^*.exe|' from texts where regexp_matches(low, '(^|[^a-z0-9])free[^a-z0-9].*[^a-z0-9]download[^a-z0-9].*[.]exe$')),
        best as (select low, block, pattern from met qualify row_number() over (partition by low order by block, length(pattern) desc, pattern desc) = 1)
        select page_id, host, path, rule, pattern,
               case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when block = 1 then 'block' else 'allow' end as verdict
        from ruled left join best on rule is null and ruled.low = best.low""",
    "op12_divergence": r"""
        with docs as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
        words as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
        kept as (select lang, term, count(*) as total from words group by all having count(distinct id) >= 30),
        groups as (select distinct lang, source from docs),
        counts as (select lang, source, term, count(*) as n from words group by all),
        cells as (select g.lang, g.source, k.term, k.total, coalesce(c.n, 0) as n from groups g join kept k using (lang) left join counts c using (lang, source, term)),
        shares as (
            select lang, source, term, n, 1 + 1000000000::hugeint * (n + 5) // (sum(n) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)) as p,
                   1 + 1000000000::hugeint * (total + 5) // (sum(total) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)) as q from cells),
        pairs as (select a.lang, a.source, b.source as item, sum(abs(x.p - y.p)) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
                  left join shares x on x.lang = a.lang and x.source = a.source left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
        parts as (select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value from pairs
                  union all select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q)
        select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from parts qualify part = 'pair' or rank <= 50""",
    "op13_codes": """
        with v as (select row_number() over (order by vec_id, embedding) as id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        size as (select len(e) // 16 as w from v where id = 1),
        parts as materialized (select id, j, e[j * w + 1:j * w + w] as x from v, size, (select unnest(range(16)) as j)),
        c0 as (select j, id - 1 as k, x as c from parts where id <= 64),
        a1 as (select * from (select id, j, k, x, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from parts join c0 using (j))
               qualify row_number() over (partition by id, j order by d, k) = 1),
        m1 as (select j, k, list(s order by i) as c from (select j, k, i, floor(sum(x[i])::double / count(*))::bigint as s from a1, (select unnest(range(1, w + 1)) as i from size) group by j, k, i) group by j, k),
        c1 as materialized (select j, k, coalesce(m1.c, c0.c) as c from c0 left join m1 using (j, k)),
        a2 as (select * from (select id, j, k, x, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from parts join c1 using (j))
               qualify row_number() over (partition by id, j order by d, k) = 1),
        m2 as (select j, k, list(s order by i) as c from (select j, k, i, floor(sum(x[i])::double / count(*))::bigint as s from a2, (select unnest(range(1, w + 1)) as i from size) group by j, k, i) group by j, k),
        c2 as materialized (select j, k, coalesce(m2.c, c1.c) as c from c1 left join m2 using (j, k)),
        a3 as (select * from (select id, j, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from parts join c2 using (j))
               qualify row_number() over (partition by id, j order by d, k) = 1),
        coded as (select id, string_agg(printf('%02x', k), '' order by j) as code, sum(d)::bigint as error from a3 group by id),
        books as (select sha256(string_agg(array_to_string(c, ','), ',' order by j, k)) as codebooks_sha256 from c2)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from v join coded using (id), books""",
}

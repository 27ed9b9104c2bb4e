"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, lloyd, mcd, packing, partenum, pii, sharding, simhash, tokens, urls, warc
from .common import table, words_of

#: Bytes of text that a shard holds at most, and words that a packed sequence holds.
SHARD_BYTES, SEQUENCE = 1 << 20, 2048
#: First fetch day of the pages, which have no dates of their own: a page's number is spread over a year.
FIRST_DAY, DAYS = "2024-01-01", 366


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mcd.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    number = lambda kind: F.size(pii.of_kinds(F.col("spans"), (kind,))).cast("long").alias(f"n_{kind}")
    base = F.array_join(pii.of_kinds(F.col("spans"), pii.BASE_KINDS), ",")
    return found.select("doc_id", *map(number, pii.BASE_KINDS), F.sha2(base, 256).alias("base_sha256"), "spans")


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op6_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapsed_chats(table(spark, sf_dir, "conversations"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a dated list: three entries each, by digests of the name, for the pages' own domains, for
    sub-domains of theirs that no page has, and for as many domains without any page."""
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day((F.col("page_id") * 37) % DAYS).alias("fetched"))
    own = pages.select(F.explode(urls.domains(urls.host(F.col("url")))).alias("domain")).distinct()
    names = own.select(F.explode(F.array("domain", F.concat(F.lit("listed."), "domain"), F.concat("domain", F.lit(".invalid")))).alias("domain"))
    dated = names.withColumn("hash", F.explode(F.array(*(F.md5(F.concat("domain", F.lit(f"#{k}"))) for k in range(3)))))
    number = lambda a, b: F.conv(F.substring("hash", a, b), 16, 10).cast("long")
    action = F.when(number(5, 1) < 8, "block").otherwise("allow")
    return urls.listed_captures(pages, dated.select("domain", action.alias("action"), day(number(1, 4) % DAYS).alias("listed")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of words without two documents of one source or two near-duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words_of(F.col("text"))).alias("n_words"), "text")
    return packing.packed(simhash.clustered(docs), SEQUENCE, "n_words")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_personal_data": op2_personal_data,
    "op3_extendible_shards": op3_extendible_shards,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_chats": op6_chats,
    "op7_warc": op7_warc,
    "op8_url_filters": op8_url_filters,
    "op9_decontamination": op9_decontamination,
    "op10_best_fit": op10_best_fit,
    "op11_centroids": op11_centroids,
    "op12_filter_audit": op12_filter_audit,
    "op13_jaccard_join": op13_jaccard_join,
}



def _rounds_sql(k: int, rounds: int) -> str:
    """Rounds of centroids c0, c1, ... over `vectors` (id, weight, v): each round's vectors go to their nearest ones."""
    out = [f"c0 as materialized (select (row_number() over (order by h, v) - 1)::int as cluster, v as c from (select h, v from kept order by h, v limit {k}))"]
    for r in range(rounds + 1):
        far = f"select id, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as d from vectors, c{r}"
        out.append(f"a{r} as materialized (select id, arg_min(cluster, (d, cluster)) as cluster, min(d) as d from ({far}) group by id)")
        if r < rounds:
            cells = f"select cluster, place, sum(weight * x)::hugeint as s, sum(weight)::hugeint as n from (select cluster, weight, unnest(v) as x, unnest(range(1, len(v) + 1)) as place from a{r} join vectors using (id)) group by 1, 2"
            means = f"select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by place) as m from ({cells}) group by 1"
            out.append(f"c{r + 1} as materialized (select cluster, coalesce(m, c) as c from c{r} left join ({means}) using (cluster))")
    return ", ".join(out)


ORACLE_SQL: dict[str, str] = {
    "op3_extendible_shards": f"""
        with sized as (
            select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
                   right(repeat('0', 60) || to_base(('0x' || left(md5(coalesce(doc_id::varchar, '')), 15))::bigint, 2), 60) as bits
            from documents),
        sums as (
            select d.depth, left(bits, d.depth) as shard, count(*) as n, sum(n_bytes)::bigint as shard_bytes
            from sized, (select unnest(range(0, 61))::integer as depth) d group by 1, 2),
        fit as (select * from sums where shard_bytes <= {SHARD_BYTES} or n = 1)
        select doc_id, n_bytes, shard, depth, shard_bytes
        from sized join fit on left(bits, depth) = shard
        qualify depth = min(depth) over (partition by bits)""",
    "op6_chats": """
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, case when conv_id is null then row_number() over () end as alone
            from conversations),
        numbered as (
            select *, row_number() over (partition by conv_id, alone order by turn nulls last, role, md5(text)) as place from turns),
        chats as (
            select conv_id, count(*) as n_turns, row_number() over (order by conv_id nulls last, alone) as number,
                   string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by place) as text
            from numbered group by conv_id, alone)
        select conv_id, n_turns, text from chats c
        where not exists (
            select 1 from chats o
            where o.n_turns > c.n_turns and starts_with(o.text, c.text) or o.text = c.text and o.number < c.number)""",
    "op7_warc": """
        with shared as (select coalesce(html, '') as html, max(page_id) as latest from pages group by 1)
        select page_id, strlen(s.html)::bigint as payload_bytes,
               (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(s.html), 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31)::int, 1), '' order by i)
                from (select unnest(range(0, 32)) as i)) as payload_digest,
               case when page_id = latest then 'response' else 'revisit' end as record_type,
               case when page_id <> latest then latest end as refers_to
        from pages p join shared s on coalesce(p.html, '') = s.html""",
    "op8_url_filters": f"""
        with captures as (
            select page_id, url, (date '{FIRST_DAY}' + ((page_id * 37) % {DAYS})::int)::date as fetched,
                   regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[0-9A-Fa-f:.%]+\\]|[^/?#:@\\[\\]]+)', 1)), '\\.$', '') as found,
                   case when found <> '' and length(found) <= 253 then found end as host
            from pages),
        parts as (
            select *, case when regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') or host[1] = '[' then [host] else string_split(host, '.') end as labels from captures),
        asked as (select page_id, fetched, array_to_string(list_slice(labels, k, len(labels)), '.') as domain
                  from (select *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) as k from parts where host is not null)),
        listed as (select distinct unnest([domain, 'listed.' || domain, domain || '.invalid']) as domain from asked),
        hashed as (select domain, md5(domain || '#' || k) as hash from listed, (select unnest(range(0, 3)) as k)),
        entries as (
            select domain, (date '{FIRST_DAY}' + (('0x' || left(hash, 4))::bigint % {DAYS})::int)::date as since,
                   min(case when ('0x' || substr(hash, 5, 1))::int < 8 then 'block' else 'zallow' end) as action
            from hashed group by 1, 2),
        spans as (select *, lead(since) over (partition by domain order by since) as until from entries),
        hits as (
            select page_id, s.domain as rule, replace(action, 'zallow', 'allow') as verdict
            from asked a join spans s on a.domain = s.domain and fetched >= since and (until is null or fetched < until)
            qualify row_number() over (partition by page_id order by length(s.domain) desc) = 1)
        select c.page_id, url, fetched, host, rule, coalesce(verdict, 'none') as verdict
        from captures c left join hits h on c.page_id = h.page_id""",
    "op11_centroids": f"""
        with kept as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v, sha256('3:' || coalesce(vec_id::varchar, '')) as h
            from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x::double))) = 64),
        vectors as materialized (select row_number() over () as id, v, count(*) as weight from kept group by v),
        {_rounds_sql(8, 10)},
        told as (
            select cluster, sum(d * weight)::bigint as cluster_inertia, sum(sum(d * weight)) over ()::bigint as inertia
            from a10 join vectors using (id) group by cluster)
        select vec_id, cluster, d::bigint as distance, cluster_inertia, inertia,
               sha256(array_to_string(c, ',')) as centroid_sha256
        from kept join vectors using (v) join a10 using (id) join told using (cluster) join c10 using (cluster)""",
    "op12_filter_audit": """
        with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
        least as (select t, min(doc_id) as first_id from texts group by t),
        said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
        worded as (
            select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from texts),
        flags as (
            select part, coalesce(good, false) as good, coalesce(s.toxic, false) as toxic,
                   [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
                    regexp_matches(t, '[#$%&*|]'), coalesce(first_id < w.doc_id, false)] as failed
            from worded w join least using (t) left join said s on w.doc_id = s.doc_id),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter),
        orders as (
            select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
            from letters a, letters b, letters c, letters d, letters e
            where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
        kinds as (select part, failed, good, toxic, count(*) as n from flags group by all),
        steps as (
            select filter_order, step, ascii(filter_order[step]) - 64 as own, [ascii(filter_order[i]) - 64 for i in range(1, step)] as before
            from orders, (select unnest(range(1, 6)) as step)),
        told as (
            select part, filter_order, step, own, n, good, toxic, failed[own] as fails,
                   coalesce(list_bool_or([failed[i] for i in before]), false) as gone,
                   list_sum([x::int for x in failed]) as fails_of
            from kinds, steps),
        counted as (
            select part, filter_order, step::int as step, own,
                   coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept,
                   coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed,
                   coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant,
                   coalesce(sum(n) filter (fails and fails_of = 1), 0)::bigint as unique_fails,
                   coalesce(sum(n) filter (fails and not gone and good), 0)::bigint as good_lost,
                   coalesce(sum(n) filter (fails and not gone and toxic), 0)::bigint as toxic_lost
            from told group by 1, 2, 3, 4)
        select * exclude (own), sum(removed) over (partition by part, own)::bigint as shapley from counted""",
}

"""DuckDB SQL with the same rows as the queries of the same names."""

from __future__ import annotations

from .queries import NOW

_Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(replace({0}, 'ß', 'ss')), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1))"
_WORDS = _TOKENS.format("text")
_QUERY = f"(select {_WORDS} as query from benchmark where item_id = 0)"
_OVERLAP = "len(list_intersect(query, words)) / greatest(1, len(query))"
_SHA32 = "(('0x' || left(sha256({0}), 8))::bigint % {1})"
_BUSY = "busy as (select user_id as owner, ts as busy_start, ts + to_minutes((event_id % 180)::int) as busy_end from events)"
_RANKED = f"""
    query as (select * from {_QUERY}), vec as (select * from {_Q}),
    m as (
        select 'p' || (doc_id // 5) as profile, doc_id as version, list_cosine_similarity(embedding::double[], q) as dense,
               {_OVERLAP} as lexical, [lang, 'l' || label] as skills, n_chars / 1000 as years,
               timestamp '2023-01-01' + to_days((doc_id % 365)::int) as submitted, lang as category
        from (select doc_id, source, lang, n_chars, {_WORDS} as words from documents) d
        join embeddings e on d.doc_id = e.vec_id, query, vec),
    c as (
        select *, least(1, greatest(0, (dense + 1) / 2)) * 0.8 + least(1, lexical) * 0.2 as semantic,
               list_contains(skills, 'en')::int::double as required, len(list_intersect(skills, ['l1', 'l2'])) / 2 as preferred,
               least(1, greatest(0, years) / 3) as experience,
               greatest(0, least(1, 1 - (epoch_us(timestamp '{NOW}') - epoch_us(submitted)) / 86400000000 / 730)) as freshness,
               (category = 'en')::int::double as cat
        from m),
    s as (
        select *, 0.50 / 1.12 * semantic + 0.25 / 1.12 * required + 0.10 / 1.12 * preferred + 0.10 / 1.12 * experience
               + 0.05 / 1.12 * freshness + 0.12 / 1.12 * cat as raw
        from c),
    ranked as (
        select *, round(raw * 100, 2) as score, count(*) over (partition by profile) - 1 as n_others
        from s qualify row_number() over (partition by profile order by raw desc, version desc) = 1
        order by score desc, version desc, profile limit 20)"""
#: All versions, with the overlap and the evidence of their whole documents.
_VERSIONS = f"""
    q as (select * from {_QUERY}),
    v as (
        select doc_id as version, source || '-' || (doc_id % 7) as profile, lang, n_chars / 1000 as years, coalesce(text, '') as document, doc_id % 7 > 0 as ready, embedding::double[] as vector, {_OVERLAP} as share,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: len(list_intersect(regexp_extract_all(lower(replace(x, 'ß', 'ss')), '[\\p{{L}}\\p{{N}}_]+'), query)) > 0) as lines,
               case when len(lines) > 0 then lines[1] else left(document, 360) end as line, case when len(lines) > 0 then 'LEXICAL_LINE' else 'DOCUMENT_CONTEXT' end as line_method
        from (select *, {_WORDS} as words from documents) left join embeddings on vec_id = doc_id, q)"""
_CHAINED = f"""
    {_VERSIONS}, vec as (select * from {_Q}),
    dn as (select vec_id as chunk, list_cosine_similarity(embedding::double[], q) as d from embeddings, vec order by d desc, vec_id limit 100),
    lx as (select doc_id as chunk, {_OVERLAP} as l from (select doc_id, {_WORDS} as words from documents), q where l > 0 order by l desc, doc_id limit 100),
    hits as (select chunk // 2 as version, chunk, case when chunk % 4 > 0 then d end as d, coalesce(l, 0) as l from dn full join lx using (chunk) where chunk % 4 > 0 or coalesce(l, 0) > 0),
    best as (select version, arg_max({{'c': chunk, 'd': d, 'l': l}}, {{'s': coalesce((d + 1) / 2, 0) * 0.8 + l * 0.2, 'k': -chunk}}) as b from hits group by 1),
    told as (
        select version, profile, lang, years, case when b.d is not null then 'CHUNK' when ready and vector is not null then 'DOCUMENT' else 'OVERLAP' end as level,
               case level when 'CHUNK' then b.d when 'DOCUMENT' then list_cosine_similarity(vector, vec.q) else share * 2 - 1 end as dense, case when b.d is not null then b.l else share end as lexical,
               case when b.d is not null then 'SEMANTIC_CHUNK' else 'LEXICAL_CHUNK' end as method, 'chunk ' || b.c as evidence
        from v join best using (version), vec)"""
#: The tokens of every clause of the documents, as the text reader cuts them: e has a row for each.
_CLAUSES = r"""
        c as (select doc_id, regexp_replace(regexp_replace(text, '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '(^|\s)[^\s@]+@\S+|https?://\S+|\b[\w-]+\.(?:net|com|org)\b', '\1 ', 'g') as t from documents),
        l as (select doc_id, generate_subscripts(string_split(t, chr(10)), 1) as line, unnest(string_split(t, chr(10))) as t from c),
        p as (select doc_id, line, string_split(replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), ';', chr(1)), chr(1)) as parts from l),
        f as (select doc_id, line, generate_subscripts(parts, 1) as clause, strip_accents(lower(unnest(parts))) as folded from p),
        k0 as (select doc_id, line, clause, regexp_extract_all(folded, '[\p{L}\p{N}]+(?:[.+#/''&-]+[\p{L}\p{N}]+)*[+#]*') as t from f),
        e as (select doc_id, line, clause, generate_subscripts(t, 1) as place, unnest(t) as tok, unnest(t[2:] || [null]) as nxt from k0 where len(t) > 0)"""
#: The first and the secondary category of `votes` (key, category, score, title_score).
_PICKED = """
        two as (select *, row_number() over (partition by key order by score desc, category) as n from votes qualify n <= 2),
        pair as (
            select key, max(category) filter (n = 1) as c1, max(category) filter (n = 2) as c2, max(score) filter (n = 1) as s1, coalesce(max(score) filter (n = 2), 0) as s2,
                   max(title_score) filter (n = 1) as t1, coalesce(max(title_score) filter (n = 2), 0) as t2 from two group by key),
        told as (select *, s1 >= s2 * 1.25 as clear, not (s1 >= s2 * 1.25) and t2 > t1 as swapped, case when not (s1 >= s2 * 1.25) and t2 > t1 then s1 else s2 end as reach from pair),
        best as (
            select key, case when swapped then c2 else c1 end as category, case when least(reach, s1) >= s1 * 0.5 and reach >= 1 then case when swapped then c1 else c2 end end as secondary
            from told where s1 >= 1 and (clear or greatest(t1, t2) >= 1 and t1 <> t2))"""
_OPERATIONS = f"""
    e as (select *, user_id % 10 as owner from events),
    a as (select owner, count(*) as tasks, count(*) filter (event_type = 'purchase') as completed, count(*) filter (event_type = 'error') as failed,
                 case when count(*) filter (event_type in ('purchase', 'error')) > 0
                      then round(count(*) filter (event_type = 'purchase') / count(*) filter (event_type in ('purchase', 'error')), 4) end as success_rate,
                 round(quantile_disc(value, 0.5), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95
          from e where ts >= timestamp '{NOW}' - interval 72 hours and ts <= timestamp '{NOW}' group by 1),
    c as (select owner, count(*) filter (event_type in ('error', 'signup') and ts >= timestamp '{NOW}' - interval 72 hours and ts <= timestamp '{NOW}') as outbox_failed,
                 count(*) filter (event_type = 'click' and ts + interval 36 hours <= timestamp '{NOW}') as due_backlog
          from e group by 1),
    d as (select owner, count(*) filter (event_type = 'view') as pending, count(*) filter (event_type = 'view' and ts < timestamp '{NOW}' - interval 24 hours) as stale
          from e group by 1),
    report as (
        select owner, coalesce(tasks, 0) as tasks, coalesce(completed, 0) as completed, coalesce(failed, 0) as failed, success_rate, p50, p95,
               coalesce(outbox_failed, 0) as outbox_failed, coalesce(due_backlog, 0) as due_backlog, coalesce(pending, 0) as pending, coalesce(stale, 0) as stale
        from a full join c using (owner) full join d using (owner))"""
_LINKS = """
    links as (
        select user_id as claim, 'm' || (event_id % 3) as model, event_id,
               case event_type when 'purchase' then 'VERIFIED' when 'error' then 'POTENTIAL_INCONSISTENCY' else 'NEW_INFO' end as relation
        from events)"""
_ROLLED = """
    e as (select *, user_id % 30 as session, event_id % 12 as claim, 'r' || (event_id % 10) as requirement from events),
    l as (select session, claim, bool_or(event_type = 'purchase') as v, bool_or(event_type = 'error') as i
          from e where event_id % 3 = 0 and claim < 9 group by 1, 2),
    a as (select c.session, count(*) filter (v) as verified, count(*) filter (v is null) as unverified, count(*) filter (i) as inconsistent
          from (select distinct session, claim from e) c left join l using (session, claim) group by 1),
    n as (select distinct session, requirement from e where event_id % 7 = 0 and event_type in ('view', 'click')),
    b as (select k.session, count(n.session) as covered, count(*) filter (n.session is null) as not_covered
          from (select distinct session, requirement from e) k left join n using (session, requirement) group by 1),
    rolled as (select * from a full join b using (session))"""
_TOP = """
    top as (select list(s order by n desc, s) as gate from (select s, count(*) as n from (select unnest(string_split(p_type, ' ')) as s from part) group by s order by n desc, s limit 3))"""
_RETRIEVAL = """
    grades as (select doc_id % 25 as query, doc_id as doc, quality * 2 + 1 - toxic as grade from labels),
    ranked as (
        select doc_id % 25 as query, doc_id as doc,
               row_number() over (partition by doc_id % 25 order by (('0x' || left(sha256(doc_id::varchar), 8))::bigint % 1000), doc_id) as rank
        from documents qualify rank <= 20),
    j as (select r.*, coalesce(grade, 0) as grade from ranked r left join grades using (query, doc)),
    f as (select query, count(*) filter (rank <= 10 and grade >= 2) as hits, min(rank) filter (grade >= 2) as first,
                 sum(case when rank <= 10 then (2 ** grade - 1) / log2(rank + 1) else 0 end) as dcg from j group by 1),
    i as (select *, row_number() over (partition by query order by grade desc, doc) as place from grades),
    b as (select query, count(*) filter (grade >= 2) as relevant, sum(case when place <= 10 then (2 ** grade - 1) / log2(place + 1) else 0 end) as ideal from i group by 1),
    joined as (select query, coalesce(hits, 0) as hits, first, coalesce(dcg, 0) as dcg, coalesce(relevant, 0) as relevant, coalesce(ideal, 0) as ideal from f full join b using (query))"""

ORACLE_SQL = {
    "dense_topk": f"select vec_id, round(d, 6) as dense from (select vec_id, list_cosine_similarity(embedding::double[], q) as d from embeddings, {_Q} order by d desc, vec_id limit 100)",
    "dense_best_per_label": f"""
        select label::int as label, vec_id, round(d, 6) as dense
        from (select *, list_cosine_similarity(embedding::double[], q) as d from embeddings, {_Q})
        qualify row_number() over (partition by label order by d desc, vec_id) = 1""",
    "lexical_overlap_topk": f"""
        select doc_id, round(lexical, 6) as lexical
        from (select doc_id, {_OVERLAP} as lexical from (select doc_id, {_WORDS} as words from documents), {_QUERY})
        where lexical > 0 order by lexical.lexical desc, doc_id limit 100""".replace("lexical.lexical", "lexical"),
    "hybrid_hits": f"""
        with dense as (select vec_id as chunk, list_cosine_similarity(embedding::double[], q) as d from embeddings, {_Q} order by d desc, vec_id limit 100),
        lexical as (select doc_id as chunk, {_OVERLAP} as l from (select doc_id, {_WORDS} as words from documents), {_QUERY} where l > 0 order by l desc, doc_id limit 100)
        select chunk, round(d, 6) as dense, round(coalesce(l, 0), 6) as lexical from dense full join lexical using (chunk)""",
    "hybrid_rank": f"with {_RANKED} select profile, version, round(semantic, 6) as semantic, round(experience, 6) as experience, round(freshness, 6) as freshness, score, n_others::int as n_others from ranked",
    "rerank_blend": f"""
        with {_RANKED},
        placed as (select profile, version, score, row_number() over (order by score desc, version desc, profile) as place,
                          ({_SHA32.format('profile', 1000)} + 0.25) / 1009 as rerank from ranked),
        mixed as (select profile, version, place, case when place <= 8 then round((score / 100 * 0.3 + rerank * 0.7) * 100, 2) else score end as score from placed)
        select profile, score from mixed
        order by place > 8, case when place > 8 then place end, score desc, version desc, profile limit 10""",
    "warehouse_rank": f"""
        with chunks as (select label as cv, list_cosine_similarity(embedding::double[], q) as cosine, 'w' || (vec_id % 7) as word from embeddings, {_Q}),
        best as (select cv, max(greatest(0, cosine)) as semantic, max(case when word in ('w1', 'w9') then 0.5 else 0 end)::double as lexical from chunks group by 1),
        scored as (
            select *, 100 * (0.12 * (cv % 2 = 1)::int + 0.10 * lexical + 0.10 * (cv % 3 in (2, 0))::int / 2 + 0.35 * (cv % 3 = 1)::int + 0.45 * semantic) / 1.12 as s
            from best)
        select cv, round(s, 6) as score, round(semantic, 6) as semantic, round(lexical, 6) as lexical, 'HYBRID_SEMANTIC' as mode
        from scored order by s desc, cv limit 20""",
    "calibrate_confidence": "select vec_id, round(1 / (1 + exp(-greatest(-50, least(50, 4.25::double * (vec_id % 101)::double / 100 + -2.5)))), 4) as confidence from embeddings",
    "coverage_gate": """
        with p as (select p_partkey, string_split(p_type, ' ') as skills from part),
        top as (select list(s) as gate from (select s from (select unnest(skills) as s from p) group by s order by count(*) desc, s limit 3))
        select p_partkey, round(len(list_intersect(skills, gate)) / 3, 6) as coverage from p, top where len(list_intersect(skills, gate)) / 3 >= 1 / 3""",
    "ilike_filter": "select p_partkey, p_name from part where p_name ilike '%a%e%' or p_brand ilike '%a%e%' or p_type ilike '%a%e%'",
    "json_path_filter": "select event_id, user_id from events where json_extract_string(props, '$.k') = '7'",
    "status_filter": "select o_orderkey, o_custkey from orders where o_orderstatus = 'F'",
    "key_prefix_filter": "select c_custkey, c_name from customer where starts_with(c_name, 'Customer#00000000')",
    "range_filter": f"select event_id, user_id, round(value, 6) as value from events where value is not null and ts >= timestamp '{NOW}' - interval 48 hours and ts <= timestamp '{NOW}'",
    "sandbox_allowed": "select c_custkey, c_custkey % 3 = 0 or c_custkey % 3 = 1 and c_custkey % 20 between 1 and 9 or c_custkey = 5 as allowed from customer",
    "page_offset": "select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40",
    "latest_per_key": "select o_custkey, o_orderkey, round(o_totalprice, 6) as price from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "version_number": """
        with kept as (select source, doc_id from documents qualify row_number() over (partition by source, sha256(text) order by doc_id) = 1)
        select source, doc_id, row_number() over (partition by source order by doc_id) as version from kept""",
    "prev_version_delta": r"""
        with v as (select source, doc_id, sha256(text) as c, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::bigint as n from documents),
        p as (select *, lag(c) over w as pc, lag(n) over w as pn, row_number() over w as rn from v window w as (partition by source order by doc_id))
        select doc_id, case when rn = 1 then 'INITIAL' when pc is not distinct from c then 'SAME_CONTENT' else 'CHANGED' end as change, n - coalesce(pn, 0) as word_delta from p""",
    "adjacent_versions": "select o_custkey, o_orderkey, lag(o_orderkey) over w as previous, lead(o_orderkey) over w as next from orders window w as (partition by o_custkey order by o_orderkey)",
    "duplicate_groups": "select lang, sha256(text) as checksum, count(*) as n, count(*) - 1 as surplus from documents group by 1, 2 having count(*) > 1",
    "dedupe_first": "select min(doc_id) as doc_id, count(*) as copies from documents group by sha256(text)",
    "sync_antijoin": """
        with d as (select doc_id, case when doc_id % 50 = 0 then '' else sha256(text) end as checksum from documents)
        select min(doc_id) as doc_id, checksum from d where doc_id % 2 = 0 and checksum <> '' and checksum not in (select checksum from d where doc_id % 2 = 1) group by checksum
        union all select doc_id, checksum from d where doc_id % 2 = 0 and checksum = ''""",
    "checksum_lookup_last": """
        with d as (select doc_id, case when doc_id % 50 = 0 then '' else sha256(text) end as checksum from documents)
        select a.doc_id, max(b.doc_id) as remote from d a left join d b on a.checksum = b.checksum and b.doc_id % 2 = 0 where a.doc_id % 2 = 1 group by 1""",
    "import_decisions": """
        with c as (select c_custkey as k, lower(c_name) as name, c_mktsegment as owner from customer),
        p as (select owner, k as profile, name from c where k % 3 = 0),
        r as (select k, owner, case when k % 5 = 0 then name || 'x' else name end as name, case when k % 2 = 0 then k else k + 3 end as phone, case when k % 7 = 0 then k + 1 else k end as content from c),
        j as (
            select r.k, r.name, e.profile as e, f.profile as f, h.profile as holder, r.owner
            from r left join p e on e.owner = r.owner and e.profile = r.k left join p f on f.owner = r.owner and f.profile = r.phone left join p h on h.owner = r.owner and h.profile = r.content),
        q as (select *, coalesce(e <> f, false) as conflict, case when not coalesce(e <> f, false) then coalesce(e, f) end as profile from j)
        select q.k, q.profile,
               case when conflict then 'IDENTITY_SPLIT' when holder is not null and (q.profile is null or holder <> q.profile) then 'CHECKSUM_IDENTITY_CONFLICT'
                    when holder is not null then 'DUPLICATE_CONTENT' when q.profile is not null then 'NEW_VERSION' else 'NEW_PROFILE' end as decision,
               case when q.profile is not null and n.name <> q.name then 'NAME_MISMATCH'
                    when q.profile is null and exists (select 1 from p t where t.owner = q.owner and t.name = q.name) then 'POSSIBLE_NAME_DUPLICATE' end as warning
        from q left join p n on n.profile = q.profile and n.owner = q.owner""",
    "canonical_skills": """
        with v as (select p_partkey, generate_subscripts(string_split(p_type, ' '), 1) - 1 as place, unnest(string_split(p_type, ' ')) as raw from part),
        w as (select *, regexp_replace(lower(raw), '[\\s._-]', '', 'g') as norm from v),
        n as (select *, case when starts_with(norm, 't') then 'Tee' when length(norm) > 4 then upper(norm[1]) || norm[2:] end as name from w)
        select p_partkey, place::bigint as place, coalesce(lower(name), 'raw:' || norm) as key, coalesce(name, raw) as name, (name is not null)::int::double as confidence
        from n qualify row_number() over (partition by p_partkey, key order by place) = 1""",
    "set_diff": """
        with l as (select l_orderkey, list_sort(list_distinct(list(case when l_linenumber % 2 = 0 then 'P' else 'p' end || (l_partkey % 50)))) as items from lineitem group by 1),
        p as (select l_orderkey, items, lead(items) over (partition by l_orderkey // 64 order by l_orderkey) as after from l),
        k as (select l_orderkey, list_distinct(list_transform(items, lambda x: lower(x))) as b, list_distinct(list_transform(after, lambda x: lower(x))) as a from p where after is not null)
        select l_orderkey, 'added' as bucket, unnest(list_filter(a, lambda x: not list_contains(b, x))) as value from k
        union all select l_orderkey, 'removed', unnest(list_filter(b, lambda x: not list_contains(a, x))) from k
        union all select l_orderkey, 'unchanged', unnest(list_intersect(a, b)) from k""",
    "version_diff": """
        with one as (select l_orderkey, (l_partkey % 20)::varchar as key, arg_min(case when l_linenumber % 3 = 0 then 'x' else 'y' end || (l_partkey % 20), l_linenumber) as raw from lineitem group by 1, 2),
        o as (select l_orderkey, lead(l_orderkey) over (partition by l_orderkey // 64 order by l_orderkey) as pair from (select distinct l_orderkey from one) qualify pair is not null),
        b as (select pair, key, raw as before from one join o using (l_orderkey)),
        a as (select l_orderkey as pair, key, raw as after from one where l_orderkey in (select pair from o)),
        d as (select pair, case when before is null then 'added' when after is null then 'removed' when lower(before) <> lower(after) then 'modified' else 'unchanged' end as bucket from b full join a using (pair, key))
        select pair, count(*) filter (bucket = 'added') as added, count(*) filter (bucket = 'removed') as removed, count(*) filter (bucket = 'modified') as modified,
               count(*) filter (bucket = 'unchanged') as unchanged, 0::bigint as conflicts from d group by 1""",
    "facets": "select distinct 'lang' as facet, lang as value from documents union all select distinct 'source', source from documents",
    "skill_facets": "select skill, count(*) as n from (select distinct p_partkey, unnest(string_split(p_type, ' ')) as skill from part) group by 1",
    "claim_matrix": f"""
        with {_LINKS},
        f as (select claim, model, max(case relation when 'POTENTIAL_INCONSISTENCY' then 3 when 'VERIFIED' then 2 else 1 end) as r from links group by 1, 2),
        n as (select claim, model, ['NEW_INFO', 'VERIFIED', 'POTENTIAL_INCONSISTENCY'][r] as v from f)
        select claim, coalesce(max(v) filter (model = 'm0'), 'N/A') as m0, coalesce(max(v) filter (model = 'm1'), 'N/A') as m1, coalesce(max(v) filter (model = 'm2'), 'N/A') as m2 from n group by 1""",
    "consensus": f"""
        with {_LINKS}
        select claim, count(distinct model) filter (relation = 'VERIFIED') as verified_by, count(distinct model) filter (relation = 'POTENTIAL_INCONSISTENCY') as inconsistent_by
        from links group by 1 having verified_by = 3 or inconsistent_by > 0""",
    "index_actions": """
        with i as (select doc_id + case when doc_id % 11 = 0 or doc_id % 5 = 0 then 1000000000 else 0 end as doc_id, case when doc_id % 7 = 0 then 'old' else md5(text) end as have, case when doc_id % 13 = 0 then 'PENDING' else 'READY' end as status from documents),
        w as (select doc_id, md5(text) as want from documents)
        select doc_id, case when want is null then 'delete' when want = have and status = 'READY' then 'skip' else 'upsert' end as action from w full join i using (doc_id)""",
    "prior_submissions": "select a.o_orderkey as k, b.o_orderkey as prior from orders a join orders b using (o_custkey) where o_custkey % 3 <> 0 and a.o_orderkey <> b.o_orderkey",
    "superseded": """
        select o_orderkey, case when o_orderstatus in ('O', 'P') and o_orderkey < max(o_orderkey) over (partition by o_custkey) then 'SUPERSEDED'
                                when o_orderstatus = 'O' then 'PENDING' when o_orderstatus = 'P' then 'ACTIVE' else 'DONE' end as status from orders""",
    "unknown_ids": "select distinct doc_id + 500 as doc_id from labels where doc_id + 500 not in (select doc_id from documents)",
    "merge_requirements": """
        with l as (select l_orderkey, (l_partkey % 25)::varchar as skill, l_linenumber as place, 'n' || l_suppkey as name, l_returnflag = 'N' as need from lineitem),
        g as (select l_orderkey, need, skill, arg_max(name, {'p': place, 'n': name}) as name, min(place)::bigint as place from l group by 1, 2, 3)
        select l_orderkey, case when need then 'required' else 'preferred' end as kind, skill, name, place from g
        where need or not exists (select 1 from g r where r.need and r.l_orderkey = g.l_orderkey and r.skill = g.skill)""",
    "status_counts_zero_filled": f"""
        select event_type, coalesce(n, 0) as n from (select unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) as event_type)
        left join (select event_type, count(*) as n from events where ts >= timestamp '{NOW}' - interval 168 hours and ts <= timestamp '{NOW}' group by 1) using (event_type)""",
    "percentile_nearest_rank": "select event_type, round(quantile_disc(value, 0.5), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95 from events group by 1",
    "percentile_floor_index": "select event_type, round(list_sort(list(value))[floor((count(value) - 1) * 0.95)::int + 1], 6) as p95 from events group by 1",
    "ops_report": f"with {_OPERATIONS} select *, outbox_failed > 0 or due_backlog > 0 or stale > 0 as degraded from report",
    "slo_breaches": f"""
        with {_OPERATIONS},
        u as (select user_id % 10 as owner, count(*) as used from events group by 1),
        r as (select *, case when owner * 300 > 0 then round(used / (owner * 300) * 100, 2) else 100.0 end as s_pct, round(used * 2 / 10000 * 100, 2) as o_pct from report join u using (owner))
        select owner, 'screening_success_rate' as signal, 'CRITICAL' as severity, round(success_rate, 6) as observed, 0.9::double as threshold from r where success_rate < 0.9
        union all select owner, 'screening_p95_latency', 'WARNING', p95, 150 from r where p95 > 150
        union all select owner, 'outbox_due_backlog', 'CRITICAL', due_backlog, 3 from r where due_backlog > 3
        union all select owner, 'outbox_failures', 'CRITICAL', outbox_failed, 5 from r where outbox_failed > 5
        union all select owner, 'stale_approvals', 'WARNING', stale, 5 from r where stale > 5
        union all select owner, 'budget_screenings', 'WARNING', s_pct, 80 from r where s_pct >= 80
        union all select owner, 'budget_tokens', 'WARNING', o_pct, 80 from r where o_pct >= 80
        union all select owner, 'budget_cost_micros', 'WARNING', o_pct, 80 from r where o_pct >= 80""",
    "search_quality": """
        select * from (select count(*) as searches, round(avg((event_type = 'error')::int), 4) as fallback_rate, round(avg(floor(value)), 4) as avg_latency from events),
        (select count(*) filter (g = 0) as grade_0, count(*) filter (g = 1) as grade_1, count(*) filter (g = 2) as grade_2, count(*) filter (g = 3) as grade_3, round(avg((g >= 2)::int), 4) as positive_rate
         from (select quality * 2 + 1 - toxic as g from labels))""",
    "batch_rollup": """
        with s as (select l_orderkey, case when l_returnflag = 'R' then 'f' when l_returnflag = 'A' then 's' when l_linenumber = 5 then 'r' else 'c' end as st from lineitem),
        g as (select l_orderkey, count(*) as total, count(*) filter (st = 'c') as completed, count(*) filter (st = 'f') as failed, count(*) filter (st = 's') as skipped from s group by 1)
        select *, case when completed + failed + skipped < total then 'PROCESSING' when failed > 0 and completed + skipped = 0 then 'FAILED' when failed > 0 then 'PARTIAL' else 'COMPLETED' end as state from g""",
    "minute_rate_window": """
        with m as (select user_id % 3 as owner, strftime(date_trunc('hour', ts), '%Y%m%d%H%M') as minute, count(*) as n from events group by 1, 2)
        select owner, minute, least(n, 3) as accepted, greatest(n - 3, 0) as rejected from m""",
    "monthly_usage": "select l_suppkey, strftime(l_shipdate, '%Y-%m') as period, sum(greatest(0, (l_quantity - 25)::bigint))::bigint as used, count(*) as n from lineitem group by 1, 2",
    "rolling_window": """
        with s as (select user_id % 5 as owner, to_timestamp((epoch(ts)::bigint // 21600) * 21600 - 21600 * k)::timestamp as start from events, (select unnest(range(0, 4)) as k))
        select owner, start, count(*) as n from s group by 1, 2""",
    "canary_gate": """
        with s as (
            select user_id, event_id % 2 as side, count(*) as samples, avg((event_type <> 'error')::int::double) as ok, quantile_disc(value, 0.95) as p95,
                   sum(floor(value * 10)::bigint) as cost, count(*) filter (event_type = 'error' and event_id % 5 = 0) as fails
            from events group by 1, 2),
        j as (select n.*, b.ok as b_ok, b.p95 as b_p95, b.cost as b_cost from s b join s n using (user_id) where b.side = 0 and n.side = 1),
        r as (
            select user_id, array_to_string(list_filter([
                case when samples < 30 then 'too few samples' end, case when ok < 0.9 then 'success rate below the service level' end,
                case when b_ok - ok > 0.02 then 'success rate dropped' end, case when p95 > 150 then 'latency above the service level' end,
                case when b_p95 > 0 and p95 > b_p95 * 1.2::double then 'latency regressed' end, case when b_cost > 0 and cost > b_cost * 1.2::double then 'cost regressed' end,
                case when fails > 0 then 'outbox failures' end], lambda x: x is not null), '|') as reasons from j)
        select user_id, case when reasons = '' then 'PROMOTION_ALLOWED' else 'PROMOTION_BLOCKED' end as status, reasons from r""",
    "variant_bucket": f"select c_custkey, {_SHA32.format('c_name', 100)} as bucket, {_SHA32.format('c_name', 100)} < 20 as challenger from customer",
    "audit_group_counts": """
        select case when event_type in ('click', 'view') then 'browse' when event_type = 'error' then 'failure' else 'change' end as grp, count(*) as n from events group by 1
        union all select 'all', count(*) from events""",
    "segment_counts": "select count(*) as n_all, count(*) filter (event_type = 'error') as n_error, count(*) filter (value > 100) as n_high, count(*) filter (event_type = 'error' and value > 100) as n_high_error from events",
    "table_counts": " union all ".join(f"select '{t}' as \"table\", count(*) as n from {t}" for t in ("documents", "labels", "events", "orders", "customer")),
    "job_score_average": "select event_type, floor(avg(floor(value - 20)) filter (floor(value - 20) > 0) + 0.5)::bigint as avg_score, count(*) as n from events group by 1",
    "dashboard_metrics": "select count(distinct o_custkey) as open_jobs, count(*) as applications, count(*) filter (o_orderstatus = 'F') as shortlisted, count(*) filter (o_orderstatus = 'O' and o_totalprice > 100000) as awaiting from orders",
    "topn_per_job": "select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders qualify place <= 7",
    "proposal_keys": """
        with t as (select o_orderpriority, o_orderkey || '@' || round(o_totalprice * 100)::bigint as m from orders qualify row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) <= 5)
        select o_orderpriority, left(sha256(string_agg(m, ',' order by m)), 20) as proposal from t group by 1""",
    "threshold_routing": "select event_id, case when event_id % 9 = 0 or event_id % 4 = 0 then 'OLD' when floor(value) < 60 then 'REJECTED' else 'WAITING_REVIEW' end as status from events",
    "score_calibration": """
        select event_id, round(0.95::double * (event_id % 101)::double + 0.05::double * (event_id % 67)::double, 6) as score,
               round(0.65::double * ((event_id % 11) / 10) + 0.35::double * ((event_id % 7) / 6), 6) as confidence,
               event_id % 101 >= 80 and (event_id % 7) / 6 < 0.5 as mismatch from events""",
    "scorecard_summary": """
        with a as (select user_id % 20 as interview, event_type as criterion, event_id % 5 + 1 as rating from events)
        select interview, criterion, round(avg(rating), 6) as mean, count(*) as n, case when avg(rating) >= 4 then 'strength' when avg(rating) <= 2.5 then 'concern' else 'neutral' end as verdict,
               count(*) > 1 and max(rating) - min(rating) >= 2 as conflict from a group by 1, 2""",
    "cross_analysis": f"with {_ROLLED} select * from rolled",
    "assessment": f"""
        with {_ROLLED},
        b2 as (select *, least(40, inconsistent * 15) as penalty, covered / nullif(covered + not_covered, 0) as r, verified / nullif(verified + unverified, 0) as c from rolled),
        s as (select *, greatest(0, least(100, round_even(coalesce(0.6::double * r + 0.4::double * c, r, c, 0) * 100 - penalty, 0)))::int as score from b2)
        select session, score, case when score >= 85 then 'STRONG_YES' when score >= 65 then 'YES' when score >= 40 then 'MIXED' when score >= 20 then 'NO' else 'STRONG_NO' end as recommendation from s""",
    "retention": "select o_orderkey, case when o_orderstatus = 'F' then 'REJECTED' else 'ARCHIVED' end as status from orders where o_orderdate < timestamp '1998-01-01' - interval 365 days and o_orderstatus in ('F', 'P')",
    "erasure": "select c_custkey, case when c_custkey % 10 = 0 then sha256(c_name) else c_name end as c_name, case when c_custkey % 10 <> 0 then c_mktsegment end as c_mktsegment from customer",
    "erasure_cascade": "select o_custkey, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 = 0) group by 1",
    "precision_recall_mrr": f"with {_RETRIEVAL} select query, hits / 10 as precision, round(case when relevant = 0 then 1 else hits / relevant end, 6) as recall, round(coalesce(1 / first, 0), 6) as rr from joined",
    "ndcg": f"with {_RETRIEVAL} select query, round(case when ideal = 0 then 1 else dcg / ideal end, 6) as ndcg from joined",
    "slice_means": """
        with r as (select lang, source, quality, toxic from documents join labels using (doc_id))
        select 'lang' as dimension, lang as value, count(*) as n, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from r group by lang
        union all select 'source', source, count(*), round(avg(quality), 6), round(avg(toxic), 6) from r group by source""",
    "micro_scores": """
        with a as (select distinct user_id as c, event_id % 15 + case when event_id % 3 = 0 then 100 else 0 end as i, 1 as e from events),
        b as (select distinct user_id as c, event_id % 15 + case when event_id % 4 = 0 then 200 else 0 end as i, 1 as f from events),
        g as (select c, sum(coalesce(e, 0) * coalesce(f, 0)) as tp, sum(coalesce(e, 0)) as e, sum(coalesce(f, 0)) as f from a full join b using (c, i) group by 1)
        select round(sum(tp) / sum(f), 6) as precision, round(sum(tp) / sum(e), 6) as recall, round(avg((tp = e and tp = f)::int), 6) as exact from g""",
    "brier_logloss": "with r as (select quality as y, (doc_id % 99 + 1) / 100 as p from labels) select round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss from r",
    "regression_gate": "select bool_and(a >= 1 and b >= 1) as passed from (select max(quality) as a, avg(toxic) as b from labels group by doc_id % 3)",
    "rule_screening": r"""
        with h as (select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)')::int as a, regexp_matches(lower(text), '(^|[^a-z0-9])la([^a-z0-9]|$)')::int as b, regexp_matches(lower(text), '(^|[^a-z0-9])der([^a-z0-9]|$)')::int as c,
                          list_max(list_transform(regexp_extract_all(lower(text), '(\d+)\+?\s*(?:năm|years?)', 1), lambda v: try_cast(v as int))) as y,
                          len(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z+#.]{1,}'))) as w from documents),
        s as (select *, least(100, 35 + (a + b) * 32.5 + least(w, 80) / 8) as semantic from h)
        select doc_id, 100 * (a + b) / 2 as required_score, 100.0 * c as preferred_score, coalesce(y, 0) as experience_years, floor(round(semantic, 1))::bigint as semantic,
               case when round((0.4 * 50 * (a + b) + 0.2 * semantic + 15 * c) / 0.75, 1) >= 80 then 'Strong Match' when round((0.4 * 50 * (a + b) + 0.2 * semantic + 15 * c) / 0.75, 1) >= 65 then 'Potential Match' else 'Needs Review' end as recommendation from s""",
    "redacted_tags": "select c_custkey, 'I am [CANDIDATE_NAME], [EMAIL] or [PHONE]; [CANDIDATE_NAME] v' || (c_custkey % 7) as letter from customer",
    "usable_answers": """
        select o_orderkey, o_orderkey % 4 < 3 and o_orderkey % 3 > 0 and o_orderkey % 5 > 0 as usable, contains(lower('Priority ' || o_orderpriority || '!'), trim(' priority ' || lower(left(o_orderpriority, 3)))) as quoted from orders""",
    "hash_embedding": r"""
        with t as (select doc_id, sha256(unnest(regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{L}\p{N}_+#.]{2,}'))) as h from documents),
        s as (select doc_id, ('0x' || left(h, 8))::bigint % 96 as bucket, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 1 then 1 else -1 end)::bigint as total from t group by 1, 2 having total <> 0)
        select doc_id, bucket, round(round(total / sqrt(sum(total * total) over (partition by doc_id)), 8), 6) as value from s""",
    "token_sets": f"with w as (select doc_id, {_WORDS} as words from documents) select doc_id, len(words) as n_tokens, md5(array_to_string(list_sort(words), ' ')) as digest from w",
    "normal_lines": r"""
        select doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(regexp_replace(x, '[ \t\x{A0}]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) as lines,
               md5(trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g'))) as flat from documents""",
    "token_estimate": "select doc_id, case when doc_id % 5 > 0 then greatest(1, length(text) // 4) else 0 end::bigint as tokens from documents",
    "pseudonyms": "select c_custkey, 'cv_' || left(sha256('salt:' || c_custkey), 16) as pseudonym from customer",
    "annotation_export": "select item_id, md5(b.text) as query, 'cv_' || left(sha256('salt:' || doc_id), 16) as document, null::int as label from benchmark b, documents",
    "question_answers": """
        select conv_id, turn, md5(answer) as answer
        from (select *, lead(role) over w as nr, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'""",
    "available_slots": f"""
        with {_BUSY},
        p as (select distinct user_id as owner, [0, 7, 0, 9][user_id % 4 + 1] as shift from events),
        s as (select owner, timestamp '2024-01-10 10:00:00' + to_hours(k::int) as slot_start, timestamp '2024-01-10 10:00:00' + to_hours((k + shift)::int) as local_start from p, (select unnest(range(0, 336)) as k))
        select owner, slot_start, local_start from s
        where isodow(local_start) <= 5 and hour(local_start) >= 8 and local_start + interval 90 minutes <= date_trunc('day', local_start) + interval 17 hours
          and not exists (select 1 from busy b where b.owner = s.owner and slot_start < busy_end and slot_start + interval 90 minutes > busy_start and busy_start < busy_end)""",
    "overlap_antijoin": f"""
        with {_BUSY}
        select event_id, user_id as owner from (select *, ts + interval 3 hours as start from events) e
        where not exists (select 1 from busy b where b.owner = e.user_id and e.start < busy_end and e.start + interval 50 minutes > busy_start and busy_start < busy_end)""",
    "merge_runs": """
        with h as (select distinct user_id % 50 as owner, date_trunc('hour', ts)::timestamp as hour from events),
        r as (select *, epoch(hour)::bigint // 3600 - row_number() over (partition by owner order by hour) as run from h)
        select owner, min(hour) as run_start, max(hour) + interval 1 hour as run_end from r group by owner, run""",
    "interval_cells": f"""
        with {_BUSY},
        c as (select owner, unnest(generate_series(date_trunc('hour', busy_start)::timestamp, busy_end - interval 1 microsecond, interval 1 hour)) as cell from busy where busy_start < busy_end)
        select owner, cell, count(*) as n from c group by 1, 2""",
    "reminder_expand": f"""
        with r as (select event_id, ts, unnest(list_distinct([60, event_id % 7 * 60])) as lead_minutes from events)
        select event_id, lead_minutes, ts - to_minutes(lead_minutes::int) as due from r where lead_minutes > 0 and ts - to_minutes(lead_minutes::int) > timestamp '{NOW}' - interval 5 minutes""",
    "deadline_sweep": f"select event_id as interview from events where event_type = 'signup' and event_id % 3 <> 0 and ts + interval 48 hours <= timestamp '{NOW}'",
    "expired_invitations": f"select event_id from events where event_type = 'view' and ts + interval 3 days <= timestamp '{NOW}'",
    "due_outbox": f"select event_id as event from events where event_type = 'click' and ts <= timestamp '{NOW}' order by ts, event_id limit 200",
    "instant_conflicts": """
        with e as (select event_id, user_id % 3 as owner, date_trunc('hour', ts) as start, event_type from events)
        select event_id from e a where event_id % 2 = 0 and exists (select 1 from e b where b.event_id % 2 = 1 and b.owner = a.owner and b.start = a.start and b.event_type <> 'error')""",
    "slots_by_day": "select user_id % 6 as owner, ts::date as day, count(*) as n, min(ts) as first_start from events group by 1, 2",
    "page_text": r"""
        with b as (select page_id, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as t from pages),
        e as (select page_id, html, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) as x from b)
        select page_id, md5(x) as text, sha256(html) as checksum, case when length(x) < 20 then 'NO_TEXT' end as reason from e""",
    "hard_chunks": """
        with n as (select doc_id, text, unnest(range(0, ceil(length(text) / 900)::bigint)) as ordinal from documents where length(text) > 0)
        select doc_id, ordinal, md5(substr(text, ordinal * 900 + 1, 900)) as chunk from n""",
    "job_reading": f"""
        with kinds(skill, category) as (values ('Python', null), ('Redis', 'BACKEND'), ('Kafka', 'DATA_ENGINEERING'), ('MySQL', 'BACKEND'), ('Docker', 'DEVOPS_SRE'), ('Terraform', 'CLOUD'), ('Java', 'BACKEND'),
            ('Hadoop', 'DATA_ENGINEERING'), ('Snowflake', 'DATA_ENGINEERING'), ('Rust', 'BACKEND'), ('AWS', 'CLOUD'), ('Go', 'BACKEND'), ('Selenium', 'QA_AUTOMATION'), ('Git', null)),
        p as (
            select c_custkey, ['Python', ['Redis', 'Kafka', 'MySQL'][c_custkey % 3 + 1]] as needs, [[], [], ['Java'], []][c_custkey % 4 + 1]::varchar[] as extra, [['Docker', 'Terraform'], ['Docker'], ['Docker', 'Terraform'], ['Docker', 'Terraform']][c_custkey % 4 + 1] as liked,
                   [['Snowflake'], ['Rust'], [], [], ['Selenium', 'Go', 'Git']][c_custkey % 5 + 1]::varchar[] as aside, [['Hadoop'], ['Hadoop'], ['AWS'], ['Snowflake'], []][c_custkey % 5 + 1]::varchar[] as unread,
                   (c_custkey % 9 + 1)::double as years, ['Senior', null, 'Junior'][c_custkey % 3 + 1] as level, ['BACKEND', 'FRONTEND', 'DATA_ENGINEERING'][c_custkey % 3 + 1] as title, ['Bachelor', 'Master', null][c_custkey // 2 % 3 + 1] as education
            from customer),
        l as (select *, case when c_custkey % 2 = 0 then needs || extra || aside else extra || aside || needs end as required, needs || extra || liked || aside || unread as named from p),
        votes as (
            select c_custkey as key, category, sum(score)::double as score, sum(t)::double as title_score
            from (select c_custkey, title as category, 3 as score, 3 as t from l union all select c_custkey, category, 1, 0 from (select distinct c_custkey, unnest(named) as skill from l) join kinds using (skill) where category is not null) group by 1, 2),
        {_PICKED}
        select c_custkey, array_to_string(required, '|') as required, array_to_string(liked, '|') as preferred, years, coalesce(b.category, 'UNCLASSIFIED') as category, secondary, level, education
        from l left join best b on key = c_custkey""",
    "category_votes": rf"""
        with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as alias from benchmark),
        k as (select alias, 'C' || {_SHA32.format("alias", 5)} as category, ({_SHA32.format("alias || 'w'", 4)} + 1) / 4 as weight from w where length(alias) > 7),
        {_CLAUSES},
        hits as (select distinct doc_id, alias, line = 1 as title from (
            select doc_id, line, unnest([tok, regexp_replace(tok, chr(39) || 's$', '')] || case when contains(tok, '/') then string_split(tok, '/') else [] end) as alias from e) join k using (alias)),
        votes as (select doc_id as key, category, sum(case when title then weight else weight * 0.5 end) as score, coalesce(sum(weight) filter (title), 0) as title_score from hits join k using (alias) group by 1, 2),
        {_PICKED}
        select doc_id, coalesce(category, 'UNCLASSIFIED') as category, secondary from documents left join best on key = doc_id""",
    "alert_states": """
        with s as (select (user_id % 5)::varchar as owner, date_trunc('day', ts)::timestamp as "at", count(*) filter (event_type = 'error') > 3 as broken from events group by 1, 2),
        p as (select *, coalesce(lag(broken) over (partition by owner order by "at"), false) as was from s),
        f as (select *, sum(broken::int) over w as n, max(case when broken and not was then "at" end) over w as opened, max(case when was and not broken then "at" end) over w as closed from p window w as (partition by owner order by "at"))
        select owner, 'errors' as signal, "at", case when broken then 'OPEN' else 'RESOLVED' end as status, n::bigint as occurrences, opened as opened_at, case when not broken then closed end as resolved_at from f where n > 0""",
    "controlled_alerts": """
        with e as (
            select user_id::varchar as owner, 's' || (event_id % 2) as signal, ts as "at", case event_type when 'error' then 'BREACH' when 'purchase' then 'RECOVER' when 'view' then 'ACKNOWLEDGE' when 'signup' then 'RESOLVE' end as event,
                   list_position(['BREACH', 'RECOVER', 'RESOLVE', 'ACKNOWLEDGE'], event) as r, sum((event = 'BREACH')::int) over (partition by owner, signal order by "at", r rows unbounded preceding) as occurrences from events where event_type <> 'click'),
        o as (select *, row_number() over (partition by owner, signal order by "at", r) as nth from e where occurrences > 0),
        w as (select *, coalesce((select p.event = 'BREACH' from o p where p.owner = o.owner and p.signal = o.signal and p.nth < o.nth and p.event <> 'ACKNOWLEDGE' order by p.nth desc limit 1), false) as was from o),
        x as (select *, case when event = 'ACKNOWLEDGE' then was else event = 'BREACH' end as open,
                     max(case when event = 'BREACH' and not was then nth end) over u as opened, max(case when event = 'RESOLVE' or event = 'RECOVER' and was then nth end) over u as closed, max(case when event = 'ACKNOWLEDGE' and was then nth end) over u as acked
              from w window u as (partition by owner, signal order by nth rows unbounded preceding)),
        t as (select owner, signal, nth, "at" from o)
        select x.owner, x.signal, x."at", event, case when not open then 'RESOLVED' when event = 'ACKNOWLEDGE' then 'ACKNOWLEDGED' else 'OPEN' end as status, occurrences::bigint as occurrences, a."at" as opened_at,
               b."at" as acknowledged_at, c."at" as resolved_at, event <> 'ACKNOWLEDGE' or was as accepted
        from x left join t a on a.owner = x.owner and a.signal = x.signal and a.nth = opened left join t b on b.owner = x.owner and b.signal = x.signal and b.nth = acked and acked > opened
        left join t c on c.owner = x.owner and c.signal = x.signal and c.nth = closed and not open""",
    "passed_deadlines": f"""
        with e as (select user_id::varchar as entity, ts as "at", case when event_type <> 'purchase' then ts + to_hours((event_id % 72)::int) end as deadline from events where event_type in ('signup', 'view', 'purchase')),
        n as (select *, lead("at") over (partition by entity order by "at", deadline is not null, deadline) as following from e)
        select entity, deadline from n where deadline < timestamp '{NOW}' and (following is null or following > deadline)""",
    "search_documents": r"""
        with w as (select *, string_split(p_name, ' ') as words from part),
        s as (
            select p_partkey, words[1] as who, p_brand as brand, p_name as name, [
                ['specialization', p_brand], ['roles', p_type], ['level', 'level ' || (p_size % 5)], ['canonical skills', array_to_string(list_filter(string_split(p_type, ' '), lambda x, i: not list_contains(list_transform(string_split(p_type, ' ')[:i - 1], lambda y: lower(y)), lower(x))), '; ')],
                ['certifications', case when p_partkey % 2 = 0 then 'CEH' else '' end], ['experience years', p_size::varchar], ['industries', array_to_string(list_filter(words, lambda x, i: not list_contains(words[:i - 1], x)), '; ')],
                ['responsibilities', 'mail about ' || p_name], ['projects', 'P' || p_partkey], ['impact', 'call for ' || p_brand], ['education', 'BSc; ' || p_name], ['professional summary', p_name || ' "' || p_brand || '"']] as lines
            from w),
        r as (select p_partkey, list_transform(lines, lambda x: [x[1], trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(x[2], '; '), lambda v: trim(regexp_replace(regexp_replace(v, who, ' ', 'gi'), '\s+', ' ', 'g'))), lambda v: v <> ''), '; '), ' +', ' ', 'g'))]) as lines from s),
        t as (select p_partkey, array_to_string(list_transform(list_filter(lines, lambda x: x[2] <> ''), lambda x: x[1] || ': ' || x[2]), chr(10)) as text from r)
        select p_partkey, md5(text) as text, sha256('{"template": "search-document-v1", "text": "' || replace(replace(text, '"', '\"'), chr(10), '\n') || '"}') as content_hash from t""",
    "eval_judgments": """
        with d as (select 'v' || (doc_id // 50) as s, case when doc_id % 23 > 0 then 'd' || (doc_id % 1000 - case when doc_id % 29 = 0 then 1 else 0 end) end as id, doc_id % 31 > 0 as texted from documents),
        k as (select distinct s, id from d where id is not null and texted),
        j as (select 'v' || (doc_id // 50) as s, 'd' || (doc_id % 1000) as document, quality * 2 + 1 - toxic + case when doc_id % 13 = 0 then 5 else 0 end as grade from labels)
        select s as dataset, 'q' as query, document, grade::int as grade from j join k using (s) where id = document and grade between 0 and 3 and s <> 'v3'""",
    "eval_rejections": """
        with d as (select 'v' || (doc_id // 50) as s, doc_id, case when doc_id % 23 > 0 then 'd' || (doc_id % 1000 - case when doc_id % 29 = 0 then 1 else 0 end) end as id, doc_id % 31 > 0 as texted from documents),
        c as (select s, id, case when id is null then 'no id' when not texted then 'no text' when row_number() over (partition by s, id, texted order by doc_id) > 1 then 'id used before' end as reason from d),
        k as (select distinct s, id from d where id is not null and texted),
        j as (select 'v' || (doc_id // 50) as s, 'd' || (doc_id % 1000) as document, quality * 2 + 1 - toxic + case when doc_id % 13 = 0 then 5 else 0 end as grade from labels),
        g as (select j.s, 'q/' || document as item, case when grade is null or grade not between 0 and 3 then 'grade' when k.id is null then 'unknown document' end as reason from j left join k on j.s = k.s and k.id = document),
        v as (select distinct s from d),
        a as (
            select s as dataset, 'document' as part, id as item, reason from c where s <> 'v3' union all select s, 'judgment', item, reason from g where s <> 'v3'
            union all select s, 'query', null, 'no id' from v where s <> 'v3' union all select s, 'query', 'q', 'id used before' from v where s <> 'v3'
            union all select null, 'set', null, 'no version' from v where s = 'v3' union all select null, 'set', null, 'not a set')
        select dataset, part, item, reason, count(*) as n from a where reason is not null group by all""",
    "stored_objects": """
        select 't' || (page_id % 7) || '/' || page_id || '/original.' || ['html', 'txt'][page_id % 3 + 1] as path, strlen(coalesce(html, ''))::bigint as length, sha256(coalesce(html, '')) as sha256 from pages where page_id % 3 < 2""",
    "platt_fit": """
        with recursive g as (
            select doc_id % 3 as owner, ((doc_id * 7 + quality * 400) % 1000 / 10) / 100 as x, (quality * 2 + 1 - toxic >= 2)::int as y, count(*)::double as w from labels where quality is not null and toxic is not null group by 1, 2, 3),
        c as (select owner, sum(w) as n, sum(w * y) as p from g group by 1 having n >= 30 and p > 0 and p < n),
        f(owner, i, n, a, b) as (
            select owner, 0, n, 1.0::double, ln((p + 1) / (n - p + 1)) from c
            union all
            select f.owner, i + 1, n, a - 0.1 * (sum(w * (1 / (1 + exp(-(a * x + b))) - y) * x) / n + 0.01 * a), b - 0.1 * sum(w * (1 / (1 + exp(-(a * x + b))) - y)) / n
            from f join g on g.owner = f.owner where i < 2000 group by f.owner, i, n, a, b)
        select f.owner, n::bigint as n, round(a, 6) as slope, round(b, 6) as intercept, round(sum(w * (1 / (1 + exp(-(a * x + b))) - y) ** 2) / n, 6) as brier,
               round(-sum(w * ln(case y when 1 then 1 / (1 + exp(-(a * x + b))) else 1 - 1 / (1 + exp(-(a * x + b))) end)) / n, 6) as log_loss
        from f join g on g.owner = f.owner where i = 2000 group by f.owner, n, a, b""",
    "outbox_states": """
        with a as (select user_id % 60 as event, event_id, timestamp '2024-01-01' + to_seconds(event_id) as "at", event_type as t, row_number() over (partition by user_id % 60 order by event_id) as attempt from events),
        s as (select *, case t when 'purchase' then 'COMPLETED' when 'signup' then 'BLOCKED' else case when attempt >= 5 then 'FAILED' else 'PENDING' end end as status from a)
        select event, event_id, attempt, status, case when status = 'PENDING' then "at" + to_seconds(least(300, (2 ** attempt)::int)) end as available_at
        from (select *, coalesce(max((status <> 'PENDING')::int) over (partition by event order by event_id rows between unbounded preceding and 1 preceding), 0) as done from s) where done = 0""",
    "task_states": """
        with a as (select l_orderkey as task, l_partkey * 8 + l_linenumber as "at", bool_or(l_returnflag = 'N') as ok from lineitem group by 1, 2),
        s as (select *, row_number() over (partition by task order by "at") as attempt from a),
        t as (select case when ok then 'COMPLETED' when attempt >= 3 then 'FAILED' else 'RETRYING' end as status, attempt from s)
        select status, case when status = 'RETRYING' then least(300, 10 * (3 ** (attempt - 1))::int) end as delay, count(*) as n from t group by 1, 2""",
    "owner_scope": "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'",
    "in_filter": "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('P', 'F')",
    "hard_filter": f"with {_TOP} select p_partkey from part, top where list_contains(string_split(p_type, ' '), gate[1]) and p_size >= 20 and p_partkey % 5 = 0",
    "warehouse_filter": """
        select p_partkey from part where p_size between 5 and 40 and contains(lower(p_name), 'a') and p_partkey % 2 = 0 and p_partkey % 5 > 0 and p_brand = 'Brand#13'
        union all select -p_partkey from part where p_partkey % 5 = 0""",
    "webhook_rows": """
        with r as (
            select event_id, user_id, event_type, '{"provider":"p' || (user_id % 4) || '",' || case event_id % 3 when 0 then '"id":"e' || event_id || '",' when 1 then '"data":{"id":"d' || event_id || '"},' else '' end
                   || case when event_id % 3 = 2 then '"event":"' else '"type":"' end || upper(event_type) || '","n":' || event_id || '}' as v from events)
        select 'p' || (user_id % 4) as provider, case event_id % 3 when 0 then 'e' || event_id when 1 then 'd' || event_id else 'sha256:' || sha256(v) end as external_id, event_type as type from r""",
    "distinct_events": "select distinct user_id, event_type, ts::date as day from events",
    "consented_rows": f"select event_id from events where event_id % 9 > 0 and ts <= timestamp '{NOW}'",
    "file_drift": "select doc_id::varchar as path from documents where doc_id % 7 = 0 or doc_id % 11 = 0 union select (doc_id + 1000000000)::varchar from documents where doc_id % 11 = 0",
    "seed_missing": "select distinct l_partkey * 3 as p_partkey from lineitem where l_partkey * 3 not in (select p_partkey from part)",
    "shortlist_report": """
        with t as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders qualify place <= 3),
        b as (select *, (select string_agg('- line ' || i, chr(10) order by i) from range(1, least(o_orderkey % 10 + 1, 8) + 1) r(i)) as ev, (select string_agg('- line ' || i, chr(10) order by i) from range(1, least(o_orderkey % 10 + 1, 7) + 1) r(i)) as qs from t),
        p as (select o_custkey, place, '## ' || place || '. Order ' || o_orderkey || chr(10) || 'Score: ' || floor(o_totalprice)::bigint || ' (' || case when o_orderstatus = 'F' then 'done' else '-' end || ')' || chr(10)
                     || '### Evidence' || chr(10) || ev || chr(10) || '### Questions' || chr(10) || case when o_orderkey % 2 = 0 then qs else '' end as s from b)
        select o_custkey, md5('# Shortlist' || chr(10) || chr(10) || string_agg(s, chr(10) || chr(10) order by place)) as report from p group by 1""",
    "subject_export": """
        with o as (select o_custkey, string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' order by o_orderkey) as items from orders group by 1)
        select c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"' || coalesce(',"orders":[' || items || ']', '') || '}' as json from customer left join o on o_custkey = c_custkey""",
    "backfill_identity": """
        with k as (select o_orderkey as id, o_orderdate, case o_orderkey % 3 when 0 then 'e:c' || o_custkey || '@x.org' when 1 then 'p:' || lpad('9' || o_custkey, 10, '0') else 'i:' || o_orderkey end as identity from orders)
        select id, identity, row_number() over (partition by identity order by o_orderdate, id) as number, case when id % 4 = 0 then 'given' else sha256('order ' || id) end as content from k""",
    "merged_profiles": """
        with r as (select o_custkey as profile, o_orderkey as n, o_orderdate::timestamp + to_seconds((o_orderkey % 86400)::int) as seen from orders),
        g as (select profile, arg_max('Name ' || n, {'a': seen, 'b': 'Name ' || n}) filter (n % 3 > 0) as name, arg_min('o' || n || '@x.org', seen) filter (n % 2 = 0) as email, arg_min(lpad('9' || n, 10, '0'), seen) filter (n % 5 = 0) as phone, max(seen) as last from r group by 1)
        select c_mktsegment as owner, c_custkey as profile, coalesce(g.name, c_name) as name, case when c_custkey % 2 = 0 then 'own@x.org' else g.email end as email, g.phone as phone,
               timestamp '1990-01-01' as first_seen, greatest(timestamp '1990-01-01', coalesce(last, timestamp '1990-01-01')) as last_seen from customer left join g on g.profile = c_custkey""",
    "active_task_count": "select o_custkey, count(*) filter (l_returnflag in ('N', 'A')) as active from orders left join lineitem on l_orderkey = o_orderkey group by 1",
    "linked_answers": """
        with t as (select conv_id || '/' || turn as pair, md5(text) as said, conv_id, turn from conversations)
        select a.pair as one, b.pair as other, a.said as said_one, b.said as said_other from t a join t b on b.pair = a.conv_id || '/' || (a.turn + 2)""",
    "filter_values": """
        with v as (select p_partkey, p_brand, generate_subscripts(w, 1) - 1 as place, unnest(w) as raw from (select p_partkey, p_brand, string_split(p_type, ' ') || [p_brand] as w from part)),
        n as (select p_partkey, place, case when raw = p_brand then 'brand-' || substr(p_brand, 7, 2) when length(raw) > 4 then 'sk-' || lower(raw) else 'raw:' || lower(raw) end as value from v)
        select p_partkey, min(place)::bigint as place, value from n group by 1, 3""",
    "ordered_children": "select o_orderkey, coalesce(string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey), '') as parts from orders left join lineitem on l_orderkey = o_orderkey group by 1",
    "truth_by_email": """
        with f as (select ['be-', 'fe-', 'ops-', 'xx-'][c_custkey % 4 + 1] || c_custkey as file, 'c' || c_nationkey || '@x.org' as email, ['BACKEND', 'FRONTEND', 'DEVOPS_SRE', null][c_custkey % 4 + 1] as category from customer)
        select email, arg_min(category, file) as category from f where category is not null group by 1""",
    "distinct_in_order": """
        with v as (select p_partkey, generate_subscripts(w, 1) as place, unnest(w) as raw from (select p_partkey, string_split(p_type || ' ' || p_type || ' ' || p_name, ' ') as w from part)),
        f as (select p_partkey, min(place) as place, arg_min(raw, place) as raw from v where raw <> '' group by p_partkey, lower(raw))
        select p_partkey, string_agg(raw, '|' order by place) as words from f group by 1""",
    "category_counts": "select c.category, count(d.lang) as n from (select unnest(['en', 'de', 'xx', 'UNCLASSIFIED']) as category) c left join (select case when lang in ('en', 'de', 'xx') then lang else 'UNCLASSIFIED' end as lang from documents) d on d.lang = c.category group by 1",
    "full_diff": """
        with o as (select o_custkey, o_orderkey as k, o_orderstatus as st, o_orderpriority as pr, floor(o_totalprice / 1000)::double as y from orders),
        p as (select k as pair, lead(k) over w as k2, st as s1, lead(st) over w as s2, pr as p1, lead(pr) over w as p2, y as y1, lead(y) over w as y2 from o window w as (partition by o_custkey order by k) qualify k2 is not null),
        sk as (select l_orderkey as o, (l_partkey % 20)::varchar as key, min(case when l_linenumber % 3 = 0 then 'x' else 'y' end || (l_partkey % 20)) as raw from lineitem group by 1, 2),
        b as (select pair, key, raw as before from p join sk on o = pair), a as (select pair, key, raw as after from p join sk on o = k2),
        d as (select pair, before, after, case when before is null then 'added' when after is null then 'removed' when lower(before) <> lower(after) then 'modified' else 'unchanged' end as bucket from b full join a using (pair, key)),
        w as (select pair, list_distinct(string_split(replace(p1, '-', ' '), ' ')) as wb, list_distinct(string_split(replace(p2, '-', ' '), ' ')) as wa from p),
        l as (select pair, wb, wa, unnest(list_distinct(wb || wa)) as v from w)
        select pair, bucket, 'skills' as category, before, after, case when bucket = 'modified' then 'ALIAS_RENAMED' end as change_type from d
        union all select pair, case when y1 = y2 then 'unchanged' else 'modified' end, 'years', y1::varchar, y2::varchar, case when y1 <> y2 then 'VALUE_CHANGED' end from p
        union all select pair, 'conflict', 'years', y1::varchar, y2::varchar, null from p where y2 < y1
        union all select pair, case when s1 = 'P' then 'added' when s1 = s2 then 'unchanged' else 'modified' end, 'status', nullif(s1, 'P'), s2, case when s1 <> 'P' and s1 <> s2 then 'VALUE_CHANGED' end from p
        union all select pair, case when p1 = p2 then 'unchanged' else 'modified' end, 'summary', p1, p2, case when p1 <> p2 then 'TEXT_CHANGED' end from p
        union all select pair, case when not list_contains(wb, v) then 'added' when not list_contains(wa, v) then 'removed' else 'unchanged' end, 'words', case when list_contains(wb, v) then v end, case when list_contains(wa, v) then v end, null from l where v <> ''""",
    "uuids": """
        with h as (select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) as h from customer)
        select c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[('0x' || h[17:17])::int % 4 + 1] || h[18:20] || '-' || h[21:32] as uuid from h""",
    "stable_dumps": """select c_custkey, '{"key":' || c_custkey || ',"name":"' || c_name || '","segment":' || case when c_custkey % 2 = 0 then '"' || c_mktsegment || '"' else 'null' end || '}' as json from customer""",
    "rendered_files": "select c_custkey, 'Dear ' || c_name || ', ' || c_mktsegment as letter, case when c_custkey % 4 > 0 then regexp_replace(c_name, '[^A-Za-z0-9_]+', '_', 'g') else 'candidate' end || '_CV_v' || (c_custkey % 9) || '.pdf' as file from customer",
    "quota_decisions": """
        with r as (select l_suppkey, l_orderkey * 10 + l_linenumber as id, strftime(l_shipdate, '%Y-%m') as period, l_shipdate, greatest(0, (l_quantity - 5)::bigint) as amount from lineitem),
        u as (select id, period, coalesce(sum(amount) over (partition by l_suppkey, period order by l_shipdate, id rows between unbounded preceding and 1 preceding), 0)::bigint as used from r)
        select *, used < 60 as accepted from u""",
    "batch_counters": "select l_orderkey, count(*) filter (l_returnflag = 'N') as created, count(*) filter (l_returnflag = 'A') as skipped, count(*) filter (l_returnflag = 'R') as failed, count(*) as total from lineitem group by 1",
    "find_mentions": rf"""
        with w as (select regexp_extract_all(lower(text), '[a-z]+') as w from benchmark),
        one as (select distinct unnest(list_filter(w, lambda x: length(x) > 8)) as a from w),
        two as (select distinct x as a, y as b from (select unnest(w[1:-2]) as x, unnest(w[2:]) as y from w where len(w) > 1) where length(x) > 5 and length(y) > 5),
        {_CLAUSES},
        s as (select doc_id, line, clause, place, nxt, unnest(list_distinct([tok, regexp_replace(tok, chr(39) || 's$', '')])) as tok, 1 as least from e
              union all select doc_id, line, clause, place, null, unnest(string_split(tok, '/')), 0 from e where contains(tok, '/')),
        m as (select doc_id, line, clause, place, least as n, tok as alias from s join one on a = tok
              union all select doc_id, line, clause, place, 2, a || ' ' || b from s join two on tok = a and (nxt = b or regexp_replace(nxt, chr(39) || 's$', '') = b) where least = 1),
        top as (select distinct * from m qualify n = max(n) over (partition by doc_id, line, clause, place)),
        free as (select x.* from top x anti join (select doc_id, line, clause, place + 1 as place from top where n = 2) y using (doc_id, line, clause, place))
        select doc_id, array_to_string(list_transform(string_split(alias, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as name, count(*) as n from free group by 1, 2""",
    "connector_rows": f"select distinct 'c' || (user_id % 3) as connector, event_type || '/' || ts::date as source_ref from events where event_id % 9 > 0 and ts <= timestamp '{NOW}'",
    "step_latency": "select event_type as step, count(*) as n, round(avg(event_id % 500), 3) as mean_ms from events group by 1",
    "dead_letters": """
        with a as (select l_orderkey as task, l_partkey * 8 + l_linenumber as "at", bool_or(l_returnflag = 'N') as ok from lineitem group by 1, 2),
        s as (select *, row_number() over (partition by task order by "at") as attempt from a)
        select task, count(*) as n from s where not ok and attempt >= 3 group by 1""",
    "candidate_search": f"""
        with {_CHAINED},
        m as (select profile, version, lang = 'en' as en, years, dense as d, lexical as l from told),
        c as (
            select *, 0.50 / 1.02 * (least(1, greatest(0, (d + 1) / 2)) * 0.8 + least(1, l) * 0.2) + 0.25 / 1.02 * en::int + 0.10 / 1.02 * least(1, greatest(0, years) / 3)
                       + 0.05 / 1.02 * (1 - (epoch_us(timestamp '{NOW}') - epoch_us(timestamp '2023-06-01')) / 86400000000 / 730) + 0.12 / 1.02 * en::int as raw from m),
        r as (
            select profile, version, round(raw * 100, 2) as score from (select *, row_number() over (partition by profile order by raw desc, version desc) as n from c) where n = 1
            order by score desc, version desc, profile limit 20),
        p as (select *, row_number() over (order by score desc, version desc, profile) as place from r),
        x as (select profile, version, place, case when place <= 8 then round((score / 100 * 0.3 + ({_SHA32.format('profile', 1000)} + 0.25) / 1009 * 0.7) * 100, 2) else score end as score from p),
        t as (select * from x order by place > 8, case when place > 8 then place end, score desc, version desc, profile limit 10)
        select 7 as event, row_number() over (order by score desc, version desc, profile) as rank, profile, score, sha256('query') as query_hash from t""",
    "evidence_levels": f"with {_CHAINED} select version, round(dense, 6) as dense, round(lexical, 6) as lexical, level, method, md5(evidence) as evidence from told",
    "keyword_fallback": f"""
        with {_VERSIONS},
        m as (select *, share * 2 - 1 as d, (d + 1) / 2 * 0.8 + share * 0.2 as semantic from v),
        c as (select *, 0.50 / 0.55 * semantic + 0.05 / 0.55 * (1 - (epoch_us(timestamp '{NOW}') - epoch_us(timestamp '2023-06-01')) / 86400000000 / 730) as raw from m),
        r as (select *, round(raw * 100, 2) as score from c qualify row_number() over (partition by profile order by raw desc, version desc) = 1 order by score desc, version desc, profile limit 20)
        select profile, version, score, round(semantic, 6) as semantic, line_method as method, md5(line) as evidence from r where semantic > 0.5""",
    "cover_density": f"""
        with q as (select unnest(query) as token from {_QUERY}),
        t as (select doc_id, unnest(regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\\p{{L}}\\p{{N}}_]+')) as token from documents),
        n as (select doc_id, count(*) * 0.1 as d from t join q using (token) group by 1 order by d desc, doc_id limit 100)
        select doc_id, round(d / max(d) over (), 6) as lexical from n""",
    "cover_windows": """
        with w as (select doc_id, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\\p{L}\\p{N}_]+') as w from documents),
        t as (select doc_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as pos from w),
        f as (select token, row_number() over (order by count(distinct doc_id) desc, token) as q from t where length(token) > 1 group by token qualify q <= 3),
        p as (select doc_id, q, pos, row_number() over (partition by doc_id order by pos) as nth from t join f using (token)),
        s as (select *, max(case when q = 1 then pos end) over u as a, max(case when q = 2 then pos end) over u as b, max(case when q = 3 then pos end) over u as c from p window u as (partition by doc_id order by pos)),
        e as (select doc_id, least(a, b, c) as start, min(pos) as stop, min(nth) as last from s where a is not null and b is not null and c is not null group by 1, 2)
        select e.doc_id, count(*) as covers, round(sum(0.1 / (1 + (stop - start) - (last - p.nth))), 6) as density from e join p on e.doc_id = p.doc_id and p.pos = start group by 1""",
    "search_modes": f"""
        with m as (select doc_id % 25 as query, doc_id as doc, {_SHA32.format('doc_id::varchar', 1000)} / 500 - 1 as d, {_SHA32.format("doc_id || 'w'", 1000)} / 1000 as l, {_SHA32.format("doc_id || 'r'", 1000)} / 1000 as rr from documents),
        s as (
            select 'dense' as mode, query, doc, rr, round((d + 1) / 2 * 100, 6) as score from m union all select 'keyword', query, doc, rr, round((l * 0.8 + l * 0.2) * 100, 6) from m
            union all select 'hybrid', query, doc, rr, round(((d + 1) / 2 * 0.8 + l * 0.2) * 100, 6) from m),
        k as (select *, row_number() over (partition by mode, query order by score desc, doc) as rank from s qualify rank <= 100),
        a as (select mode, query, doc, rank from k union all select 'reranked', query, doc, row_number() over (partition by query order by score * 0.3 + 100 * rr * 0.7 desc, rank) from k where mode = 'hybrid'),
        grades as (select doc_id % 25 as query, doc_id as doc, quality * 2 + 1 - toxic as grade from labels),
        j as (select a.*, coalesce(grade, 0) as grade from a left join grades using (query, doc)),
        f as (select mode, query, count(*) filter (rank <= 5 and grade >= 2) as h5, count(*) filter (rank <= 10 and grade >= 2) as h10, count(*) filter (rank <= 20 and grade >= 2) as h20, min(rank) filter (grade >= 2) as first,
                     sum(case when rank <= 10 then (2 ** grade - 1) / log2(rank + 1) else 0 end) as dcg from j group by 1, 2),
        i as (select *, row_number() over (partition by query order by grade desc, doc) as place from grades),
        b as (select query, count(*) filter (grade >= 2) as rel, sum(case when place <= 10 then (2 ** grade - 1) / log2(place + 1) else 0 end) as ideal from i group by 1),
        z as (select mode, query, h5, h10, h20, first, dcg, coalesce(rel, 0) as rel, coalesce(ideal, 0) as ideal from f left join b using (query))
        select mode, query, h5 / 5 as precision_at_5, round(case when rel = 0 then 1 else h10 / rel end, 6) as recall_at_10, round(case when rel = 0 then 1 else h20 / rel end, 6) as recall_at_20,
               round(coalesce(1 / first, 0), 6) as rr, round(case when ideal = 0 then 1 else dcg / ideal end, 6) as ndcg_at_10 from z""",
    "readiness": "select count(*) filter (event_type not in ('error', 'view')) as pass, count(*) filter (event_type = 'view') as warn, count(*) filter (event_type = 'error') as fail, count(*) filter (event_type = 'error') = 0 as ready from events",
    "approval_band": "select event_id, case when event_id % 101 >= 80 and (event_id % 11) / 10 * 100 >= 60 then 'APPROVE' else 'REVIEW' end as band from events",
    "proposals": """
        with a as (select o_custkey as job, o_orderkey as id, case when o_orderkey % 7 > 0 then o_orderkey % 101 end as score, (o_orderkey % 11) / 10 as conf, o_orderstatus = 'O' as waits from orders),
        s as (select * from a where score is not null),
        busy as (select distinct job from a join lineitem on l_orderkey = id where l_partkey % 40 = 0),
        t as (select job, count(*) filter (score >= 65) as good from s group by 1 having count(*) >= 2 and job not in (select job from busy))
        select 'screening_completed' as trigger, job, id, row_number() over (partition by job order by score desc, id) as place from s where waits and not (score >= 80 and conf * 100 >= 60)
        union all
        select 'manual', job, id, row_number() over (partition by job order by score desc, id) as place from s join t using (job) where good = 0 or score >= 65 qualify place <= 5""",
    "interview_kit": """
        with k as (select p_partkey, string_split(p_type, ' ') as r, case when p_partkey % 4 = 0 then 'this position' else p_brand end as t from part),
        f as (select *, list_slice(case when p_partkey % 3 > 0 then r[1:p_partkey % 3] else r end, 1, 3) as focus, coalesce(r[p_partkey % 3 + 1], '') as gap from k)
        select p_partkey, array_to_string(focus, '|') as focus, gap,
               md5('Which project of yours shows ' || focus[1] || ' best, and what of it would serve ' || t || '?' || chr(10) || 'How would you handle errors, logs and tests of a service built on ' || focus[-1] || '?' || chr(10)
                   || case when gap <> '' then 'Your CV says little of ' || gap || ': where have you met it?' else 'Which of your skills would you still like to deepen?' end || chr(10)
                   || 'A request changes shortly before the deadline: what do you do?' || chr(10) || 'What should decide for you as ' || t || '?') as questions from f""",
    "violation_rate": f"""
        with {_TOP}, v as (select (not list_contains(string_split(p_type, ' '), gate[1]))::int + (p_size < 25)::int as n from part, top)
        select sum(n)::bigint as violations, count(*) as returned, round(sum(n) / count(*), 4) as rate from v""",
    "precision_by_category": f"""
        with x as (select system, source, lang, doc_id, {_SHA32.format('system || doc_id', 100000)} as s from documents, (select unnest(['a', 'b', 'c', 'd']) as system)),
        h as (select *, ['en', 'de'][ascii(right(source, 1)) % 2 + 1] as category from x qualify row_number() over (partition by system, source order by s, doc_id) <= 10),
        q as (select system, category, source, count(*) filter (lang = category) / 10 as p from h group by 1, 2, 3),
        c as (select system, category, avg(p) as precision, count(*) as n from q group by 1, 2)
        select system, category, round(precision, 6) as precision, round(sum(precision * n) over w / sum(n) over w, 6) as overall, round(min(precision) over w, 6) as lowest from c window w as (partition by system)""",
    "case_metrics": """
        with r as (select user_id, arg_max(event_id, event_id * 7919 % 100003) as top, max(event_id) as want from events group by 1)
        select (select count(*) from r) as cases, (select round(avg((top = want)::int), 3) from r) as top_1, round(avg((event_id % 7 > 0)::int), 3) as requirement_accuracy,
               round(avg((event_id % 3 = 0 or event_id % 5 > 0)::int), 3) as evidence_support, round(avg((event_id % 2 = event_id % 6 % 3)::int), 3) as routing_accuracy from events""",
    "busy_weeks": f"""
        with d as (select unnest(generate_series(date_trunc('week', timestamp '{NOW}'), date_trunc('week', timestamp '{NOW}') + interval 20 days, interval 1 day))::date as day),
        n as (select ts::date as day, 2 * count(*) as n, count(*) * 75 * 60 as seconds from events group by 1)
        select day, coalesce(n, 0)::bigint as n, coalesce(seconds, 0)::bigint as seconds from d left join n using (day)""",
}
for _name, _head, _tail in (
    ("promotable", "canary_gate", """
        , open_ as (select distinct user_id from events where event_type = 'error' and event_id % 3 = 0)
        select user_id as owner, status, status = 'PROMOTION_ALLOWED' and user_id not in (select user_id from open_) and user_id % 4 > 0 as promotable from g"""),
    ("alert_notifications", "alert_states", " select distinct owner, signal, opened_at from g where status = 'OPEN'"),
    ("warehouse_reranked", "warehouse_rank", f"""
        , p as (select cv, row_number() over (order by score desc, cv) as was, {_SHA32.format('cv::varchar', 1000)} / 1000 as rerank from g)
        select cv, row_number() over (order by was > 13, case when was > 13 then was end, rerank desc, was) as place from p"""),
):
    ORACLE_SQL[_name] = f"with g as ({ORACLE_SQL[_head]}){_tail}"

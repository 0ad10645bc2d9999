"""The registered queries of this subpackage: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hard_negatives, license_scan, near_dedup, packing, pii, quality, runs, secret_scan, sharding, toxicity, warc

#: The key of the registered query; a deployment passes its own to ``pii.pseudonymise``.
PII_KEY = "registered-query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("hits")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), n=4)


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path).drop("url", "html")


def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    counts = [F.expr(f"cast(size(filter(pii_spans, s -> s.kind = '{k}')) as int)").alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", "text", F.size("pii_spans").alias("n_pii"), *counts)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.expr("array_sort(leaks, (x, y) -> case when x.lcs > y.lcs then -1 when x.lcs < y.lcs then 1 when x.item_id < y.item_id then -1 when x.item_id > y.item_id then 1 else 0 end)[0]")
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").alias("n_items"),
        F.expr("array_sort(transform(leaks, x -> x.item_id))").alias("item_ids"),
        F.when(F.size("leaks") > 0, best).alias("best"),
    ).select("doc_id", "contaminated", "n_items", "item_ids", F.col("best.item_id").alias("item_id"), F.col("best.lcs").alias("lcs"), F.col("best.answer").alias("answer"), F.col("best.cosine").alias("cosine"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_license_scan, op4_minhash_near_dedup, op5_warc_dictionary, op6_ring_sharding, op7_exact_dedup, op8_toxicity, op9_pii_pseudonyms, op10_decontamination, op11_hard_negatives, op12_secret_scan, op13_periodic_runs)}


#: A text in DuckDB with A-Z lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]+"


def _licence_sql() -> str:
    """Every template at every place of every text, tried one by one."""
    parts = []
    for t in license_scan.all_templates():
        (o, head), n = t.phrases[0], len(t.words)
        listed = ", ".join(f"'{w}'" for w in t.words)
        stands = lambda at, x: f"w[{at} + 1 : {at} + {len(x)}] = [{', '.join(repr(y) for y in x)}]"
        behind = "".join(f" and len(list_filter(range(p, p + {2 * n + 1}), lambda q: {stands('q', x)})) > 0" for _, x in t.phrases[1:])
        places = f"list_filter(range(0, len(w)), lambda p: {stands('p', head)}{behind})"
        cover = f"{license_scan.BASE_SCORE}::double" if t.base else f"len(list_filter(range(0, {n}), lambda j: p - {o} + j >= 0 and coalesce(w[p - {o} + j + 1] = [{listed}][j + 1], false))) / {n}.0::double"
        parts.append(f"select row, '{t.label}' as label, {str(t.base).lower()} as base, p as place, {cover} as cover from (select row, w, unnest({places}) as p from d where list_has_all(w, [{', '.join(repr(y) for _, x in t.phrases for y in x)}]))")
    word = license_scan.WORD
    return f"""
        with d as (select row_number() over () as row, doc_id, regexp_extract_all({_LOWER}, '{word}') as w from documents),
             h as ({" union all ".join(parts)}),
             g as (select row, count(*) filter (where base) as n_base, min(place) filter (where base) as first_word, max(place) filter (where base) as last_word,
                          coalesce(string_agg(distinct label, ',' order by label) filter (where base), '') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(cover) as score from h group by row)
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
        from d left join g using (row)"""


_NEAR_SQL = f"""
    with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '{_SPACE.replace('[', '[^')}') as w from documents),
         s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
                                                   when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
         n as (select doc_id, count(*) as n from s group by doc_id),
         c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
         l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
         r as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from r join l on l.a = r.other),
         m as (select doc_id, min(other) as component_id from r group by doc_id)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
    from d join m using (doc_id) left join n using (doc_id)"""


def _secrets_sql() -> str:
    """Places as sums of the lengths of the matches and of what stands between them."""
    parts = []
    for k, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        long = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
        parts.append(f"""
            select row, '{r.kind}' as kind, {k} as rank, {str(r.base).lower()} as base, {long("m[1 : i - 1]")} + {long("p[1 : i]")} as s, s + length(m[i]) as e
            from (select row, m, g, p, unnest(range(1, len(m) + 1)) as i from (
                select row, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {r.group}) as g, string_split_regex(t, '{pattern}') as p from d))
            where length(g[i]) >= {r.least}""")
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.RULES if r.base)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in secret_scan.RULES if r.base)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' order by s, rank)"
    return f"""
        with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
             h as ({" union all ".join(parts)}),
             g as (select row, {counts}, {listed} filter (where base) as b, {listed} as spans from h group by row)
        select doc_id, {zeros}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (row)"""


_NEGATIVES_SQL = """
    with r as (select vec_id as id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
               from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
         s as (select a.id as a, b.id as b, a.label = b.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score from r a join r b on a.id <> b.id where a.id % 100 = 0),
         p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
         n as (select p.a, p.b, p.score as ps, s.b as c, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
               from p join s on s.a = p.a where not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score qualify rank <= 10)
    select a as anchor_id, b as positive_id, rank::int as rank, c as negative_id, ps as positive_score, ns as negative_score from n"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express in full."""
    return {
        "op3_license_scan": _licence_sql(),
        "op4_minhash_near_dedup": _NEAR_SQL,
        "op11_hard_negatives": _NEGATIVES_SQL,
        "op12_secret_scan": _secrets_sql(),
        "op7_exact_dedup": f"""
            with t as (select doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') as n from documents)
            select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
                   doc_id = min(doc_id) over w as kept, sha256(n) as text_sha256
            from t window w as (partition by n)""",
        "op5_warc_dictionary": """
            with p as (select page_id, coalesce(html, '') as h from pages),
                 g as (select h, max(page_id) as top, count(*) as n from p where octet_length(encode(h)) >= 1000 group by h)
            select p.page_id, octet_length(encode(p.h))::bigint as payload_bytes, sha1(p.h) as payload_digest,
                   case when g.n > 1 and p.page_id <> g.top then 'revisit' else 'response' end as record_type,
                   case when g.n > 1 and p.page_id <> g.top then g.top end as refers_to
            from p left join g on p.h = g.h""",
    }

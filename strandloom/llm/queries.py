"""One query for each operator over its whole table, and the pipeline; SQL for those that SQL can express.

Nulls, empty and long texts, ties, repeated rows, empty tables and further columns are the operators' matter: each says in
its docstring what it makes of them, and a query only names columns. Every row of the table gives its row (op1: its
pieces), rows that repeat an id give one each."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, embed_classifier, linededup, merkle, packing, pagetext, quality_rules, sharding, simhash, topk, toxicity, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.voted_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_main_text, op3_simhash, op4_quality_rules, op5_quality_classifier, op6_warc, op7_toxicity, op8_line_dedup, op9_sharding, op10_decontamination,
        op11_merkle_manifest, op12_exact_topk, op13_source_divergence,
    )
} | {"pipeline": corpus_pipeline.run}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _manifest_sql(leaf_levels: int = 14, source_levels: int = 8) -> str:
    """The levels of both trees one after another (3^14 rows a source, 3^8 sources), then each leaf folded through them."""
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    crc = """case when doc_id is null then 0 else xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end))) end"""
    steps = [
        f"d as (select doc_id, dense_rank() over (order by source nulls first) - 1 as tree, {leaf('text')} as leaf, {leaf('now')} as now from (select *, case when {crc} % 2 = 0 then replace(text, chr(10), '') else text end as now from documents))",
        "t0 as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n, leaf as h from d)",
        "p0 as (select doc_id, leaf, tree, i, now as f, '' as proof from t0)",
    ]

    def level(t: str, p: str, k: int, up: str) -> None:
        steps.append(f"{t}{k + 1} as materialized (select tree, i // 3 as i, max((n + 2) // 3) as n, case when max(n) = 1 then max(h) else sha256(string_agg(h, '' order by i)) end as h from {t}{k} group by tree, i // 3)")
        near = lambda f, j: f"coalesce({f}(h, {j}) over run, '')"
        steps.append(f"{t}s{k} as materialized (select tree, i, n, {near('lag', 2)} || {near('lag', 1)} as l, {near('lead', 1)} || {near('lead', 2)} as r from {t}{k} window run as (partition by tree, i // 3 order by i))")
        steps.append(f"{p}{k + 1} as (select doc_id, leaf, {up}p.tree, p.i // 3 as i, case when n = 1 then f else sha256(l || f || r) end as f, proof || l || r as proof from {p}{k} p join {t}s{k} s on p.tree = s.tree and p.i = s.i)")

    for k in range(leaf_levels):
        level("t", "p", k, "")
    steps.append(f"u0 as materialized (select 0 as tree, tree as i, count(*) over () as n, h from t{leaf_levels})")
    steps.append(f"q0 as (select p.doc_id, p.leaf, t.h as subroot, 0 as tree, p.tree as i, p.f, p.proof from p{leaf_levels} p join t{leaf_levels} t on p.tree = t.tree)")
    for k in range(source_levels):
        level("u", "q", k, "subroot, ")
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, u.h as root, sha256(proof) as proof_sha256, f as folded_root, f = u.h as verified from q{source_levels} q join u{source_levels} u on q.i = u.i"


ORACLE: dict[str, str] = {
    "op11_merkle_manifest": _manifest_sql(),
    "op6_warc": """
        with p as (
            select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as h from pages
        ), f as (select h, min(page_id) as first_page from p group by h)
        select p.page_id, octet_length(payload) as payload_bytes,
            array_to_string(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
            case when p.page_id = first_page then 'response' else 'revisit' end as record_type,
            case when p.page_id <> first_page then first_page end as refers_to
        from p join f using (h)
    """,
    "op8_line_dedup": f"""
        with l as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents
        ), k as (
            select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l
        ), r as (
            select key, min(doc_id) as first_id from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2
        ), j as (
            select k.*, r.first_id is not null and r.first_id <> k.doc_id as lost from k left join r using (key)
        )
        select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not lost), '')) as kept_sha256
        from j group by doc_id
    """,
    "op10_decontamination": f"""
        with dw as (
            select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
        ), bw as (
            select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
        ), win as (
            select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + 9], ' ') as words
            from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bw where len(w) > 0)
        ), sizes as (select distinct size from win), dp as (
            select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as words
            from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)
        ), hit as (select doc_id, item_id, dp.size, i from dp join win using (size, words)),
        pos as (select doc_id, count(distinct i + k) as n_hit from (select doc_id, i, unnest(range(0, size)) as k from (select distinct doc_id, i, size from hit)) group by doc_id),
        its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join pos using (doc_id) left join its using (doc_id)
    """,
    "op12_exact_topk": """
        with v as (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.r, q.vec_id as query_id, p.vec_id, list_dot_product(q.v, p.v)::bigint as score from v q join v p on q.r <> p.r where q.vec_id % 20 = 0
        )
        select query_id, (row_number() over (partition by r order by score desc, vec_id))::int as rank, vec_id, score from s
        qualify row_number() over (partition by r order by score desc, vec_id) <= 20
    """,
    "op13_source_divergence": f"""
        with d as (
            select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents
        ), g as (select distinct lang, source from d),
        c as (select lang, source, term, count(*) as n, count(distinct id) as df from (select id, lang, source, unnest(w) as term from d) group by all),
        t as (select lang, term, sum(n) as n from c group by lang, term having sum(df) >= 30),
        v as (select lang, count(*) as v, sum(n) as total from t group by lang),
        gt as (select c.lang, c.source, sum(c.n) as total from c join t using (lang, term) group by all),
        p as materialized (
            select g.lang, g.source, t.term, coalesce(c.n, 0) as n,
                1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(gt.total, 0) + 5 * v.v) as p,
                1 + (1000000000::hugeint * (t.n + 5)) // (v.total + 5 * v.v) as q
            from g join t using (lang) join v using (lang) left join gt on gt.lang = g.lang and gt.source = g.source
            left join c on c.lang = g.lang and c.source = g.source and c.term = t.term
        ), f as (
            select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ), pairs as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
            from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
        ), terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
        r as (
            select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from (from pairs union all from terms)
        )
        select * from r where part = 'pair' or rank <= 50
    """,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

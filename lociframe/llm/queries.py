"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .merkle import manifest_sql
from .shared import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlgraph import judge

    return judge(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import labels

    return labels(table(spark, sf_dir, "documents"))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .telephony import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import tamper_check

    return tamper_check(table(spark, sf_dir, "documents"))


def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import fresh_path
    from .warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_secrets": op2_secrets,
    "op3_url_filters": op3_url_filters,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_telephony": op7_telephony,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc_bundles": op12_warc_bundles,
    "op13_embedding_whitening": op13_embedding_whitening,
}


def _secrets_sql() -> str:
    """Pieces between matches and the matches give each match its place, as in the operator."""
    from .secrets import BASE_RULES, RULES

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = " union all ".join(f"select doc_id, {quote(r.kind)} as kind, {i} as rank, {r.least} as least, string_split_regex(x, {quote(r.pattern)}) as gaps, regexp_extract_all(x, {quote(r.pattern)}, 0) as found, regexp_extract_all(x, {quote(r.pattern)}, {r.part}) as part from t" for i, r in enumerate(RULES))
    base = ", ".join(quote(r.kind) for r in BASE_RULES)
    text = "string_agg(kind || ':' || cast(start as varchar) || ':' || cast(start + size as varchar), ',' order by start, rank)"
    counts = ", ".join(f"count(kind) filter (where kind = {quote(r.kind)}) as n_{r.kind}" for r in BASE_RULES)
    return (
        f"with t as (select doc_id, coalesce(text, '') as x from documents), m as ({parts}), u as (select *, unnest(range(1, len(found) + 1)) as i from m where len(found) > 0),"
        " s as (select doc_id, kind, rank, cast(list_sum(list_transform(gaps[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda y: length(y))), 0) as bigint) as start, length(found[i]) as size from u where length(part[i]) >= least)"
        f" select t.doc_id, {counts}, sha256(coalesce({text} filter (where kind in ({base})), '')) as base_sha256, coalesce({text}, '') as spans from t left join s on t.doc_id = s.doc_id group by t.doc_id"
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles_sql(name: str, source: str, key: str) -> str:
    """Two tables: {name}_s of distinct (key, shingle), and {name}_n of (key, n)."""
    return (
        f"{name}_w as (select {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from {source}),"
        f" {name}_s as (select distinct {key}, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from {name}_w),"
        f" {name}_n as (select {key}, count(*) as n from {name}_s group by {key})"
    )


_JACCARD_SQL = (
    "with recursive "
    + _shingles_sql("d", "documents", "doc_id")
    + """, p as (select x.doc_id as a, y.doc_id as b, count(*) as c from d_s x join d_s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
 l as (select a, b from p join d_n x on x.doc_id = a join d_n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)), e as (select a, b from l union all select b, a from l),
 r as (select a as doc_id, b as reach from e union select r.doc_id, e.b from r join e on r.reach = e.a), k as (select doc_id, min(reach) as low from r group by doc_id),
 f as (select doc_id, md5(string_agg(s, '|' order by s)) as f from d_s group by doc_id), g as (select doc_id, min(doc_id) over (partition by f) as class_id from f)
 select t.doc_id, coalesce(n, 0) as n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) as component_id, coalesce(class_id, t.doc_id) as class_id from documents t left join d_n on t.doc_id = d_n.doc_id left join k on t.doc_id = k.doc_id left join g on t.doc_id = g.doc_id"""
)

_CONTAINMENT_SQL = (
    "with "
    + _shingles_sql("d", "documents", "doc_id")
    + ", "
    + _shingles_sql("i", "benchmark", "item_id")
    + ", p as (select doc_id, item_id, count(*) as n_shared from d_s join i_s on d_s.s = i_s.s group by 1, 2) select doc_id, p.item_id, n as n_item, n_shared, n_shared * 1e0 / n as containment from p join i_n on p.item_id = i_n.item_id where 100 * n_shared >= 80 * n"
)

_ARCHIVE_SQL = (
    "with p as (select page_id, encode(coalesce(html, '')) as x from pages), q as (select page_id, octet_length(x) as k, sha256(x) as d from p), f as (select *, case when k >= 100 then min(page_id) over (partition by d) end as first from q)"
    " select page_id, cast(k as bigint) as payload_bytes, d as payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to, 'urn:x-record:' || page_id || ':' || d[1:32] as record_id from f"
)

#: The others rank, train, tokenise or encode; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op1_ngram_join": _JACCARD_SQL, "op2_secrets": _secrets_sql(), "op10_decontamination": _CONTAINMENT_SQL, "op11_merkle_manifest": manifest_sql(), "op12_warc_bundles": _ARCHIVE_SQL}

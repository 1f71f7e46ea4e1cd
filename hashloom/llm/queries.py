"""The registered query of each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm import alignment, html, lm, media, mixing, passages, pieces, quality, secrets, simhash, substrings, toxicity, vectors

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
# Weights of the mixture's tree.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "*": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1, "*": 1}, "source": {"*": 1}}


def domain():
    """Domain of a row: its source's number modulo 4; sources without a number form their own."""
    return F.coalesce(F.concat(F.lit("d"), F.expr("cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as string)")), F.lit("other"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", (F.octet_length("spans") / 16).cast("long").alias("n_spans"), "kept_sha256")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domain(), WEIGHTS)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), MODEL)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store_texts(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectors.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vectors.digest(books)).alias("codebooks_sha256"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_MODEL, MODEL)[0]


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_secret_scans, op3_suffix_array_dedup, op4_simhash_near_dedup, op5_html_extraction, op6_mixing, op7_sentencepiece, op8_media_columns, op9_toxicity, op10_lm_scoring,
             op11_vector_code_compression, op12_cross_tokenizer_alignment, op13_quality_classifier)
    return {f.__name__: f for f in found}


def _weight_sql(level: str) -> str:
    named = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS[level].items() if k != "*")
    return f"case {level} {named} else {WEIGHTS[level].get('*', 1)} end" if named else str(WEIGHTS[level].get("*", 1))


def _share_sql(children: str, parents: str, name: str) -> str:
    """Children (parents, name, cap, w, budget) with ``got``: the budget dealt by weight, full ones first."""
    by = f"partition by {parents} order by cap / w, {name} rows between"
    return f"""(select *, case when is_full then cap else least((rest * upto) // open_sum - (rest * (upto - open)) // open_sum, cap) end as got
      from (select *, sum(open) over (partition by {parents})::bigint as open_sum, sum(open) over ({by} unbounded preceding and current row)::bigint as upto
      from (select *, budget - sum(case when is_full then cap else 0 end) over (partition by {parents})::bigint as rest, case when is_full then 0 else w end as open
      from (select *, cap / w * (sum(w) over ({by} current row and unbounded following))::bigint
              <= budget - coalesce(sum(cap) over ({by} unbounded preceding and 1 preceding), 0)::bigint as is_full from {children} where cap > 0))))"""


MIXING_SQL = rf"""with d as (
    select doc_id, lang, source, coalesce('d' || cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as varchar), 'other') as domain,
      cast(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as bigint) as n_tokens from documents),
  leaves as (select domain, lang, source, sum(n_tokens)::bigint as available, 2 * sum(n_tokens)::bigint as cap from d group by all),
  one as (select 0 as root, domain, sum(cap)::bigint as cap, {_weight_sql('domain')} as w, (select sum(available)::bigint * 70 // 100 from leaves) as budget from leaves group by domain),
  got1 as (select domain, got as budget from {_share_sql('one', 'root', 'domain')}),
  two as (select domain, lang, sum(cap)::bigint as cap, {_weight_sql('lang')} as w, any_value(budget) as budget from leaves join got1 using (domain) group by domain, lang),
  got2 as (select domain, lang, got as budget from {_share_sql('two', 'domain', 'lang')}),
  three as (select domain, lang, source, cap, {_weight_sql('source')} as w, budget from leaves join got2 using (domain, lang)),
  got3 as (select domain, lang, source, got as target from {_share_sql('three', 'domain, lang', 'source')}),
  plan as (select l.*, coalesce(target, 0) as target, case when available > 0 then coalesce(target, 0) // available else 0 end as epochs,
             case when available > 0 then coalesce(target, 0) % available else 0 end as rest from leaves l left join got3 using (domain, lang, source)),
  placed as (select d.*, p.epochs, p.rest, coalesce(sum(n_tokens) over (partition by d.domain, d.lang, d.source
               order by md5('7:' || cast(p.epochs as varchar) || ':' || cast(doc_id as varchar)), doc_id rows between unbounded preceding and 1 preceding), 0) as before
             from d join plan p on d.domain = p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source)
  select doc_id, domain, lang, source, n_tokens, cast(epochs + case when before < rest then 1 else 0 end as bigint) as copies from placed"""


def _codes_sql() -> str:
    """Product codes in DuckDB: assignments and updates of codebooks as tables, one after the other."""
    parts, entries, rounds = vectors.PARTS, vectors.ENTRIES, vectors.ROUNDS

    def assigned(books: str, name: str) -> str:
        return f"""{name} as (select rid, part, min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': entry}}) as best,
    any_value(p.v) as v from p join {books} b using (part) group by rid, part)"""

    steps = ["""k as (select row_number() over (order by vec_id, embedding) as rid, vec_id, label, embedding from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
             f"""p as (select rid, part, list_transform(embedding[part * len(embedding) // {parts} + 1 : (part + 1) * len(embedding) // {parts}],
    lambda x: floor({vectors.SCALE} * x::double)::bigint) as v from k, range({parts}) r(part))""",
             f"b0 as (select part, rid - 1 as entry, v from p where rid <= {entries})"]
    for i in range(rounds):
        steps += [assigned(f"b{i}", f"a{i}"),
                  f"""s{i} as (select part, entry, list(m order by pos) as v from (select part, best.e as entry, pos,
      ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m
    from (select part, best, unnest(v) as x, generate_subscripts(v, 1) as pos from a{i}) group by all) group by part, entry)""",
                  f"b{i + 1} as (select part, entry, coalesce(s.v, b.v) as v from b{i} b left join s{i} s using (part, entry))"]
    steps += [assigned(f"b{rounds}", "final"),
              "coded as (select rid, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from final group by rid)",
              f"""told as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as sha
    from (select part, entry, unnest(v) as x, generate_subscripts(v, 1) as pos from b{rounds}))"""]
    return "with " + ",\n  ".join(steps) + """
  select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, sha as codebooks_sha256 from k join coded using (rid), told"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": MIXING_SQL, "op11_vector_code_compression": _codes_sql()}

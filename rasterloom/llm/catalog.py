"""The queries of this subpackage over the test tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import (
    bestposition, decontaminate, imatch, langnet, licenses, linespread, mixing, neardup, packing, sortedlists, warc, whiten, wordpiece,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The closing id of a document, and the tokenizer file, of the token query.
END_ID, TOKENIZER, VOCABULARY = 2, "word_bpe_49k.json", 49_408
#: The file whose pieces the word-piece counts use.
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


MIX_SQL = r"""
with d as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as h,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight from s),
c as (select *, 3 * source_size as cap, sum(source_size) over () as total,
        sum(3 * source_size) over w as caps, coalesce(sum(weight) over (order by 3 * source_size / weight, source is null, source
          rows between 1 following and unbounded following), 0) as rest
      from r window w as (order by 3 * source_size / weight, source is null, source)),
f as (select *, caps * weight + cap * rest <= total * weight as full_up from c),
l as (select (max(total) - coalesce(sum(case when full_up then cap end), 0))::double
             / sum(case when not full_up then weight end)::double as rate from f),
t as (select source, source_size::bigint as source_size, weight,
        case when full_up then cap::double else rate * weight end as target from f, l),
o as (select d.doc_id, d.size, t.source_size, t.target, t.weight, cast(round(t.target) as bigint) as budget,
        coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id
          rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source),
k as (select o.*, p, greatest(0, least(budget - (before + p * source_size), size)) as words,
        case when budget > 0 then (before + p * source_size)::double / budget end as share
      from o, (select unnest([0, 1, 2]) as p)),
q as (select *, case when weight = 1 and share < 0.625 then 0.0e0 when weight = 3 and share < 0.375 then 0.0e0
                     when weight = 2 then 0.0e0 else 0.5e0 end as t0 from k),
z as (select *, case when weight = 2 then 0.0e0 when weight = 1 then -1.0e0 else 1.0e0 end as slope,
        case when weight = 2 then 1.0e0 when t0 > 0 then 1.0e0 when weight = 1 then 1.5e0 else 0.5e0 end as w,
        share - (case when t0 > 0 then (case when weight = 1 then 0.625e0 else 0.375e0 end) else 0.0e0 end) as missing from q),
y as (select *, least(1.0e0, t0 + missing * 2.0e0 / (w + sqrt(greatest(w * w + missing * slope * 2.0e0, 0.0e0)))) as due_at from z)
select doc_id, max(size) as size, max(source_size) as source_size, max(target) as target,
  cast(sum(words) as bigint) as taken, cast(count(*) filter (where words > 0) as bigint) as n_copies,
  round(min(case when words > 0 then due_at end), 9) + 0.0e0 as first_due
from y group by doc_id
"""


@query("op1_curriculum_mix", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.size("copies").cast("bigint").alias("n_copies"), (F.round("due", 9) + F.lit(0.0)).alias("first_due"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_packed_tokens")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = packing.library_encoder(tokenizer_path(), END_ID)
    folder, manifest = packing.write_tokens(documents(spark, sf_dir), encode, VOCABULARY)
    return packing.read_tokens(spark, folder, manifest).withColumnRenamed("id", "doc_id")


@query("op3_license_automaton")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir), "text", ["doc_id"])
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


@query("op4_minhash_neardup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op5_wordpiece_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece.Pieces(*wordpiece.piece_sets(tokenizer_path(PIECES)))
    return wordpiece.count_pieces(documents(spark, sf_dir), spark.sparkContext.broadcast(pieces), "text", ["doc_id"])


@query("op6_imatch")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op7_warc_derivatives")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_records(spark, folder, manifest)


@query("op8_benchmark_windows")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.scan(documents(spark, sf_dir), items, "text", ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


LINES_SQL = r"""
with l as (select doc_id, source, text, unnest(string_split(text, chr(10))) as raw,
             unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null),
t as (select *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from l),
g as (select line from t where line <> '' group by line having count(distinct source) >= 5)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines,
  coalesce(c.n_removed, 0)::bigint as n_removed,
  case when d.text is null then null else md5(coalesce(c.kept, '')) end as text_md5
from documents d left join (
  select doc_id, count(*) filter (where g.line is not null) as n_removed,
    string_agg(raw, chr(10) order by pos) filter (where g.line is null) as kept
  from t left join g on t.line = g.line group by doc_id) c on d.doc_id = c.doc_id
"""


@query("op9_site_spread_lines", LINES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linespread.drop_spread_lines(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op10_byte_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = langnet.fit(docs.filter(~langnet.held_out()))
    return langnet.predict(docs, net, "text", ["doc_id"]).select(
        "doc_id", langnet.held_out().alias("held_out"), "lang_pred", "score")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(embeddings(spark, sf_dir)).select(
        F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened", "explained", "identity_error")


SEARCH_SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
d as (select doc_id, count(*) as n from t group by doc_id),
g as (select count(*) as n_docs, cast(sum(n) as bigint) as total from d),
f as (select doc_id, term, count(*) as tf from t group by doc_id, term),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight
      from f, g group by term, n_docs),
q as (select item_id, term, count(*) as times from (
        select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by item_id, term),
s as (select q.item_id, f.doc_id, cast(sum(q.times * w.weight * ((1000000000 * f.tf)
               // (1000 * f.tf + 8 * (100 - 75 + ((75 * d.n * g.n_docs) // g.total))))) as bigint) as score
      from q join f on q.term = f.term join w on q.term = w.term join d on f.doc_id = d.doc_id, g group by q.item_id, f.doc_id),
r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


@query("op12_best_position", SEARCH_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return bestposition.search(documents(spark, sf_dir), items).withColumnRenamed("id", "doc_id")


PRODUCTS_SQL = """
with e as (select vec_id, [floor(256 * c::double) for c in embedding]::double[] as x from embeddings
           where embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score
      from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query("op13_sorted_lists", PRODUCTS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortedlists.top_products(embeddings(spark, sf_dir)).withColumnRenamed("id", "vec_id")

"""The registered queries of the corpus operators; each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(mod: int, at: int):
    """crc32(doc_id as text) mod ``mod`` is ``at``; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == at, F.lit(False))


def op1_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import repeats

    return repeats.digests(_table(spark, sf_dir, "documents"))


def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import lm

    docs = _table(spark, sf_dir, "documents")
    scored = lm.score(docs, *lm.fit(docs, ~held_out(7, 2)))
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), train=~held_out(5, 0))
    return toxicity.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import covertree

    vectors = _table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import vectors

    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import htmltext

    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import bytebpe

    return bytebpe.digests(_table(spark, sf_dir, "documents"))


def op8_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import oddsketch

    return oddsketch.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duochron.llm import rans

    return rans.round_trip(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_run_index, op2_log_bilinear, op3_toxicity, op4_cover_tree, op5_collisions, op6_main_text, op7_byte_bpe, op8_odd_sketch, op9_best_fit, op10_rans)}


#: Components of a link table l(a, b) with both directions, for nodes n(id).
_COMPONENTS = """, r as (select id, id as reach from n union select r.id, l.b from r join l on l.a = r.reach),
 c as (select id, min(reach) as component_id from r group by id)"""

_OP4 = """with v as (select vec_id, [floor(64 * cast(x as double)) for x in embedding] as e from embeddings where embedding is not null),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
 k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from k where rank <= 20"""

_OP5 = f"""with recursive n as (select vec_id as id, cast(embedding as double[]) as e from embeddings),
 l as (select x.id as a, y.id as b from n x join n y on x.id <> y.id and list_cosine_similarity(x.e, y.e) >= 0.95){_COMPONENTS}
select n.id as vec_id, (select count(*) from l where l.a = n.id) as n_links, c.component_id, n.id = c.component_id as kept from n join c on c.id = n.id"""

_OP8 = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
 s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] end) as g from w),
 n as (select w.doc_id as id, (select count(*) from s where s.doc_id = w.doc_id) as n from w),
 i as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
 p as (select a, b from i join n x on x.id = a join n y on y.id = b where 100 * k >= 80 * (x.n + y.n - k)),
 l as (select a, b from p union all select b, a from p){_COMPONENTS}
select n.id as doc_id, n.n as n_shingles, c.component_id, n.id = c.component_id as kept from n join c on c.id = n.id"""


def oracle_sql() -> dict[str, str]:
    """The others train models, tokenise, or compare every place of all texts, which tests check by brute force and round trips."""
    return {"op4_cover_tree": _OP4, "op5_collisions": _OP5, "op8_odd_sketch": _OP8}
